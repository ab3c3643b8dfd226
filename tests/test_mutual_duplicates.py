"""Near-duplicates by mutual neighbours against plain Python."""

from collections import Counter

import numpy as np

from notegrain.operators.iterate import mutual_duplicates


def brute(x, least=0.985, k=12, most=50):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s, block = np.round(u @ u.T, 9), {}
    for i, v in enumerate(x):
        if (v[:12] > 0).sum() >= 5:
            block.setdefault(tuple(np.argsort(v[:12], kind="stable")[::-1][:4]), []).append(i)
    label = np.arange(len(x))
    for rows in block.values():
        near = {i: set(sorted((j for j in rows if j != i), key=lambda j: (-s[i, j], j))[: k - 1]) for i in rows}
        for i in rows:
            for j in near[i]:
                if s[i, j] >= least and i in near[j]:
                    a, b = sorted((label[i], label[j]))
                    label[label == b] = a
    n = Counter(label)
    return {i: int(g) if n[g] <= most else i for i, g in enumerate(label)}


def test_mutual_duplicates(spark):
    r = np.random.default_rng(5)
    x = [np.abs(c + r.normal(size=36) * 0.03) for c in np.abs(r.normal(size=(8, 36))) for _ in range(20)]
    few = np.r_[np.ones(3), np.zeros(9), np.ones(24)]
    x += [few, few]  # too few classes
    even = np.r_[np.full(12, 0.5), np.ones(24)]
    x += [even, even + np.r_[np.zeros(20), np.full(16, 0.01)]]  # equal classes
    base = np.abs(r.normal(size=36)) + np.r_[np.arange(12) * 3, np.zeros(24)]
    x += [base + np.r_[np.zeros(12), np.full(24, 0.002 * i)] for i in range(70)]  # a chain above the limit
    x = np.array(x)
    want = brute(x)
    sizes = Counter(want.values())
    assert max(sizes.values()) > 3 and sizes[163] == 0 and all(want[i] == i for i in (*range(160, 162), *range(164, 234)))
    assert max(Counter(brute(x, most=1000).values()).values()) > 50
    df = spark.createDataFrame([(i, [float(f) for f in v]) for i, v in enumerate(x)], "vec_id bigint, v array<double>")
    got = [tuple(t) for t in mutual_duplicates(df).collect()]
    assert len(got) == len(x) and dict(got) == want
    assert mutual_duplicates(df.limit(0)).count() == 0
