import datetime as dt
import math

import numpy as np
import pyarrow as pa
import pytest

from notegrain.llm import linkage, neighbours, overlap, vectors

D = 88
T = dt.datetime(2024, 1, 1)
SCHEMA = "md5 string, vec array<float>, built_at timestamp_ntz, sig_version int, extra string"
SMALL = {"small": 4, "rates": (1 / 4, 1 / 2), "coarse": 12, "block": 16, "last_block": 16}
"""Sizes at which a few hundred rows pass through every level, large shards and block pairs."""


def name(i):
    return f"{i:032x}"


def cloud(seed=0, centres=12, each=30, loose=40, noise=0.35):
    """Clusters of very unequal size, near copies, and loose vectors; three decimals."""
    r = np.random.default_rng(seed)
    out = []
    for c in range(centres):
        m = r.normal(size=D) / 3
        for _ in range(max(2, each * (centres - c) // centres)):
            v = m + r.normal(size=D) * noise / 3
            out.append(v)
            if r.random() < 0.3:
                out.append(v + r.normal(size=D) * 0.02)
    out += list(r.normal(size=(loose, D)) / 3)
    return np.round(np.array(out), 3).astype("f4")


def frame(spark, x, names=None):
    names = names or [name(i) for i in range(len(x))]
    return spark.createDataFrame([(k, [float(f) for f in v], T, 1, "e") for k, v in zip(names, x)], SCHEMA)


def cosines(x):
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1)[:, None]
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    return s


def best_pairs(x, k=5, least=0.95):
    s, out = cosines(x), set()
    for i in range(len(x)):
        for j in sorted(np.flatnonzero(s[i] >= least), key=lambda j: (-s[i, j], j))[:k]:
            out.add((name(min(i, j)), name(max(i, j))))
    return out


def chains(x, least=0.78, smallest=3):
    s, label = cosines(x), np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(s >= least, label[None, :], len(x)).min(1))
        if (new == label).all():
            break
        label = new
    return {(name(i), name(c)) for c in np.unique(label) for i in np.flatnonzero(label == c) if (label == c).sum() >= smallest}


def test_packing_is_exact():
    r = np.random.default_rng(1)
    x = np.concatenate([np.round(r.normal(size=(50, D)), 3), r.normal(size=(20, D)), np.full((1, D), 40000.0), np.full((1, D), 1e-30)]).astype("f4")[r.permutation(72)]
    packed = vectors.pack(x)
    assert (vectors.unpack(packed) == x).all() and min(len(v.as_py()) for v in packed) == 2 * D
    assert (vectors.unpack(packed[10:30]) == x[10:30]).all() and vectors.unpack(pa.array([], pa.binary())).shape == (0, D)


def test_names_come_back_and_sort_the_same(spark):
    names = ["0" * 32, "f" * 32, "abc", "", "x" * 15, "y" * 16, "z" * 14, "é" * 8, "A" * 32]
    rows = spark.createDataFrame([(n,) for n in names], "n string").withColumn("k", vectors.key_of(vectors.F.col("n")))
    got = rows.select("n", "k", vectors.name_of(vectors.F.col("k")).alias("b")).collect()
    assert all(r.n == r.b for r in got) and len({bytes(r.k) for r in got}) == len(names)


def test_latest_usable_vector(spark):
    good, old = [0.5] * D, [0.25] * D
    rows = [(name(1), old, T, 1, ""), (name(1), good, T + dt.timedelta(1), 2, ""), (name(1), [0.0] * D, T + dt.timedelta(2), 2, ""), (name(2), None, T, 1, ""), (name(3), [1.0] * 87, T, 1, ""), (name(4), [math.nan] + [1.0] * 87, T, 1, ""), (name(5), [math.inf] * D, T, 1, ""), (None, good, T, 1, ""), (name(6), [None] + [1.0] * 87, T, 1, ""), (name(7), old, None, 1, ""), (name(7), good, T, 1, ""), (name(1), good, T + dt.timedelta(1), 2, "")]
    got = vectors.latest_vectors(spark.createDataFrame(rows, SCHEMA)).withColumn("n", vectors.name_of(vectors.F.col("md5"))).collect()
    assert {r.n: float(vectors.unpack(pa.array([bytes(r.v)], pa.binary()))[0, 0]) for r in got} == {name(1): 0.5, name(7): 0.5}


@pytest.mark.parametrize("seed", [0, 1])
def test_nearest_equals_brute_force(spark, seed):
    x = cloud(seed)
    got = [tuple(r) for r in neighbours.similar_pairs(frame(spark, x), **SMALL, factor=1.0).collect()]
    assert len(got) == len(set(got)) and set(got) == best_pairs(x)
    relaxed = {tuple(r) for r in neighbours.similar_pairs(frame(spark, x), **SMALL).collect()}
    assert len(relaxed & best_pairs(x)) >= 0.98 * len(best_pairs(x))


def test_many_copies_of_one_vector(spark):
    x = np.concatenate([cloud(2, centres=4, each=12, loose=5), np.repeat(cloud(3, centres=1, each=2, loose=1)[:1], 40, 0)])
    assert {tuple(r) for r in neighbours.similar_pairs(frame(spark, x), **SMALL, factor=1.0).collect()} == best_pairs(x)
    assert {tuple(r) for r in linkage.groups(frame(spark, x), **SMALL, factor=1.0).collect()} == chains(x)


def test_a_single_hot_shard_is_cut_into_blocks(spark):
    r = np.random.default_rng(9)
    x = np.round(r.normal(size=D) + r.normal(size=(120, D)) * 0.25, 3).astype("f4")
    assert {tuple(p) for p in neighbours.similar_pairs(frame(spark, x), **SMALL, factor=1.0).collect()} == best_pairs(x)
    assert {tuple(p) for p in linkage.groups(frame(spark, x), **SMALL, factor=1.0).collect()} == chains(x)


def test_empty_and_tiny(spark):
    for rows in ([], [(name(1), [1.0] * D, T, 1, "")]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert neighbours.similar_pairs(df).count() == 0 and linkage.groups(df).count() == 0 and linkage.clusters(df).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_groups_are_the_chains(spark, seed):
    x = cloud(seed, noise=0.5)
    assert {tuple(r) for r in linkage.groups(frame(spark, x), **SMALL, factor=1.0).collect()} == chains(x)


def naive_average(s, least):
    groups = {i: [i] for i in range(len(s))}
    w = np.where(s >= least, s, 0)
    while True:
        best = max(((np.round(w[np.ix_(a, b)].mean(), 6), -i, -j) for i, a in groups.items() for j, b in groups.items() if i < j), default=(0, 0, 0))
        if best[0] < least:
            return {tuple(g) for g in groups.values()}
        i, j = -best[1], -best[2]
        groups[i] = sorted(groups[i] + groups.pop(j))


def test_parallel_average_linkage_equals_the_sequential_one():
    x = cloud(6, centres=4, each=10, loose=6, noise=0.45)
    s = cosines(x)
    label = linkage.average_rounds(s.astype("f4"), 0.78)
    assert {tuple(np.flatnonzero(label == c)) for c in np.unique(label)} == naive_average(s, 0.78)


def test_clusters_have_size_and_members(spark):
    x = cloud(7, centres=3, each=12, loose=4, noise=0.2)
    s = cosines(x)
    label = linkage.average_rounds(s.astype("f4"), 0.78)
    want = {name(np.flatnonzero(label == c)[0]): int((label == c).sum()) for c in np.unique(label) if (label == c).sum() > 1}
    got = linkage.clusters(frame(spark, x), **SMALL, factor=1.0).collect()
    assert {r.cluster_md5: r["size"] for r in got} == want
    assert all(len(r.reps.split(";")) == min(5, r["size"]) for r in got)


META = "md5 string, song_id string, split string, other string"


def test_cross_split_overlaps(spark):
    x = cloud(8, centres=5, each=14, loose=10)
    s, r = cosines(x), np.random.default_rng(8)
    x = np.concatenate([x, np.repeat(x[:1], 9, 0)])
    s = cosines(x)
    splits = [["train", " Train", "val", "TEST ", "validation", None, ""][r.integers(7)] for _ in x]
    songs = [None if r.random() < 0.5 else f"s{r.integers(12)}" for _ in x]
    rows = [(name(i), songs[i], splits[i], "") for i in range(len(x))] + [(name(3), songs[3], "train", ""), (name(3), songs[3], "val", ""), (None, "s1", "train", ""), (name(999), "s1", "val", "")]
    clean = lambda t: {"validation": "val", "": None}.get(t.strip().lower(), t.strip().lower()) if t else None
    have = {}
    for m, g, t, _ in rows:
        if m:
            have.setdefault(m, [set(), set()])[0].add(clean(t))
            have[m][1].add(g)
    want = set()
    for m, (t, g) in have.items():
        for e in t & {"val", "test"}:
            if "train" in t:
                want.add((m, e, "same_file"))
            if any(o != m and "train" in ot and (g - {None}) & og for o, (ot, og) in have.items()):
                want.add((m, e, "same_song"))
            i = int(m, 16)
            if i < len(x) and any("train" in have[name(j)][0] for j in np.flatnonzero(s[i] >= 0.99)):
                want.add((m, e, "near"))
    import functools

    near = overlap.near
    overlap.near = functools.partial(near, factor=1.0, **SMALL)
    try:
        got = [tuple(p) for p in overlap.cross_split(spark.createDataFrame(rows, META), frame(spark, x)).collect()]
    finally:
        overlap.near = near
    assert len(got) == len(set(got)) and set(got) == want
    assert overlap.cross_split(spark.createDataFrame([], META), frame(spark, x[:2])).count() == 0


def test_chunks_cover_the_record_and_survive_an_insertion():
    data = bytes(np.random.default_rng(2).integers(32, 127, 4000, dtype="u1"))
    a, b = overlap.cut(data), overlap.cut(data[:2000] + b"inserted" + data[2000:])
    assert a[-1] == 4000 and all(0 < y - x <= overlap.MOST for x, y in zip([0, *a], a))
    parts = lambda d, e: {d[x:y] for x, y in zip([0, *e], e)}
    assert len(parts(data, a) & parts(data[:2000] + b"inserted" + data[2000:], b)) >= len(a) - 4
    assert overlap.cut(b"") == [] and overlap.cut(b"short") == [5]


def test_chunk_overlap(spark):
    base = "".join(chr(33 + (i * 7919) % 90) for i in range(400))
    other = "".join(chr(33 + (i * i * 31 + 7) % 90) for i in range(400))
    rows = [("a", "train", base), ("b", "val", base), ("c", "test", base[:200] + other[:200]), ("d", "val", None), ("e", None, base), ("f", "test", ""), ("b", "val", base)]
    got = {(r.key, r.split): r.overlap for r in overlap.chunk_overlap(spark.createDataFrame(rows, "key string, split string, record string")).collect()}
    assert got[("b", "val")] == 1 and 0.2 < got[("c", "test")] < 0.6 and got[("d", "val")] == 0 and got[("f", "test")] == 0 and len(got) == 4
