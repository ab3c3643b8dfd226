"""The last level of the search: cells in blocks, without a copy of a row for each pair of blocks."""

import numpy as np
import pytest

from notegrain.llm import linkage, overlap, vantage, vectors
from notegrain.llm.vantage import F, Plan
from test_vector_search import D, chains, cosines, name


def loose(n=1200, seed=21):
    """Loose vectors, every third with a partner at some angle from 2 to 45 degrees."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, D))
    z = r.normal(size=(n // 3, D))
    z -= x[: n // 3] * ((z * x[: n // 3]).sum(1) / (x[: n // 3] ** 2).sum(1))[:, None]
    a = np.radians(np.linspace(2, 45, n // 3))[:, None]
    z = x[: n // 3] * np.cos(a) + z / np.linalg.norm(z, axis=1)[:, None] * np.linalg.norm(x[: n // 3], axis=1)[:, None] * np.sin(a)
    return np.round(np.concatenate([x, z]) / 3, 3).astype("f4")[r.permutation(n + n // 3)]


LEAST = [0.95, 0.99, 0.78]


@pytest.mark.parametrize("least", LEAST)
@pytest.mark.parametrize("blocks", [1, 2])
def test_cells_lose_no_pair_and_leave_most_out(least, blocks):
    x = loose()
    u = vectors.unit(x)
    cell, side = (u @ u[::33].T).argmax(1), np.arange(len(u)) % blocks
    met = np.zeros((len(u), len(u)), int)
    for a, b, i, j, same in vantage.cell_strips(u, side, cell, Plan(least, 1.0).reach, 100, 8):
        assert (a == u[i]).all() and (b == u[j]).all() and same == (len(i) == len(j) and (i == j).all())
        met[np.ix_(i, j)] += 1
    met = met + met.T
    near = cosines(x) >= least
    if blocks == 2:
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(met, 0)
    assert near.sum() > 50 and (met[near] > 0).all() and met.max() <= 2
    assert (met > 0).sum() < {0.78: 1.0, 0.95: 0.6, 0.99: 0.3}[least] * len(u) ** 2


def test_every_row_is_in_one_block_and_every_pair_of_blocks_meets_once(spark):
    x = loose(150)
    rows = spark.createDataFrame([(bytes([i // 256, i % 256]), bytes(v.as_py()), i, False) for i, v in enumerate(vectors.pack(x))], "md5 binary, v binary, flag int, seen boolean")
    blocks = vantage._cell_blocks(rows, len(x), 16, 4)
    got = [r.md5 for r in blocks.select("block", F.explode("md5").alias("md5")).collect()]
    assert len(got) == len(set(got)) == len(x) and blocks.count() > 10

    def leaf(md5, x, side, flag, many, cell):
        return vantage.pa.RecordBatch.from_arrays([vantage.pa.array([sorted(flag.tolist())])], ["flags"])

    met = np.zeros((len(x), len(x)), int)
    for r in vantage._met(blocks, leaf, "flags array<bigint>").collect():
        met[np.ix_(r.flags, r.flags)] += 1
    own = len(blocks.collect())
    assert (met > 0).all() and (np.diag(met) == own).all()


@pytest.mark.parametrize("least", LEAST)
def test_sieve_loses_no_pair_and_lets_few_pass(least):
    x = loose()
    u, n = vectors.unit(x), len(x)
    near = cosines(x) >= least
    np.fill_diagonal(near, True)
    at, whole = vantage.Sieve(u, least).pairs(u, u, np.arange(n), np.arange(n))
    passed = np.zeros((n, n), bool)
    passed.reshape(-1)[at] = True
    assert whole is None and passed[near].all() and near.sum() > n + 50 and passed.sum() < near.sum() + 0.003 * n * n
    # in a cluster all pairs pass, and rows are multiplied whole
    v = vectors.unit(u[:1] + 0.01 * u)
    at, whole = vantage.Sieve(v, least).pairs(v, v, np.arange(n), np.arange(n))
    assert whole is not None and len(at) == n * n


def test_near_looks_at_evaluation_rows_against_training_rows_only(monkeypatch):
    x = loose()
    n, met = len(x), 0
    flag = np.where(np.arange(n) % 10 == 0, 2, 1)
    flag[5::40] = 3  # in both
    pairs = vantage.Sieve.pairs

    def counted(self, left, right, here, there):
        nonlocal met
        met += len(left) * len(right)
        return pairs(self, left, right, here, there)

    monkeypatch.setattr(vantage.Sieve, "pairs", counted)
    near, wants, train = cosines(x) >= 0.99, (flag & 14) > 0, (flag & 1) > 0
    for blocks in (1, 2):
        side = np.arange(n) % blocks
        ok = near & train[None, :] & (True if blocks == 1 else side[:, None] != side[None, :])
        want = set(np.flatnonzero(wants & ok.any(1)).tolist())
        got = overlap._reach(Plan(0.99, 1.0))(np.array([str(i).encode() for i in range(n)], object), x, side, flag, np.ones(n, bool), None)
        assert len(want) > 2 and {int(m) for m in got.column("md5").to_pylist()} == want
    assert met < 0.45 * n * n


def test_of_rows_drawn_together_only_the_mean_is_a_point():
    r = np.random.default_rng(3)
    groups = [r.normal(size=(1, D)) + 0.3 * r.normal(size=(k, D)) for k in (40, 2, 1, 1)]
    points, shard = vantage.centres(vectors.unit(np.concatenate(groups)))
    assert len(points) == len(shard) == 2 and shard.tolist() == [0, 40]
    assert all((vectors.unit(g) @ p >= vantage.HOME).all() for g, p in zip(groups, points))
    assert len(vantage.centres(vectors.unit(np.concatenate(groups)), 1)[0]) == 4
    # a chain too wide for one ball keeps its rows as points
    a = np.radians(np.arange(0, 180, 10))
    chain = np.stack([np.cos(a), np.sin(a)], 1).astype("f4")
    assert len(vantage.centres(chain)[0]) == len(chain)


def test_places_are_those_of_the_true_values():
    r = np.random.default_rng(4)
    for shape in ((0, 5), (1, 7), (3, 8), (31, 33)):
        mask = r.random(shape) < 0.1
        assert (vantage.places(mask) == np.flatnonzero(mask)).all()


def test_groups_of_loose_rows_need_few_whole_products(monkeypatch):
    x = loose()
    n, whole, front = len(x), 0, 0
    pairs = vantage.Sieve.pairs

    def counted(self, left, right, here, there):
        nonlocal whole, front
        got = pairs(self, left, right, here, there)
        whole, front = whole + (got[1] is not None), front + (got[1] is None)
        return got

    monkeypatch.setattr(vantage.Sieve, "pairs", counted)
    u = vectors.unit(x)
    label = linkage.task_labels(x, np.zeros(n, int), Plan(0.78, 1.0), (u @ u[::33].T).argmax(1) // 20)
    want = chains(x, 0.78, 1)
    assert {(name(i), name(c)) for i, c in enumerate(label)} == want and len({c for _, c in want}) < n - 200
    assert front > 2 and whole < front / 4
