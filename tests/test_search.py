"""Blocks against brute force; nulls, empty sides, ties and hot groups."""

import numpy as np
import pytest

from notegrain.functions import whole
from notegrain.operators import iterate, search
from notegrain.plans.ops import Binding, Op, bound
from notegrain.streaming import live

VECTORS = "vec_id bigint, label int, v array<double>, b int"


def unit(n, d=5, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, extra=()):
    return spark.createDataFrame([(i, i % 3, r.tolist(), 7) for i, r in enumerate(x)] + list(extra), VECTORS)


def test_nearest_in_blocks(spark):
    x = unit(40)
    x[5] = x[4]
    df = frame(spark, x, [(None, 1, [0.0] * 5, 1), (99, 1, None, 1)])
    s = np.round(x @ x.T, 9)
    got = {(r.q, r.rn): (r.b, r.label, r.sim) for r in search.nearest(df.filter("vec_id % 4 = 0"), df, 3, block=7).collect()}
    for q in range(0, 40, 4):
        best = sorted((-s[q, j], j) for j in range(40) if j != q)[:3]
        assert [got[q, k + 1] for k in range(3)] == [(j, j % 3, pytest.approx(-t)) for t, j in best]
    assert len(got) == 30 and search.nearest(df.limit(0), df, 3).count() == 0 == search.nearest(df, df.limit(0), 3).count()


def test_population_and_pairs_within_a_hot_group(spark):
    x = unit(30, seed=1)
    df, s = frame(spark, x), np.round(x @ x.T, 9)
    got = {r.q: (r.population, r.nearest_sim) for r in search.population(df, df, 0.2, block=8).collect()}
    assert got == {i: (int((s[i] >= 0.2).sum()), pytest.approx(1.0)) for i in range(30)}
    for by, block in (("label", 4), ("b", 6), ("b", 100)):
        pairs = {(r.a, r.b) for r in search.pairs_within(df, by, 0.3, block=block).collect()}
        assert pairs == {(i, j) for i in range(30) for j in range(i + 1, 30) if s[i, j] >= 0.3 and (by == "b" or i % 3 == j % 3)}


def test_kmeans_plane_and_trees_of_hard_tables(spark):
    x = unit(50, seed=2)
    df = frame(spark, x, [(None, 1, [0.0] * 5, 1), (99, 1, None, 1)])
    got = iterate.kmeans(df, 4).collect()
    assert {r.vec_id for r in got} == set(range(50)) and {r.cluster for r in got} <= set(range(4))
    assert iterate.kmeans(df.limit(0)).count() == 0 and iterate.plane(df.limit(0)).count() == 0
    p = {r.vec_id: (r.x, r.y) for r in iterate.plane(df).collect()}
    c = x - x.mean(0)
    two = np.linalg.svd(c, full_matrices=False)[2][:2]
    want = c @ (two * np.sign(two[[0, 1], np.abs(two).argmax(1)])[:, None]).T
    assert np.allclose([p[i] for i in range(50)], want)
    rows = spark.createDataFrame([(f"k{i}", i, float(i % 5) if i < 40 else None) for i in range(45)] + [("none", None, 1.0)], "k string, a int, y double")
    assert iterate.boosted_predictions(rows, "k", ["a"], "y", trees=3).count() == 45
    assert iterate.boosted_predictions(rows.filter("y is null"), "k", ["a"], "y").filter("predicted is null").count() == 5


def test_restarts_lose_and_repeat_nothing(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(40)], "k int, x int")
    assert sorted(map(tuple, live.restarted(rows, "k", 3).collect())) == [(i, i % 3) for i in range(40)]


NOTES = "song bigint, idx bigint, start bigint, dur bigint, chan int, pitch int, vel int, extra string"


@pytest.mark.parametrize("name", ["imitation_rate", "voice_concurrency", "phrase_cuts", "drum_vector"])
def test_whole_songs_of_hard_notes(spark, name):
    """No notes, one note, and notes with nulls: no error, at most one result a song (phrase_cuts: cuts from 0 to the last bar)."""
    from notegrain.queries import BINDINGS, OPS

    chan = 9 if name == "drum_vector" else 0
    hard = [(1, 0, 0, 240, chan, 38, 90, "x"), (2, 1, 0, 0, chan, 36, 1, "x"), (2, 2, 0, 0, chan, 36, 1, "x"), (3, 3, 4800, 480, chan, None, None, None), (3, 4, 76800, 480, chan, 42, 1, None)]
    for rows in ([], hard):
        df = spark.createDataFrame(rows, NOTES)
        inner = {**BINDINGS, "notes": Binding("", build=lambda *_: df), "drums": Binding("", build=lambda *_: df)}
        got = bound(OPS[name], inner)[0](spark, "").collect()
        assert len({r.song for r in got}) <= 3 and (rows or not got)
        if name == "phrase_cuts" and rows:
            cuts = {s: [r.bar for r in sorted(got, key=lambda r: r.place) if r.song == s] for s in (1, 2, 3)}
            assert all(c[0] == 0 and all(0 < b - a <= 8 for a, b in zip(c, c[1:])) for c in cuts.values()) and cuts[3][-1] == 41


def test_archetype_notes():
    assert whole.BINDINGS["archetypes"].sql.count("'waltz'") == 12 and Op("x", "SELECT 1 FROM {a}").inputs == ["a"]
