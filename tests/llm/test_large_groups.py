"""Groups above the limit of one matrix give the clusters of the whole group."""

from collections import Counter

import numpy as np
import pytest

from notegrain.llm import linkage
from test_vector_search import SMALL, chains, cloud, cosines, frame, naive_average, name


def rows_of(df):
    return {r.cluster_md5: (r["size"], r.reps, pytest.approx(r.tightness, abs=2e-6)) for r in df.collect()}


@pytest.mark.parametrize("seed, copies", [(11, 0), (12, 20)])
def test_large_groups_are_clustered_whole(spark, seed, copies):
    x = cloud(seed, centres=3, each=30, loose=6, noise=0.5)
    x = np.concatenate([x, np.repeat(x[:1], copies, 0)])
    want = {tuple(g) for g in naive_average(cosines(x), 0.78) if len(g) > 1}
    assert max(Counter(g for _, g in chains(x)).values()) > 24 and len(want) > 3
    got = {}
    for r in linkage.cluster_members(frame(spark, x), **SMALL, factor=1.0, dense=12).collect():
        got.setdefault(r.cluster_md5, []).append(int(r.md5, 16))
    assert {tuple(sorted(g)) for g in got.values()} == want and set(got) == {name(g[0]) for g in want}
    one, many = (rows_of(linkage.clusters(frame(spark, x), **SMALL, factor=1.0, dense=d)) for d in (6144, 12))
    assert {k: v[0] for k, v in many.items()} == {name(g[0]): len(g) for g in want}
    assert one == many
