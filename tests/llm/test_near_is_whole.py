import numpy as np

from notegrain.llm import overlap, vectors
from notegrain.llm.vantage import F, tiles

from test_vector_search import D, cosines, frame, name


def circles(n=20, pairs=15, apart=8.0):
    """Pairs ``apart`` degrees apart on circles, where the triangle inequality is tight; evaluation has the even rows, training the odd ones."""
    x = np.zeros((n * pairs * 2, D))
    for c in range(n):
        for k in range(pairs):
            for s in (0, 1):
                a = np.radians(24 * k + 1.1 * c + apart * s)
                x[(c * pairs + k) * 2 + s, [2 * c, 2 * c + 1]] = np.cos(a), np.sin(a)
    return np.round(x, 3).astype("f4")


def test_no_pair_at_the_border_of_a_ball_is_left_out(spark):
    x = circles()
    flags = spark.createDataFrame([(name(i), 2 if i % 2 == 0 else 1) for i in range(len(x))], "md5 string, flag int").withColumn("md5", vectors.key_of(F.col("md5")))
    s = cosines(x)
    want = {name(i) for i in range(0, len(x), 2) if (s[i, 1::2] >= 0.99).any()}
    got = overlap.near(flags, frame(spark, x), small=4, rates=(1 / 20,), coarse=1 << 14).select(vectors.name_of(F.col("md5")).alias("n")).collect()
    assert len(want) > 200 and {r.n for r in got} == want


def test_tiles_at_the_reach_are_compared():
    a = np.radians(np.linspace(0, 90, 2000))
    u = np.stack([np.cos(a), np.sin(a)], 1).astype("f4")
    ring = float(np.arccos(0.99))
    order, pairs = tiles(u, np.zeros(len(u), int), ring, 16)
    met = np.zeros((len(u), len(u)), bool)
    for (i, j), (k, m) in pairs:
        met[np.ix_(order[i:j], order[k:m])] = met[np.ix_(order[k:m], order[i:j])] = True
    assert met[np.abs(a[:, None] - a[None, :]) <= ring].all() and not met.all()
