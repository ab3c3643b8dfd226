from pyspark.sql import functions as F

from notegrain.functions import patterns


def test_steps_groups_and_tiling(spark):
    df = spark.createDataFrame([("a", "X..x|(xx).x."), ("b", "...."), ("c", None), ("d", "")], "name string, pattern string")
    rows = sorted((r.step, round(r["at"], 4), r.hit) for r in patterns.steps(df).collect())
    assert rows == [(0, 0.0, "X"), (3, 0.375, "x"), (4, 0.5, "x"), (4, 0.5625, "x"), (6, 0.75, "x")]
    tiled = patterns.tiled(patterns.steps(df), 2)
    assert sorted(r.start for r in tiled.collect()) == sorted(b * 1920 + s for b in (0, 1) for s in (0, 720, 960, 1080, 1440))


def test_grid_and_mask(spark):
    got = spark.range(1).select(*[patterns.snapped(F.lit(n)).alias(f"g{n}") for n in (5, 9, 16, 25, 40)], patterns.mask(F.lit("X...x...X...x...")).alias("m")).first()
    assert list(got) == [8, 12, 16, 32, 32, 0b0001000100010001]
