"""Connected components by alternating large-star and small-star rounds of minimum labels.

Each round lets every node take the smallest label among its neighbours, for neighbours above and below it in
turn (Kiveris et al. 2014); the number of rounds grows with the logarithm of the graph's size, long chains and
hubs included. Minima are combined map-side and joins are left to adaptive skew handling, so a hub's edges
are never in one task. Each round's edges are a written table, so lineage stays short and a lost executor
costs one round at most; the round before is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from notegrain.plans.shared import dropped, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label: of each node that has an edge (a, b) to another node, the smallest node it can reach.

    Loops, repeats and edges with a null end are ignored; no edges give no rows."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and a <> b").distinct()
    now, seen = written(now, "edges"), None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        last, now = now, written(small.filter("u <> v").distinct(), "edges")
        dropped(last)
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    star = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return star.union(star.select("label", "label").distinct())
