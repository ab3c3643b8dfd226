"""Stated query vectors against all vectors, in blocks.

Both sides are cut into blocks by a hash of the key; every pair of blocks meets in one task, which holds two blocks
whatever the sizes and hands on what merges: the best of its block for each query, or counts and maxima. Nothing is
broadcast. Similarities are products in double precision rounded at 1e-9, so equal ones tie; ties go to the smaller key.
Rows with a null vector or key are left out; empty sides give no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

BLOCK = 2048


def _sized(df: DataFrame, block: int) -> int:
    return max(1, -(-df.count() // block))


def _side(rows: DataFrame, key: str, mine: str, other: str, cells: int, others: int) -> DataFrame:
    kept = rows.filter(F.col("v").isNotNull() & F.col(key).isNotNull())
    return kept.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(cells))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(others - 1).cast("bigint"))))


def _matrix(t: pa.Table) -> np.ndarray:
    v = t.column("v").combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(v), -1)


def against(queries: DataFrame, vectors: DataFrame, leaf, schema: str, key: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """What ``leaf(queries, vectors, products)`` gives on each pair of blocks (tables with the columns of either side)."""
    nq, nv = _sized(queries, block), _sized(vectors, block)
    queries = queries.select(*[F.col(c).alias(f"{c}_") for c in queries.columns]).withColumnsRenamed({f"{c}_": c for c in queries.columns})  # own columns, where both sides come from one table
    q = _side(queries, key, "_q", "_v", nq, nv)
    v = _side(vectors, key, "_v", "_q", nv, nq)
    types = pa.schema([(c.split()[0], {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]]) for c in schema.split(", ")])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return types.empty_table()
        return pa.table(leaf(left, right, np.round(_matrix(left) @ _matrix(right).T, 9)), schema=types)

    return q.groupBy("_q", "_v").cogroup(v.groupBy("_q", "_v")).applyInArrow(run, schema)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """q, b, label, sim, rn: the k most similar vectors b of every query, itself left out. ``vectors`` has an integer label."""

    def leaf(left, right, s):
        mine, theirs, label = (t.column(c).to_numpy() for t, c in ((left, key), (right, key), (right, "label")))
        s[mine[:, None] == theirs[None, :]] = -np.inf
        at = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
        i, j = np.nonzero((s >= at[:, None]) & (s > -np.inf))
        order = np.lexsort((theirs[j], -s[i, j], i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, int)
        keep = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < k
        i, j = i[keep], j[keep]
        return {"q": mine[i], "b": theirs[j], "label": label[j].astype("i4"), "sim": s[i, j]}

    found = against(queries.select(key, "v"), vectors.select(key, F.col("label").cast("int").alias("label"), "v"), leaf, "q bigint, b bigint, label int, sim double", key, block)
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "b"))
    return found.withColumn("rn", rank).filter(F.col("rn") <= k)


def population(queries: DataFrame, vectors: DataFrame, radius: float, key: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """q, population, nearest_sim: of every query the number of vectors of at least ``radius`` similarity and the best one."""

    def leaf(left, right, s):
        return {"q": left.column(key).to_numpy(), "population": (s >= radius).sum(1).astype("i8"), "nearest_sim": s.max(1)}

    parts = against(queries.select(key, "v"), vectors.select(key, "v"), leaf, "q bigint, population bigint, nearest_sim double", key, block)
    return parts.groupBy("q").agg(F.sum("population").alias("population"), F.max("nearest_sim").alias("nearest_sim"))


def centroids(vectors: DataFrame, by: str, dims: int) -> DataFrame:
    """by, size, v: the unit mean of each cluster's vectors, summed column by column with map-side combining."""
    sums = vectors.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("size"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dims)])
    length = F.sqrt(reduce(lambda a, b: a + b, [F.col(f"s{i}") * F.col(f"s{i}") for i in range(dims)]))
    return sums.withColumn("l", length).filter("l > 0").select(by, "size", F.array(*[F.col(f"s{i}") / F.col("l") for i in range(dims)]).alias("v"))


def empty_blends(vectors: DataFrame, by: str = "label", dims: int = 64, low: float = 0.30, high: float = 0.75, radius: float = 0.5, coherent: float = 0.55, top: int = 200, block: int = BLOCK) -> DataFrame:
    """a, b, pair_sim, population, nearest_sim: midpoints of two anchors that few vectors lie at.

    Anchors are the clusters of at least the median size; pairs have a similarity from ``low`` to ``high``; a midpoint
    counts the vectors within ``radius`` and needs one of at least ``coherent``. The emptiest come first, of equal ones
    those with the nearest vector, then the smaller pair; ``top`` of them. Clusters are far fewer than vectors."""
    from notegrain.plans.shared import written

    cents = written(centroids(vectors, by, dims), "centroids")
    anchors = cents.filter(F.col("size") >= F.lit(cents.agg(F.median("size")).first()[0] or 0)).select(F.col(by).cast("bigint").alias("vec_id"), "v")

    def leaf(left, right, s):
        a, b = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        i, j = np.nonzero((s >= low) & (s <= high) & (a[:, None] < b[None, :]))
        return {"a": a[i], "b": b[j], "pair_sim": s[i, j]}

    pairs = against(anchors, anchors, leaf, "a bigint, b bigint, pair_sim double", block=block)
    ends = pairs.join(anchors.select(F.col("vec_id").alias("a"), F.col("v").alias("va")), "a").join(anchors.select(F.col("vec_id").alias("b"), F.col("v").alias("vb")), "b")
    total = F.zip_with("va", "vb", lambda x, y: x + y)
    length = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))
    mids = ends.withColumn("m", total).withColumn("l", length).filter("l > 0").select("a", "b", "pair_sim", F.shiftleft(F.col("a"), 31).bitwiseOR(F.col("b")).alias("vec_id"), F.transform("m", lambda x: x / F.col("l")).alias("v"))
    mids = written(mids, "midpoints")
    found = population(mids, vectors.select("vec_id", "v"), radius, block=block).filter(F.col("nearest_sim") >= coherent)
    best = mids.select("a", "b", F.round("pair_sim", 6).alias("pair_sim"), "vec_id").join(found.withColumnRenamed("q", "vec_id"), "vec_id")
    return best.orderBy("population", F.desc("nearest_sim"), "a", "b").limit(top).select("a", "b", "pair_sim", "population", F.round("nearest_sim", 6).alias("nearest_sim"))


def pairs_within(rows: DataFrame, by: str, least: float, key: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """a < b, sim: pairs of at least ``least`` similarity whose ``by`` is equal. ``v`` is of unit length.

    A value of ``by`` that many rows share is cut into blocks by a hash of the key, every pair of blocks being one task."""
    sizes = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_cells"))
    own = rows.join(sizes, by).withColumn("_own", F.pmod(F.xxhash64(key), F.col("_cells")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)))
    each = own.select(by, F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), (F.col("_own") > F.col("_other")).alias("_side"), key, "v")
    types = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float64())])

    def run(t: pa.Table) -> pa.Table:
        keys, x, side = t.column(key).to_numpy(), _matrix(t), t.column("_side").to_numpy(zero_copy_only=False)
        crossed = t.column("_i")[0].as_py() < t.column("_j")[0].as_py()
        found = [np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0)]
        for i in range(0, len(x), 512):
            s = np.round(x[i : i + 512] @ x.T, 9)
            p, q = np.nonzero(s >= least)
            w, p = s[p, q], p + i
            keep = (keys[p] < keys[q]) & ((side[p] != side[q]) | (not crossed))
            found = [np.r_[f, n[keep]] for f, n in zip(found, (keys[p], keys[q], w))]
        return pa.table(dict(zip(("a", "b", "sim"), found)), schema=types)

    return each.groupBy(by, "_i", "_j").applyInArrow(run, "a bigint, b bigint, sim double")
