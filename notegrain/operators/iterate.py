"""Operators that run in rounds: spherical k-means with fixed seeds, near-duplicates, ridge by its Gramian."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from notegrain.operators.components import components
from notegrain.operators.search import pairs_within
from notegrain.plans.shared import written


def _unit(v):
    return F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)))


def kmeans(vectors: DataFrame, k: int = 16, rounds: int = 5, key: str = "vec_id", seed: str = "kmeans") -> DataFrame:
    """key, cluster, sim: spherical Lloyd rounds from ``k`` seeds drawn by a hash of the key.

    The centroids (k rows, a parameter) go to the workers, where a batch of vectors is one matrix product; a batch hands on
    one sum a cluster, so a round shuffles k rows a task. Vectors are ``v``, of unit length; rows with a null key or
    vector are left out. A cluster that loses all vectors keeps its centroid. Ties go to the smaller cluster."""
    known = vectors.filter(F.col(key).isNotNull() & F.col("v").isNotNull()).select(key, "v")
    seeds = known.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit("|" + seed))), key).limit(k)
    cent = np.array([r["v"] for r in seeds.select("v").collect()])  # k rows
    kind = known.schema[key].dataType.simpleString()
    if not len(cent):
        return known.select(key, F.lit(0).alias("cluster"), F.lit(0.0).alias("sim"))
    spark = vectors.sparkSession

    def near(shared, sums: bool):
        def run(batches):
            c = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                s = np.round(x @ c.T, 9)
                best = s.argmax(1)
                if sums:
                    total = np.zeros_like(c)
                    np.add.at(total, best, x)
                    there = np.unique(best)
                    yield pa.RecordBatch.from_arrays([pa.array(there.astype("i4")), pa.array(list(total[there]), pa.list_(pa.float64()))], ["cluster", "v"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column(key), pa.array(best.astype("i4")), pa.array(s[np.arange(len(s)), best])], [key, "cluster", "sim"])

        return run

    for _ in range(rounds):
        parts = known.mapInArrow(near(spark.sparkContext.broadcast(cent), True), "cluster int, v array<double>")
        total = parts.groupBy("cluster").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(cent.shape[1])]).alias("v"))
        for r in total.collect():  # k rows
            length = np.linalg.norm(r["v"])
            if length > 0:
                cent[r["cluster"]] = np.array(r["v"]) / length
    return known.mapInArrow(near(spark.sparkContext.broadcast(cent), False), f"{key} {kind}, cluster int, sim double")


def mutual_duplicates(vectors: DataFrame, least: float = 0.985, k: int = 12, classes: int = 12, active: int = 5, top: int = 4, most_in_group: int = 50, key: str = "vec_id") -> DataFrame:
    """key, group: near-duplicates, every row in a group, named by its smallest key; a row without any is its own group.

    The first ``classes`` components of ``v`` are pitch classes. Rows with fewer than ``active`` positive ones are
    left alone. The others are compared within the ranked ``top`` classes (of equal ones the later first); a pair of at
    least ``least`` cosine counts if each is among the other's ``k`` nearest, itself the first of them, ties by key.
    Components of such pairs above ``most_in_group`` are dissolved. Pairs below ``least`` are dropped before the ranks,
    which they cannot change."""
    pc = F.transform(F.slice("v", 1, classes), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    ranked = F.transform(F.slice(F.reverse(F.array_sort(pc)), 1, top), lambda e: e["i"])
    rows = vectors.filter(F.size(F.filter(F.slice("v", 1, classes), lambda x: x > 0)) >= active).select(F.array_join(ranked.cast("array<string>"), ",").alias("same"), key, _unit(F.col("v")).alias("v"))
    pairs = written(pairs_within(rows, "same", least, key).select("a", F.col("b").alias("c"), "sim"), "near")
    ways = pairs.unionByName(pairs.select(F.col("c").alias("a"), F.col("a").alias("c"), "sim"))
    near = ways.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("sim"), "c"))).filter(F.col("r") < k)
    mutual = near.groupBy(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("a", "b")
    label = components(mutual)
    kept = label.join(label.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most_in_group).select("label"), "label")
    return vectors.select(key).join(kept.select(F.col("node").alias(key), "label"), key, "left").select(key, F.coalesce("label", key).alias("group"))


def ridge(rows: DataFrame, features: list[str], target: str, alpha: float = 300.0) -> dict[str, float]:
    """Coefficients and intercept by the normal equations: one aggregate of products, solved on the driver (features squared numbers)."""
    known = rows.select(*[F.col(c).cast("double").alias(c) for c in [*features, target]]).dropna()
    names = [*features, target]
    sums = known.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in names]).first()
    if not sums["n"]:
        return {**dict.fromkeys(features, 0.0), "intercept": 0.0}
    mean = {c: sums[f"m_{c}"] for c in names}
    prod = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    got = known.agg(*[F.sum((F.col(a) - mean[a]) * (F.col(b) - mean[b])).alias(f"{a}*{b}") for a, b in prod]).first()
    g = {p: v for p, v in zip(prod, got)}
    at = lambda a, b: g[(a, b)] if (a, b) in g else g[(b, a)]
    w = np.linalg.solve(np.array([[at(a, b) for b in features] for a in features]) + alpha * np.eye(len(features)), np.array([at(a, target) for a in features]))
    return {**{c: float(x) for c, x in zip(features, w)}, "intercept": float(mean[target] - sum(x * mean[c] for c, x in zip(features, w)))}


def ridge_predictions(rows: DataFrame, key: str, features: list[str], target: str, alpha: float = 300.0) -> DataFrame:
    """key, predicted: of every row whose features are known."""
    w = ridge(rows, features, target, alpha)
    value = F.lit(w["intercept"])
    for c in features:
        value = value + F.lit(w[c]) * F.col(c).cast("double")
    return rows.select(key, F.round(value, 6).alias("predicted")).dropna()


def plane(vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    """key, x, y: the two directions of most variance (a linear stand-in for a nonlinear map).

    One pass adds up each batch's sum and products (dimensions squared numbers), the axes come from them on the driver,
    and a second pass projects; the sign of an axis makes its largest component positive. Null keys and vectors are left out."""
    known = vectors.filter(F.col(key).isNotNull() & F.col("v").isNotNull()).select(key, "v")
    first = known.select(F.size("v").alias("d")).first()
    kind = known.schema[key].dataType.simpleString()
    if first is None:
        return known.select(key, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    d = first["d"]

    def matrix(b) -> np.ndarray:
        return b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)

    def products(batches):
        n, s, p = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            x = matrix(b)
            n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s], pa.list_(pa.float64())), pa.array([p.reshape(-1)], pa.list_(pa.float64()))], ["n", "s", "p"])

    def added(batches):
        n, s, p = 0, np.zeros(d), np.zeros(d * d)
        for b in batches:
            n += sum(b.column("n").to_pylist())
            s, p = s + b.column("s").flatten().to_numpy().reshape(-1, d).sum(0), p + b.column("p").flatten().to_numpy().reshape(-1, d * d).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s], pa.list_(pa.float64())), pa.array([p], pa.list_(pa.float64()))], ["n", "s", "p"])

    kinds = "n bigint, s array<double>, p array<double>"
    parts = known.select("v").mapInArrow(products, kinds).repartition(16).mapInArrow(added, kinds).collect()  # 16 rows of dimensions squared numbers
    n = sum(r["n"] for r in parts)
    mean = np.sum([r["s"] for r in parts], 0) / n
    cov = np.sum([r["p"] for r in parts], 0).reshape(d, d) / n - np.outer(mean, mean)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(axes.shape[1])])

    def project(batches):
        for b in batches:
            if b.num_rows:
                xy = (matrix(b) - mean) @ axes
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(xy[:, 0]), pa.array(xy[:, 1] if d > 1 else np.zeros(len(xy)))], [key, "x", "y"])

    return known.mapInArrow(project, f"{key} {kind}, x double, y double")


def boosted_predictions(rows: DataFrame, key: str, features: list[str], target: str, most: int = 100_000, trees: int = 20, depth: int = 4) -> DataFrame:
    """key, predicted: by boosted trees, of every row whose features are known.

    Trees are fitted on at most about ``most`` of the rows with a known target, drawn by a hash of the key."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    known = rows.select(key, *[F.col(c).cast("double").alias(c) for c in [*features, target]]).dropna(subset=features)
    ready = VectorAssembler(inputCols=features, outputCol="features").transform(known)
    labelled = ready.filter(F.col(target).isNotNull())
    n = labelled.count()
    if not n:
        return known.select(key, F.lit(None).cast("double").alias("predicted"))
    some = labelled.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < F.lit(int(min(1.0, most / n) * (1 << 20))))
    model = GBTRegressor(labelCol=target, maxIter=trees, maxDepth=depth, seed=1).fit(some)
    return model.transform(ready).select(key, F.col("prediction").alias("predicted"))
