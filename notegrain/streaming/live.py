"""Streams: ingest that skips what is known, latest-wins upserts, windowed counters with late data, session gaps.

Sources are folders of files, sinks are tables in the shared folder; state and progress live in checkpoints
there, so a restart goes on where it stopped. ``drain`` runs a stream over what is there now and ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from notegrain.plans.shared import own_dir


def follow(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", kind: str = "parquet") -> DataFrame:
    """The files of a folder as a stream, old and new."""
    return spark.readStream.format(kind).schema(schema).option("pathGlobFilter", pattern).load(folder)


def unseen(stream: DataFrame, key: str, at: str, late: str = "30 days") -> DataFrame:
    """The first row of each key; keys are remembered as long as rows may be late."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def counters(stream: DataFrame, at: str, by: list[str], value: str, every: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Rows and totals per window and key; rows later than ``late`` are dropped and their windows' state with them."""
    w = F.window(at, every, slide) if slide else F.window(at, every)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("at"), *by, "n", "total")


def sessions(stream: DataFrame, at: str, by: list[str], gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions that end where a gap begins."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("at"), F.col("w.end").alias("ends"), *by, "n")


def latest_wins(batch: DataFrame, known: DataFrame | None, key: str, version: str) -> DataFrame:
    """One row a key: of the batch and what is known, the greatest version. Repeats change nothing."""
    every = batch if known is None else known.unionByName(batch, allowMissingColumns=True)
    return every.groupBy(key).agg(F.max_by(F.struct(*every.columns), F.struct(version, F.xxhash64(*every.columns))).alias("m")).select("m.*")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there and returns its rows (in mode ``complete`` the last result)."""
    spark = stream.sparkSession
    base = f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/" + ("all" if mode == "complete" else f"batch={n}"))

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    try:
        return spark.read.schema(stream.schema).parquet(f"{base}/out/" + ("all" if mode == "complete" else "batch=*"))
    except Exception:  # nothing arrived
        return spark.createDataFrame([], stream.schema)


def upserted(stream: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key after running the stream over what is there; every batch makes a new table from the last."""
    spark = stream.sparkSession
    base = f"{own_dir(spark)}/upsert-{uuid.uuid4().hex}"
    made: list[str] = []

    def put(batch: DataFrame, n: int) -> None:
        known = spark.read.parquet(made[-1]) if made else None
        latest_wins(batch, known, key, version).write.mode("overwrite").parquet(f"{base}/v{n}")
        made.append(f"{base}/v{n}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(made[-1]) if made else spark.createDataFrame([], stream.schema)


def restarted(rows: DataFrame, key: str, runs: int) -> DataFrame:
    """The rows after arriving in ``runs`` parts (by a hash of the key), the stream being started anew after each one.

    Every start goes on from the checkpoint of the last; a batch that is repeated replaces its own folder."""
    spark = rows.sparkSession
    base = f"{own_dir(spark)}/restarts-{uuid.uuid4().hex}"

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    for i in range(runs):
        rows.filter(F.pmod(F.xxhash64(key), F.lit(runs)) == i).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out/batch=*")
