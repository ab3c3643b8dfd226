"""Readers and sinks besides plain Parquet: delimited and JSON files, buckets, SQLite images, tables of a database,
note caches, record files and shards of ids.

Whatever a task writes itself (SQLite, zipped arrays) is made as one binary value a bucket, so Spark moves and stores
it like any other row and a lost executor repeats its bucket. Buckets come from a hash of the key, so none is hot.
"""

from __future__ import annotations

import io
import json
import sqlite3

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, TimestampNTZType, TimestampType

NULL = "\\N"


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """CSV or TSV with a schema; the marker of null is kept apart from the empty text. Rows that do not fit have nulls."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).option("nullValue", NULL).option("emptyValue", "").option("multiLine", True).option("lineSep", "\n").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').option("mode", "PERMISSIVE").csv(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True, by: list[str] | None = None) -> None:
    """CSV or TSV, every text quoted; with ``by`` one folder a value. Columns of arrays have to be made texts before."""
    out = df.write.option("sep", sep).option("header", header).option("nullValue", NULL).option("emptyValue", "").option("quoteAll", True).option("lineSep", "\n").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"')
    (out.partitionBy(*by) if by else out).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; absent fields are null, unknown fields are left out."""
    return spark.read.schema(schema).json(path)


def write_manifest(rows: DataFrame, path: str, by: str) -> None:
    """One text file of paths (no header) for each value of ``by``; rows without path or value are left out."""
    kept = rows.filter(F.col("stored_path").isNotNull() & F.col(by).isNotNull()).select("stored_path", by)
    write_delimited(kept.repartition(by), path, "\t", False, [by])


def bucket(key: Column, buckets: int = 256) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, key: str, buckets: int = 256) -> None:
    """Parquet in one folder a bucket of the key; each bucket is written by one task."""
    df.withColumn("bucket", bucket(F.col(key), buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str, wanted: list[str], buckets: list[int] | None = None) -> DataFrame:
    """The wanted columns that are there, of some buckets or all; neither other columns nor other buckets are read."""
    df = spark.read.parquet(path)
    df = df if buckets is None else df.filter(F.col("bucket").isin(buckets))
    return df.select(*[c for c in wanted if c in df.columns])


def merged(parts: list[DataFrame], key: str | None = None) -> DataFrame:
    """The rows of all parts, absent columns as null; with ``key`` one row of each key (null keys stay), the least by its packed value, so that the result does not depend on order."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    if key is None:
        return every
    one = every.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*[c for c in every.columns if c != key])).alias("m")).select(key, "m.*").select(*every.columns)
    return one.unionByName(every.filter(F.col(key).isNull()))


def sql_type(t: DataType, width: int = 4000) -> str:
    """The column type of a database for a column of a frame."""
    names = {LongType: "BIGINT", IntegerType: "INTEGER", ShortType: "SMALLINT", DoubleType: "DOUBLE PRECISION", FloatType: "REAL", BooleanType: "BOOLEAN", TimestampType: "TIMESTAMP", TimestampNTZType: "TIMESTAMP", StringType: f"VARCHAR({width})"}
    return names.get(type(t), f"VARCHAR({width})")


def ddl(df: DataFrame, table: str, keys: tuple[str, ...] = (), indexes: tuple[str, ...] = ()) -> list[str]:
    """Statements that make a table for the frame, with its indexes; nothing is run."""
    columns = [f'"{f.name}" {sql_type(f.dataType)}' + (" NOT NULL" if f.name in keys else "") for f in df.schema.fields]
    return [f'CREATE TABLE "{table}" ({", ".join(columns)})', *[f'CREATE INDEX "{table}_{c}" ON "{table}" ("{c}")' for c in indexes]]


def load_database(df: DataFrame, url: str, table: str, batch: int = 10_000, connections: int = 16, **options: str) -> None:
    """Bulk load by JDBC: at most ``connections`` tasks write at once, in batches; arrays become JSON texts."""
    flat = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name) for f in df.schema.fields])
    flat.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch, numPartitions=connections, **options).mode("append").save()


def sqlite_images(df: DataFrame, table: str, key: str, indexes: tuple[str, ...] = (), views: dict[str, str] | None = None, buckets: int = 16) -> DataFrame:
    """bucket, image: SQLite databases (as bytes) that hold the rows of each bucket of the key, with indexes and views."""
    views, names = views or {}, df.columns
    make = f'CREATE TABLE "{table}" (' + ", ".join(f'"{f.name}" {sql_type(f.dataType)}' for f in df.schema.fields) + ")"
    after = [f'CREATE INDEX "{table}_{c}" ON "{table}" ("{c}")' for c in indexes] + [f'CREATE VIEW "{n}" AS SELECT * FROM "{table}" WHERE {w}' for n, w in views.items()]
    plain = [F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, (TimestampType, TimestampNTZType, ArrayType)) else F.col(f.name) for f in df.schema.fields]

    def run(key_, rows):
        with sqlite3.connect(":memory:") as db:
            db.execute(make)
            db.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(names))})', zip(*[rows.column(c).to_pylist() for c in names]))
            for statement in after:
                db.execute(statement)
            db.commit()
            image = db.serialize()
        return pa.table({"bucket": pa.array([key_[0].as_py()], pa.int32()), "image": pa.array([image], pa.binary())})

    return df.select(*plain).withColumn("_bucket", bucket(F.col(key), buckets)).groupBy("_bucket").applyInArrow(run, "bucket int, image binary")


def query_images(images: DataFrame, sql: str, schema: str) -> DataFrame:
    """The rows that a statement gives on each image."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            for image in b["image"]:
                with sqlite3.connect(":memory:") as db:
                    db.deserialize(bytes(image))
                    yield pd.DataFrame(db.execute(sql).fetchall(), columns=names, dtype=object)

    return images.select("image").mapInPandas(run, schema)


NOTE = ("start", "dur", "chan", "pitch", "vel")


def note_caches(notes: DataFrame, song: str = "song", ticks: Column | None = None, buckets: int = 64) -> DataFrame:
    """bucket, arrays, ticks: zipped arrays of each bucket's notes, one array (n x 5) a song, and a JSON of the songs' ticks a beat (only those that are not null)."""
    rows = notes.select(F.col(song).cast("string").alias("song"), *[F.col(c).cast("int").alias(c) for c in NOTE], (F.lit(None) if ticks is None else ticks).cast("int").alias("tpb"))

    def run(key, rows):
        frame, out = rows.to_pandas().sort_values(["song", *NOTE], kind="stable"), io.BytesIO()
        np.savez_compressed(out, **{s: g[list(NOTE)].to_numpy("i4") for s, g in frame.groupby("song", sort=False)})
        known = frame.dropna(subset=["tpb"]).groupby("song")["tpb"].first()
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "arrays": pa.array([out.getvalue()], pa.binary()), "ticks": [json.dumps({k: int(v) for k, v in known.items()})]})

    return rows.withColumn("_bucket", bucket(F.col("song"), buckets)).groupBy("_bucket").applyInArrow(run, "bucket int, arrays binary, ticks string")


def notes_of_caches(caches: DataFrame, default: int = 480) -> DataFrame:
    """song, tpb, idx and the five numbers of every note in the caches; a song without ticks has ``default``."""

    def run(batches):
        for b in batches:
            for arrays, ticks in zip(b["arrays"], b["ticks"]):
                known = json.loads(ticks) if ticks else {}
                with np.load(io.BytesIO(arrays)) as z:
                    for s in z.files:
                        x = z[s]
                        yield pd.DataFrame({"song": s, "tpb": int(known.get(s, default)), "idx": np.arange(len(x)), **{c: x[:, i] for i, c in enumerate(NOTE)}})

    return caches.select("arrays", "ticks").mapInPandas(run, "song string, tpb int, idx int, " + ", ".join(f"{c} int" for c in NOTE))


def id_shards(rows: DataFrame, key: str = "key", ids: str = "ids", per: int = 20_000) -> DataFrame:
    """shard, place, key, ids (16 bits) of rows numbered by the order of their keys.

    Numbers come from counts over 4,096 ranges of the key's hash, so no task orders all rows. Ids outside 0 to 32,767
    and null lists are refused by a null list."""
    small = F.when(~F.exists(ids, lambda x: x.isNull() | (x < 0) | (x > 32767)), F.transform(ids, lambda x: x.cast("smallint")))
    placed = rows.select(key, small.alias("ids"), F.pmod(F.xxhash64(key), F.lit(4096)).alias("range"))
    sizes = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(W.orderBy("range")) - F.col("n")).select("range", "before")  # 4,096 rows
    ranked = placed.withColumn("r", F.row_number().over(W.partitionBy("range").orderBy(key)) - 1).join(F.broadcast(before), "range").withColumn("at", F.col("r") + F.col("before"))
    return ranked.select(F.floor(F.col("at") / per).cast("int").alias("shard"), (F.col("at") % per).cast("int").alias("place"), key, "ids")
