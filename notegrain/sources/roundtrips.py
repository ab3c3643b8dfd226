"""Queries that write whole test tables by each sink, read them back, and give what came back; their SQL reads the tables directly."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from notegrain.plans.shared import own_dir, table
from notegrain.sources import files, smf
from notegrain.sources.bindings import BINDINGS

CATALOG = "md5 string, song_id string, split string, load_id int, bpm double, n_notes int, time_signature string, midi_patches string"
_CATALOG_COLUMNS = [c.split()[0] for c in CATALOG.split(", ")]
VIEWS = {"drummed": "has_drums = 1", "fast": "bpm > 140"}


def _new(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(BINDINGS["notes"].sql, lineitem=table(spark, d, "lineitem"))


def csv_catalog(spark: SparkSession, d: str) -> DataFrame:
    at = _new(spark, "csv")
    files.write_delimited(table(spark, d, "metadata").select(*_CATALOG_COLUMNS), at)
    return files.read_delimited(spark, at, CATALOG)


def tsv_documents(spark: SparkSession, d: str) -> DataFrame:
    """Texts with tabs, quotes, line breaks and any character survive."""
    at = _new(spark, "tsv")
    files.write_delimited(table(spark, d, "documents").select("doc_id", "text"), at, "\t", False)
    return files.read_delimited(spark, at, "doc_id bigint, text string", "\t", False).select("doc_id", F.md5("text").alias("digest"))


def json_documents(spark: SparkSession, d: str) -> DataFrame:
    at = _new(spark, "json")
    table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars", "md5").write.json(at)
    return files.read_json_lines(spark, at, "doc_id bigint, text string, lang string, n_chars bigint, md5 string, absent string").select("doc_id", F.md5("text").alias("digest"), "lang", "n_chars", "md5", "absent")


def manifest_files(spark: SparkSession, d: str) -> DataFrame:
    """Stored paths by status, one text file of paths each, without header."""
    at = _new(spark, "manifest")
    files.write_manifest(table(spark, d, "manifest"), at, "file_status")
    return spark.read.schema("stored_path string, file_status string").option("sep", "\t").option("escape", '"').csv(at)


def bucket_read(spark: SparkSession, d: str) -> DataFrame:
    """Rows and notes per load, from buckets of the key and a column that does not exist."""
    at = _new(spark, "buckets")
    files.write_buckets(table(spark, d, "metadata"), at, "md5", 32)
    back = files.read_buckets(spark, at, ["load_id", "n_notes", "no_such_column"])
    return back.groupBy("load_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_notes").alias("notes"))


def part_union(spark: SparkSession, d: str) -> DataFrame:
    """Catalog and manifest as parts with different columns, one row a file."""
    a = table(spark, d, "metadata").select("md5", "song_id")
    b = table(spark, d, "manifest").select("md5", "song_id", F.lit(1).alias("on_file"))
    return files.merged([a, b], "md5").select("md5")


def sqlite_views(spark: SparkSession, d: str) -> DataFrame:
    """Rows in each view of the catalog, counted inside the SQLite images."""
    rows = table(spark, d, "metadata").select("md5", "song_id", "bpm", "has_drums", "loaded_at")
    images = files.sqlite_images(rows.filter("md5 is not null"), "catalog", "md5", ("song_id",), VIEWS)
    sql = "SELECT 'catalog' AS name, count(*) AS n FROM catalog" + "".join(f" UNION ALL SELECT '{v}', count(*) FROM {v}" for v in VIEWS)
    return files.query_images(images, sql, "name string, n bigint").groupBy("name").agg(F.sum("n").alias("n"))


def load_statements(spark: SparkSession, d: str) -> DataFrame:
    """The statements a bulk load of the manifest would begin with."""
    df = table(spark, d, "manifest").select("md5", "stored_path", "size", "n_copies", "sources", "is_quarantined")
    return spark.createDataFrame(list(enumerate(files.ddl(df, "manifest", ("md5",), ("md5",)))), "place int, statement string")


def note_cache(spark: SparkSession, d: str) -> DataFrame:
    """Notes through zipped arrays; every third song names its ticks a beat, the others have the usual 480."""
    ticks = F.when(F.col("song") % 3 == 0, 96)
    back = files.notes_of_caches(files.note_caches(_notes(spark, d), "song", ticks))
    sums = [F.sum(F.col(c).cast("bigint")).alias(f"sum_{c}") for c in files.NOTE]
    return back.groupBy(F.col("song").cast("bigint").alias("song"), F.col("tpb").cast("bigint").alias("tpb")).agg(F.count(F.lit(1)).alias("n"), *sums)


def midi_files(spark: SparkSession, d: str) -> DataFrame:
    """Every song as a MIDI file and back: notes, and the sums of their starts, lengths and pitches (lengths of equal notes that sound at once may be swapped)."""
    notes = _notes(spark, d).select(F.col("song").cast("string").alias("md5"), *[F.col(c).cast("int").alias(c) for c in ("start", "dur", "chan", "pitch")], F.greatest("vel", F.lit(1)).cast("int").alias("vel"))

    def song(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame[["start", "dur", "chan", "pitch", "vel"]].itertuples(index=False, name=None)
        return pd.DataFrame({"md5": [key[0]], "content": [smf.encode(480, [tuple(map(int, r)) for r in rows], [(0, 120.0)], [(0, 4, 4)])]})

    events = smf.events_of(notes.groupBy("md5").applyInPandas(song, "md5 string, content binary")).filter("kind = 'note'")
    return events.groupBy(F.col("md5").cast("bigint").alias("song")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("bigint")).alias(f"sum_{c}") for c in ("start", "dur", "pitch", "vel")])


def id_shards(spark: SparkSession, d: str) -> DataFrame:
    """Shards of the songs' pitches in order of their notes: rows and ids of each."""
    lists = _notes(spark, d).groupBy("song").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "pitch"))), lambda x: x["pitch"].cast("int")).alias("ids"))
    at = _new(spark, "shards")
    files.id_shards(lists, "song", "ids", 64).repartition("shard").sortWithinPartitions("place").write.partitionBy("shard").parquet(at)
    back = spark.read.parquet(at)
    return back.select("song", F.size("ids").cast("bigint").alias("n"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("digest"))


QUERIES = {f.__name__: f for f in (csv_catalog, tsv_documents, json_documents, manifest_files, bucket_read, part_union, sqlite_views, load_statements, note_cache, midi_files, id_shards)}

_NOTES = BINDINGS["notes"].sql.format(lineitem="lineitem")
SQL = {
    "csv_catalog": f"SELECT {', '.join(_CATALOG_COLUMNS)} FROM metadata",
    "tsv_documents": "SELECT doc_id, md5(text) AS digest FROM documents",
    "json_documents": "SELECT doc_id, md5(text) AS digest, lang, n_chars, md5, NULL::VARCHAR AS absent FROM documents",
    "manifest_files": "SELECT stored_path, file_status FROM manifest WHERE stored_path IS NOT NULL AND file_status IS NOT NULL",
    "bucket_read": "SELECT load_id, count(*) AS n, sum(n_notes)::BIGINT AS notes FROM metadata GROUP BY load_id",
    "part_union": "SELECT md5 FROM metadata WHERE md5 IS NOT NULL UNION SELECT md5 FROM manifest WHERE md5 IS NOT NULL",
    "sqlite_views": "SELECT 'catalog' AS name, count(*) AS n FROM metadata UNION ALL SELECT 'drummed', count(*) FROM metadata WHERE has_drums = 1 UNION ALL SELECT 'fast', count(*) FROM metadata WHERE bpm > 140 AND NOT isnan(bpm)",
    "load_statements": """SELECT 0 AS place, 'CREATE TABLE "manifest" ("md5" VARCHAR(4000) NOT NULL, "stored_path" VARCHAR(4000), "size" BIGINT, "n_copies" BIGINT, "sources" VARCHAR(4000), "is_quarantined" INTEGER)' AS statement UNION ALL SELECT 1, 'CREATE INDEX "manifest_md5" ON "manifest" ("md5")'""",
    "note_cache": f"SELECT song, CASE WHEN song % 3 = 0 THEN 96 ELSE 480 END::BIGINT AS tpb, count(*) AS n, sum(start)::BIGINT AS sum_start, sum(dur)::BIGINT AS sum_dur, sum(chan)::BIGINT AS sum_chan, sum(pitch)::BIGINT AS sum_pitch, sum(vel)::BIGINT AS sum_vel FROM ({_NOTES}) n GROUP BY song",
    "midi_files": f"SELECT song, count(*) AS n, sum(start)::BIGINT AS sum_start, sum(dur)::BIGINT AS sum_dur, sum(pitch)::BIGINT AS sum_pitch, sum(greatest(vel, 1))::BIGINT AS sum_vel FROM ({_NOTES}) n GROUP BY song",
    "id_shards": f"SELECT song, count(*) AS n, md5(string_agg(pitch::VARCHAR, ',' ORDER BY idx, pitch)) AS digest FROM ({_NOTES}) n GROUP BY song",
}
