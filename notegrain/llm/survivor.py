"""One surviving record for each group of copies.

Members are ranked by completeness, then trust, then recency, then key, and the same ranking restricted to
members that have a field gives that field's best value. All rankings are one window over (group, ranking);
its limit of one row is applied before the shuffle as well, so a group that holds a third of the rows sends
one row a ranking and map task.

Rows without group or key belong to no group. A member is a key's latest row in its group; rows of the same
time rank by their packed values (more acceptable values first). Null trust counts as 0, null time as the
oldest. Repeated rows change nothing; empty tables give no rows; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

FIELDS = ("bpm", "note_density", "duration_sec", "time_signature")
METER = r"\A[1-9][0-9]?/(?:1|2|4|8|16|32)\z|\A[1-9][0-9]?/64\z"
RECORD = "record"


def members(metadata: DataFrame, manifest: DataFrame, baseline: DataFrame) -> DataFrame:
    """song_id, md5, loaded_at, the four fields (null where not acceptable), complete, trust."""
    bounds = {r["column_name"]: (r["lo"], r["hi"]) for r in baseline.select("column_name", "lo", "hi").collect()}  # one row a column
    inside = lambda c: F.col(c).between(*[F.lit(x).cast("double") for x in bounds.get(c, (None, None))]) & ~F.isnan(c)
    good = [F.when(inside(c), F.col(c)).alias(c) for c in FIELDS[:3]] + [F.when(F.col(FIELDS[3]).rlike(METER), F.col(FIELDS[3])).alias(FIELDS[3])]
    rows = metadata.filter("song_id is not null and md5 is not null").select("song_id", "md5", "loaded_at", *good)
    complete = sum(F.col(c).isNotNull().cast("int") for c in FIELDS)
    latest = rows.withColumn("complete", complete).groupBy("song_id", "md5").agg(F.max(F.struct("loaded_at", "complete", *FIELDS)).alias("m")).select("song_id", "md5", "m.*")
    trust = manifest.groupBy("md5").agg(F.max("n_copies").alias("trust"))
    return latest.join(trust, "md5", "left").withColumn("trust", F.coalesce("trust", F.lit(0)))


def winners(metadata: DataFrame, manifest: DataFrame, baseline: DataFrame) -> DataFrame:
    """song_id, column_name, md5 and the winner's value as text: of each song with at least two files, the first
    member (``record``) and for each field the first member that has it."""
    m = members(metadata, manifest, baseline)
    entry = lambda c, v: F.struct(F.lit(c).alias("column_name"), v.cast("string").alias("value"))
    ranked = m.select("song_id", "md5", "complete", "trust", "loaded_at", F.explode(F.array_compact(F.array(entry(RECORD, F.col("md5")), *[F.when(F.col(c).isNotNull(), entry(c, F.col(c))) for c in FIELDS]))).alias("e")).select("song_id", "md5", "complete", "trust", "loaded_at", "e.*")
    order = W.partitionBy("song_id", "column_name").orderBy(F.desc("complete"), F.desc("trust"), F.desc_nulls_last("loaded_at"), "md5")
    first = ranked.withColumn("place", F.row_number().over(order)).filter("place = 1").select("song_id", "column_name", "md5", "value")
    several = metadata.filter("song_id is not null and md5 is not null").groupBy("song_id").agg(F.min("md5").alias("lo"), F.max("md5").alias("hi")).filter("lo <> hi").select("song_id")
    return first.join(several, "song_id", "left_semi")


def survivors(metadata: DataFrame, manifest: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row a song: the surviving file, is_canonical = 1, and every field from the best member that has it."""
    best = winners(metadata, manifest, baseline)
    value = lambda c: F.max(F.when(F.col("column_name") == c, F.col("value")))
    return best.groupBy("song_id").agg(value(RECORD).alias("md5"), *[value(c).cast("double").alias(c) for c in FIELDS[:3]], value(FIELDS[3]).alias(FIELDS[3])).withColumn("is_canonical", F.lit(1))
