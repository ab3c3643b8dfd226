"""The queries on training data and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from notegrain.llm import containers, linkage, neighbours, overlap, splits, survivor, tokens, visual
from notegrain.plans.shared import table, written


def _tables(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.winners(*_tables(spark, d, "metadata", "manifest", "column_baseline")).select("song_id", "column_name", "md5")


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(*_tables(spark, d, "metadata", "manifest", "column_baseline"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "signatures_ext"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split(*_tables(spark, d, "metadata", "signatures_ext"))


MUSIC = ["bpm", "note_density", "duration_sec", "time_signature", "n_tracks", "n_notes", "has_drums", "midi_patches", "pitch_min", "pitch_max", "n_distinct_chords", "avg_vel", "tempo_change_count"]


def p4_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "metadata")
    return overlap.chunk_overlap(rows.select(F.col("md5").alias("key"), splits.split_name().alias("split"), overlap.normalised(MUSIC).alias("record")))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps per split, first source of the file's manifest row (null where there is none) and kind."""
    found = p4_found(spark, d)
    first = table(spark, d, "manifest").groupBy("md5").agg(F.min(F.element_at(F.when(F.size("sources") > 0, F.col("sources")), 1)).alias("source"))
    return found.join(first, "md5", "left").groupBy("split", "source", "overlap").agg(F.count(F.lit(1)).alias("n_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.torn_groups(table(spark, d, "metadata"), F.coalesce("song_id", "md5"))


def p5_assigned(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign(table(spark, d, "metadata"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return linkage.groups(table(spark, d, "signatures_ext"))


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    return linkage.clusters(table(spark, d, "signatures_ext"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p8_filled(spark: SparkSession, d: str) -> DataFrame:
    return containers.fill(tokens.token_counts(table(spark, d, "documents")))


def p8_summary(spark: SparkSession, d: str) -> DataFrame:
    return containers.summary(tokens.token_counts(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return visual.look_alikes(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return visual.alike_classes(table(spark, d, "documents"))


def p9_form(spark: SparkSession, d: str) -> DataFrame:
    return visual.one_form(table(spark, d, "documents"))


def _together(*parts: DataFrame) -> DataFrame:
    """What breaks a rule: rule, item."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _broken(df: DataFrame, rule: str, item: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(item).cast("string").alias("item"))


def p4_violations(spark: SparkSession, d: str) -> DataFrame:
    """Of p4_overlap: shares outside 0 to 1; evaluation files with a record that training has word for word but a share below 1."""
    got = written(p4_overlap(spark, d), "overlaps")
    rows = table(spark, d, "metadata").select("md5", splits.split_name().alias("split"), overlap.normalised(MUSIC).alias("record")).filter("md5 is not null and split is not null")
    train = rows.filter("split = 'train'").select(F.md5("record").alias("digest")).distinct()
    same = rows.filter("split in ('val', 'test')").select("md5", "split", F.md5("record").alias("digest")).join(train, "digest", "left_semi").select(F.col("md5").alias("key"), "split").distinct()
    return _together(_broken(got.filter("overlap is null or overlap < 0 or overlap > 1"), "share", "key"), _broken(same.join(got, ["key", "split"], "left").filter("overlap is null or overlap < 1"), "same record", "key"))


def p5_violations(spark: SparkSession, d: str) -> DataFrame:
    """Of p5_assigned: files or songs in two splits, files without one, and splits whose share of the rows is off by more than half a point, overall or for a label of at least a tenth of the rows by more than two."""
    got = written(p5_assigned(spark, d), "assigned")
    torn = [_broken(got.filter(F.col(c).isNotNull()).groupBy(c).agg(F.countDistinct("split").alias("n")).filter("n > 1"), f"torn {c}", c) for c in ("md5", "song_id")]
    rows = table(spark, d, "metadata").filter("md5 is not null").select("md5", "song_id", "time_signature")
    where = rows.join(got.groupBy("md5").agg(F.min("split").alias("split")), "md5", "left")
    want = F.when(F.col("split") == "train", 0.8).otherwise(0.1)
    share = where.groupBy("split").agg((F.count(F.lit(1)) / F.lit(max(1, rows.count()))).alias("share")).filter(F.abs(F.col("share") - want) > 0.005)
    by = where.groupBy("time_signature", "split").agg(F.count(F.lit(1)).alias("n"))
    total = by.groupBy("time_signature").agg(F.sum("n").alias("all")).filter(F.col("all") * 10 >= rows.count())
    label = by.join(total, "time_signature").filter(F.abs(F.col("n") / F.col("all") - want) > 0.02)
    return _together(*torn, _broken(where.filter("split is null"), "no split", "md5"), _broken(share, "share", "split"), _broken(label, "label", "time_signature"))


def p6_violations(spark: SparkSession, d: str) -> DataFrame:
    """Of p6_clusters: sizes other than the number of members, members or representatives outside, clusters across the chains of p6_found."""
    signatures = table(spark, d, "signatures_ext")
    members = written(linkage.cluster_members(signatures), "cluster-members")
    got = written(p6_clusters(spark, d), "clusters")
    sizes = members.groupBy("cluster_md5").agg(F.count(F.lit(1)).alias("n"), F.min("md5").alias("least"))
    wrong = got.join(sizes, "cluster_md5", "full").filter("size is null or n is null or size <> n or least <> cluster_md5")
    reps = got.select("cluster_md5", F.explode(F.split("reps", ";")).alias("md5")).join(members, ["cluster_md5", "md5"], "left_anti")
    groups = members.join(linkage.groups(signatures, smallest=2), "md5", "left").groupBy("cluster_md5").agg(F.count_distinct(F.coalesce("group_md5", F.lit(""))).alias("n"), F.max(F.col("group_md5").isNull()).alias("out"))
    twice = members.groupBy("md5").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _together(_broken(wrong, "size", "cluster_md5"), _broken(reps, "rep", "md5"), _broken(groups.filter("n > 1 or out"), "across", "cluster_md5"), _broken(twice, "twice", "md5"))


def p8_violations(spark: SparkSession, d: str) -> DataFrame:
    """Of p8_filled: containers that overflow, overlap or have gaps, texts not placed whole, short texts that were cut."""
    counts = written(tokens.token_counts(table(spark, d, "documents")), "counts")
    got = written(containers.fill(counts), "filled")
    boxes = got.groupBy("container_id").agg(F.sum("n_units").alias("n"), F.max(F.col("at") + F.col("n_units")).alias("end"), F.min("at").alias("begin"), F.count_distinct("at").alias("places"), F.count(F.lit(1)).alias("items"))
    texts = got.groupBy("doc_id").agg(F.sum("n_units").alias("placed"), F.count(F.lit(1)).alias("parts"), F.max(F.col("first_unit") + F.col("n_units")).alias("end"), F.count_distinct("first_unit").alias("starts"))
    each = counts.join(texts, "doc_id", "left").withColumn("placed", F.coalesce("placed", F.lit(0)))
    wrong = each.filter("placed <> n_tokens or (n_tokens <= 2048 and parts > 1) or end <> n_tokens or starts <> parts")
    return _together(_broken(boxes.filter("n > 2048 or end <> n or begin <> 0 or places <> items"), "container", "container_id"), _broken(wrong, "text", "doc_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_survivors, p3_found, p4_found, p4_overlap, p4_report, p5_found, p5_assigned, p6_found, p6_clusters, p7_ids, p8_filled, p8_summary, p9_found, p9_classes, p9_form, p4_violations, p5_violations, p6_violations, p8_violations)}
SQL: dict[str, str] = {}

_MEMBERS = """
bounds AS (SELECT column_name AS c, lo, hi FROM column_baseline),
good AS (
  SELECT song_id, md5, loaded_at,
    CASE WHEN NOT isnan(bpm) AND bpm BETWEEN (SELECT lo FROM bounds WHERE c = 'bpm') AND (SELECT hi FROM bounds WHERE c = 'bpm') THEN bpm END AS bpm,
    CASE WHEN NOT isnan(note_density) AND note_density BETWEEN (SELECT lo FROM bounds WHERE c = 'note_density') AND (SELECT hi FROM bounds WHERE c = 'note_density') THEN note_density END AS note_density,
    CASE WHEN NOT isnan(duration_sec) AND duration_sec BETWEEN (SELECT lo FROM bounds WHERE c = 'duration_sec') AND (SELECT hi FROM bounds WHERE c = 'duration_sec') THEN duration_sec END AS duration_sec,
    CASE WHEN regexp_full_match(time_signature, '[1-9][0-9]?/(1|2|4|8|16|32|64)') THEN time_signature END AS time_signature
  FROM metadata WHERE song_id IS NOT NULL AND md5 IS NOT NULL),
c AS (SELECT *, (bpm IS NOT NULL)::INT + (note_density IS NOT NULL)::INT + (duration_sec IS NOT NULL)::INT + (time_signature IS NOT NULL)::INT AS complete FROM good),
latest AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY song_id, md5 ORDER BY loaded_at DESC NULLS LAST, complete DESC, bpm DESC NULLS LAST, note_density DESC NULLS LAST, duration_sec DESC NULLS LAST, time_signature DESC NULLS LAST) = 1),
trust AS (SELECT md5, max(n_copies) AS trust FROM manifest GROUP BY md5),
m AS (SELECT latest.*, coalesce(trust, 0) AS trust FROM latest LEFT JOIN trust USING (md5)),
e AS (
  SELECT song_id, md5, complete, trust, loaded_at, 'record' AS column_name, md5 AS v FROM m
  UNION ALL SELECT song_id, md5, complete, trust, loaded_at, 'bpm', bpm::VARCHAR FROM m WHERE bpm IS NOT NULL
  UNION ALL SELECT song_id, md5, complete, trust, loaded_at, 'note_density', note_density::VARCHAR FROM m WHERE note_density IS NOT NULL
  UNION ALL SELECT song_id, md5, complete, trust, loaded_at, 'duration_sec', duration_sec::VARCHAR FROM m WHERE duration_sec IS NOT NULL
  UNION ALL SELECT song_id, md5, complete, trust, loaded_at, 'time_signature', time_signature FROM m WHERE time_signature IS NOT NULL),
best AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY song_id, column_name ORDER BY complete DESC, trust DESC, loaded_at DESC NULLS LAST, md5) = 1),
several AS (SELECT song_id FROM metadata WHERE song_id IS NOT NULL AND md5 IS NOT NULL GROUP BY song_id HAVING count(DISTINCT md5) > 1)
"""
SQL["p2_found"] = f"WITH {_MEMBERS} SELECT song_id, column_name, md5 FROM best WHERE song_id IN (FROM several)"
SQL["p2_survivors"] = f"""
WITH {_MEMBERS} SELECT song_id, max(v) FILTER (column_name = 'record') AS md5, (max(v) FILTER (column_name = 'bpm'))::DOUBLE AS bpm, (max(v) FILTER (column_name = 'note_density'))::DOUBLE AS note_density,
  (max(v) FILTER (column_name = 'duration_sec'))::DOUBLE AS duration_sec, max(v) FILTER (column_name = 'time_signature') AS time_signature, 1 AS is_canonical
FROM best WHERE song_id IN (FROM several) GROUP BY song_id"""

_SPLIT = r"CASE lower(regexp_replace(split, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')) WHEN 'training' THEN 'train' WHEN 'validation' THEN 'val' WHEN 'testing' THEN 'test' WHEN '' THEN NULL ELSE lower(regexp_replace(split, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')) END"
SQL["p5_found"] = f"SELECT coalesce(song_id, md5) AS grp FROM metadata WHERE coalesce(song_id, md5) IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_SPLIT}) > 1"

SQL |= {f"p{n}_violations": "SELECT '' AS rule, '' AS item WHERE false" for n in (4, 5, 6, 8)}

# Every pair of vectors is compared: for small tables.
_VECTORS = """
usable AS (SELECT md5, built_at, list_transform(vec, lambda x: x::DOUBLE) AS v FROM signatures_ext WHERE md5 IS NOT NULL AND len(vec) = 88 AND len(list_filter(vec, lambda x: x IS NOT NULL AND isfinite(x))) = 88 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
vectors AS MATERIALIZED (SELECT md5, v, sqrt(list_dot_product(v, v)) AS len FROM (SELECT md5, arg_max(v, coalesce(built_at, TIMESTAMP '0001-01-01')) AS v FROM usable GROUP BY md5) x),
alike AS MATERIALIZED (SELECT a.md5 AS a, b.md5 AS b, round(list_dot_product(a.v, b.v) / sqrt(a.len * a.len * b.len * b.len), 12) AS s FROM vectors a JOIN vectors b ON a.md5 < b.md5 WHERE s >= {least})
"""
SQL["p3_found"] = f"""
WITH {_VECTORS.format(least=0.95)}, ways AS (SELECT a, b, s FROM alike UNION ALL SELECT b, a, s FROM alike),
near AS (SELECT a, b FROM ways QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS md5_a, greatest(a, b) AS md5_b FROM near"""
SQL["p6_found"] = f"""
WITH RECURSIVE {_VECTORS.format(least=0.78)}, e AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike),
r(node, label) AS (SELECT a, min(least(a, b)) FROM e GROUP BY a UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node WHERE r.label < e.b),
l AS (SELECT node AS md5, min(label) AS group_md5 FROM r GROUP BY node)
SELECT md5, group_md5 FROM l WHERE group_md5 IN (SELECT group_md5 FROM l GROUP BY group_md5 HAVING count(*) >= 3)"""
SQL["p4_found"] = f"""
WITH {_VECTORS.format(least=0.99)}, m AS (SELECT md5, song_id, {_SPLIT} AS s FROM metadata WHERE md5 IS NOT NULL),
train AS (SELECT DISTINCT md5 FROM m WHERE s = 'train'), q AS (SELECT DISTINCT md5, s AS split FROM m WHERE s IN ('val', 'test')),
songs AS (SELECT DISTINCT x.md5, x.song_id FROM m x JOIN train USING (md5) WHERE x.song_id IS NOT NULL), tsongs AS (SELECT song_id, min(md5) AS lo, max(md5) AS hi FROM m WHERE s = 'train' AND song_id IS NOT NULL GROUP BY song_id),
ways AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike)
SELECT md5, split, 'same_file' AS overlap FROM q WHERE md5 IN (FROM train)
UNION ALL SELECT DISTINCT q.md5, q.split, 'same_song' FROM q JOIN (SELECT DISTINCT md5, song_id FROM m WHERE song_id IS NOT NULL) k ON k.md5 = q.md5 JOIN tsongs t ON t.song_id = k.song_id WHERE t.lo <> q.md5 OR t.hi <> q.md5
UNION ALL SELECT DISTINCT q.md5, q.split, 'near' FROM q JOIN ways w ON w.a = q.md5 WHERE w.b IN (FROM train)"""
