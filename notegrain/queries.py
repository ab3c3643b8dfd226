"""Queries of the core: name -> function of the session and the tables' folder; SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from notegrain.functions import forms, melody, pitch, rhythm, whole
from notegrain.operators import catalog, corners, iterate, profile, sampling, search, space
from notegrain.operators.components import components
from notegrain.plans.ops import Binding, Op, bound
from notegrain.plans.shared import dropped, released, table, written
from notegrain.sources import roundtrips
from notegrain.sources.bindings import BINDINGS
from notegrain.streaming import live


# the test vectors lie further apart than signatures do
BLEND = {"low": -0.3, "high": 0.75, "radius": 0.3, "coherent": 0.3}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.departures(table(spark, d, "metadata"), table(spark, d, "column_baseline"))


def p1_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.load_profile(table(spark, d, "metadata"), table(spark, d, "column_baseline"))


def _unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(BINDINGS["sig"].sql, embeddings=table(spark, d, "embeddings"))


def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    return iterate.kmeans(_unit_vectors(spark, d))


def neighbour_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the links from every fiftieth vector to its three nearest."""
    near = BINDINGS["near"].build(spark, d).filter("rn <= 3")
    return components(near.select(F.col("q").alias("a"), "b")).select(F.col("node").alias("vec_id"), F.col("label").alias("group"))


def empty_blends(spark: SparkSession, d: str) -> DataFrame:
    return search.empty_blends(_unit_vectors(spark, d), low=BLEND["low"], high=BLEND["high"], radius=BLEND["radius"], coherent=BLEND["coherent"], top=100)


def mutual_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return iterate.mutual_duplicates(_unit_vectors(spark, d))


def ridge_predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "metadata").groupBy("md5").agg(*[F.max(c).alias(c) for c in ("n_tracks", "n_distinct_patches", "n_notes")])
    return iterate.ridge_predictions(rows, "md5", ["n_tracks", "n_distinct_patches"], "n_notes")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    """Event times carry no zone; the session's is UTC."""
    stream = live.follow(spark, d, table(spark, d, "events").schema, "events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    got = live.drain(live.counters(_event_stream(spark, d), "ts", ["event_type"], "value"), "complete")
    return got.select(F.col("at").cast("timestamp_ntz").alias("at"), "event_type", "n", F.round("total", 6).alias("total"))


def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    return live.upserted(_event_stream(spark, d).select("user_id", "event_id", "event_type"), "user_id", "event_id")


def stream_unseen(spark: SparkSession, d: str) -> DataFrame:
    return live.drain(live.unseen(_event_stream(spark, d), "event_id", "ts", "400 days")).select("event_id")


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user and kind of event; a last row per group, later than the watermark, closes them."""
    got = live.drain(live.sessions(_event_stream(spark, d), "ts", ["user_id", "event_type"], "30 minutes"), "complete")
    return got.select(F.col("at").cast("timestamp_ntz").alias("at"), F.col("ends").cast("timestamp_ntz").alias("ends"), "user_id", "event_type", "n")


def stream_restarted(spark: SparkSession, d: str) -> DataFrame:
    """Events that arrive in four files, one run of the stream a file, each going on from the checkpoint: no event twice, none lost."""
    return live.restarted(table(spark, d, "events").select("event_id", "user_id", "value"), "event_id", 4)


def plane(spark: SparkSession, d: str) -> DataFrame:
    return iterate.plane(_unit_vectors(spark, d))


def plane_axes(spark: SparkSession, d: str) -> DataFrame:
    """Of the plane: mean and mean product of its coordinates, which are 0 for the means and for the product of the two."""
    p = iterate.plane(_unit_vectors(spark, d))
    return p.agg(F.round(F.abs(F.avg("x")), 6).alias("x_mean"), F.round(F.abs(F.avg("y")), 6).alias("y_mean"), F.round(F.abs(F.avg(F.col("x") * F.col("y"))), 6).alias("xy"), (F.var_pop("x") >= F.var_pop("y")).alias("ordered"), F.count(F.lit(1)).alias("n"))


def boosted_predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "metadata").groupBy("md5").agg(*[F.max(c).alias(c) for c in ("n_tracks", "n_distinct_patches", "has_drums", "n_notes")])
    return iterate.boosted_predictions(rows, "md5", ["n_tracks", "n_distinct_patches", "has_drums"], "n_notes")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_profile, kmeans_clusters, neighbour_components, empty_blends, mutual_duplicates, ridge_predictions, stream_hourly, stream_latest, stream_unseen, stream_sessions, stream_restarted, plane, plane_axes, boosted_predictions)}
SQL: dict[str, str] = {}

_LONG = """
long AS (
  SELECT load_id, 'bpm' AS column_name, CASE WHEN isnan(bpm) THEN NULL ELSE bpm END AS num, NULL::VARCHAR AS txt FROM metadata
  UNION ALL SELECT load_id, 'note_density', CASE WHEN isnan(note_density) THEN NULL ELSE note_density END, NULL FROM metadata
  UNION ALL SELECT load_id, 'duration_sec', CASE WHEN isnan(duration_sec) THEN NULL ELSE duration_sec END, NULL FROM metadata
  UNION ALL SELECT load_id, 'time_signature', NULL, time_signature FROM metadata),
flagged AS (
  SELECT l.*, b.lo, b.hi, b.q1, b.q2, b.q3, b.missing_share, b.top_value, b.top_share,
    CASE WHEN column_name = 'time_signature' THEN txt IS NULL OR regexp_full_match(txt, '[\\s\\pZ]*') ELSE num IS NULL END AS missing,
    CASE WHEN column_name = 'time_signature' THEN regexp_full_match(txt, '[1-9][0-9]?/(1|2|4|8|16|32|64)') ELSE num BETWEEN lo AND hi END AS fits
  FROM long l LEFT JOIN column_baseline b USING (column_name)),
f AS (SELECT *, NOT missing AND coalesce(fits, false) AS acceptable, NOT missing AND NOT coalesce(fits, false) AS outside FROM flagged)
"""

SQL["p1_found"] = f"""
WITH {_LONG},
most AS (SELECT load_id, column_name, max(n) AS most FROM (SELECT load_id, column_name, num, count(*) AS n FROM f WHERE acceptable AND num IS NOT NULL GROUP BY ALL) GROUP BY ALL),
s AS (
  SELECT load_id, column_name, count(*) AS n, count(*) FILTER (missing) AS missing, count(*) FILTER (acceptable) AS fit, count(*) FILTER (outside) AS outside,
    count(*) FILTER (acceptable AND txt = top_value) AS top, any_value(missing_share) AS missing_share, any_value(top_share) AS top_share,
    any_value(q1) AS q1, any_value(q2) AS q2, any_value(q3) AS q3,
    quantile_cont(num, 0.25) FILTER (acceptable) AS x1, quantile_cont(num, 0.5) FILTER (acceptable) AS x2, quantile_cont(num, 0.75) FILTER (acceptable) AS x3
  FROM f GROUP BY load_id, column_name),
r AS (SELECT s.*, most.most, column_name = 'time_signature' AS is_text FROM s LEFT JOIN most USING (load_id, column_name))
SELECT load_id, column_name, 'missing' AS finding FROM r WHERE missing::DOUBLE / n - missing_share > 0.10
UNION ALL SELECT load_id, column_name, CASE WHEN is_text THEN 'pattern' ELSE 'range' END FROM r WHERE outside > 0
UNION ALL SELECT load_id, column_name, 'drift' FROM r WHERE CASE WHEN is_text THEN fit > 0 AND abs(top::DOUBLE / fit - top_share) > 0.20
  ELSE x1 > q1 * 1.5 OR q1 > x1 * 1.5 OR x2 > q2 * 1.5 OR q2 > x2 * 1.5 OR x3 > q3 * 1.5 OR q3 > x3 * 1.5 END
UNION ALL SELECT load_id, column_name, 'constant' FROM r WHERE NOT is_text AND most > fit * 0.5
"""

SQL["p1_profile"] = f"""
WITH {_LONG},
s AS (
  SELECT load_id, column_name, count(*) AS n_rows, count(*) FILTER (missing) AS n_missing, count(*) FILTER (outside) AS n_violations,
    count(DISTINCT coalesce(txt, num::VARCHAR)) FILTER (NOT missing) AS n_distinct, min(num) AS min_value, max(num) AS max_value,
    count(*) FILTER (acceptable) AS k, sum((CASE WHEN acceptable THEN num END)::DECIMAL(18,6))::DOUBLE AS s1, sum((CASE WHEN acceptable THEN num * num END)::DECIMAL(22,6))::DOUBLE AS s2
  FROM f GROUP BY load_id, column_name),
t AS (SELECT *, sum(k) OVER w - k AS rk, sum(s1) OVER w - s1 AS r1, sum(s2) OVER w - s2 AS r2 FROM s WINDOW w AS (PARTITION BY column_name)),
u AS (SELECT *, sqrt(greatest(0, r2 / rk - (r1 / rk) * (r1 / rk))) AS others FROM t)
SELECT load_id, column_name, n_rows, n_missing, n_violations, n_distinct, min_value, max_value,
  round(CASE WHEN k > 0 THEN s1 / k END, 4) AS mean_value, round(CASE WHEN k > 0 THEN sqrt(greatest(0, s2 / k - (s1 / k) * (s1 / k))) END, 4) AS std_value,
  round(CASE WHEN k > 0 AND rk > 0 AND others > 0 THEN (s1 / k - r1 / rk) / others END, 4) AS shift
FROM u
"""

SQL["stream_hourly"] = "SELECT date_trunc('hour', ts) AS at, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"
SQL["stream_latest"] = "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id"
SQL["stream_restarted"] = "SELECT event_id, user_id, value FROM events"
SQL["stream_sessions"] = """
WITH e AS (SELECT user_id, event_type, ts, ts - lag(ts) OVER o >= INTERVAL 30 MINUTE AS apart FROM events WINDOW o AS (PARTITION BY user_id, event_type ORDER BY ts)),
s AS (SELECT user_id, event_type, ts, count(*) FILTER (coalesce(apart, true)) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS k FROM e)
SELECT min(ts) AS at, max(ts) + INTERVAL 30 MINUTE AS ends, user_id, event_type, count(*) AS n FROM s GROUP BY user_id, event_type, k"""
SQL["plane_axes"] = "SELECT 0.0::DOUBLE AS x_mean, 0.0::DOUBLE AS y_mean, 0.0::DOUBLE AS xy, true AS ordered, count(*) AS n FROM embeddings"
SQL["stream_unseen"] = "SELECT DISTINCT event_id FROM events"
_SIG = BINDINGS["sig"].check.format(embeddings="embeddings")
_NEAR = BINDINGS["near"].check.format(sig="sig")
SQL["neighbour_components"] = f"""
WITH RECURSIVE sig AS ({_SIG}), near AS ({_NEAR}), e AS (SELECT q AS a, b FROM near WHERE rn <= 3 UNION SELECT b, q FROM near WHERE rn <= 3),
r(node, label) AS (SELECT a, a FROM e UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node WHERE r.label < e.b)
SELECT node AS vec_id, min(label) AS "group" FROM (SELECT node, label FROM r UNION ALL SELECT a, a FROM e) x GROUP BY node"""
_UNIT_SUM = "list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))"
_MEAN = "SELECT {by}, count(*) AS size, [{sums}] AS v FROM {rows} GROUP BY {by}"
_SUMS = ", ".join(f"sum(v[{i + 1}])" for i in range(64))
SQL["empty_blends"] = f"""
WITH sig AS ({_SIG}), c AS MATERIALIZED (SELECT label::BIGINT AS label, size, {_UNIT_SUM} AS v FROM ({_MEAN.format(by="label", sums=_SUMS, rows="sig")}) s),
k AS (SELECT * FROM c WHERE size >= (SELECT median(size) FROM c)),
p AS (SELECT a.label AS a, b.label AS b, round(list_dot_product(a.v, b.v), 9) AS pair_sim, list_transform(range(64), lambda i: a.v[i + 1] + b.v[i + 1]) AS v FROM k a JOIN k b ON a.label < b.label),
m AS MATERIALIZED (SELECT a, b, pair_sim, {_UNIT_SUM} AS v FROM p WHERE pair_sim BETWEEN {BLEND["low"]} AND {BLEND["high"]}),
s AS (SELECT m.a, m.b, m.pair_sim, round(list_dot_product(m.v, sig.v), 9) AS sim FROM m, sig)
SELECT a, b, round(max(pair_sim), 6) AS pair_sim, count(*) FILTER (sim >= {BLEND["radius"]}) AS population, round(max(sim), 6) AS nearest_sim FROM s GROUP BY a, b HAVING max(sim) >= {BLEND["coherent"]}
ORDER BY population, max(sim) DESC, a, b LIMIT 100"""
SQL["mutual_duplicates"] = f"""
WITH RECURSIVE sig AS ({_SIG}),
w AS (SELECT vec_id, {_UNIT_SUM} AS v, list_transform(list_slice(list_reverse_sort(list_transform(range(12), lambda i: {{'x': v[i + 1], 'i': i}})), 1, 4), lambda e: e.i) AS same FROM sig WHERE len(list_filter(v[1:12], lambda x: x > 0)) >= 5),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 9) AS sim FROM w a JOIN w b ON a.same = b.same AND a.vec_id <> b.vec_id),
n AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM p WHERE sim >= 0.985) x WHERE r < 12),
e AS (SELECT n.a, n.b FROM n JOIN n AS o ON o.a = n.b AND o.b = n.a),
r(node, label) AS (SELECT a, a FROM e UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node WHERE r.label < e.b),
l AS (SELECT node, min(label) AS label FROM (SELECT node, label FROM r UNION ALL SELECT a, a FROM e) x GROUP BY node),
k AS (SELECT node, label FROM l WHERE label IN (SELECT label FROM l GROUP BY label HAVING count(*) <= 50))
SELECT sig.vec_id, coalesce(k.label, sig.vec_id) AS "group" FROM sig LEFT JOIN k ON k.node = sig.vec_id"""


def _kmeans_sql(k: int = 16, rounds: int = 5) -> str:
    parts = [f"sig AS MATERIALIZED ({_SIG})", f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY md5(vec_id::VARCHAR || '|kmeans'), vec_id) - 1)::INT AS cluster, v FROM sig ORDER BY cluster LIMIT {k})"]
    scored = "SELECT s.vec_id, s.v, c.cluster, round(list_dot_product(s.v, c.v), 9) AS sim FROM sig s, c{r} c QUALIFY row_number() OVER (PARTITION BY s.vec_id ORDER BY sim DESC, cluster) = 1"
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({scored.format(r=r)})")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT cluster, {_UNIT_SUM} AS v FROM ({_MEAN.format(by='cluster', sums=_SUMS, rows=f'a{r}')}) s) n USING (cluster))")
    return f"WITH {', '.join(parts)} SELECT vec_id, cluster, sim FROM ({scored.format(r=rounds)}) x"


SQL["kmeans_clusters"] = _kmeans_sql()
SQL["ridge_predictions"] = """
WITH m AS (SELECT md5, max(n_tracks)::DOUBLE AS x, max(n_distinct_patches)::DOUBLE AS z, max(n_notes)::DOUBLE AS y FROM metadata GROUP BY md5),
c AS (SELECT avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM m WHERE x + y + z IS NOT NULL),
s AS (SELECT sum((x - mx) * (x - mx)) + 300 AS xx, sum((z - mz) * (z - mz)) + 300 AS zz, sum((x - mx) * (z - mz)) AS xz, sum((x - mx) * (y - my)) AS xy, sum((z - mz) * (y - my)) AS zy FROM m, c WHERE x + y + z IS NOT NULL),
w AS (SELECT (xy * zz - zy * xz) / (xx * zz - xz * xz) AS a, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b FROM s)
SELECT md5, round(my - a * mx - b * mz + a * x + b * z, 6) AS predicted FROM m, c, w WHERE x IS NOT NULL AND z IS NOT NULL"""

QUERIES |= roundtrips.QUERIES
SQL |= roundtrips.SQL
OPS = {op.name: op for family in (pitch, rhythm, melody, forms, catalog, sampling, space, whole, corners) for op in family.OPS}
_KEPT: dict[tuple[str, str], DataFrame] = {}


def _features(spark: SparkSession, d: str) -> DataFrame:
    """Every operator's columns in long form, written one after another: each is computed once a process, in a plan of its own, and its shuffle files go before the next one's; the notes go at the end."""
    if (spark.sparkContext.applicationId, d) in _KEPT:
        return _KEPT[spark.sparkContext.applicationId, d]
    notes = written(bound(Op("notes", "SELECT * FROM {notes}"), BINDINGS)[0](spark, d), "notes")
    inner, parts = {**BINDINGS, "notes": Binding("", build=lambda *_: notes)}, []
    for text in whole.FEATURES:
        parts.append(written(bound(Op("part", text), inner)[0](spark, d).selectExpr("song", "CAST(dim AS INT) AS dim", "x"), "features"))
        released(spark)
    dropped(notes)
    _KEPT[spark.sparkContext.applicationId, d] = reduce(DataFrame.unionByName, parts)
    return _KEPT[spark.sparkContext.applicationId, d]


def _signature_table(spark: SparkSession, d: str) -> DataFrame:
    return written(bound(OPS["signature88"], BINDINGS)[0](spark, d), "signatures")


BINDINGS |= whole.BINDINGS | corners.BINDINGS
BINDINGS["features"] = Binding("", " UNION ALL ".join(whole.FEATURES), build=_features)
BINDINGS["sig88"] = Binding("", OPS["signature88"].sql, build=_signature_table)
for _op in OPS.values():  # an operator's result as another one's input, over notes, drums or the archetypes' drums
    for _name, _from, _to in (("of", "", ""), ("kit", "{notes}", "{drums}"), ("type", "{drums}", "{archetypes}")):
        BINDINGS[f"{_name}_{_op.name}"] = Binding(_op.sql.replace(_from, _to), _op.check and _op.check.replace(_from, _to)) if _from else Binding(_op.sql, _op.check)
for _op in OPS.values():
    QUERIES[_op.name], SQL[_op.name] = bound(_op, BINDINGS)
