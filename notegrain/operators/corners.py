"""Clusters described, corners scored, pools filled, the map's points, references between texts."""

from dataclasses import replace

from notegrain.operators.sampling import _drawn
from notegrain.plans.ops import Binding, Op

NUMERIC = ("bpm", "note_density", "duration_sec", "n_tracks", "n_notes", "has_drums", "n_distinct_patches", "pitch_min", "pitch_max", "n_distinct_chords", "avg_vel", "tempo_change_count", "lyric_events_count", "arrangement_rank")
FLAGS = {"drums": "has_drums = 1", "canonical": "is_canonical = 1", "lyrics": "lyric_events_count > 0", "constant_tempo": "tempo_change_count <= 1", "four_four": "time_signature = '4/4'"}
MODES = ("time_signature", "split", "load_id", "n_tracks", "song_id")

BINDINGS = {
    # predictions of every file, and what the gate asks of it; numbers of the catalog stand in for both
    "predictions": Binding("SELECT md5, round((8 * n_tracks + has_drums + n_distinct_patches) / 10e0, 6) AS love, CAST(n_distinct_chords % 10 AS DOUBLE) / 10e0 AS diatonic, CASE WHEN n_tracks > 1 THEN 1 ELSE 0 END AS has_melody, CAST(n_notes % 97 AS DOUBLE) AS unc, CAST(n_distinct_patches AS DOUBLE) AS prox, CAST(n_notes AS DOUBLE) AS groove, CASE WHEN load_id % 4 = 0 THEN 1 ELSE 0 END AS rated FROM {catalog}"),
    # records of labelled values by position: some in another order, some cut short, some null
    "records": Binding(
        "SELECT md5, load_id, CASE WHEN load_id % 7 = 0 THEN array(named_struct('label', 'n_notes', 'value', n_notes), named_struct('label', 'n_tracks', 'value', n_tracks)) WHEN load_id % 5 = 0 THEN array(named_struct('label', 'n_tracks', 'value', n_tracks)) WHEN load_id % 3 > 0 THEN array(named_struct('label', 'n_tracks', 'value', n_tracks), named_struct('label', 'n_notes', 'value', n_notes)) END AS record FROM {metadata}",
        "SELECT md5, load_id, CASE WHEN load_id % 7 = 0 THEN [{{'label': 'n_notes', 'value': n_notes}}, {{'label': 'n_tracks', 'value': n_tracks}}] WHEN load_id % 5 = 0 THEN [{{'label': 'n_tracks', 'value': n_tracks}}] WHEN load_id % 3 > 0 THEN [{{'label': 'n_tracks', 'value': n_tracks}}, {{'label': 'n_notes', 'value': n_notes}}] END AS record FROM {metadata}",
    ),
    "members": Binding("SELECT md5, max(cluster_id) AS cluster_id FROM {clusters} GROUP BY md5"),
}


def _cluster_profile() -> Op:
    medians = ", ".join(f"round(median(CASE WHEN c.{x} < 1e9 THEN c.{x} END), 6) AS {x}_med" for x in NUMERIC)
    flags = ", ".join(f"round(avg(CASE WHEN {w} THEN 1e0 ELSE 0e0 END), 6) AS {n}_share" for n, w in FLAGS.items())
    long = " UNION ALL ".join(f"SELECT cluster_id, '{x}' AS f, CAST({x} AS <TEXT>) AS v FROM j" for x in MODES)
    modes = ", ".join(f"max(CASE WHEN f = '{x}' THEN v END) AS {x}_mode, CAST(max(CASE WHEN f = '{x}' THEN n END) AS BIGINT) AS {x}_count" for x in MODES)
    names = ", ".join(f"m.{x}_mode, m.{x}_count" for x in MODES)
    sql = (
        f"WITH j AS (SELECT k.cluster_id, c.* FROM {{members}} k JOIN {{catalog}} c ON c.md5 = k.md5 WHERE k.cluster_id >= 0), a AS (SELECT cluster_id, count(*) AS size, {medians}, {flags} FROM j c GROUP BY cluster_id), "
        f"t AS (SELECT cluster_id, f, v, count(*) AS n FROM ({long}) u WHERE v IS NOT NULL GROUP BY cluster_id, f, v), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, f ORDER BY n DESC, v) AS rn FROM t), m AS (SELECT cluster_id, {modes} FROM r WHERE rn = 1 GROUP BY cluster_id) "
        f"SELECT a.*, {names} FROM a LEFT JOIN m ON m.cluster_id = a.cluster_id"
    )
    return Op("cluster_profile", sql.replace("<TEXT>", "STRING"), "size, fourteen medians, five shares, five modes with their counts", sql.replace("<TEXT>", "VARCHAR"))


_BEAUTY = Op(
    "corner_beauty",
    "WITH e AS (SELECT cluster_id, pos, md5 FROM (SELECT cluster_id, posexplode(split(reps, ';')) AS (pos, md5) FROM {cluster_summary} WHERE reps IS NOT NULL) x WHERE pos < 3), s AS (SELECT e.cluster_id, round(avg(p.love), 6) AS pred_love, max(CASE WHEN p.diatonic >= 6e-1 AND p.has_melody = 1 THEN 1 ELSE 0 END) AS beauty, round(avg(CASE WHEN p.diatonic >= 6e-1 AND p.has_melody = 1 THEN 1e0 ELSE 0e0 END), 6) AS beauty_share FROM e JOIN {predictions} p ON p.md5 = e.md5 GROUP BY e.cluster_id) "
    "SELECT cluster_id, pred_love, beauty, beauty_share, row_number() OVER (ORDER BY beauty DESC, pred_love DESC, cluster_id) AS place FROM s",
    "corners by the mean prediction of their three nearest songs, those with a diatonic one that has a melody first; one row a cluster, so one task orders few",
    "WITH e AS (SELECT cluster_id, unnest(string_split(reps, ';')[1:3]) AS md5 FROM {cluster_summary} WHERE reps IS NOT NULL), s AS (SELECT e.cluster_id, round(avg(p.love), 6) AS pred_love, max(CASE WHEN p.diatonic >= 6e-1 AND p.has_melody = 1 THEN 1 ELSE 0 END) AS beauty, round(avg(CASE WHEN p.diatonic >= 6e-1 AND p.has_melody = 1 THEN 1e0 ELSE 0e0 END), 6) AS beauty_share FROM e JOIN {predictions} p ON p.md5 = e.md5 GROUP BY e.cluster_id) "
    "SELECT cluster_id, pred_love, beauty, beauty_share, row_number() OVER (ORDER BY beauty DESC, pred_love DESC, cluster_id) AS place FROM s",
)


def _hybrid_pool(n: int = 200) -> Op:
    """Each bucket leaves out what the ones before took; only the rows of a bucket that are wanted are ordered (a top-k)."""
    strat, corner, banger, repeat = (round(n * x) for x in (0.60, 0.20, 0.10, 0.05))
    edge = n - strat - corner - banger - repeat
    free = lambda *t: " AND ".join(f"NOT EXISTS (SELECT 1 FROM {x} WHERE {x}.md5 = e.md5)" for x in t)
    sql = (
        "WITH e AS (SELECT c.md5, k.cluster_id, <U> AS u FROM (SELECT md5, n_notes FROM {catalog} WHERE bpm BETWEEN 20 AND 300 AND note_density < 80) c JOIN {members} k ON k.md5 = c.md5 WHERE k.cluster_id >= 0), "
        f"s AS (SELECT md5 FROM (SELECT md5, u, row_number() OVER (PARTITION BY cluster_id ORDER BY u, md5) AS rn FROM e) x WHERE rn = 1 ORDER BY u, md5 LIMIT {strat}), "
        f"iso AS (SELECT cluster_id FROM {{cluster_summary}} WHERE size >= 3 ORDER BY isolation DESC, cluster_id LIMIT 20), c AS (SELECT e.md5 FROM e JOIN iso ON iso.cluster_id = e.cluster_id WHERE {free('s')} ORDER BY e.u, e.md5 LIMIT {corner}), "
        f"b AS (SELECT e.md5 FROM e JOIN {{predictions}} p ON p.md5 = e.md5 WHERE p.love >= 6 AND {free('s', 'c')} ORDER BY e.u, e.md5 LIMIT {banger}), "
        f"lone AS (SELECT cluster_id, isolation FROM {{cluster_summary}} ORDER BY isolation DESC, cluster_id LIMIT 10), g AS (SELECT e.md5 FROM e JOIN lone ON lone.cluster_id = e.cluster_id WHERE {free('s', 'c', 'b')} ORDER BY e.u, e.md5 LIMIT {edge}), "
        f"t AS (SELECT p.md5 FROM {{predictions}} p JOIN e ON e.md5 = p.md5 WHERE p.rated = 1 ORDER BY e.u, e.md5 LIMIT {repeat}), "
        "picked AS (SELECT md5, 'stratified' AS source FROM s UNION ALL SELECT md5, 'corner' FROM c UNION ALL SELECT md5, 'banger' FROM b UNION ALL SELECT md5, 'edge' FROM g UNION ALL SELECT md5, 'repeat' FROM t), "
        f"left_ AS (SELECT {n} - count(*) AS short FROM picked), f AS (SELECT md5, row_number() OVER (ORDER BY u, md5) AS rn FROM (SELECT e.md5, e.u FROM e WHERE {free('s', 'c', 'b', 'g')} ORDER BY e.u, e.md5 LIMIT {n}) y) "
        "SELECT md5, source FROM picked UNION ALL SELECT f.md5, 'stratified_fill' FROM f CROSS JOIN left_ WHERE f.rn <= left_.short"
    )
    return _drawn("hybrid_pool", sql, "60 % one song a cluster, 20 % isolated clusters, 10 % loved, 5 % edges, 5 % repeats, filled up from the rest", "hybrid", "c.md5")


def _active_pool(n: int = 200, repeats: int = 20, forced: int = 8, share: float = 0.3) -> Op:
    empty = int(n * share)
    per = max(1, (n - repeats - forced - empty) // 10)
    sql = (
        "WITH x AS (SELECT min(unc) AS a, max(unc) AS b, min(prox) AS c, max(prox) AS d FROM {predictions}), q AS (SELECT p.md5, p.prox, p.rated, p.groove, round(5e-1 * (p.unc - x.a) / (x.b - x.a + 1e-9) + 5e-1 * (p.prox - x.c) / (x.d - x.c + 1e-9), 9) AS acq FROM {predictions} p CROSS JOIN x), "
        f"f AS (SELECT md5 FROM {{of_love_composite}} ORDER BY love DESC, md5 LIMIT {forced}), "
        f"o AS (SELECT md5 FROM q WHERE rated = 0 AND NOT EXISTS (SELECT 1 FROM f WHERE f.md5 = q.md5) ORDER BY prox DESC, md5 LIMIT {empty}), "
        f"u AS (SELECT q.* FROM q WHERE rated = 0 AND NOT EXISTS (SELECT 1 FROM f WHERE f.md5 = q.md5) AND NOT EXISTS (SELECT 1 FROM o WHERE o.md5 = q.md5)), "
        f"d AS (SELECT u.md5, u.acq, t.decile, row_number() OVER (PARTITION BY t.decile ORDER BY u.acq DESC, u.md5) AS rn FROM u JOIN {{of_decile_qcut}} t ON t.md5 = u.md5), k AS (SELECT md5 FROM d WHERE rn <= {per}), "
        "picked AS (SELECT md5, 'force_top8' AS source FROM f UNION ALL SELECT md5, 'empty' FROM o UNION ALL SELECT md5, 'uncertain' FROM k), "
        f"left_ AS (SELECT {n - repeats} - count(*) AS short FROM picked), m AS (SELECT md5, row_number() OVER (ORDER BY acq DESC, md5) AS rn FROM (SELECT md5, acq FROM u WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.md5 = u.md5) ORDER BY acq DESC, md5 LIMIT {n}) y), "
        f"r AS (SELECT md5 FROM q WHERE rated = 1 ORDER BY groove DESC, md5 LIMIT {repeats}) "
        "SELECT md5, source, 0 AS is_repeat FROM picked UNION ALL SELECT m.md5, 'uncertain', 0 FROM m CROSS JOIN left_ WHERE m.rn <= left_.short UNION ALL SELECT md5, 'repeat', 1 FROM r"
    )
    return Op("active_pool", sql, "forced, near empty corners, uncertain by deciles of groove, topped up, and repeats of rated songs")


_MAP = Op(
    "map_points",
    "WITH s AS (SELECT md5, n_notes, note_density FROM {catalog} WHERE note_density < 1e9), p AS (SELECT percentile(n_notes, 2e-3) AS xl, percentile(n_notes, 998e-3) AS xh, percentile(note_density, 2e-3) AS yl, percentile(note_density, 998e-3) AS yh FROM s), "
    "n AS (SELECT s.md5, greatest(-5e-2, least(105e-2, (s.n_notes - p.xl) / (p.xh - p.xl + 1e-9))) AS x, greatest(-5e-2, least(105e-2, (s.note_density - p.yl) / (p.yh - p.yl + 1e-9))) AS y FROM s CROSS JOIN p) "
    "SELECT k.cluster_id, count(*) AS n, round(avg(n.x), 6) AS x, round(avg(n.y), 6) AS y FROM n JOIN {members} k ON k.md5 = n.md5 WHERE k.cluster_id >= 0 GROUP BY k.cluster_id",
    "corners of the map: the mean place of a cluster's members, places normalised by outer percentiles",
)
_MAP = replace(_MAP, check=_MAP.sql.replace("percentile(", "quantile_cont("))

_REFERENCES = (
    "WITH r AS (SELECT doc_id, lower(substring(name, 1, 12)) AS ref FROM (SELECT doc_id, <EACH> AS name FROM {documents} WHERE text LIKE '%.mid%') e), f AS (SELECT substring(md5, 1, 12) AS ref, min(doc_id) AS doc FROM {documents} WHERE md5 IS NOT NULL GROUP BY substring(md5, 1, 12)), "
    "x AS (SELECT DISTINCT f.doc AS a, r.doc_id AS b FROM r JOIN f ON f.ref = r.ref WHERE f.doc <> r.doc_id), "
    "d AS (SELECT md5, doc_id, CAST(floor(doc_id / 1e3) AS BIGINT) AS k FROM {documents} WHERE md5 IS NOT NULL), g AS (SELECT md5, k, max(doc_id) AS hi FROM d GROUP BY md5, k), h AS (SELECT md5, k, lag(hi) OVER (PARTITION BY md5 ORDER BY k) AS was FROM g), "
    "l AS (SELECT d.doc_id AS b, coalesce(lag(d.doc_id) OVER (PARTITION BY d.md5, d.k ORDER BY d.doc_id), h.was) AS a FROM d JOIN h ON h.md5 = d.md5 AND h.k = d.k) "
    "SELECT a, b, 'EXTRACTED' AS kind FROM x UNION ALL SELECT a, b, 'INFERRED' FROM l WHERE a IS NOT NULL AND NOT EXISTS (SELECT 1 FROM x WHERE x.b = l.b)"
)
_NAMED = "'([0-9a-f]{{12}})[.]mid'"

_FIELDS = "SELECT md5, load_id, CASE WHEN <1>.label = 'n_tracks' THEN <1>.value END AS n_tracks, CASE WHEN <2>.label = 'n_notes' THEN <2>.value END AS n_notes FROM {records}"

OPS = [
    Op("record_fields", _FIELDS.replace("<1>", "try_element_at(record, 1)").replace("<2>", "try_element_at(record, 2)"), "fields of records by position; null where another label stands there or the record ends before", _FIELDS.replace("<1>", "record[1]").replace("<2>", "record[2]")),
    _cluster_profile(),
    _BEAUTY,
    _hybrid_pool(),
    _active_pool(),
    _MAP,
    Op("text_references", _REFERENCES.replace("<EACH>", f"explode(regexp_extract_all(text, {_NAMED}, 1))"), "edges from the first text about a file to texts that name it; of a text that names none, an edge from the one before about the same file", _REFERENCES.replace("<EACH>", f"unnest(regexp_extract_all(text, {_NAMED}, 1))")),
]
