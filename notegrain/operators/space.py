"""Vectors: scaling, cosine search, density, clusters, empty blends, corner scores, ridge propagation."""

from notegrain.plans.ops import Op

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> x * y), CAST(0 AS DOUBLE), (s, z) -> s + z)"


def _vec(name: str, sql: str, what: str) -> Op:
    """<a.v*b.v> is a dot product."""
    import re

    return Op(name, re.sub(r"<([\w.]+)\*([\w.]+)>", lambda m: _DOT.format(a=m[1], b=m[2]), sql), what, re.sub(r"<([\w.]+)\*([\w.]+)>", r"list_dot_product(\1, \2)", sql))


_CENT = "c AS (SELECT label, i, avg(x) AS m FROM {sigl} GROUP BY label, i), n AS (SELECT label, sqrt(sum(m * m)) AS len FROM c GROUP BY label), u AS (SELECT c.label, c.i, c.m / n.len AS x FROM c JOIN n ON n.label = c.label)"

def _set_ratio() -> Op:
    sql = "WITH q AS (SELECT <SH> AS sh), t AS (SELECT song, count(DISTINCT pitch) AS n FROM {notes} GROUP BY song), ref AS (SELECT DISTINCT song AS q, pitch FROM {notes} WHERE song % 50 = 0), rn AS (SELECT q, count(*) AS n FROM ref GROUP BY q), d AS (SELECT DISTINCT song, pitch FROM {notes}), m AS (SELECT d.song, ref.q, q.sh, count(*) AS hit FROM ref CROSS JOIN q JOIN d ON d.pitch = ref.pitch + q.sh GROUP BY d.song, ref.q, q.sh) SELECT m.q, m.song, round(max(CASE WHEN m.hit = rn.n THEN m.hit / CAST(t.n AS DOUBLE) ELSE m.hit / CAST(greatest(t.n, rn.n) AS DOUBLE) END), 6) AS ratio FROM m JOIN t ON t.song = m.song JOIN rn ON rn.q = m.q WHERE m.song <> m.q GROUP BY m.q, m.song"
    shifts = range(-6, 6)
    word = lambda k, low: f"coalesce(bit_or(CASE WHEN sh = {k} AND p BETWEEN {low} AND {low + 63} THEN shiftleft(1L, CAST(p - {low} AS INT)) END), 0L)"
    most = ", ".join(f"bit_count(a.lo{k + 6} & b.lo) + bit_count(a.hi{k + 6} & b.hi)" for k in shifts)
    # The ratio grows with the hits, so the most hits of the twelve shifts decide.
    ratio = "CASE WHEN {hit} = {q} THEN {hit} / CAST({t} AS DOUBLE) ELSE {hit} / CAST(greatest({t}, {q}) AS DOUBLE) END"
    # A song's pitches are bits, 64 a word. Targets within 0 to 127 are two words, every query twelve times two; the others (no MIDI pitches) are joined pitch by pitch.
    spark = (
        "WITH w AS (SELECT song, shiftright(CAST(pitch AS BIGINT), 6) AS word, bit_or(shiftleft(1L, CAST(CAST(pitch AS BIGINT) & 63L AS INT))) AS bits FROM {notes} WHERE song IS NOT NULL GROUP BY song, shiftright(CAST(pitch AS BIGINT), 6)), "
        "t AS (SELECT song, coalesce(max(CASE WHEN word = 0 THEN bits END), 0L) AS lo, coalesce(max(CASE WHEN word = 1 THEN bits END), 0L) AS hi, coalesce(sum(bit_count(bits)), 0L) AS n, coalesce(min(word) < 0 OR max(word) > 1, false) AS odd FROM w GROUP BY song), "
        "s AS (SELECT q, pitch + sh AS p, sh FROM (SELECT song AS q, explode(transform(filter(sequence(0, 63), i -> getbit(bits, i) = 1), i -> word * 64 + i)) AS pitch FROM w WHERE song % 50 = 0) x CROSS JOIN (SELECT explode(sequence(-6, 5)) AS sh) y), "
        f"a AS (SELECT c.q, c.n, {', '.join(f'm.lo{k + 6}, m.hi{k + 6}' for k in shifts)} FROM (SELECT song AS q, sum(coalesce(bit_count(bits), 1)) AS n FROM w WHERE song % 50 = 0 GROUP BY song) c JOIN (SELECT q, {', '.join(f'{word(k, 0)} AS lo{k + 6}, {word(k, 64)} AS hi{k + 6}' for k in shifts)} FROM s GROUP BY q) m ON m.q = c.q), "
        "b AS (SELECT /*+ REPARTITION(96) */ song, lo, hi, n FROM t WHERE NOT odd), "
        f"r AS (SELECT /*+ BROADCAST(a) */ a.q, b.song, a.n AS nq, b.n AS nt, greatest({most}) AS hit FROM b JOIN a ON b.song <> a.q), "
        "o AS (SELECT w.song, t.n, explode(transform(filter(sequence(0, 63), i -> getbit(bits, i) = 1), i -> word * 64 + i)) AS pitch FROM w JOIN t ON t.song = w.song AND t.odd), "
        "m AS (SELECT song, q, n, max(hit) AS hit FROM (SELECT o.song, s.q, s.sh, o.n, count(*) AS hit FROM o JOIN s ON s.p = o.pitch WHERE o.song <> s.q GROUP BY o.song, s.q, s.sh, o.n) x GROUP BY song, q, n) "
        f"SELECT q, song, round({ratio.format(hit='hit', q='nq', t='nt')}, 6) AS ratio FROM r WHERE hit > 0 UNION ALL SELECT m.q, m.song, round({ratio.format(hit='m.hit', q='a.n', t='m.n')}, 6) FROM m JOIN a ON a.q = m.q"
    )
    return Op("set_ratio_search", spark, "shared pitches of every fiftieth song with all others over twelve transpositions; a contained query counts against the target only", sql.replace("<SH>", "unnest(range(-6, 6))"))


OPS = [
    Op("scaler_stats", "SELECT i, round(avg(x), 6) AS mu, round(stddev_pop(x), 6) AS sd, round(median(x), 6) AS med, round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM {sigl} GROUP BY i", "per-dimension statistics"),
    Op("scaler_logged", "WITH l AS (SELECT 'bpm' AS col, bpm AS x FROM {catalog} WHERE bpm < 1e9 UNION ALL SELECT 'density', note_density FROM {catalog} WHERE note_density < 1e9 UNION ALL SELECT 'notes', CAST(n_notes AS DOUBLE) FROM {catalog}), f AS (SELECT col, CASE WHEN min(x) >= 0 AND max(x) > 50 THEN 1 ELSE 0 END AS logged FROM l GROUP BY col), g AS (SELECT l.col, f.logged, CASE WHEN f.logged = 1 THEN ln(1e0 + l.x) ELSE l.x END AS x FROM l JOIN f ON f.col = l.col) SELECT col, logged, round(median(x), 6) AS med, round(avg(x), 6) AS mu, round(stddev_pop(x), 6) AS sd FROM g GROUP BY col, logged", "log where nonnegative and wide, then median, mean, deviation"),
    Op("scaled_block", "WITH st AS (SELECT i, avg(x) AS mu, stddev_pop(x) AS sd FROM {sigl} GROUP BY i), z AS (SELECT l.vec_id, l.i, CASE WHEN st.sd <= 1e-12 THEN 0e0 ELSE greatest(-8e0, least(8e0, (l.x - st.mu) / st.sd)) END AS z FROM {sigl} l JOIN st ON st.i = l.i) SELECT vec_id, round(sqrt(sum(z * z)), 4) AS len, round(min(z), 4) AS lo, round(max(z), 4) AS hi FROM z GROUP BY vec_id", "standardised and clipped"),
    Op("knn_cosine", "SELECT q, b, sim FROM {near} WHERE rn <= 10", "ten nearest of every fiftieth vector, exact"),
    Op("density_frontier", "SELECT q, round(1e0 - avg(sim), 6) AS frontier FROM {near} WHERE rn <= 25 GROUP BY q", "one less the mean of the 25 nearest"),
    Op("radius_calibration", "SELECT round(median(sim), 6) AS radius FROM {near} WHERE rn = 50", "median similarity of the 50th neighbour"),
    Op("neighbour_label", "SELECT q, label FROM {near} WHERE rn = 1", "label of the nearest"),
    Op("neighbour_band", "SELECT q, b, sim FROM {near} WHERE sim BETWEEN 1e-1 AND 9e-1 AND rn <= 20", "nearest within a band"),
    Op("neighbourhood_agreement", "WITH l AS (SELECT q, label, count(*) AS n FROM {near} WHERE rn <= 11 GROUP BY q, label) SELECT q, max(n) / 11e0 AS agreement FROM l GROUP BY q", "share of the commonest label among 11"),
    Op("cluster_centroids", f"WITH {_CENT} SELECT label, i, round(x, 6) AS x FROM u", "unit centroids"),
    Op("cluster_tightness", f"WITH {_CENT}, s AS (SELECT l.label, l.vec_id, sum(l.x * u.x) AS sim FROM {{sigl}} l JOIN u ON u.label = l.label AND u.i = l.i GROUP BY l.label, l.vec_id) SELECT label, count(*) AS size, round(1e0 - avg(sim), 6) AS tightness FROM s GROUP BY label", "size and tightness"),
    Op("cluster_reps", f"WITH {_CENT}, s AS (SELECT l.label, l.vec_id, round(sum(l.x * u.x), 9) AS sim FROM {{sigl}} l JOIN u ON u.label = l.label AND u.i = l.i GROUP BY l.label, l.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rn FROM s) SELECT label, rn, vec_id FROM r WHERE rn <= 5", "five nearest the centroid"),
    Op("centroid_isolation", f"WITH {_CENT}, p AS (SELECT a.label, b.label AS other, round(sum(a.x * b.x), 9) AS sim FROM u a JOIN u b ON b.i = a.i AND b.label <> a.label GROUP BY a.label, b.label), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, other) AS rn FROM p) SELECT label, other AS nearest_other, round(1e0 - sim, 6) AS isolation FROM r WHERE rn = 1", "nearest other centroid"),
    Op("isolated_pockets", "SELECT cluster_id, size, isolation FROM {cluster_summary} WHERE size >= 30 ORDER BY isolation DESC, cluster_id LIMIT 60", "isolated clusters of some size"),
    Op("corner_scores", "WITH e AS (SELECT cluster_id, pos, md5 FROM (SELECT cluster_id, posexplode(split(reps, ';')) AS (pos, md5) FROM {cluster_summary} WHERE reps IS NOT NULL) x WHERE pos < 3) SELECT e.cluster_id, count(*) AS n, round(avg(c.n_notes), 6) AS score, max(CASE WHEN c.has_drums = 1 THEN 1 ELSE 0 END) AS gate FROM e JOIN {catalog} c ON c.md5 = e.md5 GROUP BY e.cluster_id", "mean over the three nearest, with a gate", "WITH e AS (SELECT cluster_id, pos, md5 FROM (SELECT cluster_id, unnest(range(len(string_split(reps, ';')))) AS pos, unnest(string_split(reps, ';')) AS md5 FROM {cluster_summary} WHERE reps IS NOT NULL) x WHERE pos < 3) SELECT e.cluster_id, count(*) AS n, round(avg(c.n_notes), 6) AS score, max(CASE WHEN c.has_drums = 1 THEN 1 ELSE 0 END) AS gate FROM e JOIN {catalog} c ON c.md5 = e.md5 GROUP BY e.cluster_id"),
    Op("love_composite", "SELECT md5, round((8 * n_tracks + has_drums + n_distinct_patches) / 10e0, 6) AS love FROM {catalog}", "weighted axes"),
    Op("invention_score", "SELECT cluster_id, CASE WHEN size >= 10 THEN round(6e-1 * (1e0 - tightness) + 4e-1 * isolation, 6) END AS score, CASE WHEN size >= 10 AND 1e0 - tightness > 0 THEN 'keep' ELSE 'discard' END AS status FROM {cluster_summary}", "gain and love; no score if the gate fails"),
    Op("cv_correlation", "WITH f AS (SELECT md5, ascii(substring(md5, 1, 1)) % 5 AS fold, ln(1e0 + n_notes) AS y, ln(1e0 + duration_sec) AS x FROM {catalog} WHERE duration_sec BETWEEN 1 AND 3600), t AS (SELECT a.fold, avg(b.x) AS mx, avg(b.y) AS my, (avg(b.x * b.y) - avg(b.x) * avg(b.y)) / (avg(b.x * b.x) - avg(b.x) * avg(b.x) + 1e-6) AS slope FROM (SELECT DISTINCT fold FROM f) a JOIN f b ON b.fold <> a.fold GROUP BY a.fold), p AS (SELECT f.fold, f.y, t.my + t.slope * (f.x - t.mx) AS yhat FROM f JOIN t ON t.fold = f.fold) SELECT fold, round(corr(y, yhat), 6) AS r, round(avg(abs(y - yhat)), 6) AS mae FROM p GROUP BY fold", "ridge of one feature, five folds"),
    Op("ridge_gramian", "SELECT a.i AS i, b.i AS j, round(sum(a.x * b.x), 6) AS g FROM {sigl} a JOIN {sigl} b ON b.vec_id = a.vec_id AND b.i >= a.i GROUP BY a.i, b.i", "products of feature columns for closed-form regression"),
    Op("map_payload", "WITH p AS (SELECT percentile(n_notes, 2e-3) AS lo, percentile(n_notes, 998e-3) AS hi FROM {catalog}) SELECT c.md5, round(greatest(-5e-2, least(105e-2, (c.n_notes - p.lo) / (p.hi - p.lo + 1e-9))), 6) AS x FROM {catalog} c CROSS JOIN p", "normalised by outer percentiles", "WITH p AS (SELECT quantile_cont(n_notes, 2e-3) AS lo, quantile_cont(n_notes, 998e-3) AS hi FROM {catalog}) SELECT c.md5, round(greatest(-5e-2, least(105e-2, (c.n_notes - p.lo) / (p.hi - p.lo + 1e-9))), 6) AS x FROM {catalog} c CROSS JOIN p"),
    _set_ratio(),
    Op("window_counts", "SELECT window.start AS at, event_type, count(*) AS n, round(sum(value), 6) AS total FROM {events} GROUP BY window(ts, '1 hour'), event_type", "tumbling windows", "SELECT date_trunc('hour', ts) AS at, event_type, count(*) AS n, round(sum(value), 6) AS total FROM {events} GROUP BY 1, event_type"),
]
