"""Deeper harmony and melody, phrase boundaries, arrangement and tiling, quality scores."""

from notegrain.functions.pitch import _CHORD, chorded
from notegrain.plans.ops import Op

_TOP = "top AS (SELECT song, start, max(pitch) AS pitch FROM {notes} WHERE chan NOT IN (9, 10) GROUP BY song, start), iv AS (SELECT song, start, pitch, pitch - lag(pitch) OVER (PARTITION BY song ORDER BY start) AS d, start - lag(start) OVER (PARTITION BY song ORDER BY start) AS gap FROM top)"
_CUT = f"{_TOP}, f AS (SELECT song, start, d, gap, abs(d) AS leap, abs(gap - lag(gap) OVER (PARTITION BY song ORDER BY start)) AS dgap, CASE WHEN d * lag(d) OVER (PARTITION BY song ORDER BY start) < 0 THEN 1e0 ELSE 0e0 END AS turn FROM iv), m AS (SELECT song, CAST(greatest(max(gap), 1) AS DOUBLE) AS g, CAST(greatest(max(leap), 1) AS DOUBLE) AS l, CAST(greatest(max(dgap), 1) AS DOUBLE) AS dg FROM f GROUP BY song), s AS (SELECT f.song, f.start, CAST(floor(f.start / 192e1 + 5e-1) AS BIGINT) AS bar, round(gap / m.g + 7e-1 * coalesce(dgap / m.dg, 0e0) + 5e-1 * leap / m.l + 4e-1 * turn, 9) AS novelty FROM f JOIN m ON m.song = f.song WHERE f.gap IS NOT NULL)"

OPS = [
    Op("chord_qualities", f"WITH {_CHORD}, n AS (SELECT song, CAST(count(*) AS DOUBLE) AS n FROM seg GROUP BY song) SELECT seg.song, quality, round(count(*) / max(n.n), 6) AS share FROM seg JOIN n ON n.song = seg.song GROUP BY seg.song, quality", "shares of chord kinds"),
    Op("chord_functions", f"WITH {_CHORD}, t AS (SELECT song, root, count(*) AS n, row_number() OVER (PARTITION BY song ORDER BY count(*) DESC, root) AS rn FROM seg GROUP BY song, root), k AS (SELECT song, root AS tonic FROM t WHERE rn = 1), d AS (SELECT seg.song, (seg.root - k.tonic + 12) % 12 AS deg FROM seg JOIN k ON k.song = seg.song) SELECT song, round(avg(CASE WHEN deg IN (0, 4, 9) THEN 1e0 ELSE 0e0 END), 6) AS tonic_share, round(avg(CASE WHEN deg IN (2, 5) THEN 1e0 ELSE 0e0 END), 6) AS subdominant_share, round(avg(CASE WHEN deg IN (7, 11) THEN 1e0 ELSE 0e0 END), 6) AS dominant_share FROM d GROUP BY song", "tonic, subdominant and dominant by degree over the commonest root"),
    Op("tension_curve", f"WITH {_CHORD}, t AS (SELECT song, w, CASE quality WHEN 'maj' THEN 0e0 WHEN 'min' THEN 1e-1 WHEN 'sus' THEN 3e-1 WHEN 'maj7' THEN 35e-2 WHEN 'min7' THEN 4e-1 WHEN 'dom7' THEN 6e-1 WHEN 'dim' THEN 8e-1 ELSE 9e-1 END AS tension FROM seg), p AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY tension DESC, w) AS rn FROM t) SELECT song, round(avg(tension), 6) AS mean, round(var_pop(tension), 6) AS variance, max(CASE WHEN rn = 1 THEN w END) AS peak_beat FROM p GROUP BY song", "mean, variance and peak of chord tension"),
    Op("voicing", "WITH o AS (SELECT song, start, count(*) AS k, max(pitch) - min(pitch) AS spread FROM {notes} WHERE chan NOT IN (9, 10) GROUP BY song, start) SELECT song, round(avg(k), 6) AS density, round(avg(CASE WHEN k > 1 THEN spread END), 6) AS spread FROM o GROUP BY song", "notes at once and their spread"),
    Op("phrase_contour", f"WITH {_TOP}, ph AS (SELECT song, start, pitch, sum(CASE WHEN gap >= 960 THEN 1 ELSE 0 END) OVER (PARTITION BY song ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS phrase FROM iv), e AS (SELECT song, phrase, min(start) AS a, max(start) AS b, max(pitch) AS hi, min(pitch) AS lo, count(*) AS n FROM ph GROUP BY song, phrase) SELECT e.song, CAST(e.phrase AS BIGINT) AS phrase, e.n, CASE WHEN x.pitch < y.pitch THEN 'rising' WHEN x.pitch > y.pitch THEN 'falling' WHEN e.hi = e.lo THEN 'flat' ELSE 'arch' END AS contour FROM e JOIN ph x ON x.song = e.song AND x.start = e.a JOIN ph y ON y.song = e.song AND y.start = e.b", "contour of each phrase"),
    Op("boundary_novelty", f"WITH {_CUT} SELECT song, start, novelty FROM s", "rest, change of pace, leap and turn, each by the song's largest"),
    Op("boundary_bars", f"WITH {_CUT}, b AS (SELECT song, bar, sum(novelty) AS novelty FROM s GROUP BY song, bar), r AS (SELECT song, bar, round(novelty, 6) AS novelty, row_number() OVER (PARTITION BY song ORDER BY round(novelty, 6) DESC, bar) AS rn FROM b) SELECT song, bar, novelty FROM r WHERE rn <= 4", "the bars where most begins"),
    Op("chord_grid_fill", f"WITH {_CHORD}, b AS (SELECT song, CAST(floor(w / 4e0) AS BIGINT) AS bar, max(chord_id) AS chord_id FROM seg WHERE w % 4 = 0 GROUP BY song, CAST(floor(w / 4e0) AS BIGINT)), r AS (SELECT song, CAST(min(floor(w / 4e0)) AS BIGINT) AS lo, CAST(max(floor(w / 4e0)) AS BIGINT) AS hi FROM seg GROUP BY song), g AS (SELECT song, explode(sequence(lo, hi)) AS bar FROM r), j AS (SELECT g.song, g.bar, b.chord_id FROM g LEFT JOIN b ON b.song = g.song AND b.bar = g.bar) SELECT song, bar, coalesce(last_value(chord_id) IGNORE NULLS OVER (PARTITION BY song ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(chord_id) IGNORE NULLS OVER (PARTITION BY song ORDER BY bar ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS chord_id FROM j", "one chord a bar, carried forward, then backwards",
       f"WITH {_CHORD}, b AS (SELECT song, CAST(floor(w / 4e0) AS BIGINT) AS bar, max(chord_id) AS chord_id FROM seg WHERE w % 4 = 0 GROUP BY song, CAST(floor(w / 4e0) AS BIGINT)), r AS (SELECT song, CAST(min(floor(w / 4e0)) AS BIGINT) AS lo, CAST(max(floor(w / 4e0)) AS BIGINT) AS hi FROM seg GROUP BY song), g AS (SELECT song, unnest(range(lo, hi + 1)) AS bar FROM r), j AS (SELECT g.song, g.bar, b.chord_id FROM g LEFT JOIN b ON b.song = g.song AND b.bar = g.bar) SELECT song, bar, coalesce(last_value(chord_id IGNORE NULLS) OVER (PARTITION BY song ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(chord_id IGNORE NULLS) OVER (PARTITION BY song ORDER BY bar ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS chord_id FROM j"),
    Op("arpeggiate", "WITH c AS (SELECT song, start, pitch, max(dur) AS dur, row_number() OVER (PARTITION BY song, start ORDER BY pitch) - 1 AS k, count(*) OVER (PARTITION BY song, start) AS n FROM {notes} WHERE chan NOT IN (9, 10) GROUP BY song, start, pitch) SELECT song, start + k * 60 AS start, pitch, greatest(60, dur - k * 60) AS dur FROM c WHERE n > 1", "notes of one onset one after another"),
    Op("bass_roots", "SELECT song, bar, pitch - CAST(floor(pitch / 12e0) AS BIGINT) * 12 + 36 AS bass FROM (SELECT song, CAST(floor(start / 192e1) AS BIGINT) AS bar, min(pitch) AS pitch FROM {notes} WHERE chan NOT IN (9, 10) GROUP BY song, CAST(floor(start / 192e1) AS BIGINT)) b", "the lowest note of each bar in one octave"),
    Op("power_chords", "SELECT song, start, pitch + s.up AS pitch, dur FROM {notes} CROSS JOIN (SELECT 0 AS up UNION ALL SELECT 7 UNION ALL SELECT 12) s WHERE chan = 5 AND pitch + s.up <= 127", "root, fifth and octave"),
    Op("swing_shift", "SELECT song, idx, start + CASE WHEN start % 240 = 120 THEN 40 ELSE 0 END AS start FROM {notes}", "late off-beat sixteenths"),
    Op("loop_cut", "WITH c AS (SELECT song, chan, pitch, greatest(start, 0) AS a, least(start + dur, 7680) AS b FROM {notes} WHERE start < 7680 AND start + dur > 0) SELECT c.song, c.chan, c.pitch, c.a + r.k * 7680 AS start, c.b - c.a AS dur FROM c CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) r WHERE c.b > c.a", "four bars clipped and repeated"),
    Op("palette_roles", "WITH m AS (SELECT song, chan, median(pitch) AS mid, count(*) AS n FROM {notes} WHERE chan NOT IN (9, 10) GROUP BY song, chan), r AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY mid, chan) AS rn, count(*) OVER (PARTITION BY song) AS k FROM m) SELECT song, chan, mid, CASE WHEN rn = 1 THEN 'bass' WHEN rn = k THEN 'lead' ELSE 'pad' END AS role FROM r", "roles by the median pitch of channels"),
    Op("energy_window", "WITH b AS (SELECT song, CAST(floor(start / 192e1) AS BIGINT) AS bar, sum(vel) AS e FROM {notes} GROUP BY song, CAST(floor(start / 192e1) AS BIGINT)), w AS (SELECT song, bar, sum(e) OVER (PARTITION BY song ORDER BY bar ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS e FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY e DESC, bar) AS rn FROM w) SELECT song, bar, CAST(e AS BIGINT) AS energy FROM r WHERE rn = 1", "the four bars with most energy"),
    Op("bar_offsets", "WITH s AS (SELECT song, max(start + dur) AS ends FROM {notes} GROUP BY song), b AS (SELECT song, CAST(ceil(ends / 192e1) AS BIGINT) AS bars FROM s) SELECT song, bars, CAST(floor(song / 8e0) AS BIGINT) AS suite, CAST(coalesce(sum(bars) OVER (PARTITION BY CAST(floor(song / 8e0) AS BIGINT) ORDER BY song ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_bar FROM b", "the songs of a suite laid end to end on a bar grid"),
    Op("nct_ratio", f"WITH {_CHORD}, n AS (SELECT x.song, x.idx, x.pitch % 12 AS pc, CAST(floor(x.start / 48e1) AS BIGINT) AS w FROM {{notes}} x WHERE x.chan NOT IN (9, 10)) SELECT n.song, round(avg(CASE WHEN t.tone = 1 THEN 0e0 ELSE 1e0 END), 6) AS nct_ratio FROM n JOIN seg ON seg.song = n.song AND seg.w = n.w JOIN tpl t ON t.chord_id = seg.chord_id AND t.pc = n.pc GROUP BY n.song", "share of notes outside their beat's chord"),
    Op("quality_score", "SELECT cluster_id, round(4e-1 * (1e0 - tightness) + 6e-1 * has_drums_frac, 6) AS score, CASE WHEN 1e0 - tightness >= 6e-1 AND has_drums_frac >= 3e-1 THEN 1 ELSE 0 END AS passes FROM {cluster_summary}", "two parts and a gate"),
    Op("ensemble_spread", "WITH b AS (SELECT c.song_id, k.bag, avg(c.n_notes) AS m FROM {catalog} c CROSS JOIN (SELECT 0 AS bag UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) k WHERE c.song_id IS NOT NULL AND (c.n_tracks + c.n_notes) % 5 <> k.bag GROUP BY c.song_id, k.bag) SELECT song_id, round(stddev_pop(m), 6) AS spread, count(*) AS bags FROM b GROUP BY song_id", "deviation over bags"),
    Op("signature_v3", "WITH l AS (SELECT md5, 0 AS i, ln(1e0 + greatest(coalesce(note_density, 0e0), 0e0)) AS x FROM {catalog} WHERE note_density IS NULL OR note_density < 1e9 UNION ALL SELECT md5, 1, ln(1e0 + n_notes) FROM {catalog} UNION ALL SELECT md5, 2, ln(1e0 + coalesce(n_distinct_chords, 0)) FROM {catalog}), st AS (SELECT i, avg(x) AS mu, stddev_pop(x) AS sd FROM l GROUP BY i), z AS (SELECT l.md5, l.i, (l.x - st.mu) / (st.sd + 1e-12) AS z FROM l JOIN st ON st.i = l.i), n AS (SELECT md5, sqrt(sum(z * z)) AS len FROM z GROUP BY md5) SELECT z.md5, z.i, round(sqrt(12e-1) * z.z / (n.len + 1e-12), 6) AS x FROM z JOIN n ON n.md5 = z.md5", "logged whole block, missing as zero, unit rows by weight"),
    Op("octet_rules", "SELECT i, octet, CASE WHEN substring(octet, 1, 1) = 'k' THEN 2 ELSE 0 END + CASE WHEN substring(octet, 3, 1) = 's' OR substring(octet, 7, 1) = 's' THEN 2 ELSE 0 END - CASE WHEN octet LIKE '%kkk%' OR octet LIKE '%sss%' THEN 3 ELSE 0 END + CASE WHEN octet LIKE '%kks%' THEN 1 ELSE 0 END AS score FROM (SELECT CAST(i AS INT) AS i, translate(lpad(bin(i), 8, '0'), '01', 'ks') AS octet FROM (SELECT explode(sequence(0, 255)) AS i) s) o", "anchor, backbeat, no triples, one pickup", "SELECT i, octet, CASE WHEN substring(octet, 1, 1) = 'k' THEN 2 ELSE 0 END + CASE WHEN substring(octet, 3, 1) = 's' OR substring(octet, 7, 1) = 's' THEN 2 ELSE 0 END - CASE WHEN octet LIKE '%kkk%' OR octet LIKE '%sss%' THEN 3 ELSE 0 END + CASE WHEN octet LIKE '%kks%' THEN 1 ELSE 0 END AS score FROM (SELECT CAST(i AS INT) AS i, translate(lpad(bin(i), 8, '0'), '01', 'ks') AS octet FROM range(256) s(i)) o"),
    Op("style_profile", "SELECT cluster_id, CASE WHEN caption LIKE '%swing%' THEN 'jazz' WHEN caption LIKE '%kit%' THEN 'rock' WHEN caption LIKE '%ext-harm%' THEN 'art' ELSE 'other' END AS style, CASE WHEN caption LIKE '%laid-back%' THEN 1 ELSE 0 END AS laid_back, regexp_extract(caption, '([0-9]{{2,3}})', 1) AS number FROM {cluster_summary} WHERE caption IS NOT NULL", "first keyword, then modifiers and a number"),
    Op("audio_qa", "SELECT md5, CASE WHEN avg_vel IS NULL OR avg_vel = 0 THEN 'silent' WHEN avg_vel < 50 THEN 'near_silent' WHEN avg_vel > 110 THEN 'clipping' WHEN abs(duration_sec - n_notes / 12e0) > greatest(2e0, 25e-2 * duration_sec) THEN 'length_mismatch' ELSE 'ok' END AS verdict FROM {catalog}", "first verdict that holds"),
    Op("rerank", "SELECT cluster_id, size, isolation FROM {cluster_summary} WHERE size IS NOT NULL ORDER BY isolation DESC, size DESC, cluster_id LIMIT 100", "several keys, descending"),
    Op("feature_gate", "SELECT md5, (CASE WHEN has_drums = 1 THEN 1e0 ELSE 0e0 END) * (CASE WHEN bpm BETWEEN 100 AND 140 THEN 1e0 WHEN bpm BETWEEN 80 AND 160 THEN 6e-1 ELSE 3e-1 END) AS gate, CASE WHEN lyric_events_count > 0 THEN 15e-1 WHEN n_tracks > 8 THEN 12e-1 ELSE 1e0 END AS prior FROM {catalog}", "gate times soft band; prior"),
    Op("tick_rescale", "SELECT song, idx, CAST(floor(start * 96e1 / 48e1) AS BIGINT) AS start, CAST(greatest(floor(dur * 96e1 / 48e1), 1e0) AS BIGINT) AS dur FROM {notes}", "to another number of ticks a beat"),
]
OPS = chorded(OPS)
