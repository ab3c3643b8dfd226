"""Rhythm, tempo, drums and concurrency from notes, drum hits, tempo events and onsets."""

from notegrain.plans.ops import Op

# Note values in beats in the order that breaks ties, their kinds, and metrical salience of the 16 cells of a bar.
STRAIGHT, DOTTED, TRIPLET = (4, 2, 1, 0.5, 0.25, 0.125, 0.0625), (3, 1.5, 0.75, 0.375, 0.1875), (8 / 3, 4 / 3, 2 / 3, 1 / 3, 1 / 6)
SALIENCE = (5, 1, 2, 1, 3, 1, 2, 1, 4, 1, 2, 1, 3, 1, 2, 1)
KICK, SNARE, HAT = "35, 36", "37, 38, 40", "42, 44, 46"
CYMBAL, TOM = "49, 51, 52, 53, 55, 57, 59", "41, 43, 45, 47, 48, 50"

_VALUES = ", ".join(f"({i}, '{kind}', {float(v)!r}e0)" for i, (kind, v) in enumerate([("straight", v) for v in STRAIGHT] + [("dotted", v) for v in DOTTED] + [("triplet", v) for v in TRIPLET]))
_SAL = ", ".join(f"({i}, {s}, {SALIENCE[(i + 1) % 16]})" for i, s in enumerate(SALIENCE))
_ON = "o AS (SELECT DISTINCT song, rint(start / 48e1 * 48e0) / 48e0 AS t FROM {notes})"
_ON_C = "o AS (SELECT DISTINCT song, round_even(start / 48e1 * 48e0, 0) / 48e0 AS t FROM {notes})"
_IOI = "i AS (SELECT song, t, lead(t) OVER (PARTITION BY song ORDER BY t) - t AS d FROM o)"
_CELL = "c AS (SELECT song, CAST(floor(start / 192e1) AS BIGINT) AS bar, CAST(rint(((start % 1920) / 48e1) / 25e-2) AS BIGINT) % 16 AS cell, start, pitch, vel FROM {drums} WHERE chan IN (9, 10) AND pitch BETWEEN 35 AND 81)"
_CELL_C = _CELL.replace("CAST(rint(((start % 1920) / 48e1) / 25e-2) AS BIGINT)", "CAST(round_even(((start % 1920) / 48e1) / 25e-2, 0) AS BIGINT)")
_VOICE = f"CASE WHEN pitch IN ({KICK}) THEN 'kick' WHEN pitch IN ({SNARE}) THEN 'snare' WHEN pitch IN ({HAT}) THEN 'hat' WHEN pitch IN ({CYMBAL}) THEN 'cymbal' WHEN pitch IN ({TOM}) THEN 'tom' ELSE 'other' END"


def _both(name: str, sql: str, what: str) -> Op:
    """A query over a grid: the engines' half-even rounding has different names."""
    return Op(name, "WITH " + sql.replace("<ON>", _ON).replace("<CELL>", _CELL), what, "WITH " + sql.replace("<ON>", _ON_C).replace("<CELL>", _CELL_C).replace("rint(", "round_even_0("))


def _song_structure() -> Op:
    """The windows of a song meet in one row: its counts, at most 256 times the pitch classes, are multiplied there and no pair of windows is shuffled."""
    head = "WITH m AS (SELECT song, CAST(max(start) + 1 AS DOUBLE) AS span FROM {notes} GROUP BY song), g AS (SELECT song, CASE WHEN span / 96e1 > 256e0 THEN span / 256e0 ELSE 96e1 END AS win, CAST(least(floor(span / 96e1 + 1e0), 256) AS BIGINT) AS nwin FROM m), x AS (SELECT n.song, g.nwin, CAST(least(floor(n.start / g.win), g.nwin - 1) AS BIGINT) AS w, n.pitch % 12 AS pc, CAST(count(*) AS DOUBLE) AS n FROM {notes} n JOIN g ON g.song = n.song WHERE g.nwin >= 4 GROUP BY n.song, g.nwin, CAST(least(floor(n.start / g.win), g.nwin - 1) AS BIGINT), n.pitch % 12), "
    pairs = "l AS (SELECT song, w, sum(n * n) AS ss FROM x GROUP BY song, w), d AS (SELECT a.song, a.nwin, a.w AS p, b.w AS q, sum(a.n * b.n) AS dot FROM x a JOIN x b ON b.song = a.song AND b.pc = a.pc AND b.w > a.w GROUP BY a.song, a.nwin, a.w, b.w), s AS (SELECT d.song, d.p, d.q, CASE WHEN d.q - d.p > greatest(2e0, floor(d.nwin / 16e0)) AND 1e4 * d.dot * d.dot > 9025e0 * a.ss * b.ss THEN 1 ELSE 0 END AS again, CASE WHEN d.q = d.p + 1 AND 4e0 * d.dot * d.dot >= a.ss * b.ss THEN 1 ELSE 0 END AS goes_on, d.nwin FROM d JOIN l a ON a.song = d.song AND a.w = d.p JOIN l b ON b.song = d.song AND b.w = d.q), h AS (SELECT song, count(DISTINCT w) AS hits FROM (SELECT song, p AS w FROM s WHERE again = 1 UNION ALL SELECT song, q AS w FROM s WHERE again = 1) e GROUP BY song), c AS (SELECT song, nwin, p, lead(p) OVER (PARTITION BY song ORDER BY p) AS nxt FROM s WHERE goes_on = 1), t AS (SELECT song, count(CASE WHEN p + 1 <= nwin - 2 AND (nxt IS NULL OR nxt > p + 1) THEN 1 END) AS rises FROM c GROUP BY song)"
    tail = " SELECT g.song, g.nwin AS n_windows, CASE WHEN g.nwin < 4 THEN 0 ELSE 1 + coalesce(t.rises, 0) END AS n_sections, round(coalesce(h.hits, 0) / CAST(g.nwin AS DOUBLE), 6) AS repetition_ratio, CASE WHEN 10 * coalesce(h.hits, 0) > 3 * g.nwin THEN 1 ELSE 0 END AS has_repetition FROM g LEFT JOIN h ON h.song = g.song LEFT JOIN t ON t.song = g.song"
    sql = head + "y AS (SELECT song, windows_again(nwin, collect_list(named_struct('w', w, 'pc', CAST(pc AS INT), 'n', n))) AS r FROM x WHERE w IS NOT NULL GROUP BY song, nwin), h AS (SELECT song, r.hits AS hits FROM y), t AS (SELECT song, r.rises AS rises FROM y)" + tail
    return Op("song_structure", sql, "two-beat windows, at most 256: share that comes back (cosine above 0.95) beyond the neighbourhood, sections that end where neighbours fall below 0.5", head + pairs + tail)


OPS = [
    _both("ioi_stats", f"<ON>, {_IOI} SELECT song, count(d) AS n, round(avg(d), 6) AS ioi_mean, round(median(d), 6) AS ioi_median, round(stddev_pop(d), 6) AS ioi_std FROM i WHERE d > 0 GROUP BY song", "intervals between distinct onsets"),
    _both("note_value_mix", f"<ON>, {_IOI}, nv AS (SELECT * FROM (VALUES {_VALUES}) AS v(ord, kind, beats)), m AS (SELECT i.song, i.t, nv.kind, abs(log2(i.d / nv.beats)) AS off, row_number() OVER (PARTITION BY i.song, i.t ORDER BY round(abs(log2(i.d / nv.beats)), 9), nv.ord) AS rn FROM i CROSS JOIN nv WHERE i.d > 0), k AS (SELECT song, CASE WHEN off <= 16e-2 THEN kind ELSE 'free' END AS kind FROM m WHERE rn = 1) SELECT song, kind, count(*) AS n FROM k GROUP BY song, kind", "nearest note value of each interval, else free"),
    _both("dotted_pairs", f"<ON>, {_IOI}, p AS (SELECT song, d, lead(d) OVER (PARTITION BY song ORDER BY t) AS e FROM i WHERE d > 0) SELECT song, count(*) AS n_pairs, round(avg(CASE WHEN abs(log2(d / e) - log2(3e0)) <= 16e-2 THEN 1e0 ELSE 0e0 END), 6) AS dotted_share FROM p WHERE e IS NOT NULL GROUP BY song", "long-short pairs of three to one"),
    _both("swing_ratio", "<ON>, b AS (SELECT song, floor(t + 1e-6) AS beat, t - floor(t + 1e-6) AS p FROM o), g AS (SELECT song, beat, max(CASE WHEN p < 15e-2 THEN 1 ELSE 0 END) AS lands, count(CASE WHEN p > 15e-2 AND p <= 40e-2 THEN 1 END) AS early, count(CASE WHEN p > 40e-2 AND p < 72e-2 THEN 1 END) AS mid, max(CASE WHEN p > 40e-2 AND p < 72e-2 THEN p END) AS p FROM b GROUP BY song, beat), q AS (SELECT song, p / (1e0 - p) AS r FROM g WHERE lands = 1 AND early = 0 AND mid = 1), n AS (SELECT song, count(*) AS beats FROM g GROUP BY song) SELECT q.song, round(median(q.r), 6) AS bur, count(*) AS n_beats, round(count(*) / CAST(max(n.beats) AS DOUBLE), 6) AS coverage FROM q JOIN n ON n.song = q.song GROUP BY q.song", "beat to upbeat ratio of beats with one note between"),
    Op("duration_bins", "WITH b AS (SELECT song, CASE WHEN dur / 48e1 < 1875e-4 THEN 'sub16' WHEN dur / 48e1 < 375e-3 THEN 'n16' WHEN dur / 48e1 < 75e-2 THEN 'n8' WHEN dur / 48e1 < 15e-1 THEN 'n4' WHEN dur / 48e1 < 3e0 THEN 'n2' WHEN dur / 48e1 < 6e0 THEN 'n1' ELSE 'long' END AS bin FROM {notes}) SELECT song, bin, count(*) AS n FROM b GROUP BY song, bin", "note lengths in seven right-open bins"),
    Op("rhythm_block", "WITH p AS (SELECT song, start, dur, (start % 120) / 12e1 AS a, (start % 160) / 16e1 AS b, (start % 480) / 48e1 AS beat, (start % 1920) / 48e1 AS bar FROM {notes}), q AS (SELECT song, dur, start, least(a, 1e0 - a) AS d16, least(b, 1e0 - b) AS d3, CASE WHEN least(beat, 1e0 - beat) < 5e-2 THEN 1e0 ELSE 0e0 END AS on_beat, CASE WHEN least(bar, 4e0 - bar) < 5e-2 THEN 1e0 ELSE 0e0 END AS down FROM p) SELECT song, round(count(DISTINCT floor(start / 6e1)) / (max(start + dur) / 48e1), 6) AS density, round(avg(CASE WHEN d16 < 1e-1 THEN 1e0 ELSE 0e0 END), 6) AS tight16, round(avg(CASE WHEN d3 < 1e-1 THEN 1e0 ELSE 0e0 END) - avg(CASE WHEN d16 < 1e-1 THEN 1e0 ELSE 0e0 END), 6) AS triplet_feel, round(1e0 - avg(on_beat), 6) AS offbeat, round((1e0 - avg(on_beat)) * (1e0 - avg(down)), 6) AS syncopation, round(avg(down), 6) AS downbeat, round(median(dur / 12e1), 6) AS articulation, round(least(avg(CASE WHEN d16 < 8e-2 THEN 1e0 ELSE 0e0 END), avg(CASE WHEN d3 < 8e-2 THEN 1e0 ELSE 0e0 END)), 6) AS polyrhythm FROM q GROUP BY song", "tightness, offbeats, syncopation, articulation"),
    Op("phrase_sessions", "WITH o AS (SELECT DISTINCT song, start FROM {notes}), g AS (SELECT song, start, CASE WHEN start - lag(start) OVER (PARTITION BY song ORDER BY start) >= 960 THEN 1 ELSE 0 END AS cut FROM o), s AS (SELECT song, start, sum(cut) OVER (PARTITION BY song ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS phrase FROM g) SELECT song, CAST(phrase AS BIGINT) AS phrase, count(*) AS n_onsets, min(start) AS first_tick, max(start) AS last_tick FROM s GROUP BY song, phrase", "phrases end at rests of two beats or more"),
    Op("tempo_dominant", "WITH d AS (SELECT *, row_number() OVER (PARTITION BY song, tick ORDER BY seq DESC) AS rn FROM {tempos}), v AS (SELECT song, bpm, lead(tick, 1, ends) OVER (PARTITION BY song ORDER BY tick) - tick AS w FROM d WHERE rn = 1), s AS (SELECT song, bpm, sum(w) AS w FROM v GROUP BY song, bpm), r AS (SELECT song, bpm, w, row_number() OVER (PARTITION BY song ORDER BY w DESC, bpm) AS rn, sum(w) OVER (PARTITION BY song) AS total FROM s) SELECT song, bpm, round(w / CAST(total AS DOUBLE), 6) AS share FROM r WHERE rn = 1", "the tempo that holds longest; of events at one tick the last counts"),
    Op("tempo_range", "SELECT song, count(*) AS n_events, min(bpm) AS bpm_min, max(bpm) AS bpm_max, round(avg(bpm), 6) AS bpm_mean, round(stddev_pop(bpm), 6) AS bpm_std FROM {tempos} GROUP BY song", "range of tempo events"),
    Op("tempo_class", "WITH d AS (SELECT song, tick, bpm, bpm - lag(bpm) OVER (PARTITION BY song ORDER BY tick, seq) AS d, seq FROM {tempos}), j AS (SELECT *, d - lag(d) OVER (PARTITION BY song ORDER BY tick, seq) AS dd FROM d), s AS (SELECT song, count(*) AS n, stddev_pop(bpm) / avg(bpm) AS cv, abs(sum(d)) / (sum(abs(d)) + 1e-9) AS mono, avg(abs(dd)) / avg(bpm) AS jerk FROM j GROUP BY song) SELECT song, n AS n_events, CASE WHEN n <= 1 OR cv < 1e-2 THEN 'constant' WHEN mono > 7e-1 AND cv < 25e-2 THEN 'gradual' WHEN cv >= 25e-2 OR coalesce(jerk, 0e0) > 5e-2 THEN 'erratic' ELSE 'rubato' END AS tempo_class FROM s", "constant, gradual, erratic or rubato"),
    Op("felt_tempo", "WITH d AS (SELECT md5, bpm, CASE WHEN bpm > 0 THEN bpm * power(2e0, greatest(0e0, ceil(log2(6e1 / bpm)))) END AS up FROM {catalog} WHERE bpm > 0 AND bpm < 1e4) SELECT md5, round(CASE WHEN up > 2e2 THEN up / power(2e0, ceil(log2(up / 2e2))) ELSE up END, 6) AS felt_bpm, CASE WHEN bpm < 6e1 OR bpm > 2e2 THEN 1 ELSE 0 END AS adjusted FROM d", "doubled while below 60, halved while above 200"),
    _both("onset_grid16", f"<CELL> SELECT song, {_VOICE} AS voice, cell, count(*) AS n FROM c GROUP BY song, {_VOICE}, cell", "hits per voice and sixteenth of a bar"),
    _both("grid_entropy", "<CELL>, g AS (SELECT song, cell, CAST(count(*) AS DOUBLE) AS n FROM c GROUP BY song, cell), p AS (SELECT song, n / sum(n) OVER (PARTITION BY song) AS p FROM g) SELECT song, round(abs(sum(-p * log2(p))) / 4e0, 6) AS grid_entropy FROM p GROUP BY song", "entropy of the grid, 1 for even"),
    _both("bar_variance", "<CELL>, g AS (SELECT song, bar, cell, CAST(count(*) AS DOUBLE) AS n FROM c GROUP BY song, bar, cell), b AS (SELECT song, bar, sqrt(sum(n * n)) AS len, dense_rank() OVER (PARTITION BY song ORDER BY bar) AS k FROM g GROUP BY song, bar), x AS (SELECT g.song, b.k, g.cell, g.n / b.len AS u FROM g JOIN b ON b.song = g.song AND b.bar = g.bar), d AS (SELECT b.song, b.k, 1e0 - coalesce(sum(p.u * q.u), 0e0) AS d FROM b LEFT JOIN x p ON p.song = b.song AND p.k = b.k LEFT JOIN x q ON q.song = p.song AND q.k = p.k + 1 AND q.cell = p.cell WHERE b.k < (SELECT max(k) FROM b b2 WHERE b2.song = b.song) GROUP BY b.song, b.k) SELECT song, round(avg(d), 6) AS bar_variance FROM d GROUP BY song", "cosine distance of consecutive bars that have hits"),
    _both("syncopation_lhl", f"<CELL>, g AS (SELECT DISTINCT song, bar, cell FROM c), s AS (SELECT * FROM (VALUES {_SAL}) AS s(cell, here, nxt)), h AS (SELECT g.song, g.bar, sum(CASE WHEN n.cell IS NULL AND s.nxt > s.here THEN s.nxt - s.here ELSE 0 END) / 16e0 AS v FROM g JOIN s ON s.cell = g.cell LEFT JOIN g n ON n.song = g.song AND n.bar = g.bar AND n.cell = (g.cell + 1) % 16 GROUP BY g.song, g.bar) SELECT song, round(avg(least(v, 1e0)), 6) AS syncopation FROM h GROUP BY song", "weak hits before an empty stronger cell"),
    _both("groove_dna", f"<CELL>, b AS (SELECT *, (start % 1920) / 48e1 AS ph, {_VOICE} AS voice FROM c), bars AS (SELECT song, max(bar) - min(bar) + 1 AS bars FROM c GROUP BY song) SELECT b.song, round(count(CASE WHEN voice = 'kick' THEN 1 END) / CAST(max(bars) AS DOUBLE), 6) AS kick_density, round(count(CASE WHEN voice = 'snare' THEN 1 END) / CAST(max(bars) AS DOUBLE), 6) AS snare_density, round(count(CASE WHEN voice = 'hat' THEN 1 END) / CAST(max(bars) AS DOUBLE), 6) AS hat_density, round(coalesce(avg(CASE WHEN voice = 'snare' THEN CASE WHEN abs(ph - 1e0) <= 15e-2 OR abs(ph - 3e0) <= 15e-2 THEN 1e0 ELSE 0e0 END END), 5e-1), 6) AS backbeat, round(1e0 - avg(CASE WHEN cell IN (0, 4, 8, 12) THEN 1e0 ELSE 0e0 END), 6) AS syncopation_drum, count(DISTINCT pitch) AS kit_size, round(coalesce(stddev_pop(CASE WHEN cell % 2 = 1 THEN vel END) / 127e0, 0e0), 6) AS ghost FROM b JOIN bars ON bars.song = b.song GROUP BY b.song", "densities, backbeat, syncopation, kit, ghost notes"),
    _both("microtiming", "<CELL>, o AS (SELECT song, (start / 48e1 - <R>(start / 48e1 / 25e-2) * 25e-2) / 125e-3 AS off FROM c) SELECT song, round(5e-1 + 5e-1 * greatest(-1e0, least(1e0, avg(off))), 6) AS laid_back, round(1e0 - greatest(0e0, least(1e0, avg(abs(off)))), 6) AS tight FROM o GROUP BY song", "signed and absolute distance to the nearest sixteenth"),
    _both("beat_accents", "<CELL> SELECT song, CAST(floor((start % 1920) / 48e1) AS BIGINT) AS beat, round(sum(vel) / CAST(sum(sum(vel)) OVER (PARTITION BY song) AS DOUBLE), 6) AS accent FROM c GROUP BY song, CAST(floor((start % 1920) / 48e1) AS BIGINT)", "velocity share of the four beats"),
    _both("grid_layers", f"<CELL>, bars AS (SELECT song, max(bar) - min(bar) + 1 AS bars FROM c GROUP BY song) SELECT c.song, {_VOICE} AS voice, cell, round(least(1e0, count(*) / CAST(max(bars) AS DOUBLE)), 6) AS hit, round(avg(power(vel / 127e0, 2e-1)), 6) AS loud FROM c JOIN bars ON bars.song = c.song GROUP BY c.song, {_VOICE}, cell", "hit probability and loudness per voice and cell"),
    _both("interlock", f"<CELL>, k AS (SELECT DISTINCT song, cell, CASE WHEN pitch IN ({KICK}) THEN 'k' ELSE 's' END AS v FROM c WHERE pitch IN ({KICK}, {SNARE})), g AS (SELECT song, cell, count(*) AS n FROM k GROUP BY song, cell) SELECT song, round(avg(CASE WHEN n = 1 THEN 1e0 ELSE 0e0 END), 6) AS interlock FROM g GROUP BY song", "cells of kick or snare but not both, among cells of either"),
    Op("sweep_concurrency", "WITH e AS (SELECT song, start AS t, 1 AS d FROM {notes} UNION ALL SELECT song, start + greatest(dur, 1), -1 FROM {notes}), s AS (SELECT song, t, sum(d) AS d FROM e GROUP BY song, t), r AS (SELECT song, t, sum(d) OVER (PARTITION BY song ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS live, d FROM s) SELECT song, CAST(max(live) AS BIGINT) AS most, round(avg(CASE WHEN d > 0 THEN live END), 6) AS mean_at_onsets FROM r GROUP BY song", "sweep line over starts and ends"),
    Op("onset_coincidence", "WITH o AS (SELECT song, chan, start, lag(start) OVER (PARTITION BY song ORDER BY start, idx) AS p, lead(start) OVER (PARTITION BY song ORDER BY start, idx) AS n FROM {notes}) SELECT song, round(1e0 - avg(CASE WHEN start - p <= 60 OR n - start <= 60 THEN 1e0 ELSE 0e0 END), 6) AS independence FROM o GROUP BY song", "share of onsets with no other within an eighth of a beat"),
    Op("pulse_clarity", "WITH c AS (SELECT song, CAST(floor(start / 12e1) AS BIGINT) AS cell, CAST(count(*) AS DOUBLE) AS n FROM {drums} GROUP BY song, CAST(floor(start / 12e1) AS BIGINT)), m AS (SELECT song, min(cell) AS lo, CAST(max(cell) - min(cell) + 1 AS DOUBLE) AS len, sum(n) AS s, sum(n * n) AS ss FROM c GROUP BY song), l AS (SELECT a.song, b.cell - a.cell AS lag, sum(a.n * b.n) AS ab FROM c a JOIN c b ON b.song = a.song AND b.cell - a.cell BETWEEN 2 AND 64 GROUP BY a.song, b.cell - a.cell) SELECT l.song, round(max(l.ab / m.ss), 6) AS clarity FROM l JOIN m ON m.song = l.song GROUP BY l.song", "largest autocorrelation of the onset grid at lags 2 to 64"),
    Op("self_similarity", "WITH x AS (SELECT song, CAST(floor(start / 192e2) AS BIGINT) AS w, pitch % 12 AS pc, CAST(count(*) AS DOUBLE) AS n FROM {notes} GROUP BY song, CAST(floor(start / 192e2) AS BIGINT), pitch % 12), l AS (SELECT song, w, sqrt(sum(n * n)) AS len FROM x GROUP BY song, w), u AS (SELECT x.song, x.w, x.pc, x.n / l.len AS u FROM x JOIN l ON l.song = x.song AND l.w = x.w), s AS (SELECT a.song, a.w AS p, b.w AS q, sum(a.u * b.u) AS c FROM u a JOIN u b ON b.song = a.song AND b.pc = a.pc AND b.w > a.w GROUP BY a.song, a.w, b.w), f AS (SELECT song, p, max(CASE WHEN q - p > 2 THEN c END) AS far FROM s GROUP BY song, p) SELECT song, round(avg(CASE WHEN far > 8e-1 THEN 1e0 ELSE 0e0 END), 6) AS repetition, round(avg(far), 6) AS mean_far FROM f GROUP BY song", "windows that come back later"),
    _song_structure(),
    Op("event_sessions", "WITH g AS (SELECT song, t, idx, CASE WHEN t - lag(t) OVER (PARTITION BY song ORDER BY t, idx) > 18e2 THEN 1 ELSE 0 END AS cut FROM {onsets}), s AS (SELECT song, t, sum(cut) OVER (PARTITION BY song ORDER BY t, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g) SELECT song, CAST(session AS BIGINT) AS session, count(*) AS n, max(t) - min(t) AS seconds FROM s GROUP BY song, session", "sessions end at gaps of half an hour"),
]


def _rounding(op: Op) -> Op:
    r = op.check and op.check.replace("<R>(start / 48e1 / 25e-2)", "round_even(start / 48e1 / 25e-2, 0)")
    return Op(op.name, op.sql.replace("<R>(", "rint("), op.what, r)


OPS = [_rounding(op) for op in OPS]
