"""Melody and counterpoint from notes: intervals, phrases, repetition, surprise, voices."""

from notegrain.plans.ops import Op

_LINE = "top AS (SELECT song, start, max(pitch) AS pitch FROM {notes} WHERE chan NOT IN (9, 10) GROUP BY song, start), iv AS (SELECT song, start, pitch, pitch - lag(pitch) OVER (PARTITION BY song ORDER BY start) AS d FROM top)"
_GRAM = f"{_LINE}, n AS (SELECT song, start, d, row_number() OVER (PARTITION BY song ORDER BY start) AS k FROM iv WHERE d IS NOT NULL), g AS (SELECT song, k, d AS a, lead(d, 1) OVER (PARTITION BY song ORDER BY k) AS b, lead(d, 2) OVER (PARTITION BY song ORDER BY k) AS c, lead(d, 3) OVER (PARTITION BY song ORDER BY k) AS e FROM n)"
_PART = "v AS (SELECT song, chan, start, max(pitch) AS pitch FROM {notes} WHERE chan NOT IN (9, 10) GROUP BY song, chan, start), m AS (SELECT song, chan, start, pitch, lag(pitch) OVER (PARTITION BY song, chan ORDER BY start) AS was FROM v)"


def _nearest(steps: str, within: int) -> str:
    """pairs: each row of ``steps`` (song, chan, start) with the nearest one of every other voice, less than ``within`` ticks away (of two equally near the earlier); a pair chosen from both sides is one."""
    side = "PARTITION BY song, me, you ORDER BY start{} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    other = "CASE WHEN mine = 0 THEN start END"
    return f"ch AS (SELECT DISTINCT song, chan FROM {steps}), u AS (SELECT s.song, s.chan AS me, ch.chan AS you, s.start, 1 AS mine FROM {steps} s JOIN ch ON ch.song = s.song AND ch.chan <> s.chan UNION ALL SELECT s.song, ch.chan AS me, s.chan AS you, s.start, 0 AS mine FROM {steps} s JOIN ch ON ch.song = s.song AND ch.chan <> s.chan), w AS (SELECT song, me, you, start, mine, max({other}) OVER ({side.format('')}) AS p, min({other}) OVER ({side.format(' DESC')}) AS q FROM u), near AS (SELECT song, me, you, start, CASE WHEN q IS NULL OR start - p <= q - start THEN p ELSE q END AS o FROM w WHERE mine = 1), pairs AS (SELECT DISTINCT song, least(me, you) AS a, greatest(me, you) AS b, CASE WHEN me < you THEN start ELSE o END AS sa, CASE WHEN me < you THEN o ELSE start END AS sb FROM near WHERE abs(start - o) < {within})"


OPS = [
    Op("melody_channel", "WITH c AS (SELECT song, chan, avg(pitch) / 127e0 * (count(DISTINCT start) / CAST(count(*) AS DOUBLE)) * ln(1e0 + count(*)) AS score FROM {notes} WHERE chan <> 9 GROUP BY song, chan HAVING count(*) >= 8), r AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY round(score, 9) DESC, chan) AS rn FROM c) SELECT song, chan AS melody_channel, round(score, 6) AS score FROM r WHERE rn = 1", "high, monophonic, busy; the lowest channel wins ties"),
    Op("interval_contour", f"WITH {_LINE} SELECT song, count(d) AS n, round(avg(CASE WHEN d IS NOT NULL THEN CASE WHEN abs(d) <= 2 THEN 1e0 ELSE 0e0 END END), 6) AS stepwise, round(avg(CASE WHEN d IS NOT NULL THEN CASE WHEN abs(d) >= 5 THEN 1e0 ELSE 0e0 END END), 6) AS leaps, round(avg(CASE WHEN d IS NOT NULL THEN CASE WHEN d = 0 THEN 1e0 ELSE 0e0 END END), 6) AS repeats, round(avg(CASE WHEN d IS NOT NULL THEN CASE WHEN d > 0 THEN 1e0 ELSE 0e0 END END), 6) AS rises, max(pitch) - min(pitch) AS span FROM iv GROUP BY song", "shares of steps, leaps, repeats and rises"),
    Op("direction_changes", f"WITH {_LINE}, s AS (SELECT song, start, CASE WHEN d > 0 THEN 1 ELSE -1 END AS s FROM iv WHERE d <> 0), p AS (SELECT song, s, lag(s) OVER (PARTITION BY song ORDER BY start) AS was FROM s) SELECT song, count(CASE WHEN was <> s THEN 1 END) AS turns, count(was) AS n FROM p GROUP BY song", "changes of sign among intervals that are not zero"),
    Op("motif_ngrams", f"WITH {_GRAM}, c AS (SELECT song, a, b, c, e, count(*) AS n FROM g WHERE e IS NOT NULL GROUP BY song, a, b, c, e) SELECT song, CAST(sum(n) AS BIGINT) AS n_grams, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS repeat_share FROM c GROUP BY song", "share of four-interval grams that occur again"),
    Op("interval_entropy", f"WITH {_LINE}, c AS (SELECT song, d, CAST(count(*) AS DOUBLE) AS n FROM iv WHERE d IS NOT NULL GROUP BY song, d), p AS (SELECT song, n / sum(n) OVER (PARTITION BY song) AS p FROM c) SELECT song, round(abs(sum(-p * log2(p))), 6) AS bits, count(*) AS vocab FROM p GROUP BY song", "entropy and number of intervals"),
    Op("markov_surprise", f"WITH {_GRAM}, pr AS (SELECT song, a, b, CAST(count(*) AS DOUBLE) AS n FROM g WHERE b IS NOT NULL GROUP BY song, a, b), pre AS (SELECT song, a, sum(n) AS n FROM pr GROUP BY song, a) SELECT pr.song, round(sum(pr.n * -log2(pr.n / pre.n)) / sum(pr.n), 6) AS mean_bits, round(1e0 / (1e0 + sum(pr.n * -log2(pr.n / pre.n)) / sum(pr.n)), 6) AS predictability FROM pr JOIN pre ON pre.song = pr.song AND pre.a = pr.a GROUP BY pr.song", "first-order surprise of intervals"),
    Op("sequence_rate", f"WITH {_GRAM} SELECT g.song, count(*) AS n, round(avg(CASE WHEN h.k IS NOT NULL AND g.a = h.a AND g.b = h.b AND g.c = h.c THEN 1e0 ELSE 0e0 END), 6) AS sequence_rate FROM g LEFT JOIN g h ON h.song = g.song AND h.k = g.k + 3 WHERE g.c IS NOT NULL GROUP BY g.song", "three intervals that repeat at once"),
    Op("call_response", f"WITH {_GRAM}, s AS (SELECT song, k, CASE WHEN a > 0 THEN 1 WHEN a < 0 THEN -1 ELSE 0 END * 9 + CASE WHEN b > 0 THEN 1 WHEN b < 0 THEN -1 ELSE 0 END * 3 + CASE WHEN c > 0 THEN 1 WHEN c < 0 THEN -1 ELSE 0 END AS shape FROM g WHERE c IS NOT NULL) SELECT p.song, round(avg(CASE WHEN q.shape = p.shape THEN 1e0 ELSE 0e0 END), 6) AS call_response FROM s p JOIN s q ON q.song = p.song AND q.k = p.k + 4 GROUP BY p.song", "contours that come back after four notes"),
    Op("chromaticism", "WITH t AS (SELECT song, pitch % 12 AS pc, count(*) AS n FROM {notes} WHERE chan NOT IN (9, 10) GROUP BY song, pitch % 12), m AS (SELECT song, pc, n, first_value(pc) OVER (PARTITION BY song ORDER BY n DESC, pc) AS tonic FROM t) SELECT song, min(tonic) AS tonic, round(sum(CASE WHEN (pc - tonic + 12) % 12 IN (0, 2, 4, 5, 7, 9, 11) THEN 0 ELSE n END) / CAST(sum(n) AS DOUBLE), 6) AS chromaticism FROM m GROUP BY song", "share outside the major scale of the commonest pitch class"),
    Op("motion_labels", f"WITH {_PART}, p AS (SELECT a.song, CASE WHEN a.pitch = a.was OR b.pitch = b.was THEN 'oblique' WHEN (a.pitch - a.was) * (b.pitch - b.was) < 0 THEN 'contrary' WHEN a.pitch - a.was = b.pitch - b.was THEN 'parallel' ELSE 'similar' END AS motion FROM m a JOIN m b ON b.song = a.song AND b.start = a.start AND b.chan > a.chan WHERE a.was IS NOT NULL AND b.was IS NOT NULL AND NOT (a.pitch = a.was AND b.pitch = b.was)) SELECT song, motion, count(*) AS n FROM p GROUP BY song, motion", "motion of voice pairs that move together"),
    Op("voice_crossing", f"WITH {_PART}, av AS (SELECT song, chan, avg(pitch) AS mean FROM v GROUP BY song, chan), p AS (SELECT a.song, CASE WHEN (a.pitch - b.pitch) * (x.mean - y.mean) < 0 THEN 1e0 ELSE 0e0 END AS crossed FROM v a JOIN v b ON b.song = a.song AND b.start = a.start AND b.chan > a.chan JOIN av x ON x.song = a.song AND x.chan = a.chan JOIN av y ON y.song = b.song AND y.chan = b.chan) SELECT song, round(avg(crossed), 6) AS crossing_rate, count(*) AS n FROM p GROUP BY song", "pairs whose order is not that of their mean pitch"),
    Op("voice_motion", f"WITH {_PART}, st AS (SELECT song, chan, start, pitch - was AS d FROM m WHERE was IS NOT NULL), {_nearest('st', 480)}, k AS (SELECT pairs.song, CASE WHEN x.d = 0 OR y.d = 0 THEN 'oblique' WHEN x.d * y.d < 0 THEN 'contrary' WHEN abs(abs(x.d) - abs(y.d)) <= 2 THEN 'parallel' ELSE 'similar' END AS motion FROM pairs JOIN st x ON x.song = pairs.song AND x.chan = pairs.a AND x.start = pairs.sa JOIN st y ON y.song = pairs.song AND y.chan = pairs.b AND y.start = pairs.sb) SELECT song, motion, count(*) AS n FROM k GROUP BY song, motion", "motion of all voice pairs, each step with the other voice's nearest within a beat"),
    Op("voice_overlap", f"WITH {_PART}, f AS (SELECT song, chan, pitch AS head FROM (SELECT song, chan, pitch, row_number() OVER (PARTITION BY song, chan ORDER BY start) AS rn FROM v) r WHERE rn = 1), {_nearest('v', 240)}, k AS (SELECT pairs.song, CASE WHEN abs(pairs.sa - pairs.sb) < 120 AND CASE WHEN fa.head < fb.head THEN y.pitch < x.pitch ELSE x.pitch < y.pitch END THEN 1 ELSE 0 END AS crossed FROM pairs JOIN v x ON x.song = pairs.song AND x.chan = pairs.a AND x.start = pairs.sa JOIN v y ON y.song = pairs.song AND y.chan = pairs.b AND y.start = pairs.sb JOIN f fa ON fa.song = pairs.song AND fa.chan = pairs.a JOIN f fb ON fb.song = pairs.song AND fb.chan = pairs.b) SELECT song, count(*) AS overlaps, count(CASE WHEN crossed = 1 THEN 1 END) AS crossings, round(avg(CAST(crossed AS DOUBLE)), 6) AS crossing_rate FROM k GROUP BY song", "onsets of voice pairs within half a beat; crossed within a quarter of a beat, against the order of the voices' first notes"),
    Op("imitation", f"WITH {_PART}, d AS (SELECT song, chan, start, pitch - was AS d FROM m WHERE was IS NOT NULL), g AS (SELECT song, chan, d AS a, lead(d, 1) OVER (PARTITION BY song, chan ORDER BY start) AS b, lead(d, 2) OVER (PARTITION BY song, chan ORDER BY start) AS c FROM d), u AS (SELECT DISTINCT song, chan, a, b, c FROM g WHERE c IS NOT NULL), hit AS (SELECT DISTINCT x.song, x.chan, x.a, x.b, x.c FROM u x JOIN u y ON y.song = x.song AND y.chan > x.chan AND y.a = x.a AND y.b = x.b AND y.c = x.c UNION SELECT x.song, x.chan, x.a, x.b, x.c FROM u x JOIN u y ON y.song = x.song AND y.chan > x.chan AND y.a = -x.a AND y.b = -x.b AND y.c = -x.c) SELECT song, count(*) AS n_imitated FROM hit GROUP BY song", "interval grams that another voice has, as they are or inverted"),
    Op("smoothness", f"WITH {_PART} SELECT song, chan, round(1e0 / (1e0 + avg(abs(pitch - was))), 6) AS smoothness, count(*) AS n FROM m WHERE was IS NOT NULL GROUP BY song, chan", "small mean motion is smooth"),
    Op("voice_budget", "WITH r AS (SELECT song, start, idx, chan, pitch, row_number() OVER (PARTITION BY song, start, CASE WHEN chan IN (9, 10) THEN 1 ELSE 0 END ORDER BY pitch DESC, idx) AS hi, row_number() OVER (PARTITION BY song, start, CASE WHEN chan IN (9, 10) THEN 1 ELSE 0 END ORDER BY pitch, idx) AS lo FROM {notes}) SELECT song, CASE WHEN chan IN (9, 10) THEN 'drums' WHEN hi = 1 THEN 'melody' WHEN lo = 1 THEN 'bass' ELSE 'harmony' END AS role, count(*) AS n FROM r GROUP BY song, CASE WHEN chan IN (9, 10) THEN 'drums' WHEN hi = 1 THEN 'melody' WHEN lo = 1 THEN 'bass' ELSE 'harmony' END", "highest, lowest and inner notes of each onset"),
    Op("beat_columns", "WITH n AS (SELECT song, idx, pitch, start, start + greatest(dur, 1) AS stop FROM {notes} WHERE chan NOT IN (9, 10)), s AS (SELECT DISTINCT song, CAST(floor(start / 48e1) AS BIGINT) AS beat FROM {notes} WHERE start < 48 * 480) SELECT s.song, s.beat, max(n.pitch) AS hi, min(n.pitch) AS lo, count(*) AS sounding FROM s JOIN n ON n.song = s.song AND n.start <= s.beat * 480 AND n.stop > s.beat * 480 GROUP BY s.song, s.beat", "what sounds at each of the first 48 beats"),
    Op("beat_sounding", "WITH b AS (SELECT song, pitch, explode(sequence(CAST(floor(start / 48e1) AS BIGINT), CAST(floor((start + greatest(dur, 1) - 1) / 48e1) AS BIGINT))) AS beat FROM {notes} WHERE chan NOT IN (9, 10)) SELECT song, CAST(beat AS BIGINT) AS beat, max(pitch) AS hi, min(pitch) AS lo, count(*) AS sounding FROM b GROUP BY song, beat", "what sounds in each beat of the song, notes that begin in it or are held included", "WITH b AS (SELECT song, pitch, unnest(range(CAST(floor(start / 48e1) AS BIGINT), CAST(floor((start + greatest(dur, 1) - 1) / 48e1) AS BIGINT) + 1)) AS beat FROM {notes} WHERE chan NOT IN (9, 10)) SELECT song, CAST(beat AS BIGINT) AS beat, max(pitch) AS hi, min(pitch) AS lo, count(*) AS sounding FROM b GROUP BY song, beat"),
    Op("asof_voice", "WITH a AS (SELECT song, start, max(pitch) AS pitch, 1 AS mine FROM {notes} WHERE chan = 3 GROUP BY song, start), b AS (SELECT song, start, max(pitch) AS pitch, 0 AS mine FROM {notes} WHERE chan = 4 GROUP BY song, start), u AS (SELECT * FROM a UNION ALL SELECT * FROM b), l AS (SELECT song, start, pitch, mine, max(CASE WHEN mine = 0 THEN start END) OVER (PARTITION BY song ORDER BY start, mine ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS other FROM u) SELECT l.song, l.start, l.pitch, b.start AS other_start, b.pitch AS other_pitch FROM l JOIN b ON b.song = l.song AND b.start = l.other WHERE l.mine = 1 AND l.start - l.other <= 480", "each note of one voice with the latest of another, at most a beat before"),
    Op("nct_snap", "SELECT song, pitch, CASE WHEN pitch % 12 IN (0, 2, 4, 5, 7, 9, 11) THEN pitch ELSE pitch + 1 END AS snapped, count(*) AS n FROM {notes} GROUP BY song, pitch", "to the nearest note of C major, upwards first"),
    Op("transpose_min", "WITH k AS (SELECT song, min(pitch) AS root FROM {notes} GROUP BY song) SELECT song, root, CASE WHEN (12 - root % 12) % 12 <= 6 THEN (12 - root % 12) % 12 ELSE (12 - root % 12) % 12 - 12 END AS shift FROM k", "smallest shift that brings the root to C"),
]
