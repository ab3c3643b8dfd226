"""Pitch and harmony: histograms, entropy, keys, interval classes, chords, roughness."""

from dataclasses import replace

from notegrain.plans.ops import Op

# Key profiles from C upwards, and chord templates in the order that breaks ties.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
NAMES = ("C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B")
TEMPLATES = (("maj", (0, 4, 7)), ("min", (0, 3, 7)), ("dim", (0, 3, 6)), ("aug", (0, 4, 8)), ("dom7", (0, 4, 7, 10)), ("maj7", (0, 4, 7, 11)), ("min7", (0, 3, 7, 10)), ("sus", (0, 5, 7)))
ROUGHNESS = (1.0, 0.5, 0.2, 0.15, 0.1, 0.65)


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}e0" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)


_KEYS = [(k * 2 + m, f"{NAMES[k]} {('major', 'minor')[m]}", pc, (MAJOR, MINOR)[m][(pc - k) % 12]) for k in range(12) for m in (0, 1) for pc in range(12)]
_CHORDS = [(r * 8 + q, r, name, pc, 1 if (pc - r) % 12 in tones else 0, len(tones)) for r in range(12) for q, (name, tones) in enumerate(TEMPLATES) for pc in range(12)]
_PCS = ", ".join(f"({i})" for i in range(12))

_PC = "pc AS (SELECT song, pitch % 12 AS pc, CAST(count(*) AS DOUBLE) AS n FROM {notes} WHERE chan NOT IN (9, 10) GROUP BY song, pitch % 12), h AS (SELECT song, pc, n / sum(n) OVER (PARTITION BY song) AS p FROM pc)"
_FULL = f"{_PC}, songs AS (SELECT DISTINCT song FROM h), grid AS (SELECT s.song, d.pc, coalesce(h.p, 0e0) AS p FROM songs s CROSS JOIN (VALUES {_PCS}) AS d(pc) LEFT JOIN h ON h.song = s.song AND h.pc = d.pc)"
_RANKED = f"{_FULL}, prof AS (SELECT * FROM ({_values(_KEYS)}) AS k(key_id, key_name, pc, w)), r AS (SELECT g.song, k.key_id, k.key_name, round(corr(g.p, k.w), 9) AS r FROM grid g JOIN prof k ON k.pc = g.pc GROUP BY g.song, k.key_id, k.key_name), o AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY r DESC, key_id DESC) AS rn FROM r)"
_WINDOW = "win AS (SELECT song, CAST(floor(start / 48e1) AS BIGINT) AS w, pitch % 12 AS pc, CAST(count(*) AS DOUBLE) AS n FROM {notes} GROUP BY song, CAST(floor(start / 48e1) AS BIGINT), pitch % 12), tot AS (SELECT song, w, sum(n) AS t, count(*) AS k FROM win GROUP BY song, w)"
_CHORD_CHECK = f"{_WINDOW}, tpl AS (SELECT * FROM ({_values(_CHORDS)}) AS c(chord_id, root, quality, pc, tone, size)), sc AS (SELECT x.song, x.w, c.chord_id, c.root, c.quality, round(sum(CASE WHEN c.tone = 1 THEN x.n ELSE -55e-2 * x.n END) / max(t.t) - 5e-2 * max(c.size), 9) AS score FROM win x JOIN tot t ON t.song = x.song AND t.w = x.w AND t.k >= 2 JOIN tpl c ON c.pc = x.pc GROUP BY x.song, x.w, c.chord_id, c.root, c.quality), seg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY song, w ORDER BY score DESC, chord_id) AS rn FROM sc) q WHERE rn = 1)"
_COUNTS = ", ".join(f"count_if(pitch % 12 = {i})" for i in range(12))
_SHAPES = ", ".join(f"named_struct('id', {r * 8 + q}, 'root', {r}, 'quality', '{name}', 'less', {5 * len(tones)}e-2, 'tones', array({', '.join(str((r + t) % 12) for t in tones)}))" for r in range(12) for q, (name, tones) in enumerate(TEMPLATES))
# One row a beat with its twelve counts; the templates are scored on it as literals: one shuffle, no explosion, no window.
_CHORD = f"tpl AS (SELECT * FROM ({_values(_CHORDS)}) AS c(chord_id, root, quality, pc, tone, size)), cnt AS (SELECT song, CAST(floor(start / 48e1) AS BIGINT) AS w, array({_COUNTS}) AS n, CAST(count(*) AS DOUBLE) AS t FROM {{notes}} WHERE song IS NOT NULL AND start IS NOT NULL AND pitch IS NOT NULL GROUP BY song, CAST(floor(start / 48e1) AS BIGINT)), best AS (SELECT song, w, array_max(transform(array({_SHAPES}), c -> named_struct('score', round((aggregate(c.tones, 0L, (s, i) -> s + n[i]) * 155e-2 - 55e-2 * t) / t - c.less, 9), 'o', -c.id, 'root', c.root, 'quality', c.quality))) AS m FROM cnt WHERE size(filter(n, x -> x > 0)) >= 2), seg AS (SELECT song, w, -m.o AS chord_id, m.root AS root, m.quality AS quality, m.score AS score FROM best)"


def chorded(ops: list[Op]) -> list[Op]:
    """The operators on chords, with the text of joined templates for the checking engine."""
    return [replace(op, check=(op.check or op.sql).replace(_CHORD, _CHORD_CHECK)) if _CHORD in op.sql else op for op in ops]


def _key_areas() -> Op:
    """Correlations of counts with the profiles, from sums: one row a window with its twelve counts, the profiles as literals; one shuffle, no window of keys."""
    tail = "k AS (SELECT song, w, key_name, lag(key_name) OVER (PARTITION BY song ORDER BY w) AS was FROM o WHERE rn = 1), m AS (SELECT song, key_name, count(*) AS n FROM k GROUP BY song, key_name) SELECT a.song, a.n_changes, round(b.top / CAST(a.n AS DOUBLE), 6) AS key_stability FROM (SELECT song, count(*) AS n, count(CASE WHEN was <> key_name THEN 1 END) AS n_changes FROM k GROUP BY song) a JOIN (SELECT song, max(n) AS top FROM m GROUP BY song) b ON b.song = a.song"
    check = f"WITH w8 AS (SELECT song, CAST(floor(start / 384e1) AS BIGINT) AS w, pitch % 12 AS pc, CAST(count(*) AS DOUBLE) AS n FROM {{notes}} GROUP BY song, CAST(floor(start / 384e1) AS BIGINT), pitch % 12), ws AS (SELECT DISTINCT song, w FROM w8), grid AS (SELECT s.song, s.w, d.pc, coalesce(x.n, 0e0) AS p FROM ws s CROSS JOIN (VALUES {_PCS}) AS d(pc) LEFT JOIN w8 x ON x.song = s.song AND x.w = s.w AND x.pc = d.pc), prof AS (SELECT * FROM ({_values(_KEYS)}) AS k(key_id, key_name, pc, w)), r AS (SELECT g.song, g.w, k.key_id, k.key_name, corr(g.p, k.w) AS c FROM grid g JOIN prof k ON k.pc = g.pc GROUP BY g.song, g.w, k.key_id, k.key_name), o AS (SELECT *, row_number() OVER (PARTITION BY song, w ORDER BY round(c, 9) DESC, key_id) AS rn FROM r WHERE c IS NOT NULL AND NOT isnan(c)), "
    keys = ", ".join(f"named_struct('id', {k * 2 + m}, 'key_name', '{NAMES[k]} {('major', 'minor')[m]}', 'w', array({', '.join(f'{p[(pc - k) % 12]!r}e0' for pc in range(12))}), 's', {sum(p)!r}e0, 'd', {(12 * sum(x * x for x in p) - sum(p) ** 2) ** 0.5!r}e0)" for k in range(12) for m, p in enumerate((MAJOR, MINOR)))
    sql = (
        f"WITH w8 AS (SELECT song, CAST(floor(start / 384e1) AS BIGINT) AS w, array({_COUNTS}) AS n FROM {{notes}} WHERE song IS NOT NULL AND start IS NOT NULL GROUP BY song, CAST(floor(start / 384e1) AS BIGINT)), "
        "v AS (SELECT song, w, n, aggregate(n, 0L, (a, x) -> a + x) AS t, aggregate(n, 0L, (a, x) -> a + x * x) AS tt FROM w8), "
        f"b AS (SELECT song, w, array_max(transform(array({keys}), k -> named_struct('c', round((12e0 * aggregate(zip_with(n, k.w, (x, y) -> x * y), 0e0, (a, x) -> a + x) - t * k.s) / (sqrt(CAST(12 * tt - t * t AS DOUBLE)) * k.d), 9), 'o', -k.id, 'key_name', k.key_name))).key_name AS key_name FROM v WHERE 12 * tt > t * t), "
    )
    return Op("key_areas", sql + tail.replace("FROM o WHERE rn = 1", "FROM b"), "keys of eight-beat windows: changes and share of the commonest", check + tail)


OPS = [
    Op("pc_histogram", f"WITH {_PC} SELECT song, pc, round(p, 9) AS share FROM h", "share of each pitch class, drums left out"),
    Op("pc_histogram_weighted", "WITH d AS (SELECT song, pitch % 12 AS pc, CAST(greatest(dur, 1) AS DOUBLE) AS w, chan IN (9, 10) AS drum, min(CASE WHEN chan IN (9, 10) THEN 1 ELSE 0 END) OVER (PARTITION BY song) AS only_drums FROM {notes}), s AS (SELECT song, pc, sum(w) AS w FROM d WHERE NOT drum OR only_drums = 1 GROUP BY song, pc) SELECT song, pc, round(w / sum(w) OVER (PARTITION BY song), 9) AS share FROM s", "by duration; drums count only where there is nothing else"),
    Op("pc_entropy", f"WITH {_PC} SELECT song, round(abs(sum(-p * log2(p))), 6) AS bits FROM h GROUP BY song", "entropy in bits"),
    Op("key_detect", f"WITH {_RANKED} SELECT a.song, a.key_name, a.r AS strength, round(a.r - b.r, 6) AS margin, b.key_name AS key_alt FROM o a JOIN o b ON b.song = a.song AND b.rn = 2 WHERE a.rn = 1", "best of 24 rotated profiles by correlation"),
    Op("key_distribution", f"WITH {_RANKED} SELECT key_name, count(*) AS n_songs FROM o WHERE rn = 1 GROUP BY key_name", "songs per key"),
    Op("interval_vector", f"WITH {_PC}, p AS (SELECT a.song, least(b.pc - a.pc, 12 - (b.pc - a.pc)) AS ic, least(a.p, b.p) AS m FROM h a JOIN h b ON b.song = a.song AND b.pc > a.pc), s AS (SELECT song, ic, sum(m) AS m FROM p GROUP BY song, ic) SELECT song, ic, round(m / sum(m) OVER (PARTITION BY song), 6) AS share FROM s", "interval classes 1 to 6 by the smaller mass of each pair"),
    Op("signature36", f"WITH {_FULL}, ch AS (SELECT song, start, count(DISTINCT pitch % 12) AS k FROM {{notes}} WHERE chan NOT IN (9, 10) GROUP BY song, start), cs AS (SELECT song, k, count(*) / CAST(sum(count(*)) OVER (PARTITION BY song) AS DOUBLE) AS p FROM ch WHERE k BETWEEN 2 AND 6 GROUP BY song, k), p2 AS (SELECT a.song, least(b.pc - a.pc, 12 - (b.pc - a.pc)) AS ic, sum(least(a.p, b.p)) AS m FROM h a JOIN h b ON b.song = a.song AND b.pc > a.pc GROUP BY a.song, least(b.pc - a.pc, 12 - (b.pc - a.pc))) SELECT song, pc AS dim, round(p, 6) AS x FROM grid UNION ALL SELECT song, pc + 12, round(p, 6) FROM grid UNION ALL SELECT song, ic + 23, round(m / sum(m) OVER (PARTITION BY song), 6) FROM p2 UNION ALL SELECT song, CAST(k AS INT) + 29, round(p, 6) FROM cs", "36 dimensions: histogram twice, interval vector, chord sizes (absent ones are zero)"),
    Op("chord_template", f"WITH {_CHORD} SELECT song, w, root, quality, score FROM seg", "best of 96 templates for each beat with two pitch classes or more"),
    Op("dissonance", f"WITH {_WINDOW}, rw AS (SELECT * FROM ({_values([(i + 1, w) for i, w in enumerate(ROUGHNESS)])}) AS x(ic, weight)), d AS (SELECT a.song, a.w, avg(r.weight) AS rough FROM win a JOIN win b ON b.song = a.song AND b.w = a.w AND b.pc > a.pc JOIN rw r ON r.ic = least(b.pc - a.pc, 12 - (b.pc - a.pc)) GROUP BY a.song, a.w), f AS (SELECT t.song, t.w, coalesce(d.rough, 0e0) AS rough FROM tot t LEFT JOIN d ON d.song = t.song AND d.w = t.w) SELECT song, round(avg(rough), 6) AS diss_mean, round(stddev_pop(rough), 6) AS diss_std FROM f GROUP BY song", "mean roughness of the pairs in each beat"),
    Op("harmony_features", f"WITH {_CHORD}, l AS (SELECT song, w, root, quality, chord_id, lag(chord_id) OVER (PARTITION BY song ORDER BY w) AS was FROM seg), c AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY w) AS k FROM l WHERE was IS NULL OR was <> chord_id), bars AS (SELECT song, greatest((max(start) - min(start)) / 192e1, 1e0) AS bars FROM {{notes}} GROUP BY song) SELECT c.song, count(*) AS n_segments, count(DISTINCT root) AS n_roots, round(avg(CASE WHEN quality = 'dom7' THEN 1e0 ELSE 0e0 END), 6) AS dom7_share, round((count(*) - 1) / max(b.bars), 6) AS changes_per_bar FROM c JOIN bars b ON b.song = c.song GROUP BY c.song", "segments after collapsing repeats, roots, dominant share, changes a bar"),
    Op("progression_entropy", f"WITH {_CHORD}, l AS (SELECT song, w, chord_id, lag(chord_id) OVER (PARTITION BY song ORDER BY w) AS was FROM seg), c AS (SELECT song, w, chord_id FROM l WHERE was IS NULL OR was <> chord_id), b AS (SELECT song, chord_id AS x, lead(chord_id) OVER (PARTITION BY song ORDER BY w) AS y FROM c), g AS (SELECT song, x, y, CAST(count(*) AS DOUBLE) AS n FROM b WHERE y IS NOT NULL GROUP BY song, x, y), p AS (SELECT song, n / sum(n) OVER (PARTITION BY song) AS p FROM g) SELECT song, round(abs(sum(-p * log2(p))), 6) AS bits, count(*) AS n_bigrams FROM p GROUP BY song", "entropy of chord bigrams"),
    _key_areas(),
    Op("diatonic_ratio", f"WITH {_RANKED}, k AS (SELECT song, key_id FROM o WHERE rn = 1), n AS (SELECT x.song, CAST(greatest(x.dur, 1) AS DOUBLE) AS w, (x.pitch + 1200 - CAST(floor(k.key_id / 2e0) AS BIGINT)) % 12 AS deg, k.key_id % 2 AS minor FROM {{notes}} x JOIN k ON k.song = x.song WHERE x.chan NOT IN (9, 10)) SELECT song, round(sum(CASE WHEN (minor = 0 AND deg IN (0, 2, 4, 5, 7, 9, 11)) OR (minor = 1 AND deg IN (0, 2, 3, 5, 7, 8, 10)) THEN w ELSE 0e0 END) / sum(w), 6) AS diatonic FROM n GROUP BY song", "share of duration inside the song's scale"),
    Op("chord_summary", "WITH c AS (SELECT song, start, count(DISTINCT pitch % 12) AS k, min(pitch % 12) AS low FROM {notes} WHERE chan NOT IN (9, 10) GROUP BY song, start) SELECT song, count(CASE WHEN k > 1 THEN 1 END) AS n_chords, count(DISTINCT CASE WHEN k > 1 THEN k * 12 + low END) AS n_unique, max(k) AS widest, CASE WHEN count(DISTINCT CASE WHEN k > 1 THEN k * 12 + low END) = 0 THEN 'none' WHEN count(DISTINCT CASE WHEN k > 1 THEN k * 12 + low END) < 8 THEN 'low' WHEN count(DISTINCT CASE WHEN k > 1 THEN k * 12 + low END) < 25 THEN 'medium' ELSE 'high' END AS complexity FROM c GROUP BY song", "notes that sound together at one onset"),
    Op("triple_stats", "SELECT song, CAST(floor(avg(pitch)) AS BIGINT) AS pitch_avg, CAST(floor(median(pitch)) AS BIGINT) AS pitch_med, CAST(floor(avg(dur)) AS BIGINT) AS dur_avg, CAST(floor(median(dur)) AS BIGINT) AS dur_med, min(pitch) AS pitch_min, max(pitch) AS pitch_max, count(DISTINCT chan) AS n_voices FROM {notes} GROUP BY song", "truncated averages and medians"),
]
OPS = chorded(OPS)
