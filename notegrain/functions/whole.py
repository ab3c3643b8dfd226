"""Whole blocks of a song: extracts, signatures of 88 numbers, drum vectors, archetypes, phrase cuts and recombination.

Inputs named ``of_x`` are the results of operator x over the same notes (``kit_x``: over the drums)."""

from dataclasses import replace

from notegrain.plans.ops import Binding, Op

PILLARS = {
    "rhythm": {"rhythm_block": ("density", "tight16", "triplet_feel", "offbeat", "syncopation", "downbeat", "articulation", "polyrhythm"), "ioi_stats": ("ioi_mean", "ioi_median", "ioi_std"), "dotted_pairs": ("dotted_share",), "swing_ratio": ("bur", "coverage"), "onset_coincidence": ("independence",)},
    "melody": {"interval_contour": ("stepwise", "leaps", "repeats", "rises", "span"), "motif_ngrams": ("repeat_share",), "interval_entropy": ("bits", "vocab"), "markov_surprise": ("mean_bits", "predictability"), "sequence_rate": ("sequence_rate",), "call_response": ("call_response",), "chromaticism": ("chromaticism",)},
    "harmony": {"harmony_features": ("n_segments", "n_roots", "dom7_share", "changes_per_bar"), "progression_entropy": ("bits",), "key_areas": ("n_changes", "key_stability"), "diatonic_ratio": ("diatonic",), "chord_summary": ("n_chords", "n_unique", "widest"), "dissonance": ("diss_mean", "diss_std")},
    "groove": {"groove_dna": ("kick_density", "snare_density", "hat_density", "backbeat", "syncopation_drum", "kit_size", "ghost"), "grid_entropy": ("grid_entropy",), "bar_variance": ("bar_variance",), "microtiming": ("laid_back", "tight")},
}
"""52 numbers beside the 36 of pitch: pillar -> operator -> columns."""
# Weights of the two signatures.
WEIGHTS = {"pitch": 1.0, "rhythm": 2.0, "melody": 1.0, "harmony": 1.0, "groove": 2.0}
BALANCED = {"pitch": 1.0, "rhythm": 1.2, "melody": 1.2, "harmony": 1.2, "groove": 1.2}
_DIMS = [(p, op, c) for p, ops in PILLARS.items() for op, cs in ops.items() for c in cs]


def _feature_sql(op: str) -> str:
    """Long form of one operator's columns; it is computed once for all of them."""
    mine = [(i + 36, c) for i, (_, o, c) in enumerate(_DIMS) if o == op]
    value = "CASE d.dim " + " ".join(f"WHEN {i} THEN CAST(r.{c} AS DOUBLE)" for i, c in mine) + " END"
    return f"SELECT r.song, d.dim, {value} AS x FROM {{of_{op}}} r CROSS JOIN (VALUES {', '.join(f'({i})' for i, _ in mine)}) AS d(dim)"


FEATURES = ["SELECT song, dim, CAST(x AS DOUBLE) AS x FROM {of_signature36}", *[_feature_sql(op) for ops in PILLARS.values() for op in ops]]
"""Texts whose results together are the features of all songs: song, dim (0 to 35 pitch, 36 to 87 the pillars), x."""


def _signature(name: str, weights: dict[str, float], missing: str, logged: str, what: str) -> Op:
    """Long form (song, dim, x); ``logged``: one column's or the whole block's range decides on the logarithm."""
    dims = ", ".join(f"({i + 36}, '{p}')" for i, (p, _, _) in enumerate(_DIMS))
    weight = "CASE pillar " + " ".join(f"WHEN '{p}' THEN {w!r}e0" for p, w in weights.items()) + " END"
    sql = (
        f"WITH f AS (SELECT song, dim, x FROM {{features}} WHERE dim >= 36), s AS (SELECT DISTINCT song FROM {{features}}), g AS (SELECT s.song, d.pillar, d.dim, f.x FROM s CROSS JOIN (VALUES {dims}) AS d(dim, pillar) LEFT JOIN f ON f.song = s.song AND f.dim = d.dim), "
        f"r AS (SELECT {logged} AS k, min(x) AS lo, max(x) AS hi FROM g GROUP BY {logged}), l AS (SELECT g.song, g.pillar, g.dim, CASE WHEN r.lo >= 0e0 AND r.hi > 5e1 THEN ln(1e0 + g.x) ELSE g.x END AS y FROM g JOIN r ON r.k = g.{logged}), "
        f"m AS (SELECT dim, {missing} AS y FROM l GROUP BY dim), i AS (SELECT l.song, l.pillar, l.dim, coalesce(l.y, m.y, 0e0) AS y FROM l JOIN m ON m.dim = l.dim), "
        "st AS (SELECT dim, avg(y) AS mu, stddev_pop(y) AS sd FROM i GROUP BY dim), z AS (SELECT i.song, i.pillar, i.dim, greatest(-8e0, least(8e0, CASE WHEN st.sd > 1e-12 THEN (i.y - st.mu) / st.sd ELSE i.y - st.mu END)) AS z FROM i JOIN st ON st.dim = i.dim "
        "UNION ALL SELECT p.song, 'pitch', p.dim, p.x FROM {features} p WHERE p.dim < 36), "
        "n AS (SELECT song, pillar, sqrt(sum(z * z)) AS len FROM z GROUP BY song, pillar) "
        f"SELECT z.song, CAST(z.dim AS INT) AS dim, round(CASE WHEN n.len > 1e-12 THEN z.z / n.len * sqrt({weight.replace('pillar', 'z.pillar', 1)}) ELSE 0e0 END, 6) AS x FROM z JOIN n ON n.song = z.song AND n.pillar = z.pillar"
    )
    return Op(name, sql, what)


def _even(op: Op) -> Op:
    """The checking engine's name for rounding half to even."""
    text, at = op.check or op.sql, 0
    while (at := text.find("rint(", at)) >= 0:
        end, depth = at + 5, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = f"{text[:at]}round_even({text[at + 5 : end - 1]}, 0){text[end:]}"
    return replace(op, check=text)


def _half_up(op: Op, places: int) -> Op:
    """Rounds the scaled double, as the checking engine does, where this one would round its decimals: 0.3 * 0.1875 is 0.0563 on both. For values of at least 0."""
    text, at, end_ = op.sql, 0, f", {places})"
    while (at := text.find("round(", at)) >= 0:
        end, depth = at + 6, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        if text[at:end].endswith(end_):
            text = f"{text[:at]}floor(({text[at + 6 : end - len(end_)]}) * 1e{places} + 5e-1) / 1e{places}{text[end:]}"
        at += 6
    return replace(op, sql=text, check=op.check or op.sql)


def _arrays(op: Op) -> Op:
    """<LIST(...)> is an array of columns."""
    return replace(op, sql=op.sql.replace("<LIST(", "array(").replace(")>", ")"), check=(op.check or op.sql).replace("<LIST(", "list_value(").replace(")>", ")"))


_HITS = "c AS (SELECT song, CAST(floor(start / 192e1) AS BIGINT) AS bar, CAST(rint(((start % 1920) / 48e1) / 25e-2) AS BIGINT) % 16 AS cell, start, pitch, vel, (start % 1920) / 48e1 AS ph, CASE WHEN pitch IN (35, 36) THEN 'kick' WHEN pitch IN (37, 38, 40) THEN 'snare' WHEN pitch IN (42, 44, 46) THEN 'hat' WHEN pitch IN (49, 51, 52, 53, 55, 57, 59) THEN 'cymbal' WHEN pitch IN (41, 43, 45, 47, 48, 50) THEN 'tom' ELSE 'other' END AS voice FROM {drums} WHERE chan IN (9, 10) AND pitch BETWEEN 35 AND 81)"


def _drum_vector() -> Op:
    """72 numbers: 20 scalars, 4 beat accents, and hits a bar of kick, snare and hat in 16 cells."""
    count = lambda v: f"count(CASE WHEN voice = '{v}' THEN 1 END)"
    cells = ", ".join(f"CAST(count(CASE WHEN cell = {i} THEN 1 END) AS DOUBLE) AS c{i}" for i in range(16))
    voices = ", ".join(f"least(1e0, count(CASE WHEN voice = '{v}' AND cell = {i} THEN 1 END) / CAST(max(bars) AS DOUBLE)) AS {v}{i}" for v in ("kick", "snare", "hat") for i in range(16))
    beats = ", ".join(f"CAST(sum(CASE WHEN floor(ph) = {b} THEN vel ELSE 0 END) AS DOUBLE) AS v{b}" for b in range(4))
    share = lambda v, cond: f"coalesce(avg(CASE WHEN voice = '{v}' THEN CASE WHEN {cond} THEN 1e0 ELSE 0e0 END END), 0e0)"
    dot = lambda a, b: " + ".join(f"c{i} * c{j}" for i, j in zip(a, b))
    h1, h2 = range(8), range(8, 16)
    pulse = " + ".join(f"(c{i} - m) * (c{(i + 4) % 16} - m)" for i in range(16))
    power = " + ".join(f"(c{i} - m) * (c{i} - m)" for i in range(16))
    base = (
        f"{_HITS}, n AS (SELECT song, max(bar) - min(bar) + 1 AS bars FROM c GROUP BY song), b AS (SELECT c.song, CAST(max(bars) AS DOUBLE) AS bars, {count('kick')} AS kick, {count('snare')} AS snare, {count('hat')} AS hat, {count('cymbal')} AS cymbal, {count('tom')} AS tom, CAST(count(*) AS DOUBLE) AS hits, count(DISTINCT pitch) AS kit, "
        f"{share('kick', 'ph <= 15e-2 OR ph >= 385e-2')} AS downbeat, {share('snare', 'abs(ph - 1e0) <= 15e-2 OR abs(ph - 3e0) <= 15e-2')} AS backbeat, CASE WHEN count(CASE WHEN cell % 2 = 1 THEN 1 END) >= 2 THEN least(1e0, stddev_pop(CASE WHEN cell % 2 = 1 THEN vel END) / 127e0) ELSE 0e0 END AS ghost, "
        f"coalesce(greatest(0e0, (avg(CASE WHEN cell % 4 = 0 THEN vel END) - avg(CASE WHEN cell % 2 = 1 THEN vel END)) / 127e0), 0e0) AS accent, {beats}, {cells}, {voices} FROM c JOIN n ON n.song = c.song GROUP BY c.song), "
        f"x AS (SELECT *, ({dot(h1, h2)}) AS across, sqrt({dot(h1, h1)}) * sqrt({dot(h2, h2)}) AS halves, hits / 16e0 AS m FROM b), y AS (SELECT *, {pulse} AS pulse, {power} AS power FROM x)"
    )
    scalars = [f"y.{v} / y.bars" for v in ("kick", "snare", "hat", "cymbal", "tom", "hits")] + ["CAST(y.kit AS DOUBLE)", "y.downbeat", "y.backbeat", "coalesce(i.interlock, 0e0)", "coalesce(w.bur, 0e0)", "coalesce(t.laid_back, 5e-1)", "coalesce(t.tight, 0e0)", "coalesce(l.syncopation, 0e0)", "y.ghost", "y.accent", "coalesce(e.grid_entropy, 0e0)", "coalesce(v.bar_variance, 0e0)", "CASE WHEN halves > 0 THEN across / halves ELSE 0e0 END", "CASE WHEN power > 0 THEN greatest(0e0, least(1e0, pulse / power)) ELSE 0e0 END"]
    accents = [f"CASE WHEN v0 + v1 + v2 + v3 > 0 THEN v{b} / (v0 + v1 + v2 + v3) ELSE 0e0 END" for b in range(4)]
    grid = [f"y.{v}{i}" for v in ("kick", "snare", "hat") for i in range(16)]
    every = ", ".join(f"round({x}, 6)" for x in [*scalars, *accents, *grid])
    joins = " ".join(f"LEFT JOIN {{kit_{op}}} {a} ON {a}.song = y.song" for op, a in (("interlock", "i"), ("swing_ratio", "w"), ("microtiming", "t"), ("syncopation_lhl", "l"), ("grid_entropy", "e"), ("bar_variance", "v")))
    return _arrays(Op("drum_vector", f"WITH {base} SELECT y.song, <LIST({every})> AS dna FROM y {joins}", "20 scalars, 4 accents and 3 x 16 cells of the kit as one array"))


# Five archetypes as patterns over the cells of a bar (k kick, s snare, h hat, groups at once).
ARCHETYPES = {"rock": "(hk)h(hs)(h)(hk)(hk)(hs)(h)", "surf": "khsshhsh", "reggae": "hhhh(ksh)hhh", "waltz": "3/4 kss", "raggaetone": "khshkshh"}
_KIT = {"k": 36, "s": 38, "h": 42}


def _archetype_notes() -> str:
    """The archetypes' notes over four bars, as rows of drums."""
    rows = []
    for name, pattern in ARCHETYPES.items():
        beats, _, body = pattern.rpartition(" ")
        bar = 480 * int(beats.split("/")[0]) if beats else 1920
        cells, inside = [], None
        for ch in body:
            if ch == "(":
                inside = ""
            elif ch == ")":
                cells.append(inside)
                inside = None
            elif inside is None:
                cells.append(ch)
            else:
                inside += ch
        for b in range(4):
            rows += [(name, b * bar + bar * i // len(cells), _KIT[x]) for i, cell in enumerate(cells) for x in cell]
    return ", ".join(f"('{n}', {i}, {t}, {p})" for i, (n, t, p) in enumerate(rows))


BINDINGS = {"archetypes": Binding(f"SELECT name AS song, CAST(idx AS BIGINT) AS idx, CAST(start AS BIGINT) AS start, 60 AS dur, 9 AS chan, pitch, 100 AS vel FROM (VALUES {_archetype_notes()}) AS a(name, idx, start, pitch)")}
_GROOVE = ("kick_density", "snare_density", "hat_density", "backbeat", "syncopation_drum", "kit_size", "ghost")


def _archetype_match() -> Op:
    parts = lambda kit: f"SELECT g.song, {', '.join(f'CAST(g.{c} AS DOUBLE) AS {c}' for c in _GROOVE)}, e.grid_entropy, coalesce(v.bar_variance, 0e0) AS bar_variance, t.laid_back, t.tight FROM {{{kit}_groove_dna}} g JOIN {{{kit}_grid_entropy}} e ON e.song = g.song JOIN {{{kit}_microtiming}} t ON t.song = g.song LEFT JOIN {{{kit}_bar_variance}} v ON v.song = g.song"
    far = " + ".join(f"power(s.{c} - a.{c}, 2)" for c in (*_GROOVE, "grid_entropy", "bar_variance", "laid_back", "tight"))
    return Op("archetype_match", f"WITH s AS ({parts('kit')}), a AS ({parts('type')}), d AS (SELECT s.song, a.song AS name, round(sqrt({far}), 6) AS distance FROM s CROSS JOIN a), r AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY distance, name) AS rn FROM d) SELECT song, name, distance FROM r WHERE rn = 1", "nearest of five archetypes by eleven groove numbers")


def _modes() -> Op:
    fields = ("pitch", "dur", "vel")
    long = " UNION ALL ".join(f"SELECT song, '{f}' AS f, {f} AS v FROM x" for f in fields)
    sql = (
        "WITH k AS (SELECT song FROM {notes} GROUP BY song HAVING count(*) > 32), x AS (SELECT n.song, CASE WHEN chan = 9 THEN pitch + 128 ELSE pitch END AS pitch, dur, vel, chan FROM {notes} n JOIN k ON k.song = n.song), "
        f"t AS (SELECT song, f, v, count(*) AS m FROM ({long}) u GROUP BY song, f, v), r AS (SELECT song, f, v, row_number() OVER (PARTITION BY song, f ORDER BY m DESC, v) AS rn FROM t), q AS (SELECT song, f, v FROM r WHERE rn = 1), "
        f"w AS (SELECT song, {', '.join(f'''max(CASE WHEN f = '{f}' THEN v END) AS {f}_mode''' for f in fields)} FROM q GROUP BY song), "
        f"a AS (SELECT song, count(*) AS n_notes, count(DISTINCT chan) AS n_channels, count(CASE WHEN chan = 9 THEN 1 END) AS n_drums, min(pitch) AS pitch_min, max(pitch) AS pitch_max, round(stddev_pop(pitch), 6) AS pitch_std, {', '.join(f'CAST(floor(avg({f})) AS BIGINT) AS {f}_avg, CAST(floor(median({f})) AS BIGINT) AS {f}_med' for f in fields)} FROM x GROUP BY song) "
        f"SELECT a.*, {', '.join(f'CAST(w.{f}_mode AS BIGINT) AS {f}_mode' for f in fields)}, coalesce(c.n_chords, 0) AS n_chords, coalesce(c.n_unique, 0) AS n_unique, c.complexity FROM a JOIN w ON w.song = a.song LEFT JOIN {{of_chord_summary}} c ON c.song = a.song"
    )
    return Op("record_extract", sql, "one record a song of more than 32 notes: counts, chords, averages, medians and modes (the least of equal ones), drums 128 higher")


_MONO = "v AS (SELECT song, chan, start, max(pitch) AS pitch FROM {notes} WHERE chan NOT IN (9, 10) GROUP BY song, chan, start)"


def _imitation4() -> Op:
    lead = ", ".join(f"lead(d, {k}) OVER (PARTITION BY song, chan ORDER BY start) AS d{k}" for k in (1, 2, 3))
    same = lambda sign: " AND ".join(f"y.{c} = {sign}x.{c}" for c in ("d0", "d1", "d2", "d3"))
    hit = lambda sign: f"SELECT x.song, x.chan, y.chan AS other, x.k FROM g x JOIN u y ON y.song = x.song AND y.chan > x.chan AND {same(sign)}"
    sql = (
        f"WITH {_MONO}, m AS (SELECT song, chan, start, pitch - lag(pitch) OVER (PARTITION BY song, chan ORDER BY start) AS d FROM v), i AS (SELECT song, chan, start, d AS d0, {lead}, row_number() OVER (PARTITION BY song, chan ORDER BY start) AS k, count(*) OVER (PARTITION BY song, chan) AS n FROM m WHERE d IS NOT NULL), "
        "g AS (SELECT * FROM i WHERE k <= n - 4), u AS (SELECT DISTINCT song, chan, d0, d1, d2, d3 FROM g), "
        f"h AS ({hit('')} UNION {hit('-')}), c AS (SELECT song, count(DISTINCT chan) AS voices FROM v GROUP BY song), s AS (SELECT song, count(*) AS hits FROM h GROUP BY song) "
        "SELECT c.song, coalesce(s.hits, 0) AS hits, round(least(1e0, coalesce(s.hits, 0) / (c.voices * 3e0)), 4) AS imitation FROM c LEFT JOIN s ON s.song = c.song"
    )
    return Op("imitation_rate", sql, "four intervals that a later voice has too, as they are or inverted, at any delay, for each place of each pair of voices")


_CONCURRENT = Op(
    "voice_concurrency",
    f"WITH {_MONO}, e AS (SELECT song, start, coalesce(lead(start) OVER (PARTITION BY song, chan ORDER BY start), start + 240) AS nxt FROM v), s AS (SELECT song, CAST(start AS DOUBLE) AS t, 1 AS d FROM e UNION ALL SELECT song, (start + nxt) / 2e0, -1 FROM e), "
    "r AS (SELECT song, d, sum(d) OVER (PARTITION BY song ORDER BY t, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS live FROM s) SELECT song, round(median(greatest(1, live)), 6) AS live_median, round(avg(greatest(1, live)), 6) AS live_mean FROM r WHERE d > 0 GROUP BY song",
    "voices that sound at onsets, each note lasting half the way to the voice's next one",
)

# Saliency of bar lines: what is new in the top line before each note, at its nearest bar line, and the change of harmony into the bar.
_SALIENCY = (
    "top AS (SELECT song, start, max(pitch) AS pitch, max(dur) AS dur FROM (SELECT song, start, pitch, dur, max(pitch) OVER (PARTITION BY song, start) AS high FROM {notes} WHERE chan NOT IN (9, 10)) t WHERE pitch = high GROUP BY song, start), "
    "span AS (SELECT song, CAST(greatest(1e0, ceil(max(start + dur) / 192e1)) AS BIGINT) AS bars FROM {notes} GROUP BY song), "
    "i AS (SELECT song, start, CAST(start - lag(start) OVER o AS DOUBLE) AS ioi, CAST(greatest(0, start - lag(start + dur) OVER o) AS DOUBLE) AS rest, CAST(pitch - lag(pitch) OVER o AS DOUBLE) AS leap FROM top WINDOW o AS (PARTITION BY song ORDER BY start)), "
    "j AS (SELECT *, lag(ioi) OVER o AS ioi_was, lag(leap) OVER o AS leap_was FROM i WHERE ioi IS NOT NULL WINDOW o AS (PARTITION BY song ORDER BY start)), "
    "m AS (SELECT song, max(ioi) + 1e-9 AS ioi, max(rest) + 1e-9 AS rest, max(abs(leap)) + 1e-9 AS leap, count(*) AS n FROM j GROUP BY song), "
    "nov AS (SELECT j.song, CAST(rint(j.start / 192e1) AS BIGINT) AS bar, j.rest / m.rest + 7e-1 * j.ioi / m.ioi + 6e-1 * coalesce(abs(j.ioi_was - j.ioi) / (j.ioi_was + j.ioi + 1e-9), 0e0) + 5e-1 * abs(j.leap) / m.leap + 4e-1 * CASE WHEN sign(j.leap) * sign(j.leap_was) < 0 THEN 1e0 ELSE 0e0 END AS s FROM j JOIN m ON m.song = j.song WHERE m.n >= 2), "
    "ch AS (SELECT song, CAST(floor(start / 192e1) AS BIGINT) AS bar, pitch % 12 AS pc, CAST(sum(dur) AS DOUBLE) AS x FROM {notes} WHERE chan NOT IN (9, 10) GROUP BY song, CAST(floor(start / 192e1) AS BIGINT), pitch % 12), len AS (SELECT song, bar, sqrt(sum(x * x)) AS len FROM ch GROUP BY song, bar HAVING sum(x * x) > 0), "
    "ab AS (SELECT a.song, b.bar, sum(a.x * b.x) AS ab FROM ch a JOIN ch b ON b.song = a.song AND b.bar = a.bar + 1 AND b.pc = a.pc GROUP BY a.song, b.bar), "
    "hm AS (SELECT p.song, q.bar, 1e0 - coalesce(ab.ab, 0e0) / (p.len * q.len) AS s FROM len p JOIN len q ON q.song = p.song AND q.bar = p.bar + 1 LEFT JOIN ab ON ab.song = q.song AND ab.bar = q.bar), "
    "sal AS (SELECT u.song, u.bar, round(sum(u.s), 6) AS s FROM (SELECT song, bar, s FROM nov WHERE bar > 0 UNION ALL SELECT song, bar, s FROM hm) u JOIN span ON span.song = u.song AND u.bar <= span.bars GROUP BY u.song, u.bar)"
)


def _phrase_cuts() -> Op:
    """Greedy cuts: from the last one the most salient bar 2 to 8 ahead, at least 2 before the end; 8 ahead where nothing is salient."""
    sql = (
        f"WITH {_SALIENCY}, l AS (SELECT song, map_from_entries(collect_list(struct(bar, s))) AS s FROM sal GROUP BY song), a AS (SELECT span.song, span.bars, transform(sequence(0L, span.bars), b -> coalesce(try_element_at(l.s, b), 0e0)) AS s FROM span LEFT JOIN l ON l.song = span.song), "
        "w AS (SELECT song, bars, aggregate(sequence(0L, bars), named_struct('cuts', array(0L), 'last', 0L), (c, step) -> CASE WHEN bars - c.last <= 8 THEN c ELSE element_at(transform(array(least(c.last + 8, bars - 2)), hi -> element_at(transform(array(slice(s, CAST(c.last + 3 AS INT), CAST(greatest(hi - c.last - 1, 0) AS INT))), seg -> "
        "element_at(transform(array(CASE WHEN size(seg) = 0 OR array_max(seg) <= 0 THEN c.last + 8 ELSE c.last + 1 + array_position(seg, array_max(seg)) END), nxt -> named_struct('cuts', array_append(c.cuts, nxt), 'last', nxt)), 1)), 1)), 1) END, c -> array_append(c.cuts, bars)) AS cuts FROM a) "
        "SELECT song, CAST(place AS BIGINT) AS place, bar FROM (SELECT song, posexplode(cuts) AS (place, bar) FROM w) c"
    )
    check = (
        f"WITH RECURSIVE {_SALIENCY}, cut(song, bars, place, bar) AS (SELECT song, bars, 0::BIGINT, 0::BIGINT FROM span UNION ALL "
        "SELECT c.song, c.bars, c.place + 1, CASE WHEN coalesce(max(sal.s), 0) <= 0 THEN c.bar + 8 ELSE arg_min(sal.bar, {{'a': -sal.s, 'b': sal.bar}}) END FROM cut c LEFT JOIN sal ON sal.song = c.song AND sal.bar BETWEEN c.bar + 2 AND least(c.bar + 8, c.bars - 2) WHERE c.bars - c.bar > 8 GROUP BY c.song, c.bars, c.place, c.bar) "
        "SELECT song, place, bar FROM cut UNION ALL SELECT song, max(place) + 1, max(bars) FROM cut GROUP BY song"
    )
    return Op("phrase_cuts", sql, "cuts of a song into phrases of 2 to 8 bars at the most salient bar lines", check)


_RECOMBINED = Op(
    "phrase_recombination",
    "WITH p AS (SELECT song, place, bar, lead(bar) OVER (PARTITION BY song ORDER BY place) - bar AS bars FROM {of_phrase_cuts}), k AS (SELECT * FROM p WHERE bars > 0), s AS (SELECT song, CAST(row_number() OVER (PARTITION BY song % 16 ORDER BY song) AS BIGINT) AS r, song % 16 AS ring FROM (SELECT DISTINCT song FROM k) q), "
    "n AS (SELECT ring, max(r) AS n FROM s GROUP BY ring), d AS (SELECT a.song, b.song AS donor FROM s a JOIN n ON n.ring = a.ring JOIN s b ON b.ring = a.ring AND b.r = a.r % n.n + 1), "
    "c AS (SELECT d.song, k.song AS donor, k.place, k.bar, k.bars FROM d JOIN k ON k.song = CASE WHEN k.place % 2 = 0 THEN d.song ELSE d.donor END) "
    "SELECT song, place, donor, bar AS from_bar, bars, CAST(sum(bars) OVER (PARTITION BY song ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - bars AS BIGINT) AS at_bar FROM c",
    "even phrases of a song and odd ones of a donor laid on one grid of bars",
    None,
)


def _recombined() -> Op:
    """The join by parity as two equality joins."""
    sql = _RECOMBINED.sql.replace("FROM d JOIN k ON k.song = CASE WHEN k.place % 2 = 0 THEN d.song ELSE d.donor END)", "FROM d JOIN k ON k.song = d.song WHERE k.place % 2 = 0 UNION ALL SELECT d.song, k.song, k.place, k.bar, k.bars FROM d JOIN k ON k.song = d.donor WHERE k.place % 2 = 1)")
    return replace(_RECOMBINED, sql=sql)


_PATTERN = Op(
    "pattern_similarity",
    "WITH x AS (SELECT song, dim, x FROM {sig88}), p AS (SELECT dim, x FROM x WHERE song = (SELECT min(song) FROM x)), l AS (SELECT sqrt(sum(x * x)) AS len FROM p), n AS (SELECT x.song, sum(x.x * p.x) AS xp, sqrt(sum(x.x * x.x)) AS len FROM x JOIN p ON p.dim = x.dim GROUP BY x.song), c AS (SELECT n.song, CASE WHEN n.len > 1e-9 AND l.len > 1e-9 THEN n.xp / (n.len * l.len) ELSE 0e0 END AS sim FROM n CROSS JOIN l) SELECT song, round(sim, 6) AS similarity, round(3e0 * sim, 6) AS dim89 FROM c",
    "similarity to one pattern (the first song) in the corpus's scaling, and three times that as the 89th number",
)

# Drum patterns of a bar of 16 cells, as pitch and cell:velocity, without random hits.
GENRES = {
    "blast": {36: "0:112 2:112 4:112 6:112 8:112 10:112 12:112 14:112", 38: "1:104 3:104 5:104 7:104 9:104 11:104 13:104 15:104", 51: "0:84 4:84 8:84 12:84", 42: "1:84 2:84 3:84 5:84 6:84 7:84 9:84 10:84 11:84 13:84 14:84 15:84", 49: "0:118"},
    "dbeat": {36: "0:110 3:110 6:110 8:110 11:110 14:110", 38: "4:112 12:112", 42: "0:80 2:80 4:80 6:80 8:80 10:80 12:80 14:80", 49: "0:110"},
    "metal": {36: "0:104 1:104 3:104 4:104 6:104 8:104 9:104 11:104 12:104 14:104", 38: "4:114 12:114", 51: "0:82 2:82 4:82 6:82 8:82 10:82 12:82 14:82", 49: "0:108"},
    "openhat": {36: "0:110 4:110 8:110 12:110", 38: "4:116 12:116", 42: "0:80 1:66 4:80 5:66 8:80 9:66 12:80 13:66", 46: "2:74 3:70 6:74 7:70 10:74 11:70 14:74 15:70"},
    "trap": {36: "0:112 6:96 10:100", 39: "8:116", 38: "8:96", 42: "0:78 2:70 4:78 6:70 8:78 10:70 12:78 14:70 14:60 14.5:66 15:72 15.5:78", 46: "0:70"},
    "funk": {36: "0:108 6:92 10:96", 38: "2:44 4:112 12:112 14:48", 42: "0:60 2:72 4:66 6:60 8:72 10:66 12:60 14:72"},
    "jazz": {51: "0:78 4:78 6.67:66 8:78 12:78 14.67:66", 44: "4:70 12:70"},
    "none": {42: "0:40"},
    "rock": {36: "0:108 8:104 10:96", 38: "4:110 12:110", 42: "0:84 2:76 4:84 6:76 8:84 10:76 12:84 14:76"},
    "pop": {36: "0:104 10:98", 38: "4:108 12:108", 42: "0:72 2:72 4:72 6:72 8:72 10:72 12:72 14:72"},
    "boombap": {36: "0:112 3:88 8:106 11:84", 38: "4:116 12:116", 42: "0:74 2:64 4:74 6:64 7:52 8:74 10:64 12:74 14:64"},
    "fourfloor": {36: "0:112 4:112 8:112 12:112", 39: "4:100 12:100", 46: "2:82 6:82 10:82 14:82", 42: "0:64 2:64 4:64 6:64 8:64 10:64 12:64 14:64"},
    "lofi": {36: "0:90 8:80", 38: "4:92 7:40 12:90", 42: "0:56 2:50 4:56 6:50 8:56 10:50 12:56 14:50"},
}


def _genre_bars(bars: int = 16) -> Op:
    rows = ", ".join(f"('{g}', {p}, '{cells}')" for g, lanes in GENRES.items() for p, cells in lanes.items())
    fill = ", ".join(f"({p}, {c}, {v})" for p, c, v in [(36, 0, 104), (38, 4, 100), (42, 0, 70), *[(p, 8 + i, 96 + 2 * i) for i, p in enumerate((38, 38, 47, 47, 43, 43, 50, 38))]])
    sql = (
        f"WITH g AS (SELECT * FROM (VALUES {rows}) AS g(genre, pitch, cells)), h AS (SELECT genre, pitch, CAST(substring(hit, 1, <POS> - 1) AS DOUBLE) AS cell, CAST(substring(hit, <POS> + 1) AS INT) AS vel FROM (SELECT genre, pitch, <EACH> AS hit FROM g) e), "
        f"f AS (SELECT * FROM (VALUES {fill}) AS f(pitch, cell, vel)), b AS (SELECT <BARS> AS bar), n AS (SELECT DISTINCT genre FROM g), "
        f"t AS (SELECT h.genre, b.bar, h.pitch, h.cell, h.vel FROM h CROSS JOIN b WHERE b.bar % 4 <> 3 OR b.bar = {bars - 1} OR h.genre = 'none' UNION ALL SELECT n.genre, b.bar, f.pitch, f.cell, f.vel FROM n CROSS JOIN b CROSS JOIN f WHERE b.bar % 4 = 3 AND b.bar <> {bars - 1} AND n.genre <> 'none' UNION ALL SELECT n.genre, b.bar, 49, 0, 112 FROM n CROSS JOIN b WHERE b.bar % 8 = 0) "
        "SELECT genre, CAST(bar * 1920 + rint(cell * 12e1) AS BIGINT) AS start, pitch, greatest(1, least(127, CAST(rint(vel * (6e-1 + 5e-1 * (bar % 8) / 7e0)) AS INT))) AS vel FROM t"
    )
    spark = sql.replace("<POS>", "instr(hit, ':')").replace("<EACH>", "explode(split(cells, ' '))").replace("<BARS>", f"explode(sequence(0, {bars - 1}))")
    other = sql.replace("<POS>", "strpos(hit, ':')").replace("<EACH>", "unnest(string_split(cells, ' '))").replace("<BARS>", f"unnest(range({bars}))::INT")
    return Op("genre_drums", spark, f"drum patterns of genres over {bars} bars: velocities follow the bar's energy, a fill every fourth bar, a crash every eighth", other)


# Nine voices of a kit.
VOICES = {"kick": (35, 36), "snare": (37, 38, 40), "chat": (42, 44, 22), "ohat": (46, 26), "ltom": (41, 43, 45), "mtom": (47, 48), "htom": (50,), "crash": (49, 52, 55, 57), "ride": (51, 53, 59)}


def _drum_layers() -> Op:
    """The 24 scalars and accents, then 9 x 16 cells of hits a bar, of the fifth root of velocity, and of the distance to the cell."""
    voice = "CASE " + " ".join(f"WHEN pitch IN ({', '.join(map(str, p))}) THEN {i}" for i, p in enumerate(VOICES.values())) + " END"
    sql = (
        f"WITH c AS (SELECT song, CAST(floor(start / 192e1) AS BIGINT) AS bar, {voice} AS voice, CAST(rint(((start % 1920) / 48e1) / 25e-2) AS BIGINT) % 16 AS cell, power(greatest(0e0, least(1e0, vel / 127e0)), 2e-1) AS loud, greatest(-1e0, least(1e0, ((start % 1920) / 48e1 - rint(((start % 1920) / 48e1) / 25e-2) * 25e-2) / 125e-3)) AS off FROM {{drums}} WHERE chan IN (9, 10) AND pitch BETWEEN 35 AND 81), "
        "n AS (SELECT song, CAST(max(bar) - min(bar) + 1 AS DOUBLE) AS bars FROM c GROUP BY song), g AS (SELECT c.song, c.voice * 16 + c.cell AS at, least(1e0, count(*) / max(n.bars)) AS h, avg(c.loud) AS v, avg(c.off) AS o FROM c JOIN n ON n.song = c.song WHERE c.voice IS NOT NULL GROUP BY c.song, c.voice * 16 + c.cell), "
        "d AS (SELECT n.song, l.layer * 144 + p.place AS dim, CASE l.layer WHEN 0 THEN g.h WHEN 1 THEN g.v ELSE g.o END AS x FROM n CROSS JOIN (VALUES (0), (1), (2)) AS l(layer) CROSS JOIN (SELECT <PLACES> AS place) p LEFT JOIN g ON g.song = n.song AND g.at = p.place), "
        "w AS (SELECT song, <ORDERED> AS grid FROM (SELECT song, dim, coalesce(round(x, 6), 0e0) AS x FROM d) y GROUP BY song) SELECT w.song, <JOINED> AS dna FROM w JOIN {of_drum_vector} s ON s.song = w.song"
    )
    spark = sql.replace("<PLACES>", "explode(sequence(0, 143))").replace("<ORDERED>", "transform(array_sort(collect_list(named_struct('dim', dim, 'x', x))), e -> e.x)").replace("<JOINED>", "concat(slice(s.dna, 1, 24), w.grid)")
    return Op("drum_layers", spark, "24 scalars and accents and 9 x 16 x 3 cells of hits, loudness and timing as one array", sql.replace("<PLACES>", "unnest(range(144))").replace("<ORDERED>", "list(x ORDER BY dim)").replace("<JOINED>", "list_concat(s.dna[1:24], w.grid)"))


_DEEP = Op(
    "deep_harmony",
    "WITH q AS (SELECT song, max(CASE WHEN quality = 'maj' THEN share END) AS maj, max(CASE WHEN quality = 'min' THEN share END) AS mi, max(CASE WHEN quality = 'dim' THEN share END) AS dim, max(CASE WHEN quality = 'dom7' THEN share END) AS dom7 FROM {of_chord_qualities} GROUP BY song), "
    "b AS (SELECT q.song, coalesce(q.maj, 0e0) AS maj, coalesce(q.mi, 0e0) AS mi, coalesce(q.dim, 0e0) AS dim, coalesce(q.dom7, 0e0) AS dom7, round(3e-1 * CASE WHEN k.key_name LIKE '%major' THEN coalesce(q.mi, 0e0) ELSE coalesce(q.maj, 0e0) END, 4) AS borrowed FROM q LEFT JOIN {of_key_detect} k ON k.song = q.song) "
    "SELECT b.song, b.maj AS chord_maj, b.mi AS chord_min, f.tonic_share, f.subdominant_share, f.dominant_share, t.mean AS tension_mean, t.variance AS tension_variance, v.density AS voicing_density, v.spread AS voicing_spread, round(6e-1 * b.dom7, 4) AS secondary_dominant_rate, b.borrowed AS borrowed_chord_rate, round(least(1e0, b.borrowed + b.dim), 4) AS modal_interchange "
    "FROM b LEFT JOIN {of_chord_functions} f ON f.song = b.song LEFT JOIN {of_tension_curve} t ON t.song = b.song LEFT JOIN {of_voicing} v ON v.song = b.song",
    "chord kinds, functions, tension, voicing and the rates of secondary dominants, borrowed chords and interchange of modes",
)

def _melody_walk() -> Op:
    """A motif of eight steps, drawn by a hash of the song, walked in each of eight bars from a drawn start and set on the scale of C (the note below where it misses)."""
    eight = ", ".join(f"({i})" for i in range(8))
    sql = (
        f"WITH s AS (SELECT DISTINCT song FROM {{notes}} WHERE song IS NOT NULL), m AS (SELECT s.song, m.i, <HASH(concat(s.song, '|motif|', m.i))> % 5 - 2 AS step FROM s CROSS JOIN (VALUES {eight}) AS m(i)), "
        f"w AS (SELECT song, i, sum(step) OVER (PARTITION BY song ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at FROM m), t AS (SELECT w.song, b.bar, w.i, CAST(67 + w.at + <HASH(concat(w.song, '|bar|', b.bar))> % 5 AS INT) AS p FROM w CROSS JOIN (VALUES {eight}) AS b(bar)) "
        "SELECT song, CAST(bar * 1920 + i * 240 AS BIGINT) AS start, 240 AS dur, p - CASE WHEN p % 12 IN (1, 3, 6, 8, 10) THEN 1 ELSE 0 END AS pitch FROM t"
    )
    hashed = lambda text, a, b: text.replace("<HASH(", a).replace(")>", b)
    return Op("melody_walk", hashed(sql, "CAST(conv(substring(md5(", "), 1, 6), 16, 10) AS BIGINT)"), "a motif as a random walk, repeated and set on the scale", hashed(sql, "('0x' || substring(md5(", "), 1, 6))::BIGINT"))


OPS = [
    _melody_walk(),
    _drum_layers(),
    _half_up(_DEEP, 4),
    _modes(),
    _signature("signature88", WEIGHTS, "median(y)", "dim", "36 numbers of pitch and 52 of rhythm, melody, harmony and groove: logged, imputed, scaled by the corpus, clipped; each block of unit length times the root of its weight"),
    _signature("signature_balanced", BALANCED, "avg(0e0)", "pillar", "the same with four equal pillars, missing as zero and the logarithm for whole blocks"),
    _PATTERN,
    _drum_vector(),
    _archetype_match(),
    _imitation4(),
    _CONCURRENT,
    _phrase_cuts(),
    _recombined(),
    _genre_bars(),
]
OPS = [_even(op) for op in OPS]
