"""Ranks, deciles, draws and plans. Every draw is an order by a hash of key and seed, so it can be repeated anywhere."""

from notegrain.plans.ops import Op


def _u(key: str, seed: str) -> tuple[str, str]:
    return (f"CAST(conv(substring(md5(concat({key}, '|{seed}')), 1, 8), 16, 10) AS DOUBLE) / 4294967296e0", f"('0x' || substring(md5(concat({key}, '|{seed}')), 1, 8))::BIGINT::DOUBLE / 4294967296e0")


def _drawn(name: str, sql: str, what: str, seed: str, key: str = "md5") -> Op:
    a, b = _u(key, seed)
    return Op(name, sql.replace("<U>", a), what, sql.replace("<U>", b))


# Global ranks without a global window: rows are counted by value, only the distinct values are put in order, and ties are ordered within their value.
_PLACED = "v AS (SELECT n_notes, count(*) AS m FROM {catalog} WHERE n_notes IS NOT NULL GROUP BY n_notes), o AS (SELECT n_notes, sum(m) OVER (ORDER BY n_notes ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - m AS before FROM v), t AS (SELECT sum(m) AS n FROM v), d AS (SELECT c.md5, CAST(greatest(ceil((o.before + row_number() OVER (PARTITION BY c.n_notes ORDER BY c.md5) - 1) * 10e0 / greatest(t.n - 1, 1)) - 1, 0) AS INT) AS decile FROM {catalog} c JOIN o ON o.n_notes = c.n_notes CROSS JOIN t)"


_LINSPACE = "WITH v AS (SELECT substring(md5, 1, 3) AS p, count(*) AS m FROM {catalog} GROUP BY substring(md5, 1, 3)), o AS (SELECT p, sum(m) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - m AS before FROM v), r AS (SELECT c.md5, CAST(o.before + row_number() OVER (PARTITION BY substring(c.md5, 1, 3) ORDER BY c.md5) - 1 AS BIGINT) AS i FROM {catalog} c JOIN o ON o.p = substring(c.md5, 1, 3)), k AS (SELECT DISTINCT CAST(<ROUND> AS BIGINT) AS i FROM (SELECT sum(m) AS n FROM v) x CROSS JOIN <Q>) SELECT r.md5, r.i FROM r JOIN k ON k.i = r.i"


def _mean_rank(name: str, value: str, bin_: str = "x") -> str:
    """Percentile rank with ties at their mean. Distinct values are ordered within bins (``bin_`` grows with x), bins among each other by their counts, so no task orders all values."""
    return f"{name}_v AS (SELECT x, {bin_} AS k, m FROM (SELECT {value} AS x, count(*) AS m FROM {{catalog}} GROUP BY {value}) q), {name}_b AS (SELECT k, sum(m) AS m FROM {name}_v GROUP BY k), {name}_o AS (SELECT k, sum(m) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - m AS before, sum(m) OVER () AS n FROM {name}_b), {name} AS (SELECT v.x, (o.before + sum(v.m) OVER (PARTITION BY v.k ORDER BY v.x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - v.m + (v.m + 1) / 2e0) / o.n AS pr FROM {name}_v v JOIN {name}_o o ON o.k = v.k)"


_BINNED = "CAST(floor(1e3 * ln(2e0 + least(x, 1e15))) AS BIGINT)"
# Ranks of a draw in two steps: 4,096 ranges of the draw by their counts, then rows within their range.
_RANGES = "g AS (SELECT *, CAST(floor(u * 4096e0) AS BIGINT) AS k FROM d), n AS (SELECT part, k, count(*) AS m FROM g GROUP BY part, k), o AS (SELECT part, k, CAST(sum(m) OVER (PARTITION BY part ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - m AS BIGINT) AS before, CAST(sum(m) OVER (PARTITION BY part) AS BIGINT) AS n FROM n)"


# The plain form: one window a load. The operator works by minutes of a load (by key where a load has one time only), whose maxima are accumulated first.
_BEST_CHECK = "WITH g AS (SELECT load_id, md5, loaded_at, n_notes AS score, CASE WHEN has_drums = 1 AND note_density < 20 THEN 1 ELSE 0 END AS ok FROM {catalog}), w AS (SELECT *, max(CASE WHEN ok = 1 THEN score END) OVER (PARTITION BY load_id ORDER BY loaded_at, md5 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM g) SELECT load_id, md5, score, best, CASE WHEN ok = 1 AND (best IS NULL OR score > best) THEN 'keep' ELSE 'discard' END AS status FROM w"

OPS = [
    Op("pct_rank_avg", f"WITH {_mean_rank('r', 'n_tracks')} SELECT c.md5, round(r.pr, 9) AS pr FROM {{catalog}} c JOIN r ON r.x = c.n_tracks", "percentile rank, ties share their mean"),
    Op("decile_qcut", f"WITH {_PLACED} SELECT md5, decile FROM d", "deciles by first rank"),
    _drawn("topn_per_decile", f"WITH {_PLACED} SELECT decile, md5 FROM (SELECT md5, decile, row_number() OVER (PARTITION BY decile ORDER BY <U>, md5) AS rn FROM d) r WHERE rn <= 5", "five of each decile", "decile"),
    _drawn("weighted_sample", "SELECT md5 FROM (SELECT md5, -ln(<U> + 1e-12) / (n_notes + 1e0) AS k FROM {catalog} WHERE n_notes IS NOT NULL) w ORDER BY round(k, 15), md5 LIMIT 200", "without replacement, likelier with weight", "weight"),
    _drawn("seeded_shuffle", f"WITH d AS (SELECT md5, coalesce(has_drums, -1) AS part, <U> AS u FROM {{catalog}}), {_RANGES} SELECT g.md5, o.before + row_number() OVER (PARTITION BY g.part, g.k ORDER BY g.u, g.md5) AS place FROM g JOIN o ON o.part = g.part AND o.k = g.k", "order by a hash", "shuffle"),
    Op("linspace_sample", _LINSPACE.replace("<ROUND>", "rint(q * (n - 1) / 99e0)").replace("<Q>", "(SELECT explode(sequence(0, 99)) AS q) s"), "evenly spaced positions in the order of keys", _LINSPACE.replace("<ROUND>", "round_even(q * (n - 1) / 99e0, 0)").replace("<Q>", "range(100) s(q)")),
    Op("canonical_rank", "SELECT song_id, md5, row_number() OVER (PARTITION BY song_id ORDER BY n_notes DESC, md5) - 1 AS arrangement_rank, CASE WHEN row_number() OVER (PARTITION BY song_id ORDER BY n_notes DESC, md5) = 1 THEN 1 ELSE 0 END AS is_canonical, count(*) OVER (PARTITION BY song_id) AS n_arrangements FROM {catalog} WHERE song_id IS NOT NULL", "rank of arrangements in a song"),
    Op("best_so_far", "WITH g AS (SELECT load_id, md5, loaded_at, n_notes AS score, CASE WHEN has_drums = 1 AND note_density < 20 THEN 1 ELSE 0 END AS ok FROM {catalog}), e AS (SELECT load_id, min(loaded_at) AS lo, max(loaded_at) AS hi FROM g GROUP BY load_id), s AS (SELECT g.*, CASE WHEN e.lo = e.hi THEN substring(g.md5, 1, 3) ELSE substring(CAST(g.loaded_at AS <TEXT>), 1, 16) END AS k FROM g JOIN e ON e.load_id = g.load_id), b AS (SELECT load_id, k, max(CASE WHEN ok = 1 THEN score END) AS best FROM s GROUP BY load_id, k), o AS (SELECT load_id, k, max(best) OVER (PARTITION BY load_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM b), w AS (SELECT s.*, nullif(greatest(coalesce(o.was, -1), coalesce(max(CASE WHEN ok = 1 THEN score END) OVER (PARTITION BY s.load_id, s.k ORDER BY s.loaded_at, s.md5 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)), -1) AS best FROM s JOIN o ON o.load_id = s.load_id AND o.k = s.k) SELECT load_id, md5, score, best, CASE WHEN ok = 1 AND (best IS NULL OR score > best) THEN 'keep' ELSE 'discard' END AS status FROM w".replace("<TEXT>", "STRING"), "kept while better than all kept before", _BEST_CHECK),
    _drawn("staged_pool", "WITH a AS (SELECT md5, 'long' AS stage FROM {catalog} WHERE duration_sec > 400 ORDER BY <U>, md5 LIMIT 30), b AS (SELECT md5, 'dense' AS stage FROM {catalog} WHERE note_density > 12 AND md5 NOT IN (SELECT md5 FROM a) ORDER BY <U>, md5 LIMIT 40), c AS (SELECT md5, 'any' AS stage FROM {catalog} WHERE md5 NOT IN (SELECT md5 FROM a) AND md5 NOT IN (SELECT md5 FROM b) ORDER BY <U>, md5 LIMIT 30) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c", "quotas in stages; a later stage refills its own", "pool"),
    Op("acquisition_pool", "WITH e AS (SELECT min(n_notes) AS a, max(n_notes) AS b, min(n_tracks) AS p, max(n_tracks) AS q FROM {catalog}), r AS (SELECT c.md5, round(5e-1 * (c.n_notes - e.a) / (e.b - e.a + 1e-9) + 5e-1 * (c.n_tracks - e.p) / (e.q - e.p + 1e-9), 9) AS score FROM {catalog} c CROSS JOIN e) SELECT md5, score FROM r ORDER BY score DESC, md5 LIMIT 100", "half uncertainty, half proximity"),
    Op("plan_budget", "SELECT cluster_id, seed, temp FROM (SELECT k.cluster_id, s.seed, t.temp, row_number() OVER (PARTITION BY k.cluster_id ORDER BY s.seed, t.temp) AS rn FROM {cluster_summary} k CROSS JOIN (SELECT 1 AS seed UNION ALL SELECT 2 UNION ALL SELECT 3) s CROSS JOIN (SELECT 8e-1 AS temp UNION ALL SELECT 1e0) t WHERE k.size >= 30) p WHERE rn <= 4", "corners, seeds and temperatures within a budget"),
    Op("next_unprobed", "SELECT cluster_id, isolation FROM {cluster_summary} c WHERE size >= 10 AND NOT EXISTS (SELECT 1 FROM {clusters} k WHERE k.cluster_id = c.cluster_id AND k.n_arrangements > 100) ORDER BY isolation DESC, cluster_id LIMIT 10", "first of what is not done"),
    Op("distinct_per_song", "SELECT song_id, md5 FROM (SELECT song_id, md5, row_number() OVER (PARTITION BY song_id ORDER BY coalesce(is_canonical, 0) DESC, md5) AS rn FROM {catalog} WHERE song_id IS NOT NULL) r WHERE rn = 1", "one a song, canonical preferred"),
    _drawn("random_pairs", "SELECT load_id, max(CASE WHEN rn = 1 THEN md5 END) AS a, max(CASE WHEN rn = 2 THEN md5 END) AS b FROM (SELECT load_id, md5, row_number() OVER (PARTITION BY load_id ORDER BY <U>, md5) AS rn FROM {catalog}) r WHERE rn <= 2 GROUP BY load_id", "two different rows of each load", "pair"),
    Op("gated_fallback", "SELECT load_id, md5, score FROM (SELECT load_id, md5, n_notes AS score, CASE WHEN note_density > 30 THEN 1 ELSE 0 END AS gate, max(CASE WHEN note_density > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY load_id) AS has_gate FROM {catalog}) g WHERE gate = has_gate OR has_gate = 0", "gated rows where there are any, else all"),
    Op("sampler_weights", f"WITH {_mean_rank('d', 'coalesce(note_density, -1e0)', _BINNED)}, {_mean_rank('x', 'n_distinct_patches')} SELECT c.md5, round(45e-2 * (1e0 - d.pr) + 30e-2 * x.pr + 20e-2 * c.has_drums, 6) AS weight FROM {{catalog}} c JOIN d ON d.x = coalesce(c.note_density, -1e0) JOIN x ON x.x = c.n_distinct_patches", "weights from ranks"),
]
