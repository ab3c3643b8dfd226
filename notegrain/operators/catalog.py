"""The catalog: manifest, flags, status, views, joins, splits, pools, rollups, gates."""

from dataclasses import replace

from notegrain.plans.ops import Op

_HASH = "CAST(conv(substring(md5(concat(md5, '|{seed}')), 1, 8), 16, 10) AS DOUBLE) / 4294967296e0"
_HASH_C = "('0x' || substring(md5(concat(md5, '|{seed}')), 1, 8))::BIGINT::DOUBLE / 4294967296e0"
_SOURCE = "first_source AS (SELECT md5, min(element_at(sources, 1)) AS source FROM {manifest} WHERE size(sources) > 0 GROUP BY md5)"
_SOURCE_C = "first_source AS (SELECT md5, min(sources[1]) AS source FROM {manifest} WHERE len(sources) > 0 GROUP BY md5)"
# General MIDI families, sixteen of eight programs each.
FAMILIES = ("piano", "chromatic", "organ", "guitar", "bass", "strings", "ensemble", "brass", "reed", "pipe", "synth_lead", "synth_pad", "synth_fx", "ethnic", "percussive", "sfx")
_FAMILY = "CASE CAST(floor(p / 8e0) AS INT) " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FAMILIES)) + " ELSE 'other' END"


def _seeded(name: str, sql: str, what: str, seed: str) -> Op:
    return Op(name, sql.replace("<U>", _HASH.replace("{seed}", seed)), what, sql.replace("<U>", _HASH_C.replace("{seed}", seed)))


def _first(op: Op) -> Op:
    """<FIRST> is the first of a manifest row's sources."""
    return replace(op, sql=op.sql.replace("<FIRST>", "try_element_at(sources, 1)"), check=(op.check or op.sql).replace("<FIRST>", "sources[1]"))


OPS = [
    Op("dedup_manifest", "SELECT md5, min(path) AS stored_path, min(size) AS size, count(*) AS n_copies, array_join(array_sort(collect_set(source)), ';') AS sources, array_join(array_sort(collect_set(host)), ';') AS hosts FROM {inputs} GROUP BY md5", "one row for each content hash", "SELECT md5, min(path) AS stored_path, min(size) AS size, count(*) AS n_copies, string_agg(DISTINCT source, ';' ORDER BY source) AS sources, string_agg(DISTINCT host, ';' ORDER BY host) AS hosts FROM {inputs} GROUP BY md5"),
    Op("value_counts", "SELECT time_signature AS value, count(*) AS n FROM {metadata} GROUP BY time_signature ORDER BY n DESC, value LIMIT 20", "commonest values, null included", "SELECT time_signature AS value, count(*) AS n FROM {metadata} GROUP BY time_signature ORDER BY n DESC, value NULLS FIRST LIMIT 20"),
    Op("count_distinct", "SELECT count(DISTINCT md5) AS files, count(DISTINCT song_id) AS songs, count(*) AS n_rows FROM {metadata}", "files and songs"),
    Op("source_counts", "SELECT source, count(*) AS n FROM (SELECT explode(sources) AS source FROM {manifest}) s GROUP BY source", "files per source", "SELECT source, count(*) AS n FROM (SELECT unnest(sources) AS source FROM {manifest}) s GROUP BY source"),
    Op("describe_columns", "SELECT count(bpm) AS n, round(avg(CASE WHEN bpm < 1e9 THEN bpm END), 6) AS mean_bpm, round(stddev_pop(CASE WHEN bpm < 1e9 THEN bpm END), 4) AS std_bpm, min(n_notes) AS min_notes, max(n_notes) AS max_notes, median(n_notes) AS med_notes FROM {catalog}", "summary of columns"),
    Op("classify_source", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN host LIKE '%-0' THEN 'own' WHEN path LIKE '%7%' AND source LIKE '%urg%' THEN 'urgent' WHEN source LIKE '%hig%' THEN 'archive' WHEN path LIKE '%99%' THEN 'pack' ELSE 'other' END AS kind FROM {inputs}) k GROUP BY kind", "host rule first, then ordered substring rules"),
    Op("program_families", f"SELECT family, count(*) AS n FROM (SELECT {_FAMILY} AS family FROM (SELECT CAST(x AS INT) AS p FROM (SELECT explode(split(midi_patches, ';')) AS x FROM {{catalog}} WHERE midi_patches <> '') e) p) f GROUP BY family", "programs by family", f"SELECT family, count(*) AS n FROM (SELECT {_FAMILY} AS family FROM (SELECT CAST(x AS INT) AS p FROM (SELECT unnest(string_split(midi_patches, ';')) AS x FROM {{catalog}} WHERE midi_patches <> '') e) p) f GROUP BY family"),
    Op("quality_flags", "SELECT md5, CASE WHEN time_signature IS NULL OR trim(time_signature) = '' OR time_signature IN ('1/4', '1/8') THEN '4/4' ELSE time_signature END AS meter, CASE WHEN time_signature IS NULL OR trim(time_signature) = '' OR time_signature IN ('1/4', '1/8') THEN 1 ELSE 0 END AS meter_inferred, CASE WHEN bpm BETWEEN 20 AND 300 THEN 1 ELSE 0 END AS bpm_valid, CASE WHEN duration_sec > 3600 THEN 1 ELSE 0 END AS duration_suspect FROM {catalog}", "meter repair, valid tempo, suspect duration"),
    Op("absurd_flags", "SELECT md5, absurd, CASE WHEN absurd = 0 THEN note_density END AS density FROM (SELECT md5, note_density, CASE WHEN note_density > 1e3 OR n_tracks > 200 OR tempo_change_count > 100000 THEN 1 ELSE 0 END AS absurd FROM {catalog}) a", "absurd values are cleared"),
    Op("integrity_scan", "SELECT song, count(*) AS n_notes, min(vel) AS vel_min, max(vel) AS vel_max, count(DISTINCT chan) AS n_voices, min(CASE WHEN pitch BETWEEN 21 AND 108 THEN 0 ELSE 1 END) = 1 AS all_out_of_range, round(avg(CASE WHEN chan = 9 THEN CASE WHEN pitch BETWEEN 35 AND 81 THEN 1e0 ELSE 0e0 END END), 6) AS drum_valid_share, round(count(*) / (max(start + dur) / 48e1), 6) AS density, count(CASE WHEN start < 0 OR dur < 0 THEN 1 END) AS neg_ticks FROM {notes} GROUP BY song", "per-file checks"),
    Op("quarantine_reason", "SELECT md5, CASE WHEN size = 0 THEN 'zero_byte' WHEN n_copies < 0 THEN 'negative' WHEN is_quarantined = 1 THEN coalesce(quarantine_reason, 'unknown') END AS reason FROM (SELECT DISTINCT md5, size, n_copies, is_quarantined, quarantine_reason FROM {manifest}) m", "first reason that holds"),
    Op("file_status", "SELECT status, count(*) AS n FROM (SELECT m.md5, CASE WHEN m.q = 1 THEN 'quarantined' WHEN c.md5 IS NOT NULL AND c.n_notes > 32 THEN 'in_catalog' WHEN c.md5 IS NOT NULL THEN 'too_few_notes' ELSE 'no_metadata' END AS status FROM (SELECT md5, max(is_quarantined) AS q FROM {manifest} GROUP BY md5) m LEFT JOIN {catalog} c ON c.md5 = m.md5) s GROUP BY status", "status by priority"),
    Op("catalog_views", "SELECT 'all' AS view, count(*) AS n FROM {catalog} UNION ALL SELECT 'canonical', count(*) FROM {catalog} WHERE is_canonical = 1 UNION ALL SELECT 'with_lyrics', count(*) FROM {catalog} WHERE lyric_events_count > 0 UNION ALL SELECT 'no_drums', count(*) FROM {catalog} WHERE has_drums = 0 UNION ALL SELECT 'clean', count(*) FROM {catalog} WHERE bpm BETWEEN 20 AND 300 AND duration_sec <= 3600 AND n_notes > 32", "row counts of the views"),
    Op("pristine", "SELECT md5 FROM {catalog} WHERE coalesce(bpm BETWEEN 20 AND 300, false) AND NOT coalesce(duration_sec > 3600, false) AND coalesce(note_density <= 80, true)", "null polarity by column"),
    Op("complexity_class", "SELECT class, count(*) AS n FROM (SELECT CASE WHEN n_distinct_chords IS NULL OR n_distinct_chords = 0 THEN 'none' WHEN n_distinct_chords < 8 THEN 'low' WHEN n_distinct_chords < 25 THEN 'medium' ELSE 'high' END AS class FROM {catalog}) c GROUP BY class", "classes of chord variety"),
    Op("genre_rules", "SELECT md5, CASE WHEN n_distinct_patches = 1 AND has_drums = 0 THEN 'solo_piano' WHEN has_drums = 0 AND n_tracks >= 8 THEN 'classical' WHEN coalesce(bpm, 0e0) BETWEEN 120 AND 150 AND n_distinct_patches <= 3 THEN 'electronic' WHEN coalesce(n_distinct_chords, 0) > 60 THEN 'jazz' ELSE 'unknown' END AS genre FROM {catalog}", "first rule that matches"),
    Op("meter_decode", "SELECT md5, num, den, CASE WHEN num IN (6, 9, 12) AND den = 8 THEN 1 ELSE 0 END AS compound, CASE WHEN num BETWEEN 2 AND 12 AND den IN (2, 4, 8) THEN concat(num, '/', den) ELSE '4/4' END AS meter FROM (SELECT md5, CASE WHEN regexp_like(time_signature, '^[0-9]{{1,2}}/[0-9]{{1,2}}$') THEN CAST(split_part(time_signature, '/', 1) AS INT) END AS num, CASE WHEN regexp_like(time_signature, '^[0-9]{{1,2}}/[0-9]{{1,2}}$') THEN CAST(split_part(time_signature, '/', 2) AS INT) END AS den FROM {catalog}) t", "numerator, denominator, compound, sanitised", "SELECT md5, num, den, CASE WHEN num IN (6, 9, 12) AND den = 8 THEN 1 ELSE 0 END AS compound, CASE WHEN num BETWEEN 2 AND 12 AND den IN (2, 4, 8) THEN concat(num, '/', den) ELSE '4/4' END AS meter FROM (SELECT md5, CASE WHEN regexp_full_match(time_signature, '[0-9]{{1,2}}/[0-9]{{1,2}}\\s?') THEN CAST(split_part(time_signature, '/', 1) AS INT) END AS num, CASE WHEN regexp_full_match(time_signature, '[0-9]{{1,2}}/[0-9]{{1,2}}\\s?') THEN TRY_CAST(trim(split_part(time_signature, '/', 2), chr(10)) AS INT) END AS den FROM {catalog}) t"),
    Op("clamp_rating", "SELECT md5, CASE WHEN n_tracks BETWEEN 0 AND 8 THEN n_tracks END AS rating FROM {catalog}", "0 to 8, else null"),
    Op("caption", "SELECT md5, concat_ws(' · ', CASE WHEN bpm BETWEEN 20 AND 300 THEN concat('bpm', CAST(CAST(floor(bpm) AS BIGINT) AS STRING)) END, CASE WHEN has_drums = 1 THEN 'kit' END, CASE WHEN n_distinct_chords > 40 THEN 'ext-harm' END, CASE WHEN time_signature <> '4/4' AND time_signature <> '' THEN 'odd' END) AS caption FROM {catalog}", "phrases that hold, joined", "SELECT md5, concat_ws(' · ', CASE WHEN bpm BETWEEN 20 AND 300 THEN concat('bpm', CAST(CAST(floor(bpm) AS BIGINT) AS VARCHAR)) END, CASE WHEN has_drums = 1 THEN 'kit' END, CASE WHEN n_distinct_chords > 40 THEN 'ext-harm' END, CASE WHEN time_signature <> '4/4' AND time_signature <> '' THEN 'odd' END) AS caption FROM {catalog}"),
    Op("caption_bpm", "SELECT cluster_id, CAST(regexp_extract(caption, 'bpm([0-9]{{2,3}})', 1) AS STRING) AS bpm FROM {cluster_summary} WHERE caption IS NOT NULL", "number after a word", "SELECT cluster_id, regexp_extract(caption, 'bpm([0-9]{{2,3}})', 1) AS bpm FROM {cluster_summary} WHERE caption IS NOT NULL"),
    Op("explorer_swing", "SELECT cluster_id, size, caption FROM {cluster_summary} WHERE caption LIKE '%swing%' AND caption NOT LIKE '%ext-harm%' AND size >= 5 ORDER BY size DESC, cluster_id LIMIT 500", "filtered clusters, largest first"),
    Op("rich_name", "SELECT md5, concat(substring(md5, 1, 12), CASE WHEN song_id IS NOT NULL THEN concat('_', song_id) ELSE '' END, '.mid') AS name FROM {catalog}", "formatted name with optional parts"),
    Op("wide_left_join", "SELECT c.md5, c.bpm, c.n_notes, m.n_copies, k.cluster_id FROM {catalog} c LEFT JOIN (SELECT md5, max(n_copies) AS n_copies FROM {manifest} GROUP BY md5) m ON m.md5 = c.md5 LEFT JOIN (SELECT md5, max(cluster_id) AS cluster_id FROM {clusters} GROUP BY md5) k ON k.md5 = c.md5", "families joined by file, one row a file"),
    Op("outer_then_left", "SELECT c.md5, x.a, x.b FROM {catalog} c LEFT JOIN (SELECT coalesce(p.md5, q.md5) AS md5, p.a, q.b FROM (SELECT md5, max(size) AS a FROM {manifest} WHERE n_copies > 1 GROUP BY md5) p FULL JOIN (SELECT md5, max(arrangement_rank) AS b FROM {clusters} WHERE cluster_id >= 0 GROUP BY md5) q ON q.md5 = p.md5) x ON x.md5 = c.md5", "full join, then left join"),
    Op("anti_resume", "SELECT md5, count(*) AS n FROM {manifest} m WHERE NOT EXISTS (SELECT 1 FROM {metadata} d WHERE d.md5 = m.md5) GROUP BY md5", "what is not done yet"),
    Op("semi_pool", "SELECT md5, n_notes FROM {catalog} c WHERE EXISTS (SELECT 1 FROM {signatures_ext} s WHERE s.md5 = c.md5)", "only what has a vector"),
    Op("prefix_join", "SELECT substring(c.md5, 1, 2) AS bucket, count(*) AS n FROM {catalog} c JOIN (SELECT DISTINCT substring(md5, 1, 12) AS p FROM {manifest}) m ON m.p = substring(c.md5, 1, 12) GROUP BY substring(c.md5, 1, 2)", "join by the first twelve digits"),
    Op("interval_lookup", "WITH q AS (SELECT cast(1 AS INT) AS seg, 0 AS lo, 500 AS hi UNION ALL SELECT 2, 500, 2000 UNION ALL SELECT 3, 2000, 8000 UNION ALL SELECT 4, 8000, 1000000) SELECT seg, count(*) AS n, CAST(sum(n_notes) AS BIGINT) AS notes FROM {catalog} c JOIN q ON c.n_notes >= q.lo AND c.n_notes < q.hi GROUP BY seg", "segment that contains a value"),
    Op("split_leakage", "SELECT song_id, count(DISTINCT split) AS n_splits FROM {metadata} WHERE song_id IS NOT NULL AND split IN ('train', 'val', 'test') GROUP BY song_id HAVING count(DISTINCT split) > 1", "songs in more than one split"),
    Op("split_source_matrix", f"WITH {_SOURCE} SELECT source, count(CASE WHEN split = 'train' THEN 1 END) AS train, count(CASE WHEN split = 'val' THEN 1 END) AS val, count(CASE WHEN split = 'test' THEN 1 END) AS test FROM {{catalog}} c JOIN first_source s ON s.md5 = c.md5 GROUP BY source", "splits by first source", f"WITH {_SOURCE_C} SELECT source, count(CASE WHEN split = 'train' THEN 1 END) AS train, count(CASE WHEN split = 'val' THEN 1 END) AS val, count(CASE WHEN split = 'test' THEN 1 END) AS test FROM {{catalog}} c JOIN first_source s ON s.md5 = c.md5 GROUP BY source"),
    Op("rollup_sources", f"WITH {_SOURCE} SELECT source, has_drums, count(*) AS n, CAST(grouping(source) + grouping(has_drums) AS INT) AS level FROM {{catalog}} c JOIN first_source s ON s.md5 = c.md5 GROUP BY ROLLUP (source, has_drums)", "subtotals", f"WITH {_SOURCE_C} SELECT source, has_drums, count(*) AS n, CAST(grouping(source) + grouping(has_drums) AS INT) AS level FROM {{catalog}} c JOIN first_source s ON s.md5 = c.md5 GROUP BY ROLLUP (source, has_drums)"),
    Op("grouping_sets", "SELECT split, has_drums, count(*) AS n FROM {metadata} GROUP BY GROUPING SETS ((split), (has_drums), ())", "several groupings at once"),
    _first(_seeded("split_stratified", "WITH f AS (SELECT md5, min(<FIRST>) AS source FROM {manifest} GROUP BY md5), q AS (SELECT coalesce(c.song_id, c.md5) AS grp, min(c.md5) AS md5, coalesce(min(f.source), '') AS part FROM {catalog} c LEFT JOIN f ON f.md5 = c.md5 GROUP BY coalesce(c.song_id, c.md5)), d AS (SELECT grp, part, <U> AS u FROM q), g AS (SELECT *, CAST(floor(u * 4096e0) AS BIGINT) AS k FROM d), n AS (SELECT part, k, count(*) AS m FROM g GROUP BY part, k), o AS (SELECT part, k, CAST(sum(m) OVER (PARTITION BY part ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - m AS BIGINT) AS before, CAST(sum(m) OVER (PARTITION BY part) AS BIGINT) AS n FROM n), r AS (SELECT g.grp, o.n, o.before + row_number() OVER (PARTITION BY g.part, g.k ORDER BY g.u, g.grp) AS rn FROM g JOIN o ON o.part = g.part AND o.k = g.k) SELECT grp, CASE WHEN rn <= floor(n * 1e-1) THEN 'test' WHEN rn <= 2 * floor(n * 1e-1) THEN 'val' ELSE 'train' END AS split FROM r", "80/10/10 by song, within the first source, by a hash whose ranges are counted first", "split")),
    Op("tier_pools", "SELECT tier, count(*) AS n FROM (SELECT CASE WHEN coalesce(bpm BETWEEN 20 AND 300, false) AND time_signature IS NOT NULL AND is_canonical = 1 THEN 'gold' WHEN coalesce(note_density > 40, false) OR n_notes < 100 THEN 'bronze' ELSE 'silver' END AS tier FROM {catalog}) t GROUP BY tier", "gold, bronze, else silver"),
    Op("quality_gate", "WITH c AS (SELECT 'row_count' AS name, CAST(count(*) AS DOUBLE) AS value, CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM {catalog} UNION ALL SELECT 'unique_key', CAST(count(*) - count(DISTINCT md5) AS DOUBLE), CASE WHEN count(*) = count(DISTINCT md5) THEN 'PASS' ELSE 'FAIL' END FROM {catalog} UNION ALL SELECT 'null_bpm', avg(CASE WHEN bpm IS NULL THEN 1e0 ELSE 0e0 END), CASE WHEN avg(CASE WHEN bpm IS NULL THEN 1e0 ELSE 0e0 END) < 1e-1 THEN 'PASS' ELSE 'WARN' END FROM {catalog} UNION ALL SELECT 'coverage', avg(CASE WHEN s.md5 IS NULL THEN 0e0 ELSE 1e0 END), CASE WHEN avg(CASE WHEN s.md5 IS NULL THEN 0e0 ELSE 1e0 END) > 9e-1 THEN 'PASS' ELSE 'WARN' END FROM {catalog} c LEFT JOIN (SELECT DISTINCT md5 FROM {signatures_ext}) s ON s.md5 = c.md5) SELECT name, round(value, 6) AS value, status FROM c", "one row a check"),
    Op("impact_report", "WITH x AS (SELECT md5, bpm AS now, first_value(bpm) OVER (PARTITION BY md5 ORDER BY loaded_at, n_notes, bpm) AS was, row_number() OVER (PARTITION BY md5 ORDER BY loaded_at DESC, n_notes DESC, bpm DESC) AS rn FROM {metadata} WHERE bpm < 1e9 AND NOT isnan(bpm)) SELECT count(*) AS n, round(avg(CASE WHEN now <> was THEN 1e0 ELSE 0e0 END), 6) AS changed, count(CASE WHEN abs(now - was) > 5 THEN 1 END) AS far FROM x WHERE rn = 1", "what a new load changed"),
    Op("detector_tally", "SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN abs(r - 1e0) <= 3e-2 THEN 'exact' WHEN abs(r - 2e0) <= 6e-2 OR abs(r - 3e0) <= 9e-2 OR abs(r - 4e0) <= 12e-2 THEN 'multiple' WHEN abs(r - 5e-1) <= 15e-3 OR abs(r - 33333333e-8) <= 1e-2 OR abs(r - 25e-2) <= 75e-4 THEN 'fraction' ELSE 'miss' END AS verdict FROM (SELECT c.bpm / k.felt_bpm_med AS r FROM {catalog} c JOIN (SELECT md5, max(cluster_id) AS cluster_id FROM {clusters} GROUP BY md5) m ON m.md5 = c.md5 JOIN {cluster_summary} k ON k.cluster_id = m.cluster_id WHERE c.bpm > 0 AND c.bpm < 1e9 AND k.felt_bpm_med > 0) x) v GROUP BY verdict", "octave-aware agreement"),
    Op("cluster_medians", "SELECT k.cluster_id, count(*) AS n, round(median(CASE WHEN c.bpm < 1e9 THEN c.bpm END), 6) AS bpm_med, round(median(c.duration_sec), 6) AS duration_med, round(avg(CAST(c.has_drums AS DOUBLE)), 6) AS drums_share FROM (SELECT md5, max(cluster_id) AS cluster_id FROM {clusters} GROUP BY md5) k JOIN {catalog} c ON c.md5 = k.md5 WHERE k.cluster_id >= 0 GROUP BY k.cluster_id", "per-cluster description"),
    Op("percentile_bounds", "SELECT round(percentile(n_notes, 2e-2), 6) AS p02, round(percentile(n_notes, 5e-1), 6) AS p50, round(percentile(n_notes, 98e-2), 6) AS p98, round(percentile(n_notes, 999e-3), 6) AS p999 FROM {catalog}", "linear percentiles", "SELECT round(quantile_cont(n_notes, 2e-2), 6) AS p02, round(quantile_cont(n_notes, 5e-1), 6) AS p50, round(quantile_cont(n_notes, 98e-2), 6) AS p98, round(quantile_cont(n_notes, 999e-3), 6) AS p999 FROM {catalog}"),
    Op("latest_rating", "SELECT md5, loaded_at, load_id FROM (SELECT md5, loaded_at, load_id, row_number() OVER (PARTITION BY md5 ORDER BY loaded_at DESC, load_id DESC) AS rn FROM {metadata}) r WHERE rn = 1", "latest row of a key"),
    Op("rating_mean", "SELECT song_id, round(avg(n_notes), 6) AS mean_notes, count(*) AS n FROM {metadata} WHERE song_id IS NOT NULL GROUP BY song_id", "mean per song"),
    Op("seed_song_id", "SELECT md5, concat('song_', substring(sha1(concat(unhex('6ba7b8109dad11d180b400c04fd430c8'), encode(md5, 'utf-8'))), 1, 12)) AS song_id FROM {catalog}", "name-based identifier: the first twelve digits of version 5", "SELECT md5, concat('song_', substring(sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(md5)), 1, 12)) AS song_id FROM {catalog}"),
    Op("param_hash", "SELECT md5, substring(sha1(concat(md5, '|', CAST(n_notes AS STRING), '|', CAST(n_tracks AS STRING))), 1, 8) AS h FROM {catalog}", "hash of parameters", "SELECT md5, substring(sha1(concat(md5, '|', CAST(n_notes AS VARCHAR), '|', CAST(n_tracks AS VARCHAR))), 1, 8) AS h FROM {catalog}"),
    Op("name_mining", "SELECT path, regexp_extract(path, '/arc/([a-z_]+)/', 1) AS folder, regexp_extract(path, '/([a-z]+_[a-z]+)_[0-9]+[.]mid$', 1) AS title FROM (SELECT DISTINCT explode(original_paths) AS path FROM {manifest}) p", "folder and title from paths", "SELECT path, regexp_extract(path, '/arc/([a-z_]+)/', 1) AS folder, regexp_extract(path, '/([a-z]+_[a-z]+)_[0-9]+[.]mid$', 1) AS title FROM (SELECT DISTINCT unnest(original_paths) AS path FROM {manifest}) p"),
    Op("deny_list", "SELECT md5, max(CASE WHEN exists(original_paths, p -> p LIKE '%velvet%' OR p LIKE '%oblong%') THEN 1 ELSE 0 END) AS denied FROM {manifest} GROUP BY md5", "any path on the list", "SELECT md5, max(CASE WHEN len(list_filter(original_paths, lambda p: p LIKE '%velvet%' OR p LIKE '%oblong%')) > 0 THEN 1 ELSE 0 END) AS denied FROM {manifest} GROUP BY md5"),
    Op("ordered_distinct", "SELECT source, min(pos) AS first_at FROM (SELECT md5, posexplode(sources) AS (pos, source) FROM {manifest}) s GROUP BY source", "first position of each value", "SELECT source, min(pos) AS first_at FROM (SELECT md5, unnest(range(len(sources))) AS pos, unnest(sources) AS source FROM {manifest}) s GROUP BY source"),
    Op("part_merge", "SELECT part, count(*) AS n FROM (SELECT 'a' AS part, md5 FROM {metadata} WHERE load_id % 2 = 0 UNION ALL SELECT 'b', md5 FROM {metadata} WHERE load_id % 2 = 1) u GROUP BY part", "union of parts"),
    Op("key_difference", "SELECT md5 FROM {manifest} EXCEPT SELECT md5 FROM {catalog}", "set difference"),
    Op("containment_ratio", "SELECT a.md5, b.cluster_id, round(size(array_intersect(a.s, b.s)) / CAST(greatest(size(a.s), size(b.s)) AS DOUBLE), 6) AS ratio FROM (SELECT md5, array_distinct(split(midi_patches, ';')) AS s FROM {catalog}) a CROSS JOIN (SELECT 1 AS cluster_id, array('0', '4', '8', '12') AS s UNION ALL SELECT 2, array('24', '28', '32')) b", "shared members over the larger set", "SELECT a.md5, b.cluster_id, round(len(list_intersect(a.s, b.s)) / greatest(len(a.s), len(b.s))::DOUBLE, 6) AS ratio FROM (SELECT md5, list_distinct(string_split(midi_patches, ';')) AS s FROM {catalog}) a CROSS JOIN (SELECT 1 AS cluster_id, ['0', '4', '8', '12'] AS s UNION ALL SELECT 2, ['24', '28', '32']) b"),
    Op("octets", "SELECT CAST(i AS INT) AS i, translate(lpad(bin(i), 8, '0'), '01', 'ks') AS octet, bit_count(CAST(i AS BIGINT)) AS hits, bit_count(CAST(i ^ 170 AS BIGINT)) AS off_170 FROM (SELECT explode(sequence(0, 255)) AS i) s", "all kick and snare octets", "SELECT CAST(i AS INT) AS i, translate(lpad(bin(i), 8, '0'), '01', 'ks') AS octet, bit_count(i) AS hits, bit_count(xor(i, 170)) AS off_170 FROM range(256) s(i)"),
    Op("dependency_backbone", "WITH d AS (SELECT DISTINCT source AS a, lang AS b FROM {documents} WHERE source IS NOT NULL AND lang IS NOT NULL), o AS (SELECT source AS a, row_number() OVER (ORDER BY source) AS k FROM (SELECT DISTINCT source FROM {documents} WHERE source IS NOT NULL) s), l AS (SELECT a, lag(a) OVER (ORDER BY k) AS b FROM o) SELECT a, b, 'EXTRACTED' AS kind FROM d UNION ALL SELECT a, b, 'INFERRED' FROM l WHERE b IS NOT NULL", "named edges, and the order where none is named"),
]
