"""How the test tables stand in for the engine's inputs.

notes: song, idx, start and dur in ticks (480 a beat), chan, pitch, vel. drums: the same on channel 9 with kit
pitches. tempos: song, seq, tick, bpm. songs: the catalog. inputs: one row for each input file. sig: vec_id,
label, v (unit length, doubles). ratings: key, axis scores, time.
"""

from notegrain.operators.search import nearest
from notegrain.plans.ops import Binding
from notegrain.plans.shared import table

TICKS = 480

BINDINGS = {
    "notes": Binding("SELECT l_suppkey AS song, l_orderkey * 8 + l_linenumber AS idx, (l_orderkey % 4096) * 60 AS start, CAST(l_quantity AS BIGINT) * 12 AS dur, l_linenumber + 2 AS chan, l_partkey % 128 AS pitch, CAST(floor(l_extendedprice) AS BIGINT) % 128 AS vel FROM {lineitem}"),
    "drums": Binding("SELECT l_suppkey AS song, l_orderkey * 8 + l_linenumber AS idx, (l_orderkey % 512) * 120 + (l_partkey % 5) * 6 AS start, 60 AS dur, 9 AS chan, 35 + l_partkey % 25 AS pitch, CAST(floor(l_extendedprice) AS BIGINT) % 128 AS vel FROM {lineitem}"),
    "tempos": Binding("SELECT o_custkey AS song, o_orderkey AS seq, (o_orderkey % 97) * 480 AS tick, CAST(60 + o_orderkey % 7 * 20 AS DOUBLE) AS bpm, CAST(97 * 480 AS BIGINT) AS ends FROM {orders}"),
    "inputs": Binding("SELECT md5(CAST(o_custkey AS STRING)) AS md5, concat('shelf-', CAST(o_custkey % 3 AS STRING)) AS host, concat('src_', lower(substring(o_orderpriority, 3, 4))) AS source, o_orderkey * 10 AS size, concat('/arc/', CAST(o_orderkey AS STRING), '.mid') AS path FROM {orders}",
                      "SELECT md5(CAST(o_custkey AS VARCHAR)) AS md5, concat('shelf-', CAST(o_custkey % 3 AS VARCHAR)) AS host, concat('src_', lower(substring(o_orderpriority, 3, 4))) AS source, o_orderkey * 10 AS size, concat('/arc/', CAST(o_orderkey AS VARCHAR), '.mid') AS path FROM {orders}"),
    "sig": Binding("SELECT vec_id, label, transform(embedding, x -> CAST(x AS DOUBLE) / sqrt(aggregate(embedding, CAST(0 AS DOUBLE), (a, y) -> a + CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))) AS v FROM {embeddings}",
                   "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM {embeddings}"),
    "sigl": Binding("SELECT vec_id, label, i, x FROM (SELECT vec_id, label, posexplode(v) AS (i, x) FROM {sig})", "SELECT vec_id, label, unnest(range(len(v))) AS i, unnest(v) AS x FROM {sig}"),
    "onsets": Binding("SELECT user_id AS song, event_type AS voice, event_id AS idx, CAST(unix_seconds(CAST(ts AS TIMESTAMP)) AS DOUBLE) AS t, value FROM {events}", "SELECT user_id AS song, event_type AS voice, event_id AS idx, floor(epoch(ts)) AS t, value FROM {events}"),
    "ratings": Binding("SELECT md5, song_id, load_id AS version, loaded_at AS rated_at, bpm, note_density, duration_sec, row_id FROM (SELECT *, n_notes AS row_id FROM {metadata})"),
    "catalog": Binding("SELECT md5, song_id, split, load_id, loaded_at, is_canonical, arrangement_rank, CASE WHEN isnan(bpm) THEN NULL ELSE bpm END AS bpm, CASE WHEN isnan(note_density) THEN NULL ELSE note_density END AS note_density, CASE WHEN isnan(duration_sec) THEN NULL ELSE duration_sec END AS duration_sec, time_signature, n_tracks, n_notes, has_drums, n_distinct_patches, midi_patches, pitch_min, pitch_max, n_distinct_chords, avg_vel, tempo_change_count, lyric_events_count FROM (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY loaded_at DESC, n_notes, bpm, note_density, duration_sec, time_signature, split, is_canonical) AS rn FROM {metadata}) WHERE rn = 1",
                       "SELECT md5, song_id, split, load_id, loaded_at, is_canonical, arrangement_rank, CASE WHEN isnan(bpm) THEN NULL ELSE bpm END AS bpm, CASE WHEN isnan(note_density) THEN NULL ELSE note_density END AS note_density, CASE WHEN isnan(duration_sec) THEN NULL ELSE duration_sec END AS duration_sec, time_signature, n_tracks, n_notes, has_drums, n_distinct_patches, midi_patches, pitch_min, pitch_max, n_distinct_chords, avg_vel, tempo_change_count, lyric_events_count FROM (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY loaded_at DESC, n_notes NULLS FIRST, bpm NULLS FIRST, note_density NULLS FIRST, duration_sec NULLS FIRST, time_signature NULLS FIRST, split NULLS FIRST, is_canonical NULLS FIRST) AS rn FROM metadata) WHERE rn = 1"),
    "near": Binding("", "SELECT q, b, label, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, b) AS rn FROM (SELECT q.vec_id AS q, b.vec_id AS b, b.label, round(list_dot_product(q.v, b.v), 9) AS sim FROM {sig} q JOIN {sig} b ON q.vec_id % 50 = 0 AND b.vec_id <> q.vec_id) s QUALIFY rn <= 50", build=lambda spark, d: _near(spark, d)),
}


def _near(spark, d):
    """The 50 nearest of every fiftieth vector."""
    rows = spark.sql(BINDINGS["sig"].sql, embeddings=table(spark, d, "embeddings"))
    return nearest(rows.filter("vec_id % 50 = 0"), rows, 50)
