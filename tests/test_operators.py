"""Golden grids and invariants of the declarative operators."""

import pytest

from notegrain.plans.ops import apply
from notegrain.queries import OPS

NOTES = "song bigint, idx bigint, start bigint, dur bigint, chan bigint, pitch bigint, vel bigint"


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows: spark.createDataFrame(rows, NOTES)


def grid(hits, song=1, chan=9, dur=60):
    return [(song, i, int(t * 480), dur, chan, p, v) for i, (t, p, v) in enumerate(hits)]


def one(name, **inputs):
    return apply(OPS[name], **inputs).collect()


def test_rock_backbeat(table):
    rock = table(grid([(t + 4 * bar, p, 100) for bar in range(4) for t, p in ((0, 36), (1, 38), (2, 36), (3, 38))]))
    r = one("groove_dna", drums=rock)[0]
    assert (r.kick_density, r.snare_density, r.backbeat, r.syncopation_drum) == (2.0, 2.0, 1.0, 0.0)
    cells = {(x.voice, x.cell): x.n for x in one("onset_grid16", drums=rock)}
    assert cells == {("kick", 0): 4, ("kick", 8): 4, ("snare", 4): 4, ("snare", 12): 4}
    assert one("bar_variance", drums=rock)[0].bar_variance == pytest.approx(0, abs=1e-6)


def test_laid_back_early_and_on_time(table):
    for shift, low, high in ((0, 0.499, 0.501), (0.05, 0.51, 1), (-0.05, 0, 0.49)):
        r = one("microtiming", drums=table(grid([(t + 4 + shift, 36, 90) for t in range(4)])))[0]
        assert low <= r.laid_back <= high


def test_straight_and_swung(table):
    swung = table(grid([(i + d, 42, 90) for i in range(8) for d in (0, 0.66)]))
    assert one("swing_ratio", notes=swung)[0].bur == pytest.approx(0.66 / 0.34, abs=0.1)
    straight = table(grid([(i + d, 42, 90) for i in range(8) for d in (0, 0.5)]))
    assert one("swing_ratio", notes=straight)[0].bur == pytest.approx(1, abs=0.01)


def test_key_of_a_c_major_scale_and_transposition(table):
    scale = [0, 2, 4, 5, 7, 9, 11, 0, 4, 7, 0, 7]
    for shift, key in ((0, "C major"), (2, "D major"), (9, "A major")):
        assert one("key_detect", notes=table(grid([(i, 60 + shift + p, 80) for i, p in enumerate(scale)], chan=0)))[0].key_name == key


def test_interval_vector_is_the_same_after_transposition(table):
    a = {r.ic: r.share for r in one("interval_vector", notes=table(grid([(i, 60 + p, 80) for i, p in enumerate((0, 4, 7, 10))], chan=0)))}
    b = {r.ic: r.share for r in one("interval_vector", notes=table(grid([(i, 65 + p, 80) for i, p in enumerate((0, 4, 7, 10))], chan=0)))}
    assert a == b


def test_chord_template_names_a_triad(table):
    r = one("chord_template", notes=table(grid([(0, 60, 80), (0, 64, 80), (0, 67, 80), (1, 57, 80), (1, 60, 80), (1, 64, 80)], chan=0)))
    assert sorted((x.w, x.root, x.quality) for x in r) == [(0, 0, "maj"), (1, 9, "min")]


def test_phrases_split_at_two_beats(table):
    r = one("phrase_sessions", notes=table(grid([(t, 60, 80) for t in (0, 1, 2, 4, 5, 6.5)], chan=0)))
    assert sorted(x.n_onsets for x in r) == [3, 3]


def test_empty_notes_give_no_rows(table):
    from notegrain.functions import melody, pitch, rhythm

    empty = table([])
    for op in (*pitch.OPS, *melody.OPS, *rhythm.OPS):
        if set(op.inputs) <= {"notes", "drums"}:
            assert apply(op, **dict.fromkeys(op.inputs, empty)).count() == 0, op.name


def test_order_of_rows_does_not_matter(table):
    rows = grid([(i * 0.75 % 13, 40 + i * 7 % 40, 30 + i) for i in range(60)], chan=0)
    for name in ("pc_entropy", "harmony_features", "motif_ngrams", "ioi_stats", "self_similarity"):
        assert sorted(one(name, notes=table(rows))) == sorted(one(name, notes=table(rows[::-1]))), name
