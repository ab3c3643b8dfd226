import numpy as np

from engines import NOTES, both, plan


def test_windows_meet_in_their_song_and_not_in_a_shuffle(spark):
    r = np.random.default_rng(4)
    rows = [(int(r.integers(4)), i, int(r.integers(300_000)), 60, 0, int(r.choice([60, 64, 67, 72])), 80) for i in range(900)]
    rows += [(5, i, int(r.integers(-20_000, 20_000)), 60, 0, int(r.integers(-20, 20)), 80) for i in range(150)]
    rows += [(6, i, 960 * w, 60, 0, p, 80) for i, (w, p) in enumerate((w, p) for w in range(12) for p in (60, None, 64))] + [(7, 1, None, 60, 0, 60, 80), (8, 1, 100, 60, 0, 60, 80), (None, 1, 9_000, 60, 0, 60, 80), (9, 1, 90_000, 60, 0, None, 80), (9, 1, None, 60, 0, 60, 80)]
    got, want, df = both(spark, "song_structure", notes=(rows, NOTES))
    assert got == want and len(got) == 10 and "b.w" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(df).count("ArrowEvalPython") >= 1
