import numpy as np

from engines import NOTES, both, plan


def test_shared_pitches_as_bits(spark):
    r = np.random.default_rng(5)
    rows = [(int(r.integers(60)) * int(r.choice([1, 50])), i, i, 60, 0, int(r.choice([*range(50, 75), 0, 63, 64, 127])), 80) for i in range(500)]
    rows += [(100, 1, 0, 60, 0, 60, 80), (101, 1, 0, 60, 0, 66, 80), (102, 1, 0, 60, 0, 67, 80)]  # at the ends of the twelve shifts
    rows += [(150, 1, 0, 60, 0, p, 80) for p in (-9, 126, 131, 300)] + [(151, 1, 0, 60, 0, p, 80) for p in (-12, 3, 60, 128, 305, None)] + [(200, 1, 0, 60, 0, None, 80), (None, 1, 0, 60, 0, 60, 80), (201, 1, 0, 60, 0, None, 80)]
    got, want, df = both(spark, "set_ratio_search", notes=(rows, NOTES))
    assert got == want and len(got) > 500 and "bit_count" in plan(df)
