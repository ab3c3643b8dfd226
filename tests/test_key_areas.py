import numpy as np

from engines import NOTES, both, plan


def test_keys_of_windows_without_a_row_for_every_key(spark):
    r = np.random.default_rng(3)
    rows = [(int(r.integers(5)), i, int(r.integers(40_000)), 60, 0, int(r.choice([60, 62, 64, 65, 67, 69, 71])) + int(r.integers(2)) * 12, 80) for i in range(900)]
    rows += [(6, 1, t, 60, 0, 60 + k, 80) for t in (0, 4000) for k in range(12)]  # flat windows have no key
    rows += [(7, 1, 0, 60, 0, 60 + k, 80) for k in (0, 3, 6, 9)] + [(8, 1, 0, 60, 0, None, 80), (8, 1, None, 60, 0, 60, 80), (8, 1, 9000, 60, 0, -5, 80), (None, 1, 0, 60, 0, 60, 80), (9, 1, -100, 60, 0, 64, 80), (9, 1, 10, 60, 0, None, 80), (9, 1, 10, 60, 0, 65, 80)]
    got, want, df = both(spark, "key_areas", notes=(rows, NOTES))
    assert got == want and len(got) == 7 and "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
