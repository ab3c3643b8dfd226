import math

import pytest

from notegrain.operators import profile

SCHEMA = "load_id int, bpm double, note_density double, duration_sec double, time_signature string, extra string, n int"
BASE = [("bpm", 20.0, 300.0, 100.0, 120.0, 140.0, 0.02, None, None), ("note_density", 0.05, 80.0, 5.0, 7.5, 11.0, 0.03, None, None), ("duration_sec", 1.0, 3600.0, 120.0, 180.0, 260.0, 0.01, None, None), ("time_signature", None, None, None, None, None, 0.05, "4/4", 0.75)]


@pytest.fixture(scope="module")
def baseline(spark):
    return spark.createDataFrame(BASE, "column_name string, lo double, hi double, q1 double, q2 double, q3 double, missing_share double, top_value string, top_share double")


def load(n, bpm=lambda i: 80.0 + i % 80, density=lambda i: 4.0 + i % 9, seconds=lambda i: 100.0 + i % 190, meter=lambda i: "4/4" if i % 4 else "3/4", at=1):
    return [(at, bpm(i), density(i), seconds(i), meter(i), "x", i) for i in range(n)]


def found(spark, baseline, rows):
    return {tuple(r) for r in profile.departures(spark.createDataFrame(rows, SCHEMA), baseline).collect()}


def test_an_accepted_load_has_no_finding(spark, baseline):
    assert found(spark, baseline, load(400)) == set()


def test_each_finding(spark, baseline):
    rows = load(400) + load(400, bpm=lambda i: None if i % 3 else 120.0, at=2) + load(400, density=lambda i: math.inf if i == 7 else 4.0 + i % 9, at=3)
    rows += load(400, seconds=lambda i: 600.0 + i % 190, at=4) + load(400, meter=lambda i: "4/4\n" if i == 3 else "4/4" if i % 4 else "3/4", at=5) + load(400, meter=lambda i: "3/4", at=6)
    rows += load(400, bpm=lambda i: 120.0 if i % 3 else 80.0 + i % 80, at=7)
    assert found(spark, baseline, rows) == {(2, "bpm", "missing"), (2, "bpm", "constant"), (3, "note_density", "range"), (4, "duration_sec", "drift"), (5, "time_signature", "pattern"), (6, "time_signature", "drift"), (7, "bpm", "constant")}


def test_nan_null_and_blank_are_missing_and_null_loads_are_a_load(spark, baseline):
    rows = load(100, bpm=lambda i: math.nan if i % 2 else 80.0 + i % 80, meter=lambda i: ["", " \t", None, "4/4"][i % 4] if i % 3 else "4/4", at=None)
    got = found(spark, baseline, rows)
    assert (None, "bpm", "missing") in got and (None, "time_signature", "missing") in got and (None, "time_signature", "pattern") not in got


def test_empty(spark, baseline):
    assert found(spark, baseline, []) == set()


def test_quartiles_are_interpolated_and_exact(spark, baseline):
    import numpy as np

    rng = np.random.default_rng(5)
    values = np.r_[rng.uniform(20, 300, 333), [120.0] * 200, rng.uniform(119.99, 120.01, 50)].tolist()
    rows = spark.createDataFrame([(1, v, None, None, None, "x", 0) for v in values], SCHEMA)
    got = profile.quartiles(profile.value_counts(rows, baseline)).first()
    assert np.allclose([got.x1, got.x2, got.x3], np.percentile(values, [25, 50, 75]), atol=1e-9)


def test_profile_shift_and_counts(spark, baseline):
    rows = load(300) + load(300, seconds=lambda i: 600.0 + i % 190, at=2)
    got = {(r.load_id, r.column_name): r for r in profile.load_profile(spark.createDataFrame(rows, SCHEMA), baseline).collect()}
    assert got[2, "duration_sec"].shift > 5 and abs(got[1, "bpm"].shift) < 1e-9
    assert got[1, "time_signature"].n_distinct == 2 and got[1, "bpm"].n_rows == 300 and got[1, "bpm"].min_value == 80.0
