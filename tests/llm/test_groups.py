import datetime as dt
from collections import Counter

from notegrain.llm import splits, survivor

T = dt.datetime(2024, 1, 1)
META = "md5 string, song_id string, loaded_at timestamp, bpm double, note_density double, duration_sec double, time_signature string, trust int"
BASE = [("bpm", 20.0, 300.0), ("note_density", 0.05, 80.0), ("duration_sec", 1.0, 3600.0), ("time_signature", None, None)]


def tables(spark, rows, manifest=()):
    return spark.createDataFrame(rows, META), spark.createDataFrame(list(manifest), "md5 string, n_copies bigint"), spark.createDataFrame(BASE, "column_name string, lo double, hi double")


def day(n):
    return T + dt.timedelta(n)


def test_ranking_by_completeness_trust_recency_and_key(spark):
    rows = [
        ("a", "full", day(1), 100.0, 5.0, 100.0, "4/4", 9), ("b", "full", day(9), None, 5.0, 100.0, "4/4", 9),
        ("c", "trust", day(1), 100.0, None, 100.0, None, 9), ("d", "trust", day(5), 100.0, None, None, "3/4", 9),
        ("e", "recent", day(1), 100.0, None, None, None, 9), ("f", "recent", day(2), 100.0, None, None, None, 9),
        ("g", "tie", day(1), float("nan"), None, None, None, 9), ("h", "tie", day(1), 9999.0, None, None, "4/4\n", 9), ("h", "tie", day(1), 9999.0, None, None, "4/4\n", 9),
        ("i", "alone", day(1), 1.0, 1.0, 1.0, "4/4", 9), ("i", "alone", day(2), 1.0, 1.0, 1.0, "4/4", 9), ("j", None, day(1), 100.0, 1.0, 1.0, "4/4", 9), (None, "full", day(3), 100.0, 1.0, 1.0, "4/4", 9),
        ("k", "late", day(1), 100.0, 5.0, 100.0, "4/4", 9), ("k", "late", day(3), None, None, None, None, 9), ("l", "late", None, 90.0, None, None, None, 9),
    ]
    meta, manifest, base = tables(spark, rows, [("c", 5), ("c", 5), ("c", None), ("d", 7), ("zz", 1)])
    got = {(r.song_id, r.column_name): r.md5 for r in survivor.winners(meta, manifest, base).collect()}
    assert {k: v for k, v in got.items() if k[1] == "record"} == {("full", "record"): "a", ("trust", "record"): "d", ("recent", "record"): "f", ("tie", "record"): "g", ("late", "record"): "l"}
    assert got["trust", "duration_sec"] == "c" and got["trust", "time_signature"] == "d" and ("trust", "note_density") not in got
    assert got["late", "bpm"] == "l" and ("late", "note_density") not in got and not [k for k in got if k[0] == "tie" and k[1] != "record"]
    one = {r.song_id: r for r in survivor.survivors(meta, manifest, base).collect()}
    assert one["trust"].md5 == "d" and one["trust"].duration_sec == 100.0 and one["trust"].is_canonical == 1 and one["tie"].bpm is None


def test_survivors_of_nothing(spark):
    assert survivor.winners(*tables(spark, [])).count() == 0


def test_torn_groups(spark):
    rows = [("a", "s", "train"), ("b", "s", " TRAINING\t"), ("c", "t", "val"), ("d", "t", "test"), ("e", None, "train"), ("e", None, "Validation"), ("f", None, None), ("f", None, "val"), ("g", "u", ""), ("h", "u", "test"), (None, None, "val")]
    df = spark.createDataFrame(rows, "md5 string, song_id string, split string")
    assert {r.grp for r in splits.torn_groups(df, splits.F.coalesce("song_id", "md5")).collect()} == {"t", "e"}


def test_assignment_keeps_groups_and_shares(spark):
    rows = [(f"m{i}", "big" if i % 4 == 0 else f"s{i % 700}" if i % 3 else None, ["4/4", "3/4", None, "6/8"][i % 4]) for i in range(6000)] + [("m1", "s77", "4/4"), (None, "s1", "4/4")]
    got = splits.assign(spark.createDataFrame(rows, "md5 string, song_id string, time_signature string")).collect()
    by, size = {}, Counter(r[0] for r in rows)
    for r in got:
        for k in filter(None, (r.md5 and "m" + r.md5, r.song_id and "s" + r.song_id)):
            by.setdefault(k, set()).add(r.split)
    assert all(len(v) == 1 for v in by.values()) and len({r.md5 for r in got}) == 6000
    share = Counter()
    for r in got:
        share[r.split] += 1
    total = sum(share.values())
    assert abs(share["train"] / total - 0.8) < 0.03 and abs(share["val"] / total - 0.1) < 0.02 and size
    assert splits.assign(spark.createDataFrame([], "md5 string, song_id string, time_signature string")).count() == 0
