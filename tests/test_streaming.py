import datetime as dt

from pyspark.sql import functions as F

from notegrain.streaming import live

T = dt.datetime(2024, 1, 1)
SCHEMA = "id string, at timestamp, who string, value double"


def feed(spark, folder, *files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/f{i}")
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_windowed_counts_equal_the_batch(spark, tmp_path):
    rows = [(str(i), T + dt.timedelta(minutes=7 * i), "ab"[i % 2], float(i)) for i in range(60)]
    got = live.drain(live.counters(feed(spark, tmp_path, rows[:30], rows[30:]), "at", ["who"], "value"), "complete")
    want = spark.createDataFrame(rows, SCHEMA).groupBy(F.date_trunc("hour", "at").alias("at"), "who").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_repeats_are_skipped_across_batches(spark, tmp_path):
    a = [(str(i), T, "a", 1.0) for i in range(5)]
    assert live.drain(live.unseen(feed(spark, tmp_path, a, a + [("9", T, "a", 1.0)]), "id", "at")).count() == 6


def test_sessions(spark, tmp_path):
    rows = [("x", T + dt.timedelta(minutes=m), "a", 1.0) for m in (0, 10, 20, 80, 90)] + [("y", T + dt.timedelta(days=9), "z", 0.0)]
    got = {(r.who, r.n) for r in live.drain(live.sessions(feed(spark, tmp_path, rows, [("q", T + dt.timedelta(days=30), "z", 0.0)]), "at", ["who"])).collect()}
    assert {("a", 3), ("a", 2)} <= got


def test_latest_wins_whatever_the_order(spark, tmp_path):
    rows = [("k", T + dt.timedelta(hours=h), "a", float(h)) for h in (3, 1, 2)] + [("n", T, "b", 0.5), ("n", T, "b", 0.5)]
    got = live.upserted(feed(spark, tmp_path, rows[:2], rows[2:], rows[:1]), "id", "at")
    assert {(r.id, r.value) for r in got.collect()} == {("k", 3.0), ("n", 0.5)}
