from pyspark.sql import functions as F

from notegrain.sources import files

ROWS = [("a", "x\ty", 1), ("b", 'say "no"\r\nplease', None), ("c", "", 3), (None, None, 4), ("d", " padded ", 5), ("a", "x\ty", 1)]


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_delimited_and_json_keep_null_empty_and_blanks(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "k string, t string, n int")
    for sep, header in ((",", True), ("\t", False)):
        at = str(tmp_path / f"d{header}")
        files.write_delimited(df, at, sep, header)
        assert as_rows(files.read_delimited(spark, at, "k string, t string, n int", sep, header)) == sorted(ROWS, key=repr)
    df.write.json(str(tmp_path / "j"))
    assert as_rows(files.read_json_lines(spark, str(tmp_path / "j"), "k string, t string, n int")) == sorted(ROWS, key=repr)


def test_merged_parts(spark):
    a = spark.createDataFrame([("x", 2), ("y", 1), (None, 9)], "k string, n int")
    b = spark.createDataFrame([("x", "q"), ("x", "q"), (None, "r")], "k string, t string")
    assert files.merged([a, b]).count() == 6
    assert as_rows(files.merged([a, b], "k")) == sorted([("x", None, "q"), ("y", 1, None), (None, 9, None), (None, None, "r")], key=repr)
    assert files.merged([a.limit(0), a.limit(0)], "k").count() == 0


def test_buckets_read_only_what_is_asked(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "k string, t string, n int")
    files.write_buckets(df, str(tmp_path / "b"), "k", 4)
    back = files.read_buckets(spark, str(tmp_path / "b"), ["n", "k", "none"])
    assert back.columns == ["n", "k"] and back.count() == len(ROWS)
    one = [r.b for r in df.filter("k = 'a'").select(files.bucket(F.col("k"), 4).alias("b")).distinct().collect()]
    some = files.read_buckets(spark, str(tmp_path / "b"), ["n", "k"], one)
    assert {r.k for r in some.collect()} >= {"a"} and "PartitionFilters: [isnotnull(bucket" in some._jdf.queryExecution().toString()


def test_bulk_load_into_a_database(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2], 1.5), ("b", None, None)], "k string, l array<int>, x double")
    assert files.ddl(df, "t", ("k",), ("k",)) == ['CREATE TABLE "t" ("k" VARCHAR(4000) NOT NULL, "l" VARCHAR(4000), "x" DOUBLE PRECISION)', 'CREATE INDEX "t_k" ON "t" ("k")']
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    files.load_database(df, url, "loaded", 1, 2, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    back = spark.read.format("jdbc").options(url=url, dbtable="loaded", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").load()
    assert as_rows(back.select("k", F.col("l").cast("string"), "x")) == [("a", "[1,2]", 1.5), ("b", None, None)]


def test_sqlite_images_and_caches_of_nothing(spark):
    none = spark.createDataFrame([], "k string, n int")
    assert files.query_images(files.sqlite_images(none, "t", "k"), "SELECT count(*) FROM t", "n bigint").count() == 0
    notes = spark.createDataFrame([], "song string, start int, dur int, chan int, pitch int, vel int")
    assert files.notes_of_caches(files.note_caches(notes)).count() == 0


def test_sqlite_images_hold_all_rows_and_views(spark):
    df = spark.createDataFrame([(f"k{i % 5}", i) for i in range(50)] + [(None, None)], "k string, n int")
    images = files.sqlite_images(df, "t", "k", ("n",), {"big": "n > 40"}, 4)
    got = files.query_images(images, "SELECT k, n FROM t", "k string, n bigint")
    assert got.count() == 51 and files.query_images(images, "SELECT n FROM big", "n bigint").count() == 9


def test_id_shards_number_every_row(spark):
    df = spark.createDataFrame([(i, [i, 3]) for i in range(25)] + [(99, [70000]), (98, None), (97, [])], "key int, ids array<int>")
    rows = files.id_shards(df, per=10).collect()
    assert sorted((r.shard, r.place) for r in rows) == [(i // 10, i % 10) for i in range(28)]
    assert {r.key: r.ids for r in rows} == {**{i: [i, 3] for i in range(25)}, 99: None, 98: None, 97: []}
