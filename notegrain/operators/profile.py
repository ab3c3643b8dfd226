"""Column profiles per load, and the loads that depart from an accepted profile.

Power sums are exact decimal sums, whatever the order, of values and of squares rounded at six places. Everything rests on one mergeable table of value counts (load, column, value, n): it is built with map-side
combining and hashed by all three keys, so a load that holds a third of the rows is spread like any other.
Quartiles are exact: counts per bin locate the bins that hold the wanted ranks, and only the values of
those bins are ordered. Shifts between loads come from exact (decimal) power sums.

Nulls and NaN are missing, as are blank strings in text columns; infinite numbers are present but outside
any range. A load without acceptable values has no drift and no constant. Repeated rows count. An empty
table gives an empty result. Extra columns are never read. Rows without a load id form a load of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from notegrain.plans.shared import written

NUMERIC = ("bpm", "note_density", "duration_sec")
TEXT = ("time_signature",)
METER = r"\A[1-9][0-9]?/(?:1|2|4|8|16|32)\z|\A[1-9][0-9]?/64\z"
BLANK = r"\A[\s\p{Z}]*\z"
BINS = 4096


def value_counts(rows: DataFrame, baseline: DataFrame, numeric=NUMERIC, text=TEXT, pattern: str = METER, label: str = "value-counts") -> DataFrame:
    """load_id, column_name, num, txt, n and the flags missing, acceptable, outside; joined with the accepted profile.

    ``baseline`` has one row per profiled column, so its size is the number of columns."""
    one = lambda c: F.struct(F.lit(c).alias("column_name"), F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias("num"), F.lit(None).cast("string").alias("txt"))
    two = lambda c: F.struct(F.lit(c).alias("column_name"), F.lit(None).cast("double").alias("num"), F.col(c).alias("txt"))
    long = rows.select("load_id", F.explode(F.array(*map(one, numeric), *map(two, text))).alias("c")).select("load_id", "c.*")
    counts = long.groupBy("load_id", "column_name", "num", "txt").agg(F.count(F.lit(1)).alias("n"))
    base = baseline.select("column_name", *[F.col(c).cast("double") for c in ("lo", "hi", "q1", "q2", "q3", "missing_share", "top_share")], "top_value")
    is_text = F.col("column_name").isin(*text)
    missing = F.when(is_text, F.col("txt").isNull() | F.col("txt").rlike(BLANK)).otherwise(F.col("num").isNull())
    fits = F.when(is_text, F.col("txt").rlike(pattern)).otherwise(F.col("num").between(F.col("lo"), F.col("hi")))
    flagged = counts.join(F.broadcast(base), "column_name", "left").withColumn("missing", missing).withColumn("acceptable", ~F.col("missing") & F.coalesce(fits, F.lit(False)))
    return written(flagged.withColumn("outside", ~F.col("missing") & ~F.col("acceptable")), label)


def quartiles(counts: DataFrame) -> DataFrame:
    """load_id, column_name, x1, x2, x3: linearly interpolated quartiles of the acceptable numbers."""
    keys = ["load_id", "column_name"]
    wide = F.floor((F.col("num") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * BINS)
    fit = counts.filter("acceptable and num is not null").select(*keys, "num", "n", F.least(wide, F.lit(BINS - 1)).cast("int").alias("bin"))
    bins = fit.groupBy(*keys, "bin").agg(F.sum("n").alias("m"))
    order = W.partitionBy(*keys).orderBy("bin")
    placed = bins.withColumn("upto", F.sum("m").over(order)).withColumn("total", F.sum("m").over(W.partitionBy(*keys)))
    rank = lambda q, up: (F.ceil if up else F.floor)((F.col("total") - 1) * F.lit(q))
    wanted = F.array(*[F.struct(F.lit(i).alias("q"), F.lit(up).alias("up"), rank(i / 4, up).cast("long").alias("at")) for i in (1, 2, 3) for up in (0, 1)])
    here = F.filter(wanted, lambda w: (w["at"] >= F.col("upto") - F.col("m")) & (w["at"] < F.col("upto")))
    wanted_here = F.transform(here, lambda w: F.struct(w["q"].alias("q"), w["up"].alias("up"), (w["at"] - F.col("upto") + F.col("m")).alias("at")))
    ranks = placed.filter(F.size(here) > 0).select(F.col("load_id").alias("l"), F.col("column_name").alias("c"), F.col("bin").alias("b"), "total", wanted_here.alias("wanted"))
    inside = fit.join(ranks, F.col("load_id").eqNullSafe(F.col("l")) & (F.col("column_name") == F.col("c")) & (F.col("bin") == F.col("b"))).drop("l", "c", "b")
    cum = inside.withColumn("upto", F.sum("n").over(W.partitionBy(*keys, "bin").orderBy("num")))
    hit = cum.select(*keys, "num", "total", F.explode(F.filter("wanted", lambda w: (w["at"] >= F.col("upto") - F.col("n")) & (w["at"] < F.col("upto")))).alias("w"))
    got = hit.groupBy(*keys).agg(F.max("total").alias("total"), *[F.max(F.when((F.col("w.q") == i) & (F.col("w.up") == up), F.col("num"))).alias(f"v{i}{up}") for i in (1, 2, 3) for up in (0, 1)])
    between = lambda i: F.col(f"v{i}0") + (F.col(f"v{i}1") - F.col(f"v{i}0")) * ((F.col("total") - 1) * F.lit(i / 4) - F.floor((F.col("total") - 1) * F.lit(i / 4)))
    return got.select(*keys, *[between(i).alias(f"x{i}") for i in (1, 2, 3)])


def _any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def departures(rows: DataFrame, baseline: DataFrame, missing_over: float = 0.10, factor: float = 1.5, share_over: float = 0.20, constant_over: float = 0.5) -> DataFrame:
    """load_id, column_name, finding: one row for each way in which a load departs from the accepted profile."""
    counts = value_counts(rows, baseline)
    n, text = F.col("n"), F.col("column_name").isin(*TEXT)
    when = lambda c: F.sum(F.when(F.col(c), n).otherwise(0))
    keys = ["load_id", "column_name"]
    s = counts.groupBy(*keys).agg(
        F.sum(n).alias("rows"), when("missing").alias("missing"), when("acceptable").alias("fit"), when("outside").alias("outside"),
        F.max(F.when(F.col("acceptable"), n)).alias("most"), F.sum(F.when(F.col("acceptable") & (F.col("txt") == F.col("top_value")), n).otherwise(0)).alias("top"),
        *[F.first(c).alias(c) for c in ("q1", "q2", "q3", "missing_share", "top_share")],
    )
    q = quartiles(counts).withColumnsRenamed({k: f"{k}_" for k in keys})
    s = s.join(q, F.col("load_id").eqNullSafe(F.col("load_id_")) & (F.col("column_name") == F.col("column_name_")), "left")
    far = _any(*[(F.col(f"x{i}") > F.col(f"q{i}") * factor) | (F.col(f"q{i}") > F.col(f"x{i}") * factor) for i in (1, 2, 3)])
    drift = F.when(text, (F.col("fit") > 0) & (F.abs(F.col("top") / F.col("fit") - F.col("top_share")) > share_over)).otherwise(far)
    found = F.array_compact(F.array(
        F.when(F.col("missing") / F.col("rows") - F.col("missing_share") > missing_over, F.lit("missing")),
        F.when(F.col("outside") > 0, F.when(text, F.lit("pattern")).otherwise(F.lit("range"))),
        F.when(drift, F.lit("drift")),
        F.when(~text & (F.col("most") > F.col("fit") * constant_over), F.lit("constant")),
    ))
    return s.select(*keys, F.explode(found).alias("finding"))


def load_profile(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row per load and column: counts, distinct values, range, form, exact mean and deviation, and ``shift``:
    the mean's distance from the mean of all other loads in standard deviations of those loads."""
    counts = value_counts(rows, baseline)
    n, v = F.col("n"), F.when(F.col("acceptable"), F.col("num"))
    s = counts.groupBy("load_id", "column_name").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("missing"), n).otherwise(0)).alias("n_missing"), F.sum(F.when(F.col("outside"), n).otherwise(0)).alias("n_violations"),
        F.sum(F.when(F.col("missing"), 0).otherwise(1)).alias("n_distinct"), F.min(F.when(~F.col("missing"), F.col("num"))).alias("min_value"), F.max(F.when(~F.col("missing"), F.col("num"))).alias("max_value"),
        F.sum(F.when(F.col("acceptable"), n).otherwise(0)).alias("k"), F.sum(v.cast("decimal(18,6)") * n.cast("decimal(12,0)")).alias("s1"), F.sum((v * v).cast("decimal(22,6)") * n.cast("decimal(12,0)")).alias("s2"),
    )
    whole = F.broadcast(s.groupBy("column_name").agg(*[F.sum(c).alias(f"all_{c}") for c in ("k", "s1", "s2")]))  # one row a column
    s = s.join(whole, "column_name")
    rest = lambda c: (F.col(f"all_{c}") - F.col(c)).cast("double")
    s = s.withColumn("rk", rest("k")).withColumn("r1", rest("s1")).withColumn("r2", rest("s2"))
    mean, dev = F.col("s1").cast("double") / F.col("k"), lambda a, b, k: F.sqrt(F.greatest(F.lit(0.0), b / k - (a / k) * (a / k)))
    deviation = dev(F.col("s1").cast("double"), F.col("s2").cast("double"), F.col("k"))
    others = dev(F.col("r1"), F.col("r2"), F.col("rk"))
    return s.select(
        "load_id", "column_name", "n_rows", "n_missing", "n_violations", "n_distinct", "min_value", "max_value",
        F.round(F.when(F.col("k") > 0, mean), 4).alias("mean_value"), F.round(F.when(F.col("k") > 0, deviation), 4).alias("std_value"),
        F.round(F.when((F.col("k") > 0) & (F.col("rk") > 0) & (others > 0), (mean - F.col("r1") / F.col("rk")) / others), 4).alias("shift"),
    )
