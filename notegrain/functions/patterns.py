"""Pattern strings: compact drum notation to steps, and steps to notes. All by string and array functions.

A pattern is a row of cells: ``X`` or any letter is a hit, ``.``, ``-`` and ``_`` are rests, ``(...)`` is a group
played in the time of one cell. Blanks and bars (``|``) are ignored. Null and empty patterns have no steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GRIDS = (8, 12, 16, 24, 32)


def cells(pattern: Column) -> Column:
    """The cells of a pattern in order."""
    return F.regexp_extract_all(F.regexp_replace(pattern, r"[\s|]", ""), F.lit(r"\([^)]*\)|[^()]"), F.lit(0))


def steps(df: DataFrame, pattern: str = "pattern") -> DataFrame:
    """The frame with one row for each hit: step, of (cells in the pattern), at and span as shares of the whole, hit.

    Rows without a hit disappear."""
    listed = df.withColumn("_cells", cells(F.col(pattern))).withColumn("of", F.size("_cells"))
    each = listed.select(*df.columns, "of", F.posexplode("_cells").alias("step", "_cell"))
    inner = F.when(F.col("_cell").startswith("("), F.regexp_extract_all(F.regexp_replace("_cell", r"[()]", ""), F.lit("."), F.lit(0))).otherwise(F.array("_cell"))
    parts = each.withColumn("_inner", inner).select(*df.columns, "of", "step", F.size("_inner").alias("_n"), F.posexplode("_inner").alias("_i", "hit"))
    at = (F.col("step") + F.col("_i") / F.col("_n")) / F.col("of")
    return parts.filter(~F.col("hit").isin(".", "-", "_")).select(*df.columns, "step", "of", at.alias("at"), (1 / (F.col("of") * F.col("_n"))).alias("span"), "hit")


def snapped(n: Column) -> Column:
    """The smallest usual grid that holds ``n`` cells, else the largest."""
    return F.coalesce(F.array_min(F.filter(F.array(*map(F.lit, GRIDS)), lambda g: g >= n)), F.lit(GRIDS[-1]))


def tiled(hits: DataFrame, bars: int, ticks: int = 1920) -> DataFrame:
    """The hits of a bar repeated over ``bars`` bars: start and dur in ticks."""
    every = hits.withColumn("bar", F.explode(F.sequence(F.lit(0), F.lit(bars - 1))))
    return every.withColumn("start", F.rint((F.col("bar") + F.col("at")) * ticks).cast("int")).withColumn("dur", F.greatest(F.lit(1), F.floor(F.col("span") * ticks)).cast("int"))


def mask(pattern: Column) -> Column:
    """A row of at most 16 X and . as bits, first cell lowest."""
    chars = F.regexp_extract_all(pattern, F.lit("[Xx.]"), F.lit(0))
    return F.aggregate(F.transform(chars, lambda c, i: F.when(F.lower(c) == "x", F.pow(F.lit(2), i).cast("int")).otherwise(0)), F.lit(0), lambda a, b: a + b)
