"""Joins of values with ranges and of ranges with ranges, by bins instead of a nested loop.

Ranges are half open, [low, high). A range has the level of its length's power of two and lies in at most two bins of that
width. A value is looked up in one bin of every level that occurs, a range also in its at most two bins of every wider
level; so a long range is two rows however long it is, and every join is an equality of (level, bin) with the exact
condition behind it. Each pair meets in one bin only: the later one of the two first bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(low: Column, high: Column) -> Column:
    """The least k with high - low <= 2**k."""
    return F.greatest(F.ceil(F.log2((high - low).cast("double"))), F.lit(-20)).cast("int")


def _bin(value: Column, level: Column) -> Column:
    return F.floor(value.cast("double") / F.pow(F.lit(2.0), level)).cast("long")


def _last(high: Column, first: Column, level: Column) -> Column:
    """The bin of the range's end, which is no part of it."""
    width = F.pow(F.lit(2.0), level)
    return F.greatest(first, F.ceil(high.cast("double") / width).cast("long") - 1)


def levels_of(ranges: DataFrame, low: str, high: str) -> list[int]:
    """Levels that occur, some dozens at most, as numbers have so many powers of two."""
    return sorted(r[0] for r in ranges.where(F.col(low) < F.col(high)).select(_level(F.col(low), F.col(high))).distinct().collect())


def join_values(df: DataFrame, value: str, ranges: DataFrame, low: str = "low", high: str = "high", how: str = "inner") -> DataFrame:
    """Each row of ``df`` with every range of the table ``ranges`` that holds its value. ``how="left"`` keeps rows without
    a range, or with a null value. Empty ranges hold nothing. Column names of both sides must differ."""
    levels = levels_of(ranges, low, high)
    level = _level(F.col(low), F.col(high))
    placed = ranges.where(F.col(low) < F.col(high)).withColumn("_level", level)
    placed = placed.withColumn("_first", _bin(F.col(low), F.col("_level")))
    placed = placed.withColumn("_bin", F.explode(F.sequence("_first", _last(F.col(high), F.col("_first"), F.col("_level"))))).drop("_first")
    places = F.array(*[F.struct(F.lit(k).alias("_level"), _bin(F.col(value), F.lit(k)).alias("_bin")) for k in levels])
    if how == "inner":
        spread = df.where(F.col(value).isNotNull()).withColumn("_place", F.explode(places)) if levels else df.where("false").withColumn("_place", F.lit(None).cast("struct<_level: int, _bin: bigint>"))
        spread = spread.select(*df.columns, "_place._level", "_place._bin")
        return spread.join(placed, ["_level", "_bin"]).where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_level", "_bin")
    # distinct values only: a row may have no range, one or several
    values = df.select(F.col(value).alias("_value")).distinct()
    hits = join_values(values, "_value", ranges, low, high)
    return df.join(hits, F.col(value) == F.col("_value"), "left").drop("_value")


def join_ranges(left: DataFrame, right: DataFrame, on: list[str], low: str = "low", high: str = "high") -> DataFrame:
    """Pairs of rows of equal ``on`` whose ranges share a point, each once: ``on``, and the other columns of both sides with
    the prefixes ``left_`` and ``right_``."""
    levels = sorted({*levels_of(left, low, high), *levels_of(right, low, high)})

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.where(F.col(low) < F.col(high)).select(*on, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in on])
        first, end = F.col(f"{name}_{low}"), F.col(f"{name}_{high}")
        rows = rows.withColumn("_own", _level(first, end))
        every = F.array(*[F.struct(F.lit(k).alias("level"), _bin(first, F.lit(k)).alias("first"), _last(end, _bin(first, F.lit(k)), F.lit(k)).alias("last")) for k in levels])
        wide = F.filter(every, lambda p: p["level"] >= F.col("_own"))
        rows = rows.withColumn("_p", F.explode(wide))
        return rows.withColumn("_bin", F.explode(F.sequence("_p.first", "_p.last"))).select(
            *[c for c in rows.columns if c != "_p"], F.col("_p.level").alias("_level"), F.col("_p.first").alias(f"_first_{name}"), "_bin"
        ).withColumnRenamed("_own", f"_own_{name}")

    if not levels:
        left, right, levels = left.where("false"), right.where("false"), [0]
    joined = side(left, "left").join(side(right, "right"), [*on, "_level", "_bin"])
    once = (F.col("_level") == F.greatest("_own_left", "_own_right")) & (F.col("_bin") == F.greatest("_first_left", "_first_right"))
    meet = (F.col(f"left_{low}") < F.col(f"right_{high}")) & (F.col(f"right_{low}") < F.col(f"left_{high}"))
    hidden = ["_level", "_bin", "_own_left", "_own_right", "_first_left", "_first_right"]
    return joined.where(once & meet).drop(*hidden)


def bucket_by_table(df: DataFrame, value: str, bounds: DataFrame) -> DataFrame:
    """``df`` with the column ``bucket`` of the range partition (bucket, low, high) of ``bounds`` that holds the value, null
    outside of all; of ranges that overlap, the one that begins first, then the least name."""
    values = df.select(F.col(value).alias("_value")).distinct()
    hits = join_values(values, "_value", bounds.select("bucket", "low", "high"))
    first = hits.groupBy("_value").agg(F.min(F.struct("low", "bucket")).alias("_hit"))
    joined = df.join(first, F.col(value) == F.col("_value"), "left")
    return joined.withColumn("bucket", F.col("_hit.bucket")).drop("_value", "_hit")


def overlapping_ranges(jobs: DataFrame, on: list[str], id_col: str, low: str, high: str) -> DataFrame:
    """(on, a, b, shared): pairs a < b of rows whose ranges overlap, and the length of what they share."""
    rows = jobs.select(*on, F.col(id_col).alias("id"), F.col(low).alias("low"), F.col(high).alias("high"))
    pairs = join_ranges(rows, rows, on).where("left_id < right_id")
    shared = F.least("left_high", "right_high") - F.greatest("left_low", "right_low")
    return pairs.select(*on, F.col("left_id").alias("a"), F.col("right_id").alias("b"), shared.alias("shared"))


