"""Joins Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the latest right row of its keys at or before its time: union and a running last value, one
    shuffle by the keys, no pairs. Right rows of one time are taken in the order of their values."""
    a = left.withColumns({"_t": F.col(left_time), "_side": F.lit(1), "_r": F.lit(None).cast(right.select(F.struct(right_time, *values)).schema[0].dataType)})
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(right_time, *values).alias("_r"))
    order = W.partitionBy(*keys).orderBy("_t", "_side", "_r").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_r", F.last("_r", ignorenulls=True).over(order)).where("_side = 1")
    return both.select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in values], F.col(f"_r.{right_time}").alias("matched_time"))


def in_range(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points joined with the ranges [low, high] that hold them: both sides meet in cells of ``width``, an equi-join."""
    cell = lambda c: F.floor(F.col(c).cast("double") / F.lit(width))
    spread = ranges.where(F.col(low) <= F.col(high)).withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    return points.withColumn("_cell", cell(point)).join(spread, "_cell").where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("_cell")


def salted(left: DataFrame, right: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys are spread over ``salts`` tasks: left rows draw one salt, right rows carry all."""
    a = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return a.join(b, [key, "_salt"], how).drop("_salt")
