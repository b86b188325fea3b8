"""Operators that settle on a value: consensus, conflicts, abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_CONFIDENCE = 0.55


def resolve(rows: DataFrame, group: list[str], *, value: str = "normalized_decimal", least: float = LEAST_CONFIDENCE) -> DataFrame:
    """One row per group: (…, status, answer, evidence).

    Rows below the least confidence do not count; without any other the status is low_confidence. Several distinct
    values are a conflict without an answer, exactly one is ok, none is no_value. Only sums and extremes are kept, so a
    hot group costs no more than another."""
    sure = F.coalesce(F.col("confidence") >= least, F.lit(False))
    v = F.when(sure, F.col(value))
    out = rows.groupBy(*group).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count_if(sure).alias("evidence"))
    status = F.when(F.col("evidence") == 0, "low_confidence").when(F.col("low").isNull(), "no_value").when(F.col("low") == F.col("high"), "ok").otherwise("conflict")
    return out.select(*group, status.alias("status"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("answer"), "evidence")


def dominant(rows: DataFrame, group: list[str], value: str, least: int = 2) -> DataFrame:
    """The most frequent value of each group, of equals the largest, where it occurs at least ``least`` times."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*group).agg(F.max(F.struct("n", value)).alias("b"))
    return best.select(*group, F.col(f"b.{value}").alias(value), F.col("b.n").alias("times")).where(F.col("times") >= least)


def consensus(candidates: DataFrame, group: list[str], *, margin: float = 2.0) -> DataFrame:
    """The value with the highest summed score in each group (columns value, score, canonical); where it leads by less
    than ``margin`` and is not canonical itself, none."""
    support = candidates.groupBy(*group, "value").agg(F.sum("score").alias("score"), F.bool_or("canonical").alias("canonical"))
    rank = F.struct("score", "canonical", "value")
    best = support.groupBy(*group).agg(F.max(rank).alias("b"), F.max_by("score", rank).alias("top"), F.sum(F.lit(1)).alias("values"))
    second = support.join(best.select(*group, F.col("b.value").alias("first")), group).where(F.col("value") != F.col("first")).groupBy(*group).agg(F.max("score").alias("second"))
    told = best.join(second, group, "left").withColumn("lead", F.col("top") - F.coalesce("second", F.lit(0.0)))
    sound = (F.col("lead") >= margin) | F.col("b.canonical")
    return told.select(*group, F.when(sound, F.col("b.value")).alias("value"), "lead", "values")


def employer_matches(query: list[str], tokens: Column, source: Column) -> Column:
    """Whether all query tokens are among the row's tokens, or all stand in its source path."""
    asked = F.array(*[F.lit(q) for q in query])
    in_path = F.filter(F.split(F.lower(source), r"[^a-z0-9]+"), lambda x: x != "")
    return (F.size(F.array_except(asked, F.coalesce(tokens, F.array().cast("array<string>")))) == 0) | (F.size(F.array_except(asked, in_path)) == 0)
