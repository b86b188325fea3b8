"""Writes that can be repeated: appends without repeats, replacements by source, overwrites by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def once_by_id(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each id in the given order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def append_new(rows: DataFrame, path: str, key: str, order: list[str]) -> DataFrame:
    """Append rows whose id the table at ``path`` lacks; returns the table. A repeated call adds nothing."""
    spark = rows.sparkSession
    fresh = once_by_id(rows, key, order)
    try:
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti").select(*rows.columns)
    except Exception as gone:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(gone):
            raise
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def missing_ids(written: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Ids that were to be written and cannot be read back; empty after a good write."""
    return written.select(key).distinct().join(stored.select(key), key, "left_anti")


def replace_sources(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``existing`` without any row of the sources that ``new`` brings (also entries inside them, 'source > inner'), then ``new``."""
    sources = new.select(F.col(key).alias("_s")).where("_s is not null").distinct()
    outer = F.regexp_replace(F.col(key), r" > .*$", "")
    kept = existing.withColumn("_outer", outer).join(sources, F.col("_outer") == F.col("_s"), "left_anti").drop("_outer")
    return kept.unionByName(new)


def overwrite_partitions(rows: DataFrame, path: str, partition: str) -> None:
    """Replace exactly the partitions that ``rows`` has, each atomically by the committer."""
    rows.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def append_audit(records: DataFrame, path: str, *, longest: int = 500) -> None:
    """Append audit records as JSON lines: query texts cut to ``longest``, parameters without a value dropped. Records with
    a time ``ts`` go to a folder of their day, so that old days are dropped whole."""
    rows = records
    if "queries" in rows.columns:
        rows = rows.withColumn("queries", F.transform("queries", lambda q: F.substring(q, 1, longest)))
    if "params" in rows.columns:
        rows = rows.withColumn("params", F.map_filter("params", lambda k, v: v.isNotNull()))
    if "ts" in rows.columns:
        rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)
    else:
        rows.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of an audit log of any days, oldest first; lines that are no records are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path).orderBy("ts")
