"""Applying changes to a library: latest states, upserts, removals, digests, and a repeatable sink for change feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.shared import names_in, remove


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; a row limit of one is pushed below the shuffle."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` but those of the keys that ``gone`` holds."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the columns of ``new`` written over it by key: fields that are new and not null win, all others stay,
    unknown keys are added. Both sides have a key once."""
    fresh = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys])
    both = old.join(fresh, keys, "full_outer")
    extra = [c for c in new.columns if c not in old.columns]
    pick = [F.coalesce(f"_new_{c}", c).alias(c) if c in new.columns else F.col(c) for c in old.columns if c not in keys]
    return both.select(*keys, *pick, *[F.col(f"_new_{c}").alias(c) for c in extra])


def ancestors(rows: DataFrame, path: str, name: str) -> DataFrame:
    """``rows`` once for each folder above their path, in a column ``name``."""
    parts = F.split(path, "/")
    return rows.withColumn(name, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))).where(F.col(name) != "")


def digest(rows: DataFrame, key: str, value: str, width: int = 3) -> DataFrame:
    """(key, digest): a fingerprint of the distinct values of a key, whatever their order.

    Values are hashed by parts that share their first ``width`` characters, then the parts' hashes are: of hexadecimal
    hashes a task holds one part in 16^width."""
    once = rows.select(key, value, F.substring(value, 1, width).alias("part")).where(F.col(value).isNotNull()).distinct()
    parts = once.groupBy(key, "part").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(value)), ""), 256).alias("d"))
    whole = F.array_sort(F.collect_list(F.struct("part", "d")))
    return parts.groupBy(key).agg(F.sha2(F.array_join(F.transform(whole, lambda p: p["d"]), ""), 256).alias("digest"))


def back_off(attempt: Column) -> Column:
    """Seconds to wait after a failed attempt, counted from 1."""
    return F.when(attempt == 1, 30).when(attempt == 2, 60).when(attempt == 3, 120).otherwise(300).cast("decimal(18,6)")


class Library:
    """A table in a folder to which batches of changes are applied, each exactly once.

    Every applied epoch leaves a whole new version ``v=<epoch>``, which counts once its write has committed; an epoch that is
    delivered again finds its version there and changes nothing. Readers see the last whole version."""

    def __init__(self, schema: str, folder: str, keys: list[str]) -> None:
        self.schema, self.folder, self.keys = schema, folder.rstrip("/"), keys

    def versions(self, spark) -> list[int]:  # noqa: ANN001
        done = [n for n in names_in(spark, self.folder) if n.startswith("v=") and "_SUCCESS" in names_in(spark, f"{self.folder}/{n}")]
        return sorted(int(n[2:]) for n in done)

    def read(self, spark) -> DataFrame:  # noqa: ANN001
        found = self.versions(spark)
        if not found:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(f"{self.folder}/v={found[-1]}")

    def apply(self, changes: DataFrame, epoch: int) -> None:
        """Apply ``changes`` (action, seq and the table's columns): of a key the last by ``seq`` counts; 'delete' removes it,
        'update' replaces or adds it. To be handed to :func:`feeds.apply_changes`."""
        spark = changes.sparkSession
        if epoch in self.versions(spark):
            return
        last = latest(changes, self.keys, [F.desc("seq")]).persist()  # both sides below read it; its source is read once
        try:
            old = self.read(spark)
            new = without(old, last, self.keys).unionByName(last.where("action = 'update'").select(*old.columns))
            new.write.mode("overwrite").parquet(f"{self.folder}/v={epoch}")
        finally:
            last.unpersist()

    def vacuum(self, spark, keep: int = 2) -> None:  # noqa: ANN001
        for version in self.versions(spark)[:-keep]:
            remove(spark, f"{self.folder}/v={version}")
