"""Operators over the catalogue of files: roll-ups, finders, change-sets and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.dates import month_inside
from tidewell.functions.texts import base_name, extension
from tidewell.operators.ranked import cut_off


def modified(mtime: str = "mtime") -> Column:
    """Modification time as a UTC timestamp; null without one."""
    return F.timestamp_seconds(F.col(mtime))


def count_by(files: DataFrame, dimension: str) -> DataFrame:
    """(label, files) by extension, folder, year, month or quarter, most first, then by label."""
    when = modified()
    labels = {
        "extension": F.when(extension("path") == "", "(none)").otherwise(extension("path")),
        "folder": F.regexp_extract("path", r"^(.*)/[^/]*$", 1),
        "year": F.date_format(when, "yyyy"),
        "month": F.date_format(when, "yyyy-MM"),
        "quarter": F.concat(F.date_format(when, "yyyy"), F.lit("-Q"), F.quarter(when).cast("string")),
    }
    labelled = files.select(labels[dimension].alias("label")).where("label is not null")
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "label")


def collapse_duplicates(files: DataFrame, key: Column) -> DataFrame:
    """One row per content: (content, path, copies, latest), the path the smallest of its copies."""
    return files.withColumn("content", key).groupBy("content").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("copies"), F.max("mtime").alias("latest"))


def find_files(files: DataFrame, *, name: str | None = None, low: str | None = None, high: str | None = None, limit: int = 100) -> DataFrame:
    """Files whose name matches a glob and whose name date or modification date falls into [low, high].

    ``date_source`` says which date matched (name_date, mtime or both); a month-precise name date matches only where
    the range holds the whole month. Dated names first, newest first, then by path and key; ``truncated`` marks a cut."""
    rows = files
    if name:
        pattern = "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c in "_-" else "\\" + c) for c in name.lower())
        rows = rows.where(F.regexp_like(F.lower(base_name("path")), F.lit(f"^{pattern}$")))
    rows = rows.withColumn("mtime_date", F.to_date(modified()))
    if low and high:
        lo, hi = F.lit(low).cast("date"), F.lit(high).cast("date")
        day = F.when(F.col("name_date_precision") == "month", month_inside(F.col("name_date"), lo, hi)).otherwise(F.col("name_date").between(lo, hi))
        by_name, by_time = F.coalesce(day, F.lit(False)), F.coalesce(F.col("mtime_date").between(lo, hi), F.lit(False))
        rows = rows.withColumn("matched_by", F.when(by_name & by_time, "both").when(by_name, "name_date").when(by_time, "mtime")).where("matched_by is not null")
    else:
        rows = rows.withColumn("matched_by", F.lit(None).cast("string"))
    order = [F.col("name_date").desc_nulls_last(), F.col("path"), F.col("file_key")]
    return cut_off(rows, limit, *order)


def change_set(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """(silo, path, action): update where size, time or presence differ, delete where the listing lacks it, else unchanged."""
    key = ["silo", "path"]
    a = listing.select(*key, F.col("size").alias("size_a"), F.col("mtime").alias("mtime_a"), F.lit(True).alias("here"))
    b = manifest.select(*key, F.col("size").alias("size_b"), F.col("mtime").alias("mtime_b"), F.lit(True).alias("there"))
    same = F.col("size_a").eqNullSafe(F.col("size_b")) & F.col("mtime_a").eqNullSafe(F.col("mtime_b"))
    action = F.when(F.col("here").isNull(), "delete").when(F.col("there").isNull() | ~same, "update").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(*key, action.alias("action"))


def nested_paths(silos: DataFrame) -> DataFrame:
    """(inner, outer, relation) of silos whose folders coincide or lie inside one another.

    Every folder is joined to its own ancestors by equality, so no pair of unrelated silos is ever formed."""
    clean = silos.where("path is not null").select("slug", F.regexp_replace(F.regexp_replace(F.trim("path"), "/+", "/"), r"(.)/$", "$1").alias("path"))
    parts = F.split("path", "/")
    above = clean.select("slug", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("at"))
    other = clean.select(F.col("slug").alias("outer"), F.col("path").alias("at"))
    pair = above.join(other, "at").where((F.col("slug") != F.col("outer")) & ((F.col("path") != F.col("at")) | (F.col("slug") < F.col("outer"))))
    return pair.select(F.col("slug").alias("inner"), "outer", F.when(F.col("path") == F.col("at"), "same_path").otherwise("nested").alias("relation"))


def count_mismatches(silos: DataFrame, files: DataFrame) -> DataFrame:
    """(slug, registered, listed) of silos whose registered number of files is not the listed one."""
    listed = files.groupBy("silo").agg(F.count_distinct("path").alias("listed"))
    both = silos.join(listed, silos["slug"] == listed["silo"], "left")
    return both.select("slug", F.col("files_indexed").alias("registered"), F.coalesce("listed", F.lit(0)).alias("listed")).where(~F.col("registered").eqNullSafe(F.col("listed")))


def latest_first(rows: DataFrame, key: str, order: list[Column], keep: int) -> DataFrame:
    """The newest row of each key, of these the newest ``keep``: a retention rule for failure logs."""
    n = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n").orderBy(*order).limit(keep)
