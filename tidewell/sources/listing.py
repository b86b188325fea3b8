"""Listing of folders and admission of files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.texts import kind

MAX_BYTES = 20 * 1024 * 1024


def glob_regex(glob: str) -> str:
    """A glob of names or paths as a regular expression; one ending in a slash means a folder of that name anywhere."""
    if glob.endswith("/"):
        return "/" + re.escape(glob.strip("/")) + "/"
    body = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob)
    return f"(^|/){body}$"


def admitted(files: DataFrame, *, include: list[str] | None = None, exclude: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows of ``files`` (path, size) to be read: excludes first, hidden and lock files never, oversize ones never."""
    rows = files.where(F.col("path").isNotNull() & (F.col("size") <= max_bytes) & ~F.regexp_like("path", F.lit(r"(^|/)(~\$|\.)[^/]*$")))
    if exclude:
        rows = rows.where(~F.regexp_like("path", F.lit("|".join(map(glob_regex, exclude)))))
    if include:
        rows = rows.where(F.regexp_like("path", F.lit("|".join(map(glob_regex, include)))))
    return rows


def list_folder(spark: SparkSession, root: str, **rules) -> DataFrame:  # noqa: ANN003
    """(path, mtime, size, kind, content) of the admitted files below ``root``; content is read only where it is used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = found.select(F.regexp_replace("path", "^file:", "").alias("path"), F.unix_micros("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"), "content")
    return admitted(rows.withColumn("mtime", F.col("mtime") / 1e6), **rules).withColumn("kind", kind("path"))
