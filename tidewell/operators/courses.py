"""Rows of course transcripts out of lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = r"^([A-Z]{2,4} \d{3})\s{2,}(.+?)\s{2,}([A-F][+-]?|P|W|IP)\s{2,}(\d+\.\d{2})$"


def status(grade: Column) -> Column:
    return F.when(grade.isin("W"), "withdrawn").when(grade.isin("IP"), "in_progress").when(grade == "F", "failed").otherwise("completed")


def course_rows(texts: DataFrame) -> DataFrame:
    """(source, line_no, course_code, course_title, course_grade, course_credits, course_status) of the lines of ``texts``
    (source, text) that are course rows; each line of a source counts."""
    lines = texts.select("source", F.posexplode(F.split("text", r"\r?\n", -1)).alias("at", "line"))
    part = lambda n: F.regexp_extract(F.trim("line"), LINE, n)
    rows = lines.where(F.regexp_like(F.trim("line"), F.lit(LINE)))
    return rows.select("source", (F.col("at") + 1).cast("bigint").alias("line_no"), part(1).alias("course_code"), part(2).alias("course_title"), part(3).alias("course_grade"), part(4).cast("decimal(6,2)").alias("course_credits"), status(part(3)).alias("course_status"))


def distinct_courses(rows: DataFrame) -> DataFrame:
    """One row per source, code and title: the first line; (…, times)."""
    key = ["source", "course_code", "course_title"]
    best = F.min_by(F.struct("line_no", "course_grade", "course_credits", "course_status"), "line_no")
    return rows.groupBy(*key).agg(best.alias("b"), F.count(F.lit(1)).alias("times")).select(*key, "b.*", "times")
