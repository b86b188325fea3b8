"""Queries that order and sum up ranked streams by source, and rows of courses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.operators import courses, ranked, rerank
from tidewell.plans.registry import query
from tidewell.session import table
from tidewell.shared import Scratch

STREAM = """st AS (SELECT c.id, c.source, c.silo, c.page, round((c.line_start % 97) / 97.0::DOUBLE, 6) AS dist, CAST(row_number() OVER (ORDER BY c.file_key, c.chunk_no, c.id) - 1 AS BIGINT) AS pos
  FROM (SELECT DISTINCT * FROM chunks WHERE batch) c)""".replace("SELECT DISTINCT * FROM chunks WHERE batch", "SELECT DISTINCT id, file_key, chunk_no, source, silo, page, line_start FROM chunks")
EXT = r"lower(regexp_extract(source, '[^/]\.([^./]+)$', 1))"


def _dist() -> Column:
    return F.round((F.col("line_start") % 97) / F.lit(97.0), 6).alias("dist")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("id", "file_key", "chunk_no", "source", "silo", "page", "line_start").distinct()


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct chunks as a ranked stream; ``pos`` is the key they are ordered by, as no number is needed to order."""
    return _chunks(spark, sf_dir).select("id", "source", "silo", "page", _dist(), F.struct("file_key", "chunk_no", "id").alias("pos"))


def _numbered(stream: DataFrame, label: str, *order: str) -> DataFrame:
    return ranked.numbered(stream.withColumnRenamed("pos", "at"), Scratch(stream.sparkSession, label), *order)


@query("sources_by_extension_hint", f"""WITH {STREAM}, h AS (SELECT *, CASE {EXT} WHEN 'pdf' THEN 0 WHEN 'py' THEN 1 ELSE 2 END AS hint, min(coalesce(dist, 999)) OVER (PARTITION BY source) AS best FROM st)
  SELECT id, CAST(row_number() OVER (ORDER BY hint, best, source, dist, pos) - 1 AS BIGINT) AS pos FROM h QUALIFY row_number() OVER (ORDER BY hint, best, source, dist, pos) <= 60""")
def sources_by_extension_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.by_extension_hint(_whole(spark, sf_dir), ["pdf", "py"], 60).select("id", "pos")


@query("year_first", f"""WITH {STREAM} SELECT id, CAST(row_number() OVER (ORDER BY NOT regexp_matches(source, '(^|[^0-9])2014([^0-9]|$)'), contains(lower(source), 'readme'), coalesce(dist, 0), pos) - 1 AS BIGINT) AS pos FROM st
  QUALIFY row_number() OVER (ORDER BY NOT regexp_matches(source, '(^|[^0-9])2014([^0-9]|$)'), contains(lower(source), 'readme'), coalesce(dist, 0), pos) <= 50""")
def year_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.heuristic(_whole(spark, sf_dir).withColumn("text", F.lpad(F.lit(""), 100, "x")), 50, year=2014).select("id", "pos")


@query("near_named_sources", f"""WITH {STREAM}, b AS (SELECT source, min(dist) AS best FROM st GROUP BY source),
  n AS (SELECT *, best <= 0.5 AND len(list_intersect(['lease', 'survey', 'the', 'signed'], regexp_extract_all(lower(regexp_replace(source, '[^A-Za-z0-9]+', ' ', 'g')), '([a-z0-9]{{3,}})', 1))) > 0 AS named FROM b),
  k AS (SELECT *, bool_or(named) OVER () AS anynamed, row_number() OVER (ORDER BY best, source) AS rk FROM n) SELECT id, source FROM st WHERE source IN (SELECT source FROM k WHERE (anynamed AND named) OR (NOT anynamed AND rk <= 2))""")
def near_named_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.near_and_named(_whole(spark, sf_dir), "the signed lease survey", 0.5).select("id", "source")


@query("source_footer", f"WITH {STREAM} SELECT source, min(pos) AS first_pos, min(dist) AS best, coalesce(list_sort(list(DISTINCT page) FILTER (page IS NOT NULL)), []) AS pages FROM st GROUP BY source")
def source_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.source_footer(_numbered(_whole(spark, sf_dir), "footer", "at"))


@query("silos_by_best", f"WITH {STREAM} SELECT id, silo, CAST(row_number() OVER (ORDER BY best, silo, pos) - 1 AS BIGINT) AS pos FROM (SELECT *, min(dist) OVER (PARTITION BY silo) AS best FROM st)")
def silos_by_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _whole(spark, sf_dir)
    best = rows.groupBy(F.col("silo").alias("of")).agg(F.min("dist").alias("best"))
    told = rows.join(best, F.col("silo").eqNullSafe(F.col("of"))).drop("of")
    return _numbered(told, "silos", "best", "silo", "at").select("id", "silo", "pos")


@query("sub_scope", "SELECT DISTINCT silo, path FROM files WHERE contains(lower(path), 'lease') OR contains(lower(path), 'survey')")
def sub_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.contains(F.lower("path"), F.lit("lease")) | F.contains(F.lower("path"), F.lit("survey"))
    return table(spark, sf_dir, "files").where(hit).select("silo", "path").distinct()


@query("longest_slug_of_path", "SELECT path, slug FROM silos WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rtrim(trim(path), '/') ORDER BY length(slug) DESC, slug) = 1")
def longest_slug_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy(F.rtrim(F.trim("path"), F.lit("/"))).orderBy(F.desc(F.length("slug")), "slug"))
    return table(spark, sf_dir, "silos").where("path is not null").withColumn("n", n).where("n = 1").select("path", "slug")


@query("slug_prefixes", "WITH p AS (SELECT DISTINCT substr(slug, 1, 4) AS hint FROM silos) SELECT hint, min(slug) AS slug FROM p JOIN silos ON starts_with(slug, hint) GROUP BY hint HAVING count(*) = 1")
def slug_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints that begin exactly one slug; each slug is joined by its own prefix."""
    silos = table(spark, sf_dir, "silos").select(F.substring("slug", 1, 4).alias("hint"), "slug")
    return silos.groupBy("hint").agg(F.min("slug").alias("slug"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


@query("health", "SELECT count(*) AS silos, CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS chunks, count(*) FILTER (c.n IS NULL) AS empty_silos, CASE WHEN count(*) FILTER (c.n IS NULL) > 0 THEN 'attention' ELSE 'ok' END AS state FROM silos LEFT JOIN (SELECT silo, count(*) AS n FROM chunks GROUP BY silo) c ON c.silo = slug")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "chunks").groupBy("silo").agg(F.count(F.lit(1)).alias("n"))
    both = table(spark, sf_dir, "silos").join(held, F.col("slug") == F.col("silo"), "left")
    gone = F.count_if(F.col("n").isNull())
    return both.agg(F.count(F.lit(1)).alias("silos"), F.sum(F.coalesce("n", F.lit(0))).alias("chunks"), gone.alias("empty_silos"), F.when(gone > 0, "attention").otherwise("ok").alias("state"))


COURSE = r"^([A-Z]{2,4} \d{3})\s{2,}(.+?)\s{2,}([A-F][+-]?|P|W|IP)\s{2,}(\d+\.\d{2})$"


@query("course_rows", f"""WITH l AS (SELECT doc_id, i, trim(string_split(text, chr(10))[i]) AS line FROM documents, range(1, len(string_split(text, chr(10))) + 1) r(i)),
  c AS (SELECT doc_id, i, regexp_extract(line, '{COURSE}', ['code', 'title', 'grade', 'credits']) AS p FROM l WHERE regexp_matches(line, '{COURSE}'))
  SELECT CAST(doc_id AS VARCHAR) AS source, arg_min(CAST(i AS BIGINT), i) AS line_no, p.code AS course_code, p.title AS course_title, arg_min(p.grade, i) AS course_grade, CAST(arg_min(p.credits, i) AS DECIMAL(6,2)) AS course_credits,
    CASE arg_min(p.grade, i) WHEN 'W' THEN 'withdrawn' WHEN 'IP' THEN 'in_progress' WHEN 'F' THEN 'failed' ELSE 'completed' END AS course_status, count(*) AS times FROM c GROUP BY doc_id, p.code, p.title""")
def course_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), "text")
    return courses.distinct_courses(courses.course_rows(docs))


@query("credits_by_status", f"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT regexp_extract(trim(line), '{COURSE}', 3) AS g, CAST(regexp_extract(trim(line), '{COURSE}', 4) AS DECIMAL(6,2)) AS k FROM l WHERE regexp_matches(trim(line), '{COURSE}'))
  SELECT CASE g WHEN 'W' THEN 'withdrawn' WHEN 'IP' THEN 'in_progress' WHEN 'F' THEN 'failed' ELSE 'completed' END AS course_status, CAST(sum(k) AS DECIMAL(18,2)) AS credits, count(*) AS courses FROM c GROUP BY 1""")
def credits_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), "text")
    return courses.course_rows(docs).groupBy("course_status").agg(F.sum("course_credits").cast("decimal(18,2)").alias("credits"), F.count(F.lit(1)).alias("courses"))
