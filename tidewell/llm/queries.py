"""Queries of this subpackage and the SQL that some of them can be checked with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from tidewell.session import table
from tidewell.shared import Scratch

Query = Callable[[SparkSession, str], DataFrame]


def _op(name: str) -> ModuleType:
    """An operator's module, imported once it is used: the driver need not hold what other queries import."""
    return import_module(f"tidewell.llm.{name}")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = table(spark, sf_dir, "ledger")
    return _op("survivors").duplicate_pairs(_op("survivors").group_duplicates(ledger, Scratch(spark, "p1")))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("survivors").classes(_op("survivors").group_duplicates(table(spark, sf_dir, "ledger"), Scratch(spark, "p1")))


def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, scratch = table(spark, sf_dir, "ledger"), Scratch(spark, "p1")
    groups = scratch.keep(_op("survivors").group_duplicates(ledger, scratch), "groups")
    return _op("survivors").survivors(ledger, groups, scratch)


def _scanned(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("extracted_pages", "image_regions", "extracted_images")]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("scans").noise(*_scanned(spark, sf_dir), Scratch(spark, "p2"))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("scans").repaired(*_scanned(spark, sf_dir), Scratch(spark, "p2"))


def p3_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("origins").classify(table(spark, sf_dir, "files"), table(spark, sf_dir, "extracted_texts"), Scratch(spark, "p3"), table(spark, sf_dir, "silos"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_labels(spark, sf_dir).where("label <> 'handwritten'").select("file_key").distinct()


def _long_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("splitting").records(table(spark, sf_dir, "extracted_texts"), table(spark, sf_dir, "extracted_pages"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("splitting").split_records(_long_records(spark, sf_dir)).where("pieces > 1 and piece_no = 0").select("record_kind", "record_key")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("splitting").with_text(_long_records(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [table(spark, sf_dir, t) for t in ("files", "chunks", "ledger")]
    return _op("history").forerunners(*tables, Scratch(spark, "p5"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("packing").fill_containers(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"), Scratch(spark, "p6"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("packing").fill_rates(p6_containers(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("leaks").leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _op("languages").identify(docs, _op("languages").fit(docs, Scratch(spark, "p8")))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _op("languages").segment_languages(docs, _op("languages").fit(docs, Scratch(spark, "p8")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("languages").mislabelled(p8_languages(spark, sf_dir))


def queries() -> dict[str, Query]:
    named = (
        p1_found, p1_classes, p1_survivors, p2_found, p2_repaired, p3_found, p3_labels, p4_found, p4_pieces, p5_found,
        p6_containers, p6_fill, p7_found, p7_leaks, p8_found, p8_languages, p8_segments,
    )
    return {f.__name__: f for f in named}


P4_SQL = """
  SELECT 'text' AS record_kind, text_key AS record_key FROM extracted_texts WHERE length(text) > 1000
  UNION ALL SELECT 'page', page_key FROM extracted_pages WHERE length(text) > 1000
"""

P5_SQL = r"""
  WITH f AS (SELECT file_key, batch_no, nullif(regexp_replace(lower(trim(hash)), '^(md5|sha1|sha256)\s*[:=]\s*', ''), '') AS h FROM files WHERE batch_no IS NOT NULL),
  t AS (SELECT DISTINCT file_key, lower(trim(chunk_hash)) AS c FROM chunks WHERE trim(chunk_hash) <> ''),
  n AS (SELECT file_key, count(*) AS m FROM t GROUP BY file_key),
  shr AS (SELECT a.file_key AS fa, b.file_key AS fb, count(*) AS o FROM t a JOIN t b ON a.c = b.c
    JOIN f x ON x.file_key = a.file_key JOIN f y ON y.file_key = b.file_key WHERE x.batch_no < y.batch_no GROUP BY 1, 2),
  near AS (SELECT fa AS earlier_key, fb AS later_key FROM shr JOIN n na ON na.file_key = fa JOIN n nb ON nb.file_key = fb WHERE 5 * o >= 4 * (na.m + nb.m - o)),
  same AS (SELECT a.file_key AS earlier_key, b.file_key AS later_key FROM f a JOIN f b ON a.h = b.h AND a.batch_no < b.batch_no),
  l AS (SELECT row_key, batch_no, nullif(regexp_replace(lower(trim(doc_hash)), '^(md5|sha1|sha256)\s*[:=]\s*', ''), '') AS h, coalesce(cast(page AS varchar), '-') AS p, field_code FROM ledger WHERE batch_no IS NOT NULL),
  rws AS (SELECT a.row_key AS earlier_key, b.row_key AS later_key FROM l a JOIN l b ON a.h = b.h AND a.p = b.p AND a.field_code = b.field_code AND a.batch_no < b.batch_no)
  SELECT 'file' AS record_kind, min(earlier_key) AS earlier_key, later_key FROM (SELECT * FROM near UNION ALL SELECT * FROM same) z GROUP BY later_key
  UNION ALL SELECT 'ledger', min(earlier_key), later_key FROM rws GROUP BY later_key
"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL, "p5_found": P5_SQL}
