"""Queries over texts: words, chunks, quality, classes, identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import dates, quality, texts
from tidewell.operators import chunking
from tidewell.plans.registry import query
from tidewell.session import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


#: The chunker as a recursion over the lines of each text: lines are held from ``b`` on, ``n`` long, until they reach the size.
CHUNKS_SQL = """WITH RECURSIVE d AS (SELECT {key} AS k, string_split(text, chr(10)) AS ls FROM {table} WHERE regexp_matches(text, '\\S')),
  e AS (SELECT k, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d), q AS (SELECT k, list(length(line) + 1 ORDER BY i) AS w, list(cum ORDER BY i) AS p FROM (SELECT *, sum(length(line) + 1) OVER (PARTITION BY k ORDER BY i) AS cum FROM e) GROUP BY k),
  r AS (SELECT k, 0::BIGINT AS j, 1::BIGINT AS b, 0::BIGINT AS n, 1::BIGINT AS eb, 0::BIGINT AS ee FROM q
    UNION ALL SELECT k, j, CASE WHEN w > 1001 THEN j + 1 WHEN t >= 1000 THEN kept ELSE b END, CASE WHEN w > 1001 THEN 0 WHEN t >= 1000 THEN pj - coalesce(p[kept - 1], 0) ELSE t END,
      b, CASE WHEN w > 1001 THEN j - 1 WHEN t >= 1000 THEN j ELSE 0 END FROM (
      SELECT *, coalesce(list_max(list_filter(range(b, j + 1), lambda x: pj - coalesce(p[x - 1], 0) >= 150)), b) AS kept FROM (
        SELECT r.k, r.j + 1 AS j, r.b, q.w[r.j + 1] AS w, r.n + q.w[r.j + 1] AS t, q.p, q.p[r.j + 1] AS pj FROM r JOIN q USING (k) WHERE r.j < len(q.w)))),
  c AS (SELECT k, j, 0 AS o, eb AS line_start, array_to_string(ls[eb:ee], chr(10)) AS t FROM r JOIN d USING (k) WHERE ee >= eb
    UNION ALL SELECT k, len(ls) + 1, 0, b, array_to_string(ls[b:], chr(10)) FROM r JOIN d USING (k) WHERE j = len(ls) AND b <= len(ls)
    UNION ALL SELECT k, i, 1 + s, i, substr(line, s * 850 + 1, 1000) FROM e, range(0, 1 + CAST(ceil((length(line) - 1000) / 850.0) AS BIGINT)) z(s) WHERE length(line) > 1000),
  m AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY j, o) - 1 AS chunk_no, line_start, substr(sha256(t), 1, 16) AS chunk_hash, length(t) AS chars FROM c)"""
INNER = "substr(sha256('doc/' || k || '|0.0|' || chunk_no), 1, 20)"


@query("chunk_documents", CHUNKS_SQL.format(key="doc_id", table="documents") + f"""
  SELECT substr(sha256(concat_ws('|', source, {INNER})), 1, 20) AS id, source AS silo, 'doc/' || k AS source, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(line_start AS INTEGER) AS line_start, chunk_hash, CAST(chars AS INTEGER) AS chars FROM m JOIN documents ON doc_id = k""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.col("source").alias("silo"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source"), F.lit(0.0).alias("mtime"), "text")
    return chunking.chunk(rows).select("id", "silo", "source", "chunk_no", "line_start", "chunk_hash", F.length("text").alias("chars"))


@query("chunk_pages", CHUNKS_SQL.format(key="page_key", table="extracted_pages") + " SELECT k AS page_key, page_num, CAST(page_num * 1000 + chunk_no AS INTEGER) AS place, CAST(line_start AS INTEGER) AS line_start, chunk_hash FROM m JOIN extracted_pages ON page_key = k")
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of pages, numbered through their file: a thousand places a page."""
    pages = table(spark, sf_dir, "extracted_pages")
    made = chunking.chunk(pages.select(F.lit("").alias("silo"), F.col("page_key").cast("string").alias("source"), F.lit(0.0).alias("mtime"), "text"))
    told = made.select(F.col("source").cast("bigint").alias("page_key"), "chunk_no", "line_start", "chunk_hash").join(pages.select("page_key", "page_num"), "page_key")
    return told.select("page_key", "page_num", (F.col("page_num") * 1000 + F.col("chunk_no")).cast("int").alias("place"), "line_start", "chunk_hash")


@query("document_lines", "SELECT doc_id, CAST(i AS BIGINT) AS line_no, string_split(text, chr(10))[i] AS line FROM documents, range(1, len(string_split(text, chr(10))) + 1) r(i)")
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return lines.select("doc_id", (F.col("at") + 1).cast("bigint").alias("line_no"), "line")


@query("section_of_lines", r"""WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM documents, range(1, len(string_split(text, chr(10))) + 1) r(i))
  SELECT doc_id, CAST(i AS BIGINT) AS line_no, last_value(CASE WHEN starts_with(line, '# ') THEN substr(line, 3) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM l""")
def section_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    title = F.when(F.startswith("line", F.lit("# ")), F.substring(F.col("line"), F.lit(3), F.length("line")))
    return lines.select("doc_id", (F.col("at") + 1).cast("bigint").alias("line_no"), F.last(title, ignorenulls=True).over(W.partitionBy("doc_id").orderBy("at")).alias("section"))


@query("text_hashes", "SELECT doc_id, substr(sha256(text), 1, 16) AS chunk_hash, md5(text) AS md5, sha1(text) AS sha1 FROM documents WHERE text IS NOT NULL")
def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", texts.chunk_hash(F.col("text")).alias("chunk_hash"), F.md5("text").alias("md5"), F.sha1("text").alias("sha1"))


@query("silo_slugs", "SELECT slug, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(display_name)), '[^a-z0-9]+', '-', 'g'), '(^-+|-+$)', '', 'g'), ''), 'silo') || '-' || substr(sha1(display_name || '|' || path), 1, 8) AS made FROM silos WHERE display_name IS NOT NULL AND path IS NOT NULL")
def silo_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    silos = table(spark, sf_dir, "silos").where("display_name is not null and path is not null")
    return silos.select("slug", texts.slug(F.col("display_name"), F.col("path")).alias("made"))


@query("query_overlap", """WITH q AS (SELECT list_distinct(regexp_extract_all('when did the audit committee approve the lease renewal', '([a-z0-9]{3,})', 1)) AS q)
  SELECT doc_id, round(len(list_intersect(q, regexp_extract_all(lower(text), '([a-z0-9]{3,})', 1))) / len(q)::DOUBLE, 6) AS overlap FROM documents, q WHERE text IS NOT NULL""")
def query_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = texts.words(F.lit("when did the audit committee approve the lease renewal"))
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.round(texts.overlap(asked, texts.words(F.col("text"))), 6).alias("overlap"))


@query("lexical_terms", "SELECT item_id, list_slice(list_distinct_ordered, 1, 8) AS terms FROM (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i AND x NOT IN ('the', 'what', 'which', 'does', 'for', 'about', 'say')) AS list_distinct_ordered FROM (SELECT item_id, regexp_extract_all(lower(query), '([a-z0-9]{3,})', 1) AS w FROM eval_items))")
def lexical_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop = ["the", "what", "which", "does", "for", "about", "say"]
    return table(spark, sf_dir, "eval_items").select("item_id", F.slice(texts.words(F.col("query"), stop), 1, 8).alias("terms"))


_FITS = lambda p: f"regexp_matches(lower(trim(query)), '{p}')"
INTENT_CASE = "CASE " + " ".join("WHEN " + " AND ".join([_FITS(p) for p in a] + ["NOT " + _FITS(p) for p in n]) + f" THEN '{k}'" for k, a, n in quality.RULES) + " ELSE 'LOOKUP' END"


@query("question_intents", f"SELECT item_id, {INTENT_CASE} AS intent FROM eval_items")
def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select("item_id", quality.intent(F.col("query")).alias("intent"))


@query("line_intents", "WITH q AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS query FROM documents) SELECT " + INTENT_CASE + " AS intent, count(*) AS lines FROM q GROUP BY 1")
def line_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct line of the texts taken for a question: how many of each kind."""
    lines = _docs(spark, sf_dir).where("text is not null").select(F.explode(F.split("text", "\n", -1)).alias("query")).distinct()
    return lines.groupBy(quality.intent(F.col("query")).alias("intent")).agg(F.count(F.lit(1)).alias("lines"))


@query("mentioned_years", "SELECT doc_id, len(list_distinct(regexp_extract_all(text, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1))) > 0 AS dated FROM documents WHERE text IS NOT NULL")
def mentioned_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", (F.size(dates.years(F.col("text"))) > 0).alias("dated"))


KIND_CASE = "CASE " + " ".join(f"WHEN regexp_matches(lower(path), '{p}') THEN '{k}'" for k, p in quality.PATH_KINDS) + " ELSE 'other' END"


@query("path_kinds", f"SELECT {KIND_CASE} AS kind, count(*) AS files FROM files WHERE path IS NOT NULL GROUP BY 1")
def path_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").where("path is not null").groupBy(quality.path_kind(F.col("path")).alias("kind")).agg(F.count(F.lit(1)).alias("files"))


@query("readout_quality", """WITH w AS (SELECT region_key, regexp_extract_all(text, '([A-Za-z0-9]+)', 1) AS w, length(regexp_replace(text, '\\s', '', 'g')) AS ink, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS an FROM image_regions WHERE text IS NOT NULL),
  q AS (SELECT region_key, len(w) AS words, CASE WHEN ink > 0 THEN an / ink::DOUBLE ELSE 0 END AS alnum, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: length(x) = 1)) / len(w)::DOUBLE ELSE 0 END AS short FROM w)
  SELECT region_key, words, round(alnum, 6) AS alnum, round(short, 6) AS short_share, list_filter([CASE WHEN words < 5 THEN 'few_words' END, CASE WHEN alnum < 0.6 THEN 'noise' END, CASE WHEN short > 0.4 THEN 'broken_words' END], lambda x: x IS NOT NULL) AS reasons, NOT (words < 5 OR alnum < 0.6 OR short > 0.4) AS usable FROM q""".replace("\\\\s", "\\s"))
def readout_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "image_regions").where("text is not null").select("region_key", quality.readout_quality(F.col("text")).alias("q")).select("region_key", "q.*")


@query("reassembled_pages", "SELECT file_key, string_agg(text, chr(10) || chr(10) ORDER BY page_num, page_key) AS text FROM extracted_pages WHERE text IS NOT NULL GROUP BY file_key")
def reassembled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "extracted_pages").where("text is not null")
    whole = F.array_sort(F.collect_list(F.struct("page_num", "page_key", "text")))
    return pages.groupBy("file_key").agg(F.array_join(F.transform(whole, lambda p: p["text"]), "\n\n").alias("text"))


@query("image_texts", "SELECT i.image_key, count(r.region_key) AS regions, min(bbox_x) AS left_edge, max(bbox_x + bbox_w) AS right_edge, coalesce(bool_or(needs_vision_enrichment), false) AS needs_vision FROM extracted_images i LEFT JOIN image_regions r USING (image_key) GROUP BY i.image_key")
def image_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "image_regions").groupBy("image_key").agg(
        F.count("region_key").alias("n"), F.min("bbox_x").alias("left_edge"), F.max(F.col("bbox_x") + F.col("bbox_w")).alias("right_edge"), F.bool_or("needs_vision_enrichment").alias("v")
    )
    images = table(spark, sf_dir, "extracted_images").select("image_key").join(regions, "image_key", "left")
    return images.select("image_key", F.coalesce("n", F.lit(0)).alias("regions"), "left_edge", "right_edge", F.coalesce("v", F.lit(False)).alias("needs_vision"))


@query("image_regions_in_order", "SELECT region_key, CAST(row_number() OVER (PARTITION BY image_key ORDER BY (region_role <> 'heading') NULLS LAST, region_index, region_key) - 1 AS BIGINT) AS place FROM image_regions")
def image_regions_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [(F.col("region_role") != "heading").asc_nulls_last(), F.col("region_index").asc_nulls_last(), F.col("region_key")]
    return table(spark, sf_dir, "image_regions").select("region_key", (F.row_number().over(W.partitionBy("image_key").orderBy(*order)).cast("bigint") - 1).alias("place"))


@query("csv_fields", r"SELECT doc_id, regexp_extract(text, 'Total=([^|\n]*?) \|', 1) AS total FROM documents WHERE contains(text, 'CSV row 1: ') AND regexp_extract(text, 'Total=([^|\n]*?) \|', 1) <> ''")
def csv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).where(F.contains("text", F.lit("CSV row 1: ")))
    return rows.select("doc_id", F.regexp_extract("text", r"Total=([^|\n]*?) \|", 1).alias("total")).where("total <> ''")


@query("label_values", r"SELECT doc_id, len(regexp_extract_all(text, '(?m)^([A-Z][A-Za-z ]{1,30}): ', 1)) AS pairs FROM documents WHERE regexp_matches(text, '(?m)^[A-Z][A-Za-z ]{1,30}: ')")
def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.size(F.regexp_extract_all("text", F.lit(r"(?m)^([A-Z][A-Za-z ]{1,30}): "), F.lit(1))).cast("bigint")
    return _docs(spark, sf_dir).select("doc_id", pairs.alias("pairs")).where("pairs > 0")
