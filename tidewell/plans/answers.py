"""Queries on the way from a question to an answer: traits of questions, evidence in texts, excerpts, images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import questions, texts
from tidewell.operators import images, ranked, rerank
from tidewell.plans.registry import query
from tidewell.plans.retrieval import FUSED, FUSED_TOP, NEAR, TERMS, WORDS, _near, _with_documents, _words
from tidewell.session import table

ASKED = "when did the audit committee approve the lease renewal"
WORD_SQL = "list_distinct(regexp_extract_all(lower({t}), '([a-z0-9]{{3,}})', 1))"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items")


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def _kinds(kinds: tuple[tuple[str, str], ...], text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{_sql(p)}') THEN '{k}'" for k, p in kinds)


TOLD = f"WITH {NEAR}, told AS (SELECT n.*, d.text, d.source FROM near n JOIN documents d ON d.doc_id = n.id)"


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_documents(spark, sf_dir, _near(spark, sf_dir, 0, 60)).withColumn("silo", F.col("silo").cast("string"))


@query("question_traits", f"SELECT item_id, regexp_matches(lower(query), '{questions.RECENT}') AS recent, regexp_matches(lower(query), '{questions.SPEED}') AS speed, regexp_matches(lower(query), '{questions.SLIDES}') AS slides FROM eval_items WHERE query IS NOT NULL")
def question_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("query")
    return _items(spark, sf_dir).where("query is not null").select("item_id", questions.has(q, questions.RECENT).alias("recent"), questions.has(q, questions.SPEED).alias("speed"), questions.has(q, questions.SLIDES).alias("slides"))


@query("line_traits", rf"""WITH l AS (SELECT doc_id, lower(unnest(string_split(text, chr(10)))) AS line FROM documents), t AS (SELECT doc_id, regexp_matches(line, '{questions.FILE_NOUN}') AS f, regexp_matches(line, '{questions.DATED}') AS d, regexp_matches(line, '{questions.SPOKEN}') AS s FROM l)
  SELECT doc_id, count(*) FILTER (f) AS files, count(*) FILTER (d) AS dated, count(*) FILTER (s) AS spoken, count(*) FILTER (f AND NOT s) AS file_lines FROM t GROUP BY doc_id""")
def line_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of a text name files, name dates, or tell what somebody said: the traits of a search for dated files."""
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    f, d, s = (questions.has(F.col("line"), p) for p in (questions.FILE_NOUN, questions.DATED, questions.SPOKEN))
    return lines.groupBy("doc_id").agg(F.count_if(f).alias("files"), F.count_if(d).alias("dated"), F.count_if(s).alias("spoken"), F.count_if(f & ~s).alias("file_lines"))


SYNONYM_SQL = ", ".join(f"CASE WHEN list_contains(regexp_split_to_array(lower(trim(query)), '\\s+'), '{w}') THEN '{s}' END" for w, s in questions.SYNONYMS.items())


@query("expanded_questions", f"SELECT item_id, concat_ws(' ', trim(query), nullif(array_to_string(list_filter([{SYNONYM_SQL}], lambda x: x IS NOT NULL), ' '), '')) AS query FROM eval_items WHERE query IS NOT NULL")
def expanded_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).where("query is not null").select("item_id", questions.expanded(F.col("query")).alias("query"))


@query("content_kinds", f"SELECT doc_id, {_kinds(questions.CONTENT_KINDS, 'substr(text, 1, 500)')} ELSE 'other' END AS kind FROM documents WHERE text IS NOT NULL")
def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", questions.content_kind(F.col("text")).alias("kind"))


YEARS = "list_filter(regexp_split_to_array({c}, '[^0-9]+'), lambda x: regexp_matches(x, '^20[0-9][0-9]$'))"


@query("year_of_text", f"""WITH t AS (SELECT t.text_key, regexp_extract(f.path, '([^/]*)$', 1) AS b, f.path, t.text FROM extracted_texts t JOIN files f USING (file_key))
  SELECT text_key, CAST(coalesce({YEARS.format(c='b')}[1], {YEARS.format(c='path')}[-1], {YEARS.format(c='text')}[1]) AS INTEGER) AS year FROM t""")
def year_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year of a text by its file's name, else its path, else what it says."""
    both = table(spark, sf_dir, "extracted_texts").select("text_key", "file_key", "text").join(table(spark, sf_dir, "files").select("file_key", "path"), "file_key")
    return both.select("text_key", questions.year_of(F.col("path"), F.col("text")).alias("year"))


@query("fact_kinds", f"SELECT source, kind, count(*) AS n FROM (SELECT source, {_kinds(questions.FACT_KINDS, 'lower(text)')} END AS kind FROM documents) WHERE kind IS NOT NULL GROUP BY 1, 2")
def fact_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of a source speak of risks, segments, guidance or metrics; the first kind that fits counts."""
    return _docs(spark, sf_dir).select("source", questions.first_kind(F.lower("text"), questions.FACT_KINDS).alias("kind")).where("kind is not null").groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("fact_input", f"""WITH r AS (SELECT doc_id, source, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS used, {_kinds(questions.FACT_KINDS, 'lower(text)')} END AS kind FROM documents WHERE trim(text) <> ''),
  k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM r WHERE used <= 180000 AND kind IS NOT NULL) SELECT source, doc_id, kind FROM k WHERE n <= 80""")
def fact_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a compiler of facts reads of each source: texts in order up to 180,000 characters, 80 facts at most."""
    order = W.partitionBy("source").orderBy("doc_id")
    rows = _docs(spark, sf_dir).where(F.trim("text") != "").select("source", "doc_id", F.sum(F.length("text")).over(order).alias("used"), questions.first_kind(F.lower("text"), questions.FACT_KINDS).alias("kind"))
    kept = rows.where("used <= 180000 and kind is not null").withColumn("n", F.row_number().over(order))
    return kept.where("n <= 80").select("source", "doc_id", "kind")


@query("retrieval_breakdown", TOLD + """, s AS (SELECT 'source' AS part, source AS name, count(*) AS rows, min(dist) AS best FROM told GROUP BY source ORDER BY rows DESC, name LIMIT 12)
  SELECT 'silo' AS part, CAST(silo AS VARCHAR) AS name, count(*) AS rows, min(dist) AS best FROM told GROUP BY silo UNION ALL SELECT * FROM s""")
def retrieval_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.breakdown(_told(spark, sf_dir))


@query("chunks_by_silo", TOLD + " SELECT CAST(silo AS VARCHAR) AS silo, min(pos) AS first_pos, list(id ORDER BY pos) AS ids FROM told GROUP BY silo")
def chunks_by_silo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result of 60 rows grouped by silo, in order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
    return _told(spark, sf_dir).groupBy("silo").agg(F.min("pos").alias("first_pos"), ids.alias("ids"))


@query("any_overlap", TOLD + f" SELECT bool_or(len(list_intersect({WORD_SQL.format(t=chr(39) + ASKED + chr(39))}, {WORD_SQL.format(t='text')})) > 0) AS overlaps, count(*) AS texts FROM told WHERE pos < 16")
def any_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any of the first sixteen texts shares a word with the question."""
    head = _told(spark, sf_dir).where("pos < 16")
    return head.agg(F.bool_or(F.arrays_overlap(texts.words(F.lit(ASKED)), texts.words(F.col("text")))).alias("overlaps"), F.count(F.lit(1)).alias("texts"))


@query("rerank_lexical", TOLD + f""", s AS (SELECT id, pos, len(list_intersect({WORD_SQL.format(t=chr(39) + ASKED + chr(39))}, {WORD_SQL.format(t='text')})) / len({WORD_SQL.format(t=chr(39) + ASKED + chr(39))})::DOUBLE AS score FROM told)
  SELECT id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, s.pos) - 1 AS BIGINT) AS pos FROM s QUALIFY row_number() OVER (ORDER BY score DESC, s.pos) <= 12""")
def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.by_scorer(_told(spark, sf_dir), ASKED, 12).select("id", F.round("score", 6).alias("score"), "pos")


@query("source_priority", TOLD + """, s AS (SELECT id, dist, pos, CASE WHEN contains(lower(source), 'garden') THEN 10 ELSE 0 END - CASE WHEN contains(lower(source), 'old') THEN 5 ELSE 0 END AS score FROM told)
  SELECT id, CAST(row_number() OVER (ORDER BY score DESC, dist, pos) - 1 AS BIGINT) AS pos FROM s""")
def source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.by_source_priority(_told(spark, sf_dir), 60, ["garden"], ["old"]).select("id", "pos")


@query("explain_retrieval", f"WITH {NEAR}, {WORDS}, {FUSED}, {FUSED_TOP} SELECT CASE WHEN vector_rank IS NULL THEN 'words' WHEN lexical_rank IS NULL THEN 'vector' ELSE 'both' END AS signal, count(*) AS rows, min(pos) AS first_pos FROM top GROUP BY 1")
def explain_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By which signals the rows of a fused result came in."""
    fused = ranked.reciprocal_rank(_near(spark, sf_dir, 0, 60), _words(spark, sf_dir, TERMS), 60)
    signal = F.when(F.col("vector_rank").isNull(), "words").when(F.col("lexical_rank").isNull(), "vector").otherwise("both")
    return fused.groupBy(signal.alias("signal")).agg(F.count(F.lit(1)).alias("rows"), F.min("pos").alias("first_pos"))


DEPTHS = " UNION ALL ".join(f"SELECT '{n}' AS intent, {s} AS per_source, {k} AS per_silo, {questions.stage_one_rows(12)} AS stage_one, {questions.fan_out_rows(questions.stage_one_rows(12))} AS fan_out" for n, s, k in questions.CAPS)


@query("retrieval_depths", DEPTHS)
def retrieval_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each kind of question takes of a source and a silo, before ranking, and of each candidate silo."""
    one = questions.stage_one_rows(12)
    caps = F.explode(F.array(*[F.struct(F.lit(n).alias("intent"), F.lit(s).alias("per_source"), F.lit(k).alias("per_silo")) for n, s, k in questions.CAPS]))
    return spark.range(1).select(caps.alias("c")).select("c.*", F.lit(one).alias("stage_one"), F.lit(questions.fan_out_rows(one)).alias("fan_out"))


@query("capabilities", "SELECT unnest(['csv', 'db', 'docx', 'htm', 'html', 'pptx', 'sqlite', 'xlsx', 'zip']) AS extension")
def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extensions with an extractor of their own; everything else is read as plain text."""
    from tidewell.sources.extract import EXTRACTORS

    return spark.range(1).select(F.explode(F.array(*[F.lit(e) for e in sorted([*EXTRACTORS, "zip"])])).alias("extension"))


@query("scope_candidates", """WITH r AS (SELECT slug, 0 AS pad, 3 * CAST(contains(lower(display_name), 'garden') AS INTEGER) AS score FROM silos WHERE contains(lower(display_name), 'garden') UNION ALL SELECT slug, 1, 0 FROM silos WHERE NOT coalesce(contains(lower(display_name), 'garden'), false))
  SELECT slug, CAST(row_number() OVER (ORDER BY pad, score DESC, slug) - 1 AS BIGINT) AS pos FROM r QUALIFY pos < 5""")
def scope_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five silos a question may mean: those named in it, filled up in the order of their slugs."""
    named = F.coalesce(F.contains(F.lower("display_name"), F.lit("garden")), F.lit(False))
    silos = table(spark, sf_dir, "silos").select("slug", (~named).cast("int").alias("pad"))
    return ranked.top(silos, 5, "pad", "slug").select("slug", "pos")


@query("excerpts", "SELECT doc_id, left(array_to_string(list_slice(string_split(text, chr(10)), 1, 40), chr(10)), 4000) AS excerpt, len(string_split(text, chr(10))) > 40 OR length(text) > 4000 AS cut FROM documents WHERE text IS NOT NULL")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of a text: forty lines and 4,000 characters at most."""
    lines = F.split("text", "\n", -1)
    return _docs(spark, sf_dir).select("doc_id", F.substring(F.array_join(F.slice(lines, 1, 40), "\n"), 1, 4000).alias("excerpt"), ((F.size(lines) > 40) | (F.length("text") > 4000)).alias("cut"))


@query("snippets", r"SELECT doc_id, CASE WHEN length(s) > 120 THEN rtrim(left(s, 117)) || '...' ELSE s END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents WHERE text IS NOT NULL)")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    short = _docs(spark, sf_dir).select("doc_id", flat.alias("s"))
    return short.select("doc_id", F.when(F.length("s") > 120, F.concat(F.rtrim(F.substring("s", 1, 117)), F.lit("..."))).otherwise(F.col("s")).alias("snippet"))


@query("merged_pages", r"SELECT page_key, left(concat_ws(chr(10), nullif(trim(source), ''), nullif(trim(text), '')), 6000) AS merged FROM extracted_pages")
def merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a page that are there, joined by line ends, 6,000 characters at most."""
    part = lambda c: F.nullif(F.btrim(F.col(c), F.lit(" ")), F.lit(""))
    return table(spark, sf_dir, "extracted_pages").select("page_key", F.substring(F.concat_ws("\n", part("source"), part("text")), 1, 6000).alias("merged"))


@query("file_roster", "WITH r AS (SELECT silo, path, row_number() OVER (PARTITION BY silo ORDER BY path) AS n FROM (SELECT DISTINCT silo, path FROM files WHERE path IS NOT NULL)) SELECT silo, count(*) AS files, string_agg(path, chr(10) ORDER BY path) FILTER (n <= 20) AS roster FROM r GROUP BY silo")
def file_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty paths of each silo as a text, and how many there are."""
    each = table(spark, sf_dir, "files").where("path is not null").select("silo", "path").distinct().withColumn("n", F.row_number().over(W.partitionBy("silo").orderBy("path")))
    return each.groupBy("silo").agg(F.count(F.lit(1)).alias("files"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") <= 20, F.col("path")))), "\n").alias("roster"))


NEGATED = questions.NEGATION.replace("'", "''")


@query("negated_sentences", rf"WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]')) AS sentence FROM documents) SELECT doc_id, count(*) AS sentences, count(*) FILTER (regexp_matches(sentence, '{NEGATED}')) AS negated FROM s GROUP BY doc_id")
def negated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of a text and those that deny something."""
    found = F.regexp_extract_all("text", F.lit(r"([^.!?\n]+[.!?])"), F.lit(1))
    told = _docs(spark, sf_dir).select("doc_id", F.size(found).cast("bigint").alias("sentences"), F.size(F.filter(found, lambda s: F.regexp_like(s, F.lit(questions.NEGATION)))).cast("bigint").alias("negated"))
    return told.where("sentences > 0")


PAIR = r"(?m)^([A-Z][A-Za-z ]{1,30}): (.+)$"


@query("label_pairs", rf"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '{PAIR}', 1)) AS label, unnest(regexp_extract_all(text, '{PAIR}', 2)) AS value FROM documents)
  SELECT doc_id, label, value, len(list_intersect(['employer', 'name', 'total', 'wages'], {WORD_SQL.format(t='label')})) AS shared FROM p""")
def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 'label: value' line of a text, and how many words of the question its label has."""
    zipped = F.arrays_zip(F.regexp_extract_all("text", F.lit(PAIR), F.lit(1)).alias("label"), F.regexp_extract_all("text", F.lit(PAIR), F.lit(2)).alias("value"))
    asked = F.array(*[F.lit(w) for w in ("employer", "name", "total", "wages")])
    each = _docs(spark, sf_dir).select("doc_id", F.explode(zipped).alias("p")).select("doc_id", "p.*")
    return each.withColumn("shared", F.size(F.array_intersect(asked, texts.words(F.col("label")))).cast("bigint"))


TERM, CREDITS = r"\b((?:Spring|Summer|Fall|Autumn|Winter) \d{4})\b", r"(\d\.\d{2})$"


@query("carried_terms", rf"""WITH l AS (SELECT doc_id, i, trim(string_split(text, chr(10))[i]) AS line FROM documents, range(1, len(string_split(text, chr(10))) + 1) r(i)),
  m AS (SELECT *, nullif(regexp_extract(line, '{TERM}', 1), '') AS t, nullif(regexp_extract(line, '{CREDITS}', 1), '') AS c FROM l)
  SELECT doc_id, CAST(i AS BIGINT) AS line_no, last_value(t IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS term, first_value(c IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS next_credits FROM m""")
def carried_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each line of a text, as of a transcript, the last term named, and the first credits within the next four lines."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    told = lines.select("doc_id", (F.col("at") + 1).cast("bigint").alias("line_no"), F.nullif(F.regexp_extract(F.btrim(F.col("line"), F.lit(" ")), TERM, 1), F.lit("")).alias("t"), F.nullif(F.regexp_extract(F.btrim(F.col("line"), F.lit(" ")), CREDITS, 1), F.lit("")).alias("c"))
    order = W.partitionBy("doc_id").orderBy("line_no")
    return told.select("doc_id", "line_no", F.last("t", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("term"), F.first("c", ignorenulls=True).over(order.rowsBetween(1, 4)).alias("next_credits"))


@query("image_hits", """WITH h AS (SELECT image_key, round((image_key % 89) / 89.0::DOUBLE, 6) AS dist FROM extracted_images ORDER BY dist, image_key LIMIT 30),
  t AS (SELECT image_key, region_key AS id, round((region_key % 97) / 97.0::DOUBLE, 6) AS dist, row_number() OVER (PARTITION BY image_key ORDER BY region_index, region_key) AS n FROM image_regions)
  SELECT image_key, id, (h.dist + t.dist) / 2 AS dist FROM h JOIN t USING (image_key) WHERE n <= 2""")
def image_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty nearest images with two texts each; distances stand in for those of an index."""
    hits = table(spark, sf_dir, "extracted_images").select("image_key", F.round((F.col("image_key") % 89) / F.lit(89.0), 6).alias("dist")).orderBy("dist", "image_key").limit(30)
    parts = table(spark, sf_dir, "image_regions").select("image_key", F.col("region_key").alias("id"), F.round((F.col("region_key") % 97) / F.lit(97.0), 6).alias("dist"), F.col("region_index").alias("place"))
    return images.with_parents(hits, parts, "image_key")


@query("images_first", f"WITH {NEAR}, i AS (SELECT image_key AS id, round((image_key % 89) / 89.0::DOUBLE, 6) AS dist FROM extracted_images ORDER BY dist, id LIMIT 5), u AS (SELECT id, dist, 0 AS stream FROM i UNION ALL SELECT id, dist, 1 FROM near) SELECT id, stream, dist, CAST(row_number() OVER (ORDER BY stream, dist, id) - 1 AS BIGINT) AS pos FROM u")
def images_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five image hits before the hits of texts."""
    hits = table(spark, sf_dir, "extracted_images").select(F.col("image_key").alias("id"), F.round((F.col("image_key") % 89) / F.lit(89.0), 6).alias("dist")).orderBy("dist", "id").limit(5).withColumn("stream", F.lit(0))
    both = hits.unionByName(_near(spark, sf_dir, 0, 60).select("id", "dist", F.lit(1).alias("stream")))
    return ranked.with_pos(both, "stream", "dist", "id").select("id", "stream", "dist", "pos")


OBSERVED = "SELECT image_key, bbox_x AS x, bbox_y AS y, bbox_w AS w, bbox_h AS h, region_key AS key, trim(text) AS text FROM image_regions WHERE trim(text) <> '' AND bbox_x IS NOT NULL AND bbox_y IS NOT NULL AND bbox_w IS NOT NULL AND bbox_h IS NOT NULL"
BANDS = f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY image_key ORDER BY y DESC, x, y, w, h, text, key) AS i FROM ({OBSERVED})),
  b AS (SELECT image_key, greatest(0.012, list_extract(list_sort(list(h)), CAST(floor(count(*) / 2) AS INTEGER) + 1) * 0.7) AS band FROM o GROUP BY image_key),
  f AS (SELECT o.image_key, o.i, 1 AS row, o.y AS head FROM o WHERE i = 1 UNION ALL SELECT o.image_key, o.i, CASE WHEN abs(o.y - f.head) > b.band THEN f.row + 1 ELSE f.row END, CASE WHEN abs(o.y - f.head) > b.band THEN o.y ELSE f.head END FROM f JOIN o ON o.image_key = f.image_key AND o.i = f.i + 1 JOIN b ON b.image_key = o.image_key),
  r AS (SELECT image_key, row, string_agg(text, ' ' ORDER BY x, key) AS text, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM f JOIN o USING (image_key, i) GROUP BY image_key, row)"""


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = {"x": "bbox_x", "y": "bbox_y", "w": "bbox_w", "h": "bbox_h"}
    rows = table(spark, sf_dir, "image_regions").where(" and ".join(f"{c} is not null" for c in boxes.values()))
    return rows.select("image_key", *[F.col(c).alias(k) for k, c in boxes.items()], F.col("region_key").alias("key"), F.trim("text").alias("text"))


@query("region_rows", BANDS + " SELECT image_key, CAST(row AS INTEGER) AS row, text, x0, y0 FROM r")
def region_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.row_bands(_observed(spark, sf_dir), "image_key").select("image_key", "row", "text", "x0", "y0")


@query("region_blocks", BANDS + """, p AS (SELECT *, lag(x0) OVER w AS ax0, lag(y0) OVER w AS ay0, lag(x1) OVER w AS ax1, lag(y1) OVER w AS ay1 FROM r WINDOW w AS (PARTITION BY image_key ORDER BY row)),
  n AS (SELECT *, CASE WHEN ay0 - y1 <= greatest(0.03, greatest(ay1 - ay0, y1 - y0) * 1.6) AND ((least(ax1, x1) - greatest(ax0, x0)) / greatest(0.0001, least(ax1 - ax0, x1 - x0)) >= 0.18 OR abs(ax0 - x0) <= 0.08) THEN 0 ELSE 1 END AS new FROM p),
  k AS (SELECT *, sum(new) OVER (PARTITION BY image_key ORDER BY row) AS block FROM n) SELECT image_key, CAST(block AS BIGINT) AS block, count(*) AS rows, string_agg(text, chr(10) ORDER BY row) AS text FROM k GROUP BY image_key, block""")
def region_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images.row_bands(_observed(spark, sf_dir), "image_key")
    return images.blocks(rows, "image_key").select("image_key", "block", "rows", "text")


@query("chunks_of_type", "SELECT doc_type, count(DISTINCT id) AS chunks, count(DISTINCT source) AS sources FROM chunks WHERE content_extracted = 1 GROUP BY doc_type")
def chunks_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").where("content_extracted = 1").groupBy("doc_type").agg(F.count_distinct("id").alias("chunks"), F.count_distinct("source").alias("sources"))


@query("byte_labels", "SELECT file_key, CASE WHEN size >= 1073741824 THEN format('{:,.1f} GiB', size / 1073741824.0) WHEN size >= 1048576 THEN format('{:,.1f} MiB', size / 1048576.0) WHEN size >= 1024 THEN format('{:,.1f} KiB', size / 1024.0) ELSE size || ' B' END AS label FROM files WHERE size IS NOT NULL")
def byte_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").where("size is not null").select("file_key", questions.bytes_label(F.col("size")).alias("label"))


@query("image_summaries", "SELECT i.image_key, coalesce(nullif(trim(i.summary), ''), nullif(trim(i.visible_text), ''), r.t, '(no text)') AS summary FROM extracted_images i LEFT JOIN (SELECT image_key, string_agg(trim(text), chr(10) ORDER BY region_index, region_key) AS t FROM image_regions WHERE trim(text) <> '' GROUP BY image_key) r USING (image_key)")
def image_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for an image: its summary, else its visible text, else the texts of its regions in order."""
    part = F.array_sort(F.collect_list(F.struct(F.coalesce("region_index", F.lit(2**31 - 1)).alias("at"), "region_key", F.btrim(F.col("text"), F.lit(" ")).alias("t"))))
    regions = table(spark, sf_dir, "image_regions").where(F.btrim(F.col("text"), F.lit(" ")) != "").groupBy("image_key").agg(F.array_join(F.transform(part, lambda x: x["t"]), "\n").alias("regions"))
    there = lambda c: F.nullif(F.btrim(F.col(c), F.lit(" ")), F.lit(""))
    return table(spark, sf_dir, "extracted_images").join(regions, "image_key", "left").select("image_key", F.coalesce(there("summary"), there("visible_text"), "regions", F.lit("(no text)")).alias("summary"))


THEMES = {"storage": ("load", "store", "cache", "index"), "parsing": ("parse", "token", "scan", "read"), "tests": ("test", "assert", "mock"), "network": ("socket", "request", "http", "packet")}


@query("activity_themes", "SELECT silo, " + ", ".join("bool_or(" + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f") AS {t}" for t, ws in THEMES.items()) + ", count(*) AS texts FROM extracted_texts WHERE text IS NOT NULL GROUP BY silo")
def activity_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which themes the texts of a silo touch: any word of a theme in any text."""
    rows = table(spark, sf_dir, "extracted_texts").where("text is not null")
    touched = {t: F.bool_or(ranked.any_term("low", list(ws))) for t, ws in THEMES.items()}
    return rows.withColumn("low", F.lower("text")).groupBy("silo").agg(*[c.alias(t) for t, c in touched.items()], F.count(F.lit(1)).alias("texts"))


@query("table_markdown", r"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^CSV row (\d+): .*$', 1)) AS n, unnest(regexp_extract_all(text, '(?m)^CSV row \d+: (.*)$', 1)) AS body FROM documents)
  SELECT doc_id, CAST(n AS INTEGER) AS row_no, '| ' || array_to_string(list_transform(string_split(body, ' | '), lambda c: trim(regexp_replace(c, '^[^=]*=', ''))), ' | ') || ' |' AS line FROM r GROUP BY ALL""".replace("\\\\", "\\"))
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables read out as 'name=value | …' as rows of a Markdown table, each of a text once."""
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(r"(?m)^CSV row (\d+): .*$"), F.lit(1)).alias("n"), F.regexp_extract_all("text", F.lit(r"(?m)^CSV row \d+: (.*)$"), F.lit(1)).alias("body"))
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(found).alias("r"))
    cells = F.transform(F.split("r.body", r" \| ", -1), lambda c: F.btrim(F.regexp_replace(c, "^[^=]*=", ""), F.lit(" ")))
    return rows.select("doc_id", F.col("r.n").cast("int").alias("row_no"), F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")).alias("line")).distinct()
