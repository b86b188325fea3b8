"""Upkeep of a library: applied changes, merged states, indexes, counts, reports of what does not fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import questions, texts
from tidewell.operators import catalog, ingest
from tidewell.operators.ranked import fallback_filter
from tidewell.plans.catalogue import AT, CODE_LIST, CONTENT, EXT, _content
from tidewell.plans.registry import query
from tidewell.session import table

BASE = "regexp_extract(path, '([^/]*)$', 1)"
ROOT = r"rtrim(regexp_replace(trim(path), '/+', '/', 'g'), '/')"
BUCKET = "CASE " + " ".join(f"WHEN {EXT} = '{e}' THEN '{b}'" for e, b in questions.BUCKETS.items()) + " WHEN " + EXT + " IN (" + ", ".join(f"'{c}'" for c in questions.CODE) + ") THEN 'code' ELSE 'other' END"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files")


def _silos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "silos")


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.rtrim(F.regexp_replace(F.trim("path"), "/+", "/"), F.lit("/"))
    return _silos(spark, sf_dir).where("path is not null").select("slug", root.alias("root"))


@query("applied_changes", "SELECT silo, path, file_key, hash FROM files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY silo, path ORDER BY batch_no DESC NULLS LAST, file_key DESC) = 1")
def applied_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest after all batches have been applied in order: the last row of each path counts."""
    rows = _files(spark, sf_dir).where("path is not null").select("silo", "path", "file_key", "hash", "batch_no")
    return ingest.latest(rows, ["silo", "path"], [F.col("batch_no").desc_nulls_last(), F.desc("file_key")]).select("silo", "path", "file_key", "hash")


@query("removed_and_kept", """WITH gone AS (SELECT DISTINCT silo, path FROM files WHERE batch_no = 9) SELECT c.id, min(c.file_key) AS file_key FROM chunks c JOIN files f USING (file_key) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.silo = f.silo AND g.path = f.path) GROUP BY c.id""")
def removed_and_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that stay when the files of the last batch are removed, each id once."""
    files = _files(spark, sf_dir)
    chunks = table(spark, sf_dir, "chunks").select("id", "file_key").join(files.select("file_key", "silo", "path"), "file_key")
    return ingest.without(chunks, files.where("batch_no = 9").select("silo", "path"), ["silo", "path"]).groupBy("id").agg(F.min("file_key").alias("file_key"))


@query("cloned_chunks", f"""WITH f AS (SELECT *, {CONTENT} AS content FROM files WHERE coalesce(trim(hash), '') <> ''), o AS (SELECT content, min(file_key) AS owner FROM f GROUP BY 1),
  t AS (SELECT DISTINCT f.silo, o.owner FROM f JOIN o USING (content) JOIN files g ON g.file_key = o.owner WHERE f.silo <> g.silo)
  SELECT t.silo, c.id FROM t JOIN (SELECT DISTINCT id, file_key FROM chunks) c ON c.file_key = t.owner""")
def cloned_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks another silo gets without reading its file, as a file of the same content is there already."""
    files = _files(spark, sf_dir).where(F.coalesce(F.trim("hash"), F.lit("")) != "").select("file_key", "silo", _content().alias("content"))
    owner = files.groupBy("content").agg(F.min(F.struct("file_key", "silo")).alias("o")).select("content", F.col("o.file_key").alias("owner"), F.col("o.silo").alias("owner_silo"))
    wanted = files.join(owner, "content").where(F.col("silo") != F.col("owner_silo")).select("silo", F.col("owner").alias("file_key")).distinct()
    return wanted.join(table(spark, sf_dir, "chunks").select("id", "file_key").distinct(), "file_key").select("silo", "id")


@query("merged_silos", """WITH a AS (SELECT slug, display_name, files_indexed FROM silos WHERE length(slug) % 2 = 0), b AS (SELECT silo AS slug, count(*) AS n FROM files WHERE silo IS NOT NULL GROUP BY silo)
  SELECT slug, display_name, coalesce(n, files_indexed) AS files_indexed FROM a FULL OUTER JOIN b USING (slug)""")
def merged_silos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows updated by new counts: known fields stay, unknown silos are added."""
    old = _silos(spark, sf_dir).where(F.length("slug") % 2 == 0).select("slug", "display_name", "files_indexed")
    new = _files(spark, sf_dir).where("silo is not null").groupBy(F.col("silo").alias("slug")).agg(F.count(F.lit(1)).alias("files_indexed"))
    return ingest.upserted(old, new, ["slug"])


@query("silo_counts", "SELECT slug, coalesce(f.n, 0) AS files, coalesce(c.n, 0) AS chunks FROM silos LEFT JOIN (SELECT silo, count(DISTINCT path) AS n FROM files GROUP BY silo) f ON f.silo = slug LEFT JOIN (SELECT silo, count(DISTINCT id) AS n FROM chunks GROUP BY silo) c ON c.silo = slug")
def silo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).groupBy(F.col("silo").alias("slug")).agg(F.count_distinct("path").alias("f"))
    chunks = table(spark, sf_dir, "chunks").groupBy(F.col("silo").alias("slug")).agg(F.count_distinct("id").alias("c"))
    both = _silos(spark, sf_dir).select("slug").join(files, "slug", "left").join(chunks, "slug", "left")
    return both.select("slug", F.coalesce("f", F.lit(0)).alias("files"), F.coalesce("c", F.lit(0)).alias("chunks"))


DIGEST = """(SELECT silo, sha256(string_agg(digest, '' ORDER BY part)) AS {n} FROM (SELECT silo, part, sha256(string_agg(chunk_hash, '' ORDER BY chunk_hash)) AS digest
  FROM (SELECT DISTINCT silo, chunk_hash, substr(chunk_hash, 1, 3) AS part FROM chunks WHERE chunk_hash IS NOT NULL AND {w}) GROUP BY silo, part) GROUP BY silo)"""


@query("content_digest", "SELECT silo, digest FROM " + DIGEST.format(n="digest", w="true"))
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free fingerprint of a silo's contents by a tree of hashes: no task holds more than a part of 4,096."""
    return ingest.digest(table(spark, sf_dir, "chunks"), "silo", "chunk_hash")


@query("silos_to_compile", "SELECT b.silo FROM " + DIGEST.format(n="new", w="true") + " b LEFT JOIN " + DIGEST.format(n="old", w="file_key IN (SELECT file_key FROM files WHERE batch_no <= 8)") + " a ON a.silo = b.silo WHERE a.old IS DISTINCT FROM b.new")
def silos_to_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silos whose derived rows must be written anew, as their contents changed with the last batch."""
    chunks = table(spark, sf_dir, "chunks")
    before = chunks.join(_files(spark, sf_dir).where("batch_no <= 8").select("file_key").distinct(), "file_key", "left_semi")
    old, new = ingest.digest(before, "silo", "chunk_hash"), ingest.digest(chunks, "silo", "chunk_hash")
    both = new.join(old.withColumnRenamed("digest", "old"), "silo", "left")
    return both.where(~F.col("digest").eqNullSafe(F.col("old"))).select("silo")


@query("hash_index", f"SELECT {CONTENT} AS content, silo, path FROM files WHERE coalesce(trim(hash), '') <> '' AND path IS NOT NULL GROUP BY ALL")
def hash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted index of contents, one row for each place that holds them: no list grows with a frequent content."""
    return _files(spark, sf_dir).where((F.coalesce(F.trim("hash"), F.lit("")) != "") & F.col("path").isNotNull()).select(_content().alias("content"), "silo", "path").distinct()


@query("doc_type_buckets", f"SELECT silo, {BUCKET} AS bucket, count(DISTINCT path) AS files FROM files WHERE path IS NOT NULL GROUP BY 1, 2")
def doc_type_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where("path is not null").groupBy("silo", questions.bucket(texts.extension("path")).alias("bucket")).agg(F.count_distinct("path").alias("files"))


@query("merged_language_stats", f"SELECT ext, CAST(sum(n) AS BIGINT) AS sources FROM (SELECT silo, {EXT.replace('path', 'source')} AS ext, count(DISTINCT source) AS n FROM chunks GROUP BY 1, 2) WHERE ext IN ({CODE_LIST}) GROUP BY ext")
def merged_language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of sources by extension, one a silo, merged by sums."""
    counts = table(spark, sf_dir, "chunks").groupBy("silo", texts.extension("source").alias("ext")).agg(F.count_distinct("source").alias("n")).where(F.col("ext").isin(*texts.CODE))
    maps = counts.groupBy("silo").agg(F.map_from_entries(F.collect_list(F.struct("ext", "n"))).alias("stats"))
    return maps.select(F.explode("stats").alias("ext", "n")).groupBy("ext").agg(F.sum("n").alias("sources"))


@query("code_languages_of_year", f"WITH r AS (SELECT ext, path, row_number() OVER (PARTITION BY ext ORDER BY path) AS n FROM (SELECT DISTINCT {EXT} AS ext, path FROM files WHERE year({AT}) = 2015) WHERE ext IN ({CODE_LIST})) SELECT ext, count(*) AS sources, list(path ORDER BY path) FILTER (n <= 3) AS samples FROM r GROUP BY ext")
def code_languages_of_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _files(spark, sf_dir).where(F.year(catalog.modified()) == 2015).select(texts.extension("path").alias("ext"), "path").where(F.col("ext").isin(*texts.CODE)).distinct()
    told = seen.withColumn("n", F.row_number().over(W.partitionBy("ext").orderBy("path")))
    return told.groupBy("ext").agg(F.count(F.lit(1)).alias("sources"), F.sort_array(F.collect_list(F.when(F.col("n") <= 3, F.col("path")))).alias("samples"))


@query("code_sources_of_year", f"SELECT DISTINCT silo, path FROM files WHERE year({AT}) = 2015 AND {EXT} IN ({CODE_LIST}) ORDER BY silo, path LIMIT 50")
def code_sources_of_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _files(spark, sf_dir).where((F.year(catalog.modified()) == 2015) & texts.extension("path").isin(*texts.CODE))
    return kept.select("silo", "path").distinct().orderBy("silo", "path").limit(50)


@query("failures_by_silo", f"WITH s AS (SELECT slug, {ROOT} AS root FROM silos WHERE path IS NOT NULL) SELECT s.slug, count(f.file_key) AS failures, max(f.batch_no) AS last_batch FROM s LEFT JOIN files f ON starts_with(f.path, s.root || '/') AND coalesce(f.hash, '') = '' GROUP BY s.slug")
def failures_by_silo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures below the folder of each silo: every path meets its own ancestors by equality."""
    failed = _files(spark, sf_dir).where("coalesce(hash, '') = '' and path is not null").select("file_key", "batch_no", "path")
    roots = _roots(spark, sf_dir)
    hits = roots.join(ingest.ancestors(failed, "path", "root"), "root").groupBy("slug").agg(F.count("file_key").alias("n"), F.max("batch_no").alias("last_batch"))
    return roots.select("slug").join(hits, "slug", "left").select("slug", F.coalesce("n", F.lit(0)).alias("failures"), "last_batch")


@query("paths_in_silo", f"WITH s AS (SELECT slug, {ROOT} AS root FROM silos WHERE path IS NOT NULL) SELECT f.file_key, substr(f.path, length(s.root) + 2) AS relative FROM files f JOIN s ON s.slug = f.silo WHERE starts_with(f.path, s.root || '/')")
def paths_in_silo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths relative to the folder of their silo; a file outside of it has none."""
    both = _files(spark, sf_dir).select("file_key", "silo", "path").join(_roots(spark, sf_dir), F.col("silo") == F.col("slug"))
    inside = both.where(F.startswith("path", F.concat("root", F.lit("/"))))
    return inside.select("file_key", F.substring(F.col("path"), F.length("root") + 2, F.length("path")).alias("relative"))


@query("merged_states", "SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds, bool_or(event_type = 'error') AS failed, min(ts) AS since FROM events GROUP BY user_id")
def merged_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of one key merged: sets united, flags or-ed, the earliest start."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("kinds"), F.bool_or(F.col("event_type") == "error").alias("failed"), F.min("ts").alias("since"))


@query("query_health_retained", "SELECT event_id, user_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def query_health_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A health log keeps its last hundred errors."""
    return table(spark, sf_dir, "events").where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id", "ts")


@query("retry_schedule", """WITH e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events WHERE event_type = 'error')
  SELECT event_id, attempt, ts + to_seconds(CASE WHEN attempt = 1 THEN 30 WHEN attempt = 2 THEN 60 WHEN attempt = 3 THEN 120 ELSE 300 END) AS due FROM e""")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each failed attempt of a key is due again: after 30, 60, 120, then always 300 seconds."""
    errors = table(spark, sf_dir, "events").where("event_type = 'error'")
    told = errors.withColumn("attempt", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint"))
    return told.select("event_id", "attempt", (F.col("ts") + F.make_dt_interval(secs=ingest.back_off(F.col("attempt")))).alias("due"))


@query("merged_patterns", "SELECT pattern, count(*) AS silos FROM (SELECT DISTINCT slug, trim(unnest(exclude_patterns)) AS pattern FROM silos) WHERE pattern <> '' GROUP BY 1")
def merged_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusion patterns of all silos, blanks trimmed, each of a silo once."""
    each = _silos(spark, sf_dir).select("slug", F.explode(F.array_distinct(F.transform("exclude_patterns", lambda p: F.trim(p)))).alias("pattern"))
    return each.where("pattern <> ''").groupBy("pattern").agg(F.count(F.lit(1)).alias("silos"))


@query("files_with_silo_names", "SELECT f.file_key, coalesce(s.display_name, f.silo) AS name FROM files f LEFT JOIN silos s ON s.slug = f.silo")
def files_with_silo_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).join(_silos(spark, sf_dir).select(F.col("slug").alias("silo"), "display_name"), "silo", "left").select("file_key", F.coalesce("display_name", "silo").alias("name"))


@query("watch_coverage", """WITH a AS (SELECT slug FROM silos), b AS (SELECT DISTINCT silo AS slug FROM files WHERE batch_no = 9), c AS (SELECT DISTINCT source AS slug FROM documents WHERE batch_no = 9)
  SELECT slug, a.slug IS NOT NULL AS registered, b.slug IS NOT NULL AS indexed, c.slug IS NOT NULL AS watched FROM a FULL OUTER JOIN b USING (slug) FULL OUTER JOIN c USING (slug) WHERE slug IS NOT NULL""".replace("a.slug IS NOT NULL AS registered, b.slug IS NOT NULL AS indexed, c.slug IS NOT NULL AS watched", "slug IN (SELECT slug FROM a) AS registered, slug IN (SELECT slug FROM b WHERE slug IS NOT NULL) AS indexed, slug IN (SELECT slug FROM c WHERE slug IS NOT NULL) AS watched"))
def watch_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which silos are registered, had new files and had new documents in the last batch."""
    parts = {"registered": _silos(spark, sf_dir).select("slug"), "indexed": _files(spark, sf_dir).where("batch_no = 9").select(F.col("silo").alias("slug")), "watched": table(spark, sf_dir, "documents").where("batch_no = 9").select(F.col("source").alias("slug"))}
    tagged = [rows.where("slug is not null").distinct().select("slug", *[F.lit(k == name).alias(k) for k in parts]) for name, rows in parts.items()]
    both = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return both.groupBy("slug").agg(*[F.bool_or(k).alias(k) for k in parts])


@query("slug_hints", """WITH h AS (SELECT slug AS hint FROM silos UNION SELECT upper(slug) FROM silos UNION SELECT display_name FROM silos WHERE display_name IS NOT NULL UNION SELECT substr(slug, 1, 6) FROM silos),
  r AS (SELECT h.hint, s.slug, CASE WHEN s.slug = h.hint THEN 1 WHEN lower(s.slug) = lower(h.hint) THEN 2 WHEN s.display_name = h.hint THEN 3 ELSE 4 END AS rung FROM h JOIN silos s ON lower(s.slug) = lower(h.hint) OR s.display_name = h.hint OR starts_with(s.slug, h.hint)),
  b AS (SELECT hint, min(rung) AS rung FROM r GROUP BY hint) SELECT hint, CASE WHEN count(*) = 1 THEN min(slug) END AS slug, rung FROM r JOIN b USING (hint, rung) GROUP BY hint, rung""")
def slug_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints resolved to slugs on a ladder: exact, whatever case, display name, beginning; several on a rung give none."""
    silos = _silos(spark, sf_dir).select("slug", "display_name")
    hints = silos.select(F.col("slug").alias("hint")).union(silos.select(F.upper("slug"))).union(silos.where("display_name is not null").select("display_name")).union(silos.select(F.substring("slug", 1, 6))).distinct()
    begins = silos.select("slug", F.explode(F.transform(F.sequence(F.lit(1), F.length("slug")), lambda n: F.substring(F.col("slug"), F.lit(1), n))).alias("hint"))
    rungs = [
        hints.join(silos, F.col("hint") == F.col("slug")).select("hint", "slug", F.lit(1).alias("rung")),
        hints.join(silos, F.lower("hint") == F.lower("slug")).select("hint", "slug", F.lit(2).alias("rung")),
        hints.join(silos, F.col("hint") == F.col("display_name")).select("hint", "slug", F.lit(3).alias("rung")),
        hints.join(begins, "hint").select("hint", "slug", F.lit(4).alias("rung")),
    ]
    told = rungs[0].unionByName(rungs[1]).unionByName(rungs[2]).unionByName(rungs[3]).groupBy("hint", "slug").agg(F.min("rung").alias("rung"))
    by_rung = told.groupBy("hint", "rung").agg(F.min("slug").alias("slug"), F.count(F.lit(1)).alias("n"))
    best = by_rung.groupBy("hint").agg(F.min(F.struct("rung", "slug", "n")).alias("b"))
    return best.select("hint", F.when(F.col("b.n") == 1, F.col("b.slug")).alias("slug"), F.col("b.rung").alias("rung"))


@query("audit_report", f"""SELECT 'count_mismatch' AS issue, count(*) AS n FROM silos LEFT JOIN (SELECT silo, count(DISTINCT path) AS n FROM files GROUP BY silo) f ON f.silo = slug WHERE files_indexed IS DISTINCT FROM coalesce(n, 0)
  UNION ALL SELECT 'shared_content', count(*) FROM (SELECT 1 FROM files GROUP BY {CONTENT} HAVING count(DISTINCT silo) > 1) UNION ALL SELECT 'no_new_files', count(*) FROM silos WHERE slug NOT IN (SELECT silo FROM files WHERE batch_no = 9 AND silo IS NOT NULL)
  UNION ALL SELECT 'unread_files', count(*) FROM files WHERE file_key NOT IN (SELECT file_key FROM chunks WHERE file_key IS NOT NULL)""")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each issue an audit finds."""
    files, silos = _files(spark, sf_dir), _silos(spark, sf_dir)
    fresh = files.where("batch_no = 9").select(F.col("silo").alias("slug"))
    issues = {
        "count_mismatch": catalog.count_mismatches(silos, files), "shared_content": files.groupBy(_content().alias("c")).agg(F.count_distinct("silo").alias("n")).where("n > 1"),
        "no_new_files": silos.join(fresh, "slug", "left_anti"), "unread_files": files.join(table(spark, sf_dir, "chunks").select("file_key"), "file_key", "left_anti"),
    }
    parts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("issue"), "n") for k, rows in issues.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("nested_folders", """WITH f AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM files WHERE path IS NOT NULL) SELECT a.folder AS "inner", b.folder AS "outer", 'nested' AS relation FROM f a JOIN f b ON starts_with(a.folder, b.folder || '/')""")
def nested_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of files that lie in one another, by the plan that compares silos."""
    folders = _files(spark, sf_dir).where("path is not null").select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path")).where("path <> ''").distinct()
    return catalog.nested_paths(folders.select(F.col("path").alias("slug"), "path"))


@query("silos_without_new_files", "SELECT slug FROM silos WHERE NOT EXISTS (SELECT 1 FROM files WHERE silo = slug AND batch_no = 9 AND path LIKE '%.pdf')")
def silos_without_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = _files(spark, sf_dir).where("batch_no = 9 and path like '%.pdf'").select(F.col("silo").alias("slug"))
    return _silos(spark, sf_dir).select("slug").join(fresh, "slug", "left_anti")


@query("sources_new_to_manifest", "SELECT DISTINCT source FROM chunks WHERE source IS NOT NULL AND source NOT IN (SELECT path FROM files WHERE path IS NOT NULL AND batch_no <= 5)")
def sources_new_to_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _files(spark, sf_dir).where("batch_no <= 5").select(F.col("path").alias("source"))
    return table(spark, sf_dir, "chunks").select("source").where("source is not null").distinct().join(old, "source", "left_anti")


@query("customers_without_late_orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1997-01-01')")
def customers_without_late_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return table(spark, sf_dir, "customer").join(late, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("section_filter", "WITH h AS (SELECT doc_id FROM documents WHERE contains(lower(text), '# final minutes')) SELECT doc_id FROM documents WHERE (SELECT count(*) FROM h) = 0 OR doc_id IN (SELECT doc_id FROM h)")
def section_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that have the section asked for or, where none has it, all texts."""
    return fallback_filter(table(spark, sf_dir, "documents"), F.contains(F.lower("text"), F.lit("# final minutes"))).select("doc_id")


@query("conflict_candidates", """WITH v AS (SELECT silo, tax_year, field_code, normalized_decimal, min(row_key) AS k FROM ledger WHERE normalized_decimal IS NOT NULL GROUP BY 1, 2, 3, 4), r AS (SELECT *, row_number() OVER (PARTITION BY silo, tax_year, field_code ORDER BY k) AS n, count(*) OVER (PARTITION BY silo, tax_year, field_code) AS total FROM v)
  SELECT silo, tax_year, field_code, total AS distinct_values, list(k ORDER BY n) FILTER (n <= 3) AS preview FROM r WHERE total > 1 GROUP BY ALL""")
def conflict_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures that disagree, with the first rows of three values each."""
    key = ["silo", "tax_year", "field_code"]
    values = table(spark, sf_dir, "ledger").where("normalized_decimal is not null").groupBy(*key, "normalized_decimal").agg(F.min("row_key").alias("k"))
    told = values.withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy("k")))
    out = told.groupBy(*key).agg(F.count(F.lit(1)).alias("distinct_values"), F.sort_array(F.collect_list(F.when(F.col("n") <= 3, F.col("k")))).alias("preview"))
    return out.where("distinct_values > 1")


@query("trace_refs", "SELECT row_key, source || CASE WHEN page IS NULL THEN '' ELSE '#page=' || page END AS trace FROM ledger WHERE source IS NOT NULL")
def trace_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "ledger").where("source is not null")
    return rows.select("row_key", F.concat("source", F.coalesce(F.concat(F.lit("#page="), F.col("page").cast("string")), F.lit(""))).alias("trace"))


@query("money_labels", "SELECT row_key, format('{:,}', CAST(trunc(normalized_decimal) AS BIGINT)) || substr(CAST(normalized_decimal AS VARCHAR), -3) AS label FROM ledger WHERE normalized_decimal >= 0")
def money_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ledger").where("normalized_decimal >= 0").select("row_key", F.format_number("normalized_decimal", 2).alias("label"))


@query("slug_names", r"SELECT slug, regexp_replace(slug, '-[0-9a-f]{8}$', '') AS name FROM silos")
def slug_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silos(spark, sf_dir).select("slug", F.regexp_replace("slug", r"-[0-9a-f]{8}$", "").alias("name"))


@query("vision_allowed", "SELECT f.file_key FROM files f JOIN silos s ON s.slug = f.silo WHERE s.image_vision_enabled AND " + EXT.replace("path", "f.path") + " IN ('png', 'jpg', 'jpeg', 'gif', 'tif', 'tiff', 'webp', 'bmp', 'pdf')")
def vision_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and scans whose silo lets a vision model see them."""
    open_ = _silos(spark, sf_dir).where("image_vision_enabled").select(F.col("slug").alias("silo"))
    seen = _files(spark, sf_dir).where(texts.extension("path").isin("png", "jpg", "jpeg", "gif", "tif", "tiff", "webp", "bmp", "pdf"))
    return seen.join(open_, "silo", "left_semi").select("file_key")


@query("catalog_freshness", f"""WITH f AS (SELECT silo, count(*) AS n, count(*) FILTER (coalesce(hash, '') = '') AS unread, max({AT}) AS newest FROM files GROUP BY silo)
  SELECT slug, CASE WHEN f.n IS NULL THEN 'no_files' WHEN files_indexed IS NULL THEN 'never_counted' WHEN files_indexed <> f.n THEN 'count_differs' WHEN newest > updated THEN 'newer_files' WHEN unread > 0 THEN 'unread_files' ELSE 'fresh' END AS reason FROM silos LEFT JOIN f ON f.silo = slug""")
def catalog_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a silo's catalogue is fresh; of several reasons against it the first counts."""
    held = _files(spark, sf_dir).groupBy(F.col("silo").alias("slug")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("hash", F.lit("")) == "").alias("unread"), F.max(catalog.modified()).alias("newest"))
    both = _silos(spark, sf_dir).join(held, "slug", "left")
    reason = (
        F.when(F.col("n").isNull(), "no_files").when(F.col("files_indexed").isNull(), "never_counted").when(F.col("files_indexed") != F.col("n"), "count_differs")
        .when(F.col("newest") > F.col("updated").cast("timestamp"), "newer_files").when(F.col("unread") > 0, "unread_files").otherwise("fresh")
    )
    return both.select("slug", reason.alias("reason"))
