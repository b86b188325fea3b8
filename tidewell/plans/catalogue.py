"""Queries over the catalogue of silos, files and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import dates, texts
from tidewell.operators import catalog
from tidewell.operators.ranked import cut_off
from tidewell.plans.registry import query
from tidewell.session import table

BASE = "regexp_extract(path, '([^/]*)$', 1)"
EXT = r"lower(regexp_extract(path, '[^/]\.([^./]+)$', 1))"
AT = "make_timestamp(CAST(floor(mtime * 1000000) AS BIGINT))"
CONTENT = "coalesce('h:' || nullif(regexp_replace(lower(trim(hash)), '^md5:', ''), ''), 'p:' || lower(path))"
CODE_LIST = ", ".join(f"'{c}'" for c in texts.CODE)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files")


def _content():  # noqa: ANN202
    bare = F.regexp_replace(F.lower(F.trim("hash")), "^md5:", "")
    return F.coalesce(F.concat(F.lit("h:"), F.when(bare != "", bare)), F.concat(F.lit("p:"), F.lower("path")))


def _counted(dimension: str, label: str) -> None:
    sql = f"SELECT {label} AS label, count(*) AS files FROM files WHERE {label} IS NOT NULL GROUP BY 1"

    @query(f"count_by_{dimension}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return catalog.count_by(_files(spark, sf_dir), dimension)


for _dimension, _label in {
    "extension": f"CASE WHEN {EXT} = '' THEN '(none)' ELSE {EXT} END", "folder": "regexp_extract(path, '^(.*)/[^/]*$', 1)", "year": f"strftime({AT}, '%Y')",
    "month": f"strftime({AT}, '%Y-%m')", "quarter": f"strftime({AT}, '%Y') || '-Q' || quarter({AT})",
}.items():
    _counted(_dimension, _label)


@query("collapse_duplicates", f"SELECT {CONTENT} AS content, min(path) AS path, count(*) AS copies, max(mtime) AS latest FROM files GROUP BY 1")
def collapse_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.collapse_duplicates(_files(spark, sf_dir), _content())


@query("structure_inventory", f"WITH c AS (SELECT {CONTENT} AS content, min(path) AS path, count(*) AS copies FROM files GROUP BY 1) SELECT {EXT} AS ext, count(*) AS contents, CAST(sum(copies) AS BIGINT) AS files FROM c GROUP BY 1")
def structure_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.collapse_duplicates(_files(spark, sf_dir), _content()).groupBy(texts.extension("path").alias("ext")).agg(F.count(F.lit(1)).alias("contents"), F.sum("copies").alias("files"))


@query("structure_recent", f"WITH c AS (SELECT {CONTENT} AS content, min(path) AS path, max(mtime) AS latest FROM files GROUP BY 1) SELECT path, latest, count(*) OVER () > 40 AS cap_applied FROM c ORDER BY latest DESC NULLS LAST, path LIMIT 40")
def structure_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = catalog.collapse_duplicates(_files(spark, sf_dir), _content())
    return cut_off(whole, 40, F.col("latest").desc_nulls_last(), "path", flag="cap_applied").select("path", "latest", "cap_applied")


@query("duplicate_hashes", f"SELECT {CONTENT} AS content, list_sort(list(DISTINCT silo)) AS silos, count(*) AS copies FROM files GROUP BY 1 HAVING count(DISTINCT silo) > 1")
def duplicate_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that several silos hold; the silos of one content are at most as many as there are silos."""
    return _files(spark, sf_dir).groupBy(_content().alias("content")).agg(F.sort_array(F.collect_set("silo")).alias("silos"), F.count(F.lit(1)).alias("copies")).where(F.size("silos") > 1)


@query(
    "find_files_by_date",
    f"""WITH f AS (SELECT *, CAST({AT} AS DATE) AS md, DATE '2014-03-01' AS lo, DATE '2014-05-15' AS hi FROM files),
      g AS (SELECT *, coalesce(CASE WHEN name_date_precision = 'month' THEN lo <= name_date AND hi >= last_day(name_date) ELSE name_date BETWEEN lo AND hi END, false) AS n, coalesce(md BETWEEN lo AND hi, false) AS m FROM f)
      SELECT file_key, path, CASE WHEN n AND m THEN 'both' WHEN n THEN 'name_date' ELSE 'mtime' END AS matched_by, count(*) OVER () > 100 AS truncated FROM g WHERE n OR m ORDER BY name_date DESC NULLS LAST, path, file_key LIMIT 100""",
)
def find_files_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.find_files(_files(spark, sf_dir), low="2014-03-01", high="2014-05-15").select("file_key", "path", "matched_by", "truncated")


@query("find_files_by_name", f"SELECT file_key, path, count(*) OVER () > 100 AS truncated FROM files WHERE lower({BASE}) GLOB '*lease*.pdf' ORDER BY name_date DESC NULLS LAST, path, file_key LIMIT 100")
def find_files_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.find_files(_files(spark, sf_dir), name="*lease*.pdf").select("file_key", "path", "truncated")


@query(
    "filename_dates",
    rf"""WITH b AS (SELECT file_key, {BASE} AS b FROM files),
      d AS (SELECT file_key, regexp_extract(b, '(?:^|[^0-9])([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})(?:[^0-9]|$)', 1) AS dashed, regexp_extract(b, '(?:^|[^0-9])((?:19|20)[0-9]{{6}})(?:[^0-9]|$)', 1) AS plain,
        lower(regexp_extract(b, '(?i)(?:^|[^a-z])((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* [0-9]{{1,2}},? [0-9]{{4}})', 1)) AS worded, regexp_extract(b, '(?:^|[^0-9])([0-9]{{4}}-[0-9]{{2}})(?:[^0-9-]|$)', 1) AS month FROM b),
      s AS (SELECT *, CASE WHEN dashed <> '' THEN dashed WHEN plain <> '' THEN plain[1:4] || '-' || plain[5:6] || '-' || plain[7:8]
        WHEN worded <> '' THEN worded[-4:] || '-' || lpad(CAST(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], worded[1:3]) AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract(worded, ' ([0-9]{{1,2}})', 1), 2, '0') END AS day FROM d),
      t AS (SELECT file_key, TRY_CAST(day AS DATE) AS d1, CASE WHEN day IS NULL AND month <> '' THEN TRY_CAST(month || '-01' AS DATE) END AS d2 FROM s)
      SELECT file_key, coalesce(d1, d2) AS parsed, CASE WHEN d1 IS NOT NULL THEN 'day' ELSE 'month' END AS precision FROM t WHERE coalesce(d1, d2) IS NOT NULL""",
)
def filename_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _files(spark, sf_dir).select("file_key", dates.name_date(F.col("path")).alias("d"))
    return found.select("file_key", F.col("d.date").alias("parsed"), F.col("d.precision").alias("precision")).where("parsed is not null")


@query("files_of_year", f"SELECT silo, path, file_key FROM files WHERE year({AT}) = 2015 ORDER BY silo, path, file_key LIMIT 50")
def files_of_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(F.year(catalog.modified()) == 2015).select("silo", "path", "file_key").orderBy("silo", "path", "file_key").limit(50)


@query("timeline", f"SELECT path, mtime, file_key FROM files WHERE year({AT}) BETWEEN 2012 AND 2014 AND (contains(lower(path), 'lease') OR contains(lower(path), 'survey')) ORDER BY mtime, path, file_key LIMIT 100")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(F.lit("lease"), F.lit("survey"))
    kept = _files(spark, sf_dir).where(F.year(catalog.modified()).between(2012, 2014) & F.exists(words, lambda w: F.contains(F.lower("path"), w)))
    return kept.select("path", "mtime", "file_key").orderBy("mtime", "path", "file_key").limit(100)


@query("code_languages", f"WITH c AS (SELECT DISTINCT {EXT} AS ext, source FROM (SELECT source AS path, source FROM chunks)), r AS (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY source) AS n FROM c WHERE ext IN ({CODE_LIST})) SELECT ext, count(*) AS sources, list(source ORDER BY source) FILTER (n <= 3) AS samples FROM r GROUP BY ext")
def code_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sources by extension with the first three; only three of a group ever meet in one array."""
    seen = table(spark, sf_dir, "chunks").select(texts.extension("source").alias("ext"), "source").where(F.col("ext").isin(*texts.CODE)).distinct()
    ranked = seen.withColumn("n", F.row_number().over(W.partitionBy("ext").orderBy("source")))
    return ranked.groupBy("ext").agg(F.count(F.lit(1)).alias("sources"), F.sort_array(F.collect_list(F.when(F.col("n") <= 3, F.col("source")))).alias("samples"))


@query("project_count", f"WITH r AS (SELECT f.silo, substr(f.path, length(s.path) + 2) AS rel, {EXT.replace('path', 'f.path')} AS ext FROM files f JOIN (SELECT slug, min(path) AS path FROM (SELECT slug, rtrim(trim(path), '/') AS path FROM silos) GROUP BY slug) s ON s.slug = f.silo AND starts_with(f.path, s.path || '/')) SELECT silo, count(DISTINCT CASE WHEN contains(rel, '/') THEN split_part(rel, '/', 1) ELSE '(root)' END) AS projects FROM r WHERE ext IN ({CODE_LIST}) GROUP BY silo")
def project_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "silos").groupBy(F.col("slug").alias("silo")).agg(F.min(F.rtrim(F.trim("path"), F.lit("/"))).alias("root"))
    code = _files(spark, sf_dir).select("silo", "path").where(texts.extension("path").isin(*texts.CODE)).join(roots, "silo").where(F.startswith("path", F.concat("root", F.lit("/"))))
    rel = F.substring(F.col("path"), F.length("root") + 2, F.length("path"))
    return code.select("silo", F.when(F.contains(rel, F.lit("/")), F.split(rel, "/")[0]).otherwise("(root)").alias("bucket")).groupBy("silo").agg(F.count_distinct("bucket").alias("projects"))


FORMS = (("W-2", r"(^|[^a-z0-9])w-?2([^a-z0-9]|$)"), ("1099", r"(^|[^0-9])1099([^0-9]|$)"), ("1040", r"(^|[^0-9])1040([^0-9]|$)"))
FORM_CASE = "CASE " + " ".join(f"WHEN regexp_matches(lower({BASE}), '{p}') THEN '{n}'" for n, p in FORMS) + " END"


@query("form_counts", f"SELECT form, count(*) AS files, count(DISTINCT silo) AS silos FROM (SELECT {FORM_CASE} AS form, silo FROM files) WHERE form IS NOT NULL GROUP BY form")
def form_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.lower(texts.base_name("path"))
    form = F.coalesce(*[F.when(F.regexp_like(base, F.lit(p)), n) for n, p in FORMS])
    return _files(spark, sf_dir).select(form.alias("form"), "silo").where("form is not null").groupBy("form").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("silo").alias("silos"))


@query("paths_with_year", "SELECT file_key FROM files WHERE regexp_matches(path, '(^|[^0-9])2014([^0-9]|$)')")
def paths_with_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(texts.has_year(F.col("path"), 2014)).select("file_key")


@query(
    "change_set",
    """WITH l AS (SELECT silo, path, any_value(size ORDER BY file_key) AS size, any_value(mtime ORDER BY file_key) AS mtime FROM files WHERE batch_no <= 6 GROUP BY 1, 2),
      m AS (SELECT silo, path, any_value(size ORDER BY file_key DESC) AS size, any_value(mtime ORDER BY file_key DESC) AS mtime FROM files WHERE batch_no >= 2 GROUP BY 1, 2)
      SELECT silo, path, CASE WHEN l.path IS NULL THEN 'delete' WHEN m.path IS NULL OR l.size IS DISTINCT FROM m.size OR l.mtime IS DISTINCT FROM m.mtime THEN 'update' ELSE 'unchanged' END AS action
      FROM l FULL OUTER JOIN m USING (silo, path)""".replace("any_value(size ORDER BY file_key DESC)", "arg_max(size, file_key)").replace("any_value(mtime ORDER BY file_key DESC)", "arg_max(mtime, file_key)")
    .replace("any_value(size ORDER BY file_key)", "arg_min(size, file_key)").replace("any_value(mtime ORDER BY file_key)", "arg_min(mtime, file_key)"),
)
def change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What turns the manifest of the later batches into the listing of the earlier ones."""
    files = _files(spark, sf_dir)

    def state(part: DataFrame, pick) -> DataFrame:  # noqa: ANN001
        known = lambda c: pick(c, F.when(F.col(c).isNotNull(), F.col("file_key")))
        return part.groupBy("silo", "path").agg(known("size").alias("size"), known("mtime").alias("mtime"))

    return catalog.change_set(state(files.where("batch_no <= 6"), F.min_by), state(files.where("batch_no >= 2"), F.max_by))


@query("nested_silos", r"""WITH c AS (SELECT slug, regexp_replace(regexp_replace(trim(path), '/+', '/', 'g'), '(.)/$', '\1') AS path FROM silos WHERE path IS NOT NULL)
  SELECT a.slug AS inner, b.slug AS outer, CASE WHEN a.path = b.path THEN 'same_path' ELSE 'nested' END AS relation FROM c a JOIN c b ON a.slug <> b.slug AND ((a.path = b.path AND a.slug < b.slug) OR starts_with(a.path, b.path || '/'))""".replace("AS inner", 'AS "inner"').replace("AS outer", 'AS "outer"'))
def nested_silos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.nested_paths(table(spark, sf_dir, "silos"))


@query("count_mismatches", "SELECT slug, files_indexed AS registered, coalesce(n, 0) AS listed FROM silos LEFT JOIN (SELECT silo, count(DISTINCT path) AS n FROM files GROUP BY silo) f ON f.silo = slug WHERE files_indexed IS DISTINCT FROM coalesce(n, 0)")
def count_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.count_mismatches(table(spark, sf_dir, "silos"), _files(spark, sf_dir))


@query("orphaned_silos", "SELECT slug FROM silos WHERE NOT EXISTS (SELECT 1 FROM files WHERE silo = slug)")
def orphaned_silos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "silos").join(_files(spark, sf_dir), F.col("slug") == F.col("silo"), "left_anti").select("slug")


@query("inspect_silo", """WITH c AS (SELECT source, count(*) AS chunks, max(file_hash) AS h FROM chunks GROUP BY source) SELECT source, chunks, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS duplicated FROM c ORDER BY chunks DESC, source LIMIT 50""")
def inspect_silo(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "chunks").groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.max("file_hash").alias("h"))
    copies = sources.where("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    told = sources.orderBy(F.desc("chunks"), "source").limit(50).join(copies, "h", "left")
    return told.select("source", "chunks", F.coalesce(F.col("n") > 1, F.lit(False)).alias("duplicated"))


@query("distinct_chunks", "SELECT id, min(file_key) AS file_key, count(*) AS deliveries FROM chunks GROUP BY id HAVING count(*) > 1")
def distinct_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").groupBy("id").agg(F.min("file_key").alias("file_key"), F.count(F.lit(1)).alias("deliveries")).where("deliveries > 1")


@query("index_consistency", """SELECT f.silo, count(*) AS owned, count(*) FILTER (c.file_key IS NULL) AS missing, CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS chunks FROM files f LEFT JOIN (SELECT file_key, count(DISTINCT id) AS n FROM chunks GROUP BY file_key) c USING (file_key) GROUP BY f.silo""")
def index_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "chunks").groupBy("file_key").agg(F.count_distinct("id").alias("n"))
    both = _files(spark, sf_dir).join(held, "file_key", "left")
    return both.groupBy("silo").agg(F.count(F.lit(1)).alias("owned"), F.count_if(F.col("n").isNull()).alias("missing"), F.sum(F.coalesce("n", F.lit(0))).alias("chunks"))


@query("unknown_chunks", "SELECT DISTINCT source FROM chunks WHERE source NOT IN (SELECT path FROM files WHERE path IS NOT NULL)")
def unknown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _files(spark, sf_dir).select(F.col("path").alias("source"))
    return table(spark, sf_dir, "chunks").select("source").where("source is not null").distinct().join(paths, "source", "left_anti")


@query("staleness", f"SELECT f.silo, count(*) FILTER ({AT} > s.updated) AS newer, max(f.mtime) AS newest FROM files f JOIN silos s ON s.slug = f.silo GROUP BY f.silo")
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    silos = table(spark, sf_dir, "silos").select(F.col("slug").alias("silo"), F.col("updated").cast("timestamp").alias("updated"))
    return _files(spark, sf_dir).join(silos, "silo").groupBy("silo").agg(F.count_if(catalog.modified() > F.col("updated")).alias("newer"), F.max("mtime").alias("newest"))


@query("recency_hints", "SELECT silo, max(mtime) AS newest, min(mtime) AS oldest, count(mtime) AS dated FROM files GROUP BY silo ORDER BY newest DESC, silo LIMIT 6")
def recency_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).groupBy("silo").agg(F.max("mtime").alias("newest"), F.min("mtime").alias("oldest"), F.count("mtime").alias("dated")).orderBy(F.desc("newest"), "silo").limit(6)


@query("silo_ranking_by_tokens", """WITH t AS (SELECT unnest(['lease', 'garden', 'survey']) AS w), p AS (SELECT silo, path, row_number() OVER (PARTITION BY silo ORDER BY path, file_key) AS n FROM files QUALIFY n <= 120)
  SELECT s.slug, 3 * (SELECT count(*) FROM t WHERE contains(lower(s.display_name), w)) + (SELECT count(DISTINCT w) FROM t, p WHERE p.silo = s.slug AND contains(lower(p.path), w)) AS score FROM silos s""")
def silo_ranking_by_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ["lease", "garden", "survey"]
    shown = _files(spark, sf_dir).withColumn("n", F.row_number().over(W.partitionBy("silo").orderBy("path", "file_key"))).where("n <= 120")
    hits = shown.groupBy("silo").agg(*[F.max(F.contains(F.lower("path"), F.lit(w)).cast("bigint")).alias(w) for w in words])
    silos = table(spark, sf_dir, "silos").join(hits, F.col("slug") == F.col("silo"), "left")
    named = sum((F.coalesce(F.contains(F.lower("display_name"), F.lit(w)).cast("bigint"), F.lit(0)) for w in words), F.lit(0))
    return silos.select("slug", (3 * named + sum((F.coalesce(F.col(w), F.lit(0)) for w in words), F.lit(0))).alias("score"))


@query("failures_retained", "WITH f AS (SELECT path, batch_no, file_key, row_number() OVER (PARTITION BY path ORDER BY batch_no DESC, file_key DESC) AS n FROM files WHERE hash IS NULL OR hash = '' QUALIFY n = 1) SELECT path, batch_no, file_key FROM f ORDER BY batch_no DESC, file_key DESC LIMIT 50")
def failures_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = _files(spark, sf_dir).where("hash is null or hash = ''").select("path", "batch_no", "file_key")
    return catalog.latest_first(failed, "path", [F.desc("batch_no"), F.desc("file_key")], 50)


@query("content_fingerprint", "SELECT silo, sha256(string_agg(chunk_hash, '' ORDER BY chunk_hash)) AS fingerprint FROM (SELECT DISTINCT silo, chunk_hash FROM chunks) GROUP BY silo")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free fingerprint of a silo's contents; parity form (the scalable one is ``content_checksum``)."""
    once = table(spark, sf_dir, "chunks").select("silo", "chunk_hash").distinct()
    return once.groupBy("silo").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("chunk_hash")), ""), 256).alias("fingerprint"))


@query("content_checksum")
def content_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free fingerprint as two folds of hashes with partial aggregation: no group is ever collected."""
    once = table(spark, sf_dir, "chunks").select("silo", "chunk_hash").distinct()
    return once.groupBy("silo").agg(F.bit_xor(F.xxhash64("chunk_hash")).alias("fold"), F.bit_xor(F.xxhash64("chunk_hash", F.lit(1))).alias("twin"), F.count(F.lit(1)).alias("chunks"))


@query("file_kinds", f"SELECT CASE WHEN ext IN ({CODE_LIST}) THEN 'code' WHEN ext IN ('pdf', 'docx', 'xlsx', 'pptx', 'zip') THEN ext WHEN ext IN ('png', 'jpg', 'jpeg', 'gif', 'tif', 'tiff', 'webp', 'bmp') THEN 'image' ELSE 'text' END AS kind, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, coalesce(bool_or(size > 1073741824), false) AS huge FROM (SELECT {EXT} AS ext, size FROM files WHERE path IS NOT NULL) GROUP BY 1")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).where("path is not null")
    return files.groupBy(texts.kind("path").alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.coalesce(F.bool_or(F.col("size") > 1 << 30), F.lit(False)).alias("huge"))


@query("admitted_files", f"SELECT file_key FROM files WHERE path IS NOT NULL AND NOT regexp_matches(path, '/(node_modules|[.]venv|dist)/') AND NOT regexp_matches({BASE}, '^(~[$]|[.])') AND size <= 20971520")
def admitted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.sources.listing import admitted

    return admitted(_files(spark, sf_dir), exclude=["node_modules/", ".venv/", "dist/"]).select("file_key")
