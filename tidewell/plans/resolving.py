"""Queries that resolve facts of the ledger, and scores of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.operators import evidence
from tidewell.plans.registry import query
from tidewell.session import table


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ledger")


RESOLVED = """SELECT {g}, CASE WHEN count(*) FILTER (confidence >= 0.55) = 0 THEN 'low_confidence' WHEN min(normalized_decimal) FILTER (confidence >= 0.55) IS NULL THEN 'no_value'
  WHEN min(normalized_decimal) FILTER (confidence >= 0.55) = max(normalized_decimal) FILTER (confidence >= 0.55) THEN 'ok' ELSE 'conflict' END AS status,
  CASE WHEN min(normalized_decimal) FILTER (confidence >= 0.55) = max(normalized_decimal) FILTER (confidence >= 0.55) THEN min(normalized_decimal) FILTER (confidence >= 0.55) END AS answer,
  count(*) FILTER (confidence >= 0.55) AS evidence FROM ledger GROUP BY {g}"""


@query("ledger_resolution", RESOLVED.format(g="silo, source, page, field_code"))
def ledger_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.resolve(_ledger(spark, sf_dir), ["silo", "source", "page", "field_code"])


@query("ledger_single_value", RESOLVED.format(g="silo, tax_year, field_code"))
def ledger_single_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.resolve(_ledger(spark, sf_dir), ["silo", "tax_year", "field_code"])


@query("ledger_sum_by_year", "WITH d AS (SELECT silo, tax_year, doc_hash, page, max(normalized_decimal) AS v FROM ledger WHERE field_code = 'w2_box_1_wages' AND confidence >= 0.55 AND normalized_decimal IS NOT NULL GROUP BY ALL) SELECT silo, tax_year, CAST(sum(v) AS DECIMAL(28,2)) AS wages, count(*) AS documents FROM d GROUP BY silo, tax_year")
def ledger_sum_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wages of a year: the largest sure figure of each document, summed exactly."""
    sure = _ledger(spark, sf_dir).where("field_code = 'w2_box_1_wages' and confidence >= 0.55 and normalized_decimal is not null")
    docs = sure.groupBy("silo", "tax_year", "doc_hash", "page").agg(F.max("normalized_decimal").alias("v"))
    return docs.groupBy("silo", "tax_year").agg(F.sum("v").cast("decimal(28,2)").alias("wages"), F.count(F.lit(1)).alias("documents"))


@query("total_income", """WITH a AS (SELECT silo, tax_year, max(normalized_decimal) AS line9 FROM ledger WHERE field_code = 'f1040_line_9_total_income' AND confidence >= 0.55 GROUP BY 1, 2),
  b AS (SELECT silo, tax_year, sum(normalized_decimal) AS wages FROM (SELECT silo, tax_year, doc_hash, max(normalized_decimal) AS normalized_decimal FROM ledger WHERE field_code = 'w2_box_1_wages' AND confidence >= 0.55 GROUP BY 1, 2, 3) GROUP BY 1, 2)
  SELECT silo, tax_year, CAST(coalesce(line9, wages) AS DECIMAL(28,2)) AS income, CASE WHEN line9 IS NOT NULL THEN 'line_9' WHEN wages IS NOT NULL THEN 'wages' ELSE 'no_value' END AS basis FROM a FULL OUTER JOIN b USING (silo, tax_year) WHERE tax_year IS NOT NULL""")
def total_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line 9 of the main return, else the sum of wages."""
    sure = _ledger(spark, sf_dir).where("confidence >= 0.55 and tax_year is not null")
    line9 = sure.where("field_code = 'f1040_line_9_total_income'").groupBy("silo", "tax_year").agg(F.max("normalized_decimal").alias("line9"))
    wages = sure.where("field_code = 'w2_box_1_wages'").groupBy("silo", "tax_year", "doc_hash").agg(F.max("normalized_decimal").alias("v")).groupBy("silo", "tax_year").agg(F.sum("v").alias("wages"))
    basis = F.when(F.col("line9").isNotNull(), "line_9").when(F.col("wages").isNotNull(), "wages").otherwise("no_value")
    return line9.join(wages, ["silo", "tax_year"], "full_outer").select("silo", "tax_year", F.coalesce("line9", "wages").cast("decimal(28,2)").alias("income"), basis.alias("basis"))


@query("dominant_amount", """WITH c AS (SELECT silo, tax_year, normalized_decimal, count(*) AS n FROM ledger WHERE field_code = 'w2_box_1_wages' AND normalized_decimal IS NOT NULL GROUP BY 1, 2, 3)
  SELECT silo, tax_year, normalized_decimal, n AS times FROM c WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY silo, tax_year ORDER BY n DESC, normalized_decimal DESC) = 1""")
def dominant_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.dominant(_ledger(spark, sf_dir).where("field_code = 'w2_box_1_wages'"), ["silo", "tax_year"], "normalized_decimal")


@query("employer_rows", """SELECT row_key FROM ledger WHERE coalesce(list_has_all(entity_tokens, ['taikulume', 'konoshel']), false) OR list_has_all(list_filter(regexp_split_to_array(lower(source), '[^a-z0-9]+'), lambda x: x <> ''), ['taikulume', 'konoshel'])""")
def employer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).where(evidence.employer_matches(["taikulume", "konoshel"], F.col("entity_tokens"), F.col("source"))).select("row_key")


@query("withholding_below_wages", """WITH w AS (SELECT silo, source, page, max(normalized_decimal) AS wages FROM ledger WHERE field_code = 'w2_box_1_wages' GROUP BY 1, 2, 3),
  b AS (SELECT l.silo, l.source, l.page, normalized_decimal AS amount, confidence, wages, row_key FROM ledger l LEFT JOIN w USING (silo, source, page) WHERE field_code = 'w2_box_2_federal_income_tax_withheld' AND normalized_decimal IS NOT NULL)
  SELECT silo, source, page, amount FROM b WHERE wages IS NULL OR amount < wages QUALIFY row_number() OVER (PARTITION BY silo, source, page ORDER BY confidence DESC NULLS LAST, amount DESC, row_key) = 1""")
def withholding_below_wages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Withheld tax of each page: of the figures below the page's wages the most confident one."""
    key = ["silo", "source", "page"]
    rows = _ledger(spark, sf_dir)
    wages = rows.where("field_code = 'w2_box_1_wages'").groupBy(*key).agg(F.max("normalized_decimal").alias("wages"))
    held = rows.where("field_code = 'w2_box_2_federal_income_tax_withheld' and normalized_decimal is not null").join(wages, key, "left").where("wages is null or normalized_decimal < wages")
    best = F.struct(F.coalesce("confidence", F.lit(-1.0)), "normalized_decimal", -F.col("row_key"))
    return held.groupBy(*key).agg(F.max_by("normalized_decimal", best).alias("amount"))


@query("ledger_by_tier", "SELECT extractor_tier, field_code, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, grouping(extractor_tier, field_code) AS level FROM ledger GROUP BY GROUPING SETS ((extractor_tier), (field_code), ())")
def ledger_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [[F.col("extractor_tier")], [F.col("field_code")], []]
    return _ledger(spark, sf_dir).groupingSets(sets, "extractor_tier", "field_code").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.grouping_id().alias("level"))


@query("raw_money", r"""SELECT row_key, TRY_CAST(nullif(regexp_replace(raw_value, '[^0-9.\-]', '', 'g'), '') AS DECIMAL(18,2)) AS amount FROM ledger""")
def raw_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.functions.texts import money

    return _ledger(spark, sf_dir).select("row_key", money(F.col("raw_value")).alias("amount"))


@query("replace_ledger_sources", "WITH s AS (SELECT DISTINCT source FROM ledger WHERE batch_no >= 7) SELECT row_key FROM ledger WHERE batch_no >= 7 OR source NOT IN (SELECT source FROM s)")
def replace_ledger_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after the sources of the newest batches have replaced all their earlier rows."""
    from tidewell.sources.sinks import replace_sources

    rows = _ledger(spark, sf_dir).select("row_key", "source", "batch_no")
    return replace_sources(rows.where("batch_no < 7"), rows.where("batch_no >= 7"), "source").select("row_key")


@query("eval_report", """WITH a AS (SELECT i.item_id, i.category, max(CASE WHEN contains(d.text, i.expected_value) THEN 1 ELSE 0 END) AS found FROM eval_items i LEFT JOIN documents d ON contains(d.text, i.expected_value) GROUP BY 1, 2)
  SELECT category, count(*) AS items, CAST(sum(found) AS BIGINT) AS answered, round(avg(found), 6) AS share FROM a GROUP BY ROLLUP (category)""")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose expected value stands in some document, by category and in all.

    The items are a stated set of fixed size: every task holds their values and tests each text against all of them."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "category", "expected_value")
    values = [r[0] for r in items.select("expected_value").where("expected_value is not null").distinct().collect()]  # a stated set of fixed size
    docs = table(spark, sf_dir, "documents").select("text")
    held = docs.select(F.explode(F.filter(F.array(*[F.when(F.contains("text", F.lit(v)), F.lit(v)) for v in values]), lambda x: x.isNotNull())).alias("expected_value")).distinct()
    told = items.join(held.withColumn("hit", F.lit(1)), "expected_value", "left").withColumn("found", F.coalesce("hit", F.lit(0)))
    return told.rollup("category").agg(F.count(F.lit(1)).alias("items"), F.sum("found").alias("answered"), F.round(F.avg("found"), 6).alias("share"))


@query("audit_rollup", "SELECT event_type AS tool, user_id % 10 AS silo, count(*) AS calls, count(*) FILTER (value = 0) AS empty, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 10), ())")
def audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("tool", F.col("event_type")).withColumn("silo", F.col("user_id") % 10)
    return events.groupingSets([[F.col("tool")], [F.col("silo")], []], "tool", "silo").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("value") == 0).alias("empty"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("audit_last_calls", "SELECT event_id, ts, event_type FROM (SELECT * FROM events WHERE event_type IN ('view', 'error') AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 40)")
def audit_last_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "error") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")))
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(40).select("event_id", "ts", "event_type")


@query("audit_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def audit_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k bigint")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k")).where("k is not null")


@query("latest_error_by_user", "SELECT user_id, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) = count(DISTINCT ts)")
def latest_error_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id")
    return errors.agg(F.max_by("event_id", "ts").alias("event_id"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"), F.count_distinct("ts").alias("d")).where("n = d").drop("n", "d")


@query("debounced_actions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
  k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g) SELECT user_id, CAST(burst AS BIGINT) AS burst, count(*) AS actions, last(event_type ORDER BY ts, event_id) AS last_action FROM k GROUP BY user_id, burst""")
def debounced_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of a key's actions, closed by half an hour of silence; the last action of a burst stands for it."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(order) <= F.expr("interval 30 minutes")
    events = table(spark, sf_dir, "events").withColumn("s", F.when(gap, 0).otherwise(1)).withColumn("burst", F.sum("s").over(order))
    return events.groupBy("user_id", "burst").agg(F.count(F.lit(1)).alias("actions"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_action"))


FORM_SQL = r"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS source, text FROM documents WHERE regexp_matches(text, '(?m)^Form ([A-Z0-9-]+) for the year (\d{4})')),
  f AS (SELECT source, regexp_extract(text, '(?m)^Form ([A-Z0-9-]+) for the year (\d{4})', 1) AS form_type, CAST(regexp_extract(text, '(?m)^Form ([A-Z0-9-]+) for the year (\d{4})', 2) AS INTEGER) AS tax_year,
    nullif(trim(regexp_extract(text, '(?m)^(?:Employer|Payer|Taxpayer): (.+)$', 1)), '') AS entity_name, unnest(regexp_extract_all(text, '(?m)^((?:Box|Line) \w+ [a-z ]+|Totals): (-?[\d., $]+)$', 1)) AS field_label, unnest(regexp_extract_all(text, '(?m)^((?:Box|Line) \w+ [a-z ]+|Totals): (-?[\d., $]+)$', 2)) AS v FROM t)
  SELECT source, form_type, tax_year, entity_name, field_label, trim(v) AS raw_value, TRY_CAST(regexp_replace(v, '[^0-9.\-]', '', 'g') AS DECIMAL(18,2)) AS normalized_decimal, substr(sha1(source || '|' || form_type || '|' || tax_year || '|' || field_label), 1, 24) AS record_id FROM f"""


@query("form_facts", FORM_SQL)
def form_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.operators.forms import form_facts as facts

    return facts(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), "text"))


@query("csv_rank_lookup", r"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^(CSV row \d+: .*)$', 1)) AS line FROM documents WHERE contains(text, 'CSV row '))
  SELECT doc_id, line FROM (SELECT doc_id, line, contains(line, 'Total=1 |') AS hit FROM r) WHERE hit ORDER BY doc_id, line LIMIT 5""")
def csv_rank_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables in texts whose rank column is 1, the first five of the catalogue."""
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("CSV row ")))
    lines = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^(CSV row \d+: .*)$"), F.lit(1))).alias("line"))
    return lines.where(F.contains("line", F.lit("Total=1 |"))).orderBy("doc_id", "line").limit(5)
