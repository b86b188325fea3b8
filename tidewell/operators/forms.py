"""Facts of tax forms out of the lines of a read-out: one row per labelled box or line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.texts import money

FORM = r"(?m)^Form ([A-Z0-9-]+) for the year (\d{4})"
PAYER = r"(?m)^(?:Employer|Payer|Taxpayer): (.+)$"
FIELD = r"(?m)^((?:Box|Line) \w+ [a-z ]+|Totals): (-?[\d., $]+)$"


def form_facts(texts: DataFrame) -> DataFrame:
    """(source, form_type, tax_year, entity_name, field_label, raw_value, normalized_decimal, record_id) of the forms in
    ``texts`` (source, text): no UDF, one pattern for the head and one for the fields; texts without a form give no row."""
    heads = texts.where(F.regexp_like("text", F.lit(FORM))).select(
        "source", F.regexp_extract("text", FORM, 1).alias("form_type"), F.regexp_extract("text", FORM, 2).cast("int").alias("tax_year"),
        F.nullif(F.trim(F.regexp_extract("text", PAYER, 1)), F.lit("")).alias("entity_name"),
        F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(FIELD), F.lit(1)).alias("label"), F.regexp_extract_all("text", F.lit(FIELD), F.lit(2)).alias("value"))).alias("f"),
    )
    identity = F.substring(F.sha1(F.concat_ws("|", "source", "form_type", F.col("tax_year").cast("string"), "f.label")), 1, 24)
    return heads.select("source", "form_type", "tax_year", "entity_name", F.col("f.label").alias("field_label"), F.trim("f.value").alias("raw_value"), money(F.col("f.value")).alias("normalized_decimal"), identity.alias("record_id"))
