"""Problem 1: the best representative of each group of duplicate ledger records.

Records of one document page and field are read-outs of one figure. Which payer and year a document
is about is itself decided by truth discovery over all its read-outs (:mod:`truth`): names are compared as
skeletons of confusable glyphs, without legal suffixes, after undoing "noun, name" inversions; a cut-off name
votes for the full one it begins. Records then form a group when silo, field, year and payer agree, whatever
document they come from, and a second truth discovery settles each field of the group's survivor.

Defined results:
* null or blank silo or field_code: the record is alone in its group; null or blank doc_hash: it is a document of its own;
* null names and years take the document's; a document with neither name is told by silo, document, page and field alone;
* a repeated row_key counts once for grouping; ties take the larger value and the smaller row_key;
* empty input gives empty results; further columns, however named, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.glyphs import skeleton, to_leaf
from tidewell.llm.hashes import clean_hash
from tidewell.llm.truth import discover
from tidewell.shared import Scratch

#: Legal forms and articles that are no part of a payer's name, as skeletons need them.
NO_NAME = ("inc", "llc", "co", "corp", "ltd", "gmbh", "the", "plc", "ag", "sa")
TIERS = ("form_field", "layout", "ocr_layout")


def payer_key(name: Column) -> Column:
    """Words of a payer's name as skeletons, in order, joined by blanks; null when none is left."""
    lower = F.trim(F.lower(name))
    tail = F.trim(F.regexp_extract(lower, r"^([^,]+),\s*(.+)$", 2))
    head = F.regexp_extract(lower, r"^([^,]+),\s*(.+)$", 1)
    legal = F.lit("^(" + "|".join(NO_NAME) + r")\.?$")
    lower = F.when((tail != "") & ~F.regexp_like(tail, legal), F.concat_ws(" ", tail, head)).otherwise(lower)
    words = F.regexp_extract_all(lower, F.lit(r"([\p{L}\p{N}!|$]+)"), F.lit(1))
    keys = F.transform(words, lambda k: skeleton(k))
    stop = F.transform(F.array(*[F.lit(w) for w in NO_NAME]), lambda k: skeleton(k))
    text = F.array_join(F.filter(keys, lambda k: ~F.array_contains(stop, k)), " ")
    return F.when(F.length(text) > 0, text)


def _rows(ledger: DataFrame) -> DataFrame:
    blank = lambda c: F.when(F.length(F.trim(F.col(c))) > 0, F.trim(F.col(c)))
    return ledger.select(
        "row_key",
        blank("silo").alias("silo"),
        blank("field_code").alias("field_code"),
        clean_hash("doc_hash").alias("doc"),
        F.col("page"),
        F.col("tax_year"),
        payer_key(F.col("entity_name")).alias("payer"),
        F.lower(F.col("source")).alias("path"),
        F.coalesce("extractor_tier", F.lit("unknown")).alias("tier"),
        F.coalesce("confidence", F.lit(0.3)).alias("confidence"),
    ).withColumn("doc_id", F.concat_ws("\x1f", F.coalesce("silo", F.lit("")), F.coalesce("doc", F.concat(F.lit("row:"), F.col("row_key").cast("string")))))


def group_duplicates(ledger: DataFrame, scratch: Scratch) -> DataFrame:
    """(row_key, group_id) for every row_key: records that report the same figure share a group_id."""
    rows = scratch.keep(_rows(ledger), "rows")
    names = rows.where("payer is not null").groupBy("doc_id", "payer").agg(F.lit(1).alias("one"))
    whole = to_leaf(names, ["doc_id"], "payer").select("doc_id", "payer", F.when(F.col("ambiguous"), F.col("payer")).otherwise(F.col("leaf")).alias("leaf"))
    claims = rows.join(whole, ["doc_id", "payer"], "left").select(
        F.col("doc_id").alias("object_id"),
        F.explode(F.create_map(F.lit("payer"), F.coalesce("leaf", F.lit("")), F.lit("year"), F.coalesce(F.col("tax_year").cast("string"), F.lit("")))).alias("attribute", "value"),
        F.concat_ws("\x1f", "tier", F.coalesce("path", F.lit(""))).alias("source_id"),
        F.col("tier").alias("source_class"),
        (F.col("confidence") + 0.05).alias("n"),
    ).where("value <> ''")
    truth = discover(claims, scratch, "documents").truths
    truth = truth.groupBy("object_id").agg(
        F.max(F.when(F.col("attribute") == "payer", F.col("truth"))).alias("payer"),
        F.max(F.when(F.col("attribute") == "year", F.col("truth"))).alias("year"),
    )
    docs = rows.groupBy("doc_id", "silo").agg(F.max("path").alias("path"))
    docs = docs.join(truth.withColumnRenamed("object_id", "doc_id"), "doc_id", "left")
    # a year that no read-out gives may stand in the path
    in_path = F.regexp_extract(F.col("path"), r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1)
    docs = docs.withColumn("year", F.coalesce("year", F.when(in_path != "", in_path)))
    docs = scratch.keep(docs.withColumn("base", F.coalesce(F.nullif(F.regexp_extract("payer", r"^(.*) [^ ]+$", 1), F.lit("")), F.substring("payer", 1, 3))), "docs")
    # cut-off names across the documents of a silo, looked up among names with the same leading words, or the same first
    # three glyphs where there is one word only
    known = docs.where("payer is not null").groupBy("silo", "base", "payer").agg(F.count(F.lit(1)).alias("docs"))
    leaves = to_leaf(known, ["silo", "base"], "payer")
    sure = leaves.where("not ambiguous").select("silo", "base", "payer", "leaf")
    # where two full names begin alike, the file's own name may tell which one is meant
    unsure = leaves.where("ambiguous").select(F.col("silo").alias("u_silo"), F.col("base").alias("u_base"), F.col("payer").alias("u_payer"))
    ends = leaves.where("leaf = payer and not ambiguous")
    asked = docs.join(unsure, (F.col("silo").eqNullSafe(F.col("u_silo"))) & (F.col("base") == F.col("u_base")) & (F.col("payer") == F.col("u_payer")))
    named = (
        asked.select("doc_id", "u_silo", "u_base", "u_payer", skeleton(F.regexp_extract("path", r"([^/]+)$", 1)).alias("told"))
        .join(ends, (F.col("silo").eqNullSafe(F.col("u_silo"))) & (F.col("base") == F.col("u_base")) & F.startswith(F.col("payer"), F.col("u_payer")))
        .where(F.contains(F.col("told"), F.regexp_extract("payer", r"([^ ]+)$", 1)))
        .groupBy("doc_id").agg(F.max_by("payer", F.struct("docs", "payer")).alias("told_payer"))
    )
    docs = (
        docs.alias("d").join(sure.alias("s"), F.col("d.silo").eqNullSafe(F.col("s.silo")) & (F.col("d.base") == F.col("s.base")) & (F.col("d.payer") == F.col("s.payer")), "left")
        .join(named.alias("n"), F.col("d.doc_id") == F.col("n.doc_id"), "left")
        .select("d.doc_id", F.coalesce("n.told_payer", "s.leaf", "d.payer").alias("doc_payer"), F.col("d.year").alias("doc_year"))
    )
    told = rows.join(docs, "doc_id")
    same = F.when(
        F.col("doc_payer").isNotNull() & F.col("doc_year").isNotNull(), F.concat_ws("\x1f", F.lit("p"), "silo", "field_code", "doc_year", "doc_payer")
    ).otherwise(F.concat_ws("\x1f", F.lit("d"), "doc_id", F.coalesce(F.col("page").cast("string"), F.lit("")), "field_code"))
    alone = F.concat(F.lit("r\x1f"), F.col("row_key").cast("string"))
    group = F.when(F.col("silo").isNull() | F.col("field_code").isNull(), alone).otherwise(same)
    return told.select("row_key", F.sha2(group, 256).alias("group_id")).groupBy("row_key").agg(F.min("group_id").alias("group_id"))


def duplicate_pairs(groups: DataFrame) -> DataFrame:
    """Every pair of different rows of a group, the smaller key first; the problem asks for all of them."""
    return (
        groups.select("group_id", F.col("row_key").alias("row_key_a"))
        .join(groups.select("group_id", F.col("row_key").alias("row_key_b")), "group_id")
        .where("row_key_a < row_key_b")
        .select("row_key_a", "row_key_b")
    )


def classes(groups: DataFrame) -> DataFrame:
    """(row_key, group_id, links): each record with its class and the number of records it is linked to."""
    sizes = groups.groupBy("group_id").agg((F.count(F.lit(1)) - 1).alias("links"))
    return groups.join(sizes, "group_id").select("row_key", "group_id", "links")


def survivors(ledger: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per group, built field by field from the votes.

    Columns: group_id, members, row_key (of the best record that agrees with the amount), entity_name, tax_year,
    form_type, normalized_decimal (each the value with most support), source, extractor_tier, confidence (each the best
    among the records that agree with the amount: the source by the reliability it was found to have, the tier by the
    order of ``TIERS``, the highest confidence), value_support (the amount's share of all votes). Where no record gives an
    amount, the amount stays null and all records count as agreeing.
    """
    names = ["entity_name", "tax_year", "form_type", "normalized_decimal"]
    used = ledger.select("row_key", *names, "source", "extractor_tier", "confidence", "created_at").dropDuplicates(["row_key"])
    # short names for the rounds: half of the group's hash, and a hash of tier and path for the source
    source = F.xxhash64(F.coalesce("extractor_tier", F.lit("unknown")), F.coalesce("source", F.lit("")))
    used = used.join(groups, "row_key").withColumns({"object_id": F.unhex(F.substring("group_id", 1, 32)), "source_id": source})
    used = scratch.keep(used, "members")
    text = {n: F.col(n).cast("string") for n in names}
    text["entity_name"] = F.regexp_replace(F.trim("entity_name"), r"\s+", " ")
    claims = used.select(
        "object_id",
        F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.coalesce(text[n], F.lit("")))])).alias("attribute", "value"),
        "source_id",
        F.coalesce("extractor_tier", F.lit("unknown")).alias("source_class"),
        (F.coalesce("confidence", F.lit(0.3)) + 0.05).alias("n"),
    ).where("value <> ''")
    found = discover(claims, scratch, "fields")
    truth = found.truths
    wide = truth.groupBy("object_id").agg(
        *[F.max(F.when(F.col("attribute") == n, F.col("truth"))).alias(f"t_{n}") for n in names],
        F.max(F.when(F.col("attribute") == "normalized_decimal", F.col("support") / F.greatest("all_support", F.lit(1e-9)))).alias("value_support"),
    )
    tier = F.coalesce(*[F.when(F.col("extractor_tier") == t, F.lit(len(TIERS) - k)) for k, t in enumerate(TIERS)], F.lit(0))
    whole = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    agrees = F.col("t_normalized_decimal").isNull() | F.coalesce(F.col("normalized_decimal").cast("string") == F.col("t_normalized_decimal"), F.lit(False))
    rank = F.struct(
        agrees.alias("agrees"),
        tier.alias("tier"), F.coalesce("confidence", F.lit(0.0)).alias("sure"), whole.alias("whole"),
        F.col("created_at").alias("recent"), (-F.col("row_key")).alias("key"),
    )
    best = (
        used.join(found.weights, "source_id", "left")
        .join(wide, "object_id", "left")
        .groupBy("group_id")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.max_by("row_key", rank).alias("row_key"),
            F.max_by("source", F.when(F.col("source").isNotNull(), F.struct(agrees, F.coalesce("weight", F.lit(0.0)), tier, F.coalesce("confidence", F.lit(0.0)), "source"))).alias("source"),
            F.max_by("extractor_tier", F.when(F.col("extractor_tier").isNotNull(), F.struct(agrees, tier, "extractor_tier"))).alias("extractor_tier"),
            F.coalesce(F.max(F.when(agrees, F.col("confidence"))), F.max("confidence")).alias("confidence"),
            *[F.first(f"t_{n}").alias(f"t_{n}") for n in names],
            F.first("value_support").alias("value_support"),
        )
    )
    return best.select(
        "group_id", "members", "row_key", F.col("t_entity_name").alias("entity_name"),
        F.col("t_tax_year").cast("int").alias("tax_year"), F.col("t_form_type").alias("form_type"),
        F.col("t_normalized_decimal").cast("decimal(18,2)").alias("normalized_decimal"),
        "source", "extractor_tier", "confidence", "value_support",
    )
