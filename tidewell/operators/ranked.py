"""Operators over ranked streams.

A ranked stream is a DataFrame with an explicit ``pos`` (bigint, from 0): its order. Every operator here is lazy,
breaks ties by ``pos`` last and emits a fresh ``pos``. Columns used where present: id, source, silo, dist (smaller is
better, null where only words matched), chunk_hash, text, page, line_start, region_index, record_type.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.shared import Scratch

#: Distance that a row without one is sorted by.
FAR = 999.0


def with_pos(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with ``pos`` renumbered from 0 in the given order; meant for result-sized streams."""
    rank = F.row_number().over(W.orderBy(*order)).cast("bigint") - 1
    return df.drop("pos").withColumn("pos", rank) if "pos" not in _names(order) else df.withColumn("_pos", rank).drop("pos").withColumnRenamed("_pos", "pos")


def _names(order: tuple[Column | str, ...]) -> set[str]:
    return {"pos"} if any("pos" in str(o) for o in order) else set()


def numbered(df: DataFrame, scratch: Scratch, *order: str) -> DataFrame:
    """``df`` with ``pos`` renumbered from 0 in the given order of columns, for streams of any length: ranges of the order
    are numbered apart, each from the number of rows in the ranges before it. ``order`` must not tie."""
    ranges = scratch.keep(df.drop("pos").repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))  # one row a partition
    before = F.coalesce(F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    told = ranges.withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy(*order))).join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part")
    return told.withColumn("pos", F.col("_before") + F.col("_n") - 1).drop("_part", "_n", "_before")


def top(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows in the given order, planned as a take-ordered, with a fresh ``pos``."""
    return with_pos(df.orderBy(*order).limit(k), *order)


def cap_per_key(stream: DataFrame, key: str, cap: int, k: int | None = None) -> DataFrame:
    """At most ``cap`` rows of each ``key`` in stream order, then the first ``k``; a null or blank key is its own."""
    own = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.concat(F.lit("__unknown_"), F.col("pos").cast("string")))
    kept = stream.withColumn("_own", own).withColumn("_n", F.row_number().over(W.partitionBy("_own").orderBy("pos"))).where(F.col("_n") <= cap).drop("_own", "_n")
    return top(kept, k, "pos") if k is not None else with_pos(kept, "pos")


def first_of_hash(stream: DataFrame, key: str = "chunk_hash") -> DataFrame:
    """Rows whose content hash appears for the first time; rows without a hash all stay."""
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    n = F.row_number().over(W.partitionBy(key).orderBy("pos"))
    return with_pos(stream.withColumn("_n", n).where(blank | (F.col("_n") == 1)).drop("_n"), "pos")


def reciprocal_rank(vector: DataFrame, lexical: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Fusion of two streams with unique ids by the sum of 1 / (constant + rank), ranks from 1; ties follow the
    vector stream, then the lexical one. Columns: id, dist (null where only words matched), vector_rank,
    lexical_rank, rrf_score, pos."""
    v = vector.select(F.col("id"), "dist", (F.col("pos") + 1).alias("vector_rank"))
    x = lexical.select(F.col("id"), (F.col("pos") + 1).alias("lexical_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(constant) + F.col(c)), F.lit(0.0))
    both = v.join(x, "id", "full_outer").withColumn("rrf_score", part("vector_rank") + part("lexical_rank"))
    order = [F.desc("rrf_score"), F.col("vector_rank").isNull(), F.coalesce("vector_rank", "lexical_rank")]
    return top(both, k, *order)


def dual_stream(raw: DataFrame, derived: DataFrame, keys: list[str], k: int, constant: int = 60) -> DataFrame:
    """Fusion of two streams on shared key columns; ties by distance (none is far), then by first sight."""
    tag = lambda df, n: df.select(*keys, "dist", "pos", F.lit(n).alias("stream"))
    both = tag(raw, 0).unionByName(tag(derived, 1)).withColumn("score", F.lit(1.0) / (F.lit(constant + 1) + F.col("pos")))
    seen = F.struct("stream", "pos")
    out = both.groupBy(*keys).agg(F.sum("score").alias("rrf_score"), F.min_by("dist", F.when(F.col("dist").isNotNull(), seen)).alias("dist"), F.min(seen).alias("_seen"), F.count_distinct("stream").cast("bigint").alias("streams"))
    order = [F.desc("rrf_score"), F.coalesce("dist", F.lit(FAR)), F.col("_seen")]
    return top(out, k, *order).drop("_seen")


def least_coverage(stream: DataFrame, key: str, k: int, groups: int) -> DataFrame:
    """The first row of each of the ``groups`` keys with the best distance, filled up in order to ``k``, in stream order."""
    best = F.min(F.coalesce("dist", F.lit(FAR))).over(W.partitionBy(key))
    first = F.row_number().over(W.partitionBy(key).orderBy("pos"))
    marked = stream.withColumns({"_best": best, "_first": first})
    rank = marked.where("_first = 1").select(F.col(key).alias("_key"), F.row_number().over(W.orderBy("_best", "pos")).alias("_rank")).where(F.col("_rank") <= groups)
    told = marked.join(F.broadcast(rank.limit(groups)), F.col(key) == F.col("_key"), "left")
    must = (F.col("_first") == 1) & F.col("_rank").isNotNull()
    picked = told.withColumn("_late", (~must).cast("int")).orderBy("_late", "pos").limit(k)
    return with_pos(picked.drop("_key", "_rank", "_best", "_first", "_late"), "pos")


def promote_diversity(stream: DataFrame, key: str, k: int, *, dominance: float = 0.7, margin: float = 0.08, most: int = 2) -> DataFrame:
    """Where one key holds at least ``dominance`` of the first ``k`` rows, rows beyond them take places of its last ones:
    of each other key that comes within ``margin`` of the leading key's best distance the nearest, ``most`` in all, the
    nearest first. A null or blank key is its own; fewer than four rows change nothing."""
    far = F.coalesce("dist", F.lit(FAR))
    own = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.concat(F.lit("__unknown_"), F.col("pos").cast("string")))
    rows = stream.withColumns({"_own": own, "_far": far})
    head = rows.where(F.col("pos") < k)
    size = head.agg(F.count(F.lit(1)).alias("_size"))
    lead = head.groupBy(F.col("_own").alias("_lead")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("p")).orderBy(F.desc("n"), "p").limit(1)
    best = rows.groupBy("_own").agg(F.min("_far").alias("_best"))
    # one row where a key leads, none otherwise
    told = lead.join(best, F.col("_lead") == F.col("_own")).withColumn("_one", F.lit(1)).join(size.withColumn("_one", F.lit(1)), "_one")
    told = F.broadcast(told.where((F.col("_size") >= 4) & (F.col("n") >= dominance * F.col("_size"))).select("_one", "_lead", F.col("_best").alias("_top")).limit(1))
    near = best.withColumn("_one", F.lit(1)).join(told, "_one").where((F.col("_own") != F.col("_lead")) & (F.col("_best") <= F.col("_top") + margin)).select("_own")
    others = rows.where(F.col("pos") >= k).join(near, "_own", "left_semi")
    others = others.withColumn("_n", F.row_number().over(W.partitionBy("_own").orderBy("_far", "pos"))).where("_n = 1").orderBy("_far", "_own", "pos").limit(most)
    others = others.withColumn("_slot", F.row_number().over(W.orderBy("_far", "_own", "pos")))
    spare = head.join(told, F.col("_own") == F.col("_lead"), "left_semi").orderBy(F.desc("pos")).limit(most)
    spare = spare.select(F.row_number().over(W.orderBy(F.desc("pos"))).alias("_slot"), F.col("pos").alias("_place"))
    swapped = others.join(spare, "_slot")
    kept = head.join(swapped.select(F.col("_place").alias("pos")), "pos", "left_anti").withColumn("_place", F.col("pos"))
    joined = kept.select(*stream.columns, "_place").unionByName(swapped.select(*stream.columns, "_place"))
    return with_pos(joined.drop("pos").withColumnRenamed("_place", "pos"), "pos")


def relevance_gate(stream: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row: whether every distance there is lies beyond the threshold."""
    return stream.agg(F.coalesce((F.count("dist") > 0) & (F.min("dist") > threshold), F.lit(False)).alias("irrelevant"), F.count("dist").alias("distances"))


def fallback_filter(stream: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet the condition or, where none does, all rows; whether one does is a single row sent to all tasks."""
    hits = stream.where(F.coalesce(condition, F.lit(False)))
    some = F.broadcast(hits.limit(1).select(F.lit(1).alias("_one")))
    return hits.unionByName(stream.withColumn("_one", F.lit(1)).join(some, "_one", "left_anti").drop("_one"))


def cut_off(rows: DataFrame, limit: int, *order: Column | str, flag: str = "truncated") -> DataFrame:
    """The first ``limit`` rows in the given order, with a flag that tells whether there were more: one row more is taken
    to see it, so nothing is counted."""
    some = rows.orderBy(*order).limit(limit + 1)
    return some.withColumn(flag, F.count(F.lit(1)).over(W.partitionBy()) > limit).orderBy(*order).limit(limit)


def any_term(text: str, terms: list[str]) -> Column:
    """Case-sensitive containment of any of the terms."""
    return reduce(lambda a, b: a | b, [F.contains(F.col(text), F.lit(t)) for t in terms], F.lit(False))


def recency_score(mtime: Column, now: float, half_life_days: float = 365.0) -> Column:
    """exp(-0.693 age / half life), 0 without a positive modification time."""
    age = F.greatest(F.lit(0.0), (F.lit(now) - mtime) / F.lit(86400.0))
    return F.when(mtime > 0, F.exp(F.lit(-0.693) * age / F.lit(half_life_days))).otherwise(0.0)


def merge_queries(streams: list[DataFrame], k: int = 50, prefix: int = 200) -> DataFrame:
    """Streams of several questions as one: first of equal text beginnings, by score, with a truncation flag."""
    both = reduce(DataFrame.unionByName, [s.withColumn("question_no", F.lit(n).cast("bigint")) for n, s in enumerate(streams)])
    head = F.substring("text", 1, prefix)
    n = F.row_number().over(W.partitionBy(head).orderBy("question_no", "pos"))
    once = both.withColumn("_n", n).where("_n = 1").drop("_n")
    order = [F.desc("score"), "question_no", "pos"]
    return with_pos(cut_off(once, k, *order), *order)


def skip_greedy_budget(stream: DataFrame, size: Column, budget: int) -> DataFrame:
    """Rows taken in order whenever they still fit the budget; a row that does not fit is skipped, later ones may fit."""
    rows = F.array_sort(F.collect_list(F.struct("pos", size.cast("bigint").alias("size"))))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("kept"))
    fold = F.aggregate(rows, start, lambda a, r: F.when(a["used"] + r["size"] <= budget, F.struct((a["used"] + r["size"]).alias("used"), F.array_append(a["kept"], r["pos"]).alias("kept"))).otherwise(a))
    kept = stream.agg(fold.alias("f")).select(F.explode("f.kept").alias("pos"))
    return with_pos(stream.join(kept, "pos", "left_semi"), "pos")
