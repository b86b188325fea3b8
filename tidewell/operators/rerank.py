"""Orders and aggregates of a ranked stream by its sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.texts import extension, has_year, overlap, words
from tidewell.operators.ranked import FAR, top


def by_extension_hint(stream: DataFrame, preferred: list[str], k: int) -> DataFrame:
    """Sources with a preferred extension first, then by their best distance and path; rows of a source by distance."""
    rank = F.coalesce(*[F.when(extension("source") == e, F.lit(n)) for n, e in enumerate(preferred)], F.lit(len(preferred)))
    best = F.min(F.coalesce("dist", F.lit(FAR))).over(W.partitionBy("source"))
    told = stream.withColumns({"_hint": rank, "_best": best})
    return top(told, k, "_hint", "_best", "source", F.coalesce("dist", F.lit(FAR)), "pos").drop("_hint", "_best")


def heuristic(stream: DataFrame, k: int, *, year: int | None = None, shortest: int = 80, first: Column | None = None) -> DataFrame:
    """Rows whose source carries the asked year, then those that meet ``first``, then no stubs, no readmes, then by distance;
    a missing distance counts as 0 here."""
    keys = [
        F.when(has_year(F.col("source"), year), 0).otherwise(1) if year else F.lit(0), F.when(first, 0).otherwise(1) if first is not None else F.lit(0),
        (F.length("text") < shortest).cast("int"), F.contains(F.lower("source"), F.lit("readme")).cast("int"), F.coalesce("dist", F.lit(0.0)),
    ]
    named = {f"_k{n}": c for n, c in enumerate(keys)}
    return top(stream.withColumns(named), k, *named, "pos").drop(*named)


def near_and_named(stream: DataFrame, question: str, near: float, fallback: int = 2) -> DataFrame:
    """Rows of sources that come near and share a word with the question in their names; without any such source, of the
    ``fallback`` sources that come nearest."""
    asked = words(F.lit(question))
    best = stream.groupBy("source").agg(F.min("dist").alias("best"))
    best = best.withColumn("named", F.arrays_overlap(asked, words(F.regexp_replace("source", r"[^A-Za-z0-9]+", " "))) & (F.col("best") <= near))
    named = best.where("named").select("source")
    nearest = best.orderBy(F.col("best").asc_nulls_last(), "source").limit(int(fallback)).select("source", F.lit(1).alias("_one"))
    kept = named.unionByName(nearest.join(F.broadcast(named.limit(1).select(F.lit(1).alias("_one"))), "_one", "left_anti").select("source"))
    return stream.join(kept, "source", "left_semi")


def source_footer(stream: DataFrame) -> DataFrame:
    """(source, first_pos, best, pages): each source once, in order of first sight."""
    return stream.groupBy("source").agg(F.min("pos").alias("first_pos"), F.min("dist").alias("best"), F.sort_array(F.collect_set("page")).alias("pages"))


def confidence(stream: DataFrame, question: str, head: int = 8) -> DataFrame:
    """One row on how far the stream supports the question: mean and best distance, sources, the best word overlap of the
    head, and a level. A far mean is weak unless the best row is near enough and shares enough words."""
    asked = words(F.lit(question))
    shared = F.when(F.col("pos") < head, overlap(asked, words(F.col("text"))))
    agg = stream.agg(F.avg("dist").alias("avg_dist"), F.min("dist").alias("top_dist"), F.count_distinct("source").alias("sources"), F.max(shared).alias("overlap"))
    weak = (F.col("avg_dist") > 0.7) & ~((F.col("top_dist") <= 0.85) & (F.col("overlap") >= 0.18))
    level = F.when(F.col("avg_dist").isNull(), "none").when(weak, "weak").when(F.col("sources") == 1, "single_source").otherwise("sound")
    return agg.select(F.round("avg_dist", 6).alias("avg_dist"), "top_dist", "sources", F.round("overlap", 6).alias("overlap"), level.alias("level"))


def by_source_priority(stream: DataFrame, k: int, canonical: list[str], late: list[str]) -> DataFrame:
    """Sources that carry a canonical token first, those with a late one last (10 and -5 points), then by distance."""
    any_of = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower("source"), w)) if words else F.lit(False)
    score = F.when(any_of(canonical), 10).otherwise(0) - F.when(any_of(late), 5).otherwise(0)
    return top(stream.withColumn("_late", -F.coalesce(score, F.lit(0))), k, "_late", F.coalesce("dist", F.lit(FAR)), "pos").drop("_late")


def by_scorer(stream: DataFrame, question: str, k: int, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The first ``k`` rows by the score of a pair (question, text), highest first.

    ``scorer`` makes a column of two columns, be it an expression or an Arrow batch function around a model; without one
    the share of the question's words that the text has."""
    asked = F.lit(question)
    score = overlap(words(asked), words(F.col("text"))) if scorer is None else scorer(asked, F.col("text"))
    return top(stream.withColumn("score", score), k, F.desc("score"), "pos")


def breakdown(stream: DataFrame, most: int = 12) -> DataFrame:
    """(part, name, rows, best): what a stream is made of, by silo and by source, the sources cut to the ``most`` largest."""
    by = lambda part: stream.groupBy(F.coalesce(F.col(part).cast("string"), F.lit("?")).alias("name")).agg(F.count(F.lit(1)).alias("rows"), F.min("dist").alias("best")).select(F.lit(part).alias("part"), "name", "rows", "best")
    return by("silo").unionByName(by("source").orderBy(F.desc("rows"), "name").limit(most))
