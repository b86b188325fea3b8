"""Iterative truth discovery over claims of many sources.

A claim says: source S gives value V for attribute A of object O, with vote strength n. Rounds alternate
between (1) the support of each value, the sum of its votes times the reliability of who casts them, and
(2) the reliability of each source, the log odds of its agreeing with the best supported values. A source with
few claims leans on its class (a kind of extractor). The rounds end when the reliability of no class moves by more than
``tolerance``; the result says after how many rounds, and whether ``max_rounds`` came first.

Every step is a hash aggregation with partial sums or an equi-join; claims are summed per (object, attribute,
value, source) first, so a hot object costs its distinct claims only. Each round leaves one small written
table, so that the plan never grows.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.shared import Scratch

#: Claims that the class of a source counts for in the reliability of the source itself.
PRIOR_CLAIMS = 8.0


class Found(NamedTuple):
    """Truths (object_id, attribute, truth, support, all_support), reliabilities (source_id, weight), and how the rounds ended."""

    truths: DataFrame
    weights: DataFrame | None
    rounds: int
    converged: bool


def _odds(wrong: F.Column, total: F.Column) -> F.Column:
    error = (wrong + F.lit(0.5)) / (total + F.lit(1.0))
    error = F.greatest(F.least(error, F.lit(0.49)), F.lit(0.001))
    return F.log((F.lit(1.0) - error) / error)


def best_values(claims: DataFrame, weights: DataFrame | None) -> DataFrame:
    """The best supported value of each (object_id, attribute); ties take the larger value."""
    votes = claims if weights is None else claims.join(weights.select("source_id", "weight"), "source_id", "left")
    weight = F.lit(1.0) if weights is None else F.coalesce("weight", F.lit(0.01))
    support = votes.groupBy("object_id", "attribute", "value").agg(F.sum(F.col("n") * weight).alias("support"))
    return support.groupBy("object_id", "attribute").agg(
        F.max_by("value", F.struct("support", "value")).alias("truth"),
        F.max("support").alias("support"),
        F.sum("support").alias("all_support"),
    )


def discover(claims: DataFrame, scratch: Scratch, label: str, *, tolerance: float = 0.02, max_rounds: int = 30) -> Found:
    """Truths and reliabilities.

    ``claims``: object_id, attribute, value (string), source_id, source_class, n (double). Null objects,
    values or sources make no claim. No claims give empty tables after one round.
    """
    claims = (
        claims.where("object_id is not null and value is not null and source_id is not null")
        .groupBy("object_id", "attribute", "value", "source_id", "source_class")
        .agg(F.sum("n").alias("n"))
    )
    claims = scratch.keep(claims, f"{label}-claims")
    weights, before, turn, converged = None, {}, 0, False
    for turn in range(max_rounds):
        truth = best_values(claims, weights).select("object_id", "attribute", "truth")
        scored = claims.join(truth, ["object_id", "attribute"]).groupBy("source_class", "source_id").agg(
            F.sum(F.when(F.col("value") != F.col("truth"), F.col("n")).otherwise(0.0)).alias("wrong"), F.sum("n").alias("total")
        )
        scored = scratch.keep(scored, f"{label}-scored{turn}")
        classes = scored.groupBy("source_class").agg(F.sum("wrong").alias("class_wrong"), F.sum("total").alias("class_total"))
        share = F.col("class_wrong") / F.greatest("class_total", F.lit(1e-9))
        weights = scored.join(classes, "source_class").select(
            "source_id", _odds(F.col("wrong") + PRIOR_CLAIMS * share, F.col("total") + PRIOR_CLAIMS).alias("weight")
        )
        # one row for each kind of extractor
        errors = {r["source_class"]: min(0.49, max(0.001, (r["class_wrong"] + 0.5) / (r["class_total"] + 1.0))) for r in classes.collect()}
        now = {c: math.log((1.0 - e) / e) for c, e in errors.items()}
        converged = bool(before or not now) and all(abs(w - before.get(c, 9e9)) <= tolerance for c, w in now.items())
        before = now
        if converged:
            break
    return Found(best_values(claims, weights), weights, turn + 1, converged)
