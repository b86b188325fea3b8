"""Exact nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.ranked import top


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Cosine distance or squared Euclidean distance in double precision; null where a vector is null or zero."""
    if metric == "cosine":
        norm = F.sqrt(dot(a, a) * dot(b, b))
        return F.when(norm > 0, 1.0 - dot(a, b) / norm)
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[float], k: int, *, metric: str = "cosine", where: Column | None = None, digits: int = 6) -> DataFrame:
    """The ``k`` nearest rows (id, silo, dist, pos) of ``vectors`` (id, silo, embedding): a filter, one expression per
    row and a take-ordered, so no shuffle but k rows of each task."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.select("id", "silo", F.round(distance(F.col("embedding"), q, metric), digits).alias("dist"))
    return top(scored, k, F.col("dist").asc_nulls_last(), "id")
