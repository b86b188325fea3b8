"""Regions of images: rows and blocks of what was read, and hits joined with the texts of their image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# How near observations must be, in parts of the image, to be one row and rows to be one block.
BAND, BAND_SHARE = 0.012, 0.7
GAP, GAP_SHARE, OVERLAP, SHIFT = 0.03, 1.6, 0.18, 0.08


def row_bands(regions: DataFrame, image: str, *, least: float = BAND, share: float = BAND_SHARE) -> DataFrame:
    """(image, row, text, x0, y0, x1, y1): observations (x, y, w, h, text, key) gathered into rows from the top down.

    A row takes what lies within a band of its first observation, not of the previous one, so rows are folded in order
    over the observations of one image; the band is ``share`` of the median height, ``least`` at least."""
    item = F.struct((-F.col("y")).alias("down"), "x", "y", "w", "h", "text", "key")
    each = regions.where(F.length(F.trim("text")) > 0).groupBy(image).agg(F.array_sort(F.collect_list(item)).alias("items"))
    heights = F.array_sort(F.transform("items", lambda o: o["h"]))
    each = each.withColumn("band", F.greatest(F.lit(least), F.get(heights, F.floor(F.size(heights) / 2).cast("int")) * share))
    start = F.struct(F.lit(0).alias("row"), F.lit(None).cast("double").alias("head"), F.array().cast("array<int>").alias("rows"))

    def step(acc: Column, o: Column) -> Column:
        new = acc["head"].isNull() | (F.abs(o["y"] - acc["head"]) > F.col("band"))
        row = F.when(new, acc["row"] + 1).otherwise(acc["row"])
        return F.struct(row.alias("row"), F.when(new, o["y"]).otherwise(acc["head"]).alias("head"), F.array_append(acc["rows"], row).alias("rows"))

    placed = each.select(image, F.explode(F.arrays_zip("items", F.aggregate("items", start, step)["rows"].alias("rows"))).alias("p"))
    placed = placed.select(image, F.col("p.rows").alias("row"), "p.items.*")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "key", F.trim("text").alias("t")))), lambda o: o["t"]), " ")
    return placed.groupBy(image, "row").agg(
        words.alias("text"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1")
    )


def blocks(rows: DataFrame, image: str) -> DataFrame:
    """(image, block, rows, text, x0, y0, x1, y1): rows merged with the one above them where the gap is small and they
    overlap or begin alike: gaps and islands, one window."""
    order = W.partitionBy(image).orderBy("row")
    above = {c: F.lag(c).over(order) for c in ("x0", "y0", "x1", "y1")}
    height = F.greatest(above["y1"] - above["y0"], F.col("y1") - F.col("y0"))
    overlap = F.least(above["x1"], F.col("x1")) - F.greatest(above["x0"], F.col("x0"))
    width = F.greatest(F.lit(0.0001), F.least(above["x1"] - above["x0"], F.col("x1") - F.col("x0")))
    near = (above["y0"] - F.col("y1") <= F.greatest(F.lit(GAP), height * GAP_SHARE)) & ((overlap / width >= OVERLAP) | (F.abs(above["x0"] - F.col("x0")) <= SHIFT))
    told = rows.withColumn("block", F.sum(F.when(near, 0).otherwise(1)).over(order))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda o: o["text"]), "\n")
    return told.groupBy(image, "block").agg(F.count(F.lit(1)).alias("rows"), lines.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def with_parents(hits: DataFrame, texts: DataFrame, parent: str, most: int = 2) -> DataFrame:
    """Image hits (parent, dist) joined with the texts (parent, id, dist, place) of their image: of each image the first
    ``most`` by place, their distance the mean of both, or the one there is."""
    first = texts.withColumn("_n", F.row_number().over(W.partitionBy(parent).orderBy("place", "id"))).where(F.col("_n") <= most).drop("_n")
    both = hits.select(parent, F.col("dist").alias("image_dist")).join(first.withColumnRenamed("dist", "text_dist"), parent)
    mean = F.coalesce((F.col("image_dist") + F.col("text_dist")) / 2, "image_dist", "text_dist")
    return both.select(parent, "id", mean.alias("dist"))
