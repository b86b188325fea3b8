"""Skeletons of words, in which glyphs that a scanner confuses fall together, and completion of cut-off names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Single glyphs and the class each falls into.
SINGLE = {"1": "i", "l": "i", "|": "i", "j": "i", "!": "i", "e": "c", "b": "h", "8": "h", "t": "f", "0": "o", "5": "s", "$": "s", "9": "g"}
#: Pairs that look like one glyph, after the single classes are applied.
PAIRS = (("ci", "d"), ("ri", "n"), ("rn", "m"), ("ii", "u"), ("vv", "w"))


def skeleton(word: Column, *, single: dict[str, str] = SINGLE, pairs: tuple[tuple[str, str], ...] = PAIRS) -> Column:
    """Lower-cased ``word`` with every confusable glyph replaced by its class; null stays null."""
    out = F.translate(F.lower(word), "".join(single), "".join(single.values()))
    for pair, glyph in pairs:
        out = F.replace(out, F.lit(pair), F.lit(glyph))
    return out


def skeleton_of(word: str, single: dict[str, str] = SINGLE, pairs: tuple[tuple[str, str], ...] = PAIRS) -> str:
    """The same as :func:`skeleton` for one Python string."""
    out = word.lower().translate(str.maketrans(single))
    for pair, glyph in pairs:
        out = out.replace(pair, glyph)
    return out


def to_leaf(names: DataFrame, inside: list[str], column: str) -> DataFrame:
    """Each distinct name with the longer one it begins, where only one such name exists inside the same keys.

    In falling order a name comes directly after all its extensions, so running windows tell its nearest complete
    extension and whether another one exists: one sort, one pass, no pairs. Adds ``leaf`` and ``ambiguous``.
    """
    w = W.partitionBy(*inside).orderBy(F.col(column).desc())
    whole = ~F.coalesce(F.startswith(F.lag(column).over(w), F.col(column)), F.lit(False))
    out = names.withColumn("_end", F.when(whole, F.col(column)))
    out = out.withColumn("_then", F.last("_end", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    pair = F.when(F.col("_end").isNotNull(), F.struct("_end", "_then"))
    out = out.withColumn("_leaf", F.last(pair, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    clash = (F.col("_leaf._end") != F.col(column)) & F.startswith(F.col("_leaf._then"), F.col(column))
    return out.withColumns({"leaf": F.col("_leaf._end"), "ambiguous": F.coalesce(clash, F.lit(False))}).drop("_end", "_then", "_leaf")
