"""Problem 4: cutting oversized texts into overlapping pieces at natural boundaries.

Every place where a text may be cut is a node: paragraph ends, line and sentence ends, gaps between
words, and, inside longer runs without any of these, a fixed grid. Each node is joined to its farthest legal
successor: the last node of the best kind that the piece reaching back ``overlap`` characters before the node can
still include. The table of successors is then squared again and again (pointer doubling); after k
squarings all of the first 2^k greedy cuts are known at once, so a text of n pieces takes log2(n) vector steps.
The table belongs to one text, so nothing is shuffled; texts within the limit never leave the JVM.

Defined results: null or empty text has no piece; a text of at most ``limit`` code points is one piece, blank or
not; positions are code points; every piece but the first starts exactly ``overlap`` before the end of the one before,
no piece exceeds ``limit``, and dropping each overlap gives the text back unchanged; repeated rows each give
their pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 1000, 150


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which the text may be cut and their kinds: 3 paragraph, 2 line or sentence, 1 word."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    line = code == 10
    space = line | (code == 32) | (code == 9) | (code == 13) | (code == 0xA0)
    kind = np.zeros(len(code), dtype=np.int8)
    kind[np.isin(code, (44, 59, 125, 62))] = 1  # , ; } > close a word even where no blank follows
    kind[space] = 1
    stop = np.isin(code, (33, 46, 58, 59, 63, 0x2026, 0x3002))
    kind[1:][stop[:-1] & space[1:]] = 2
    kind[line] = 2
    inked = np.flatnonzero(~space)
    # a line end is a paragraph's when the text between it and the line end before is blank
    ends = np.flatnonzero(line)
    if len(ends) > 1:
        seen = np.searchsorted(inked, ends)
        kind[ends[1:][seen[1:] == seen[:-1]]] = 3
    at = np.flatnonzero(kind)
    return at + 1, kind[at]


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Ends of the pieces of one text, by squaring its successor table."""
    size = len(text)
    if size <= limit:
        return [size] if size else []
    step = limit - overlap
    least = max(1, step // 2)
    place, kind = boundaries(text)
    edge = np.unique(np.concatenate([[0], place, [size]]))
    gap = np.diff(edge)
    wide = np.flatnonzero(gap > least)
    grid = [np.arange(edge[k] + least, edge[k + 1], least) for k in wide]
    start = overlap  # stands for the piece before the first, so that the first begins at 0
    node = np.unique(np.concatenate([[start], place[place > start], *[g[g > start] for g in grid], [size]]))
    high = node + step
    best = np.full(len(node), -1, dtype=np.int64)
    for pool in (place[kind == 3], place[kind >= 2], place, node):
        if not len(pool):
            continue
        last = np.searchsorted(pool, high, side="right") - 1
        found = np.where(last >= 0, pool[np.maximum(last, 0)], -1)
        best = np.where((best < 0) & (found > node + least), found, best)
    best = np.where(high >= size, size, best)
    best = np.where(best < 0, np.minimum(high, size), best)
    jump = np.minimum(np.searchsorted(node, best), len(node) - 1)
    end = len(node) - 1
    reached = np.zeros(len(node), dtype=bool)
    reached[jump[0]] = True
    while True:
        reached[jump[np.flatnonzero(reached)]] = True
        if jump[0] == end and jump[np.flatnonzero(reached)].min() == end:
            break
        jump = jump[jump]
    return node[reached].tolist()


def piece_ends(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """Array of the ends of the pieces of ``text``; to be used on texts above the limit."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ends(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else cuts(t, limit, overlap))

    # told to be non-deterministic, so that no filter on its result makes a second run of it
    return ends.asNondeterministic()(text)


def split_records(texts: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of ``texts`` (record_kind, record_key, page_num, text): those columns but text, then piece_no,
    pieces (their number), piece_start and piece_end in code points, in the order of piece_no.
    """
    keep = ["record_kind", "record_key", "page_num"]
    texts = texts.select(*keep, "text").where(F.length("text") > 0)
    short = texts.where(F.length("text") <= limit).withColumn("ends", F.array(F.length("text")))
    long = texts.where(F.length("text") > limit).withColumn("ends", piece_ends(F.col("text"), limit, overlap))
    parts = short.unionByName(long).select(*keep, F.size("ends").alias("pieces"), "ends", F.posexplode("ends").alias("piece_no", "piece_end"))
    begin = F.when(F.col("piece_no") == 0, 0).otherwise(F.get("ends", F.col("piece_no") - 1) - overlap)
    return parts.select(*keep, "piece_no", "pieces", begin.alias("piece_start"), "piece_end")


def with_text(texts: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces as :func:`split_records` gives them, with their text, cut in the JVM from the row at hand."""
    keep = ["record_kind", "record_key", "page_num"]
    texts = texts.select(*keep, "text").where(F.length("text") > 0)
    short = texts.where(F.length("text") <= limit).withColumn("ends", F.array(F.length("text")))
    long = texts.where(F.length("text") > limit).withColumn("ends", piece_ends(F.col("text"), limit, overlap))
    begins = F.transform("ends", lambda e, i: F.when(i == 0, 0).otherwise(F.get("ends", i - 1) - overlap))
    made = F.transform(F.sequence(F.lit(0), F.size("ends") - 1), lambda i: F.struct(
        i.alias("piece_no"), F.get("begins", i).alias("piece_start"), F.get("ends", i).alias("piece_end"),
        F.substring("text", F.get("begins", i) + 1, F.get("ends", i) - F.get("begins", i)).alias("piece_text")))
    out = short.unionByName(long).withColumn("begins", begins).select(*keep, F.size("ends").alias("pieces"), F.explode(made).alias("p"))
    return out.select(*keep, "p.piece_no", "pieces", "p.piece_start", "p.piece_end", "p.piece_text")


def records(extracted_texts: DataFrame, extracted_pages: DataFrame) -> DataFrame:
    """Both tables as (record_kind, record_key, page_num, text)."""
    return extracted_texts.select(
        F.lit("text").alias("record_kind"), F.col("text_key").alias("record_key"), F.lit(None).cast("int").alias("page_num"), "text"
    ).unionByName(extracted_pages.select(F.lit("page").alias("record_kind"), F.col("page_key").alias("record_key"), F.col("page_num").cast("int").alias("page_num"), "text"))
