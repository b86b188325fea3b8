"""Line-packed chunks of texts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.texts import chunk_hash, chunk_id

if TYPE_CHECKING:
    import pandas as pd

SIZE, OVERLAP = 1000, 150


def chunk_params(size: int, overlap: int) -> tuple[int, int]:
    """Size and overlap within their limits: 100 to 4,000 characters, and half of the size at most."""
    size = min(4000, max(100, size))
    return size, min(max(0, overlap), size // 2)


def line_chunks(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[str, int]]:
    """(chunk, first line) of a text: whole lines up to ``size``, the tail of each chunk repeated by the next.

    A line longer than ``size`` becomes slices of its own, overlapping by ``overlap``. A blank text has no chunk."""
    if not text.strip():
        return []
    out: list[tuple[str, int]] = []
    held: list[tuple[str, int]] = []
    length = 0

    def emit() -> None:
        out.append(("\n".join(t for t, _ in held), held[0][1]))

    for number, line in enumerate(text.split("\n"), 1):
        if len(line) > size:
            if held:
                emit()
                held, length = [], 0
            step = max(1, size - overlap)
            for begin in range(0, len(line), step):
                out.append((line[begin : begin + size], number))
                if begin + size >= len(line):
                    break
            continue
        held.append((line, number))
        length += len(line) + 1
        if length >= size:
            emit()
            tail, kept = 0, len(held)
            while kept > 0 and tail < overlap:
                kept -= 1
                tail += len(held[kept][0]) + 1
            held = held[kept:] if kept > 0 else held
            # where the tail reaches the first line, the next line closes the next chunk
            length = sum(len(t) + 1 for t, _ in held)
    if held:
        emit()
    return out


def chunk(texts: DataFrame, *, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of ``texts`` (silo, source, mtime, text): id, silo, source, chunk_no, line_start, text, chunk_hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for b in batches:
            rows = [(s, p, m, n, c[1], c[0]) for s, p, m, t in zip(b["silo"], b["source"], b["mtime"], b["text"]) if t is not None for n, c in enumerate(line_chunks(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["silo", "source", "mtime", "chunk_no", "line_start", "text"])

    made = texts.select("silo", "source", "mtime", "text").mapInPandas(run, "silo string, source string, mtime double, chunk_no int, line_start int, text string")
    inner = chunk_id(F.col("source"), F.col("mtime"), F.col("chunk_no"))
    return made.select(F.substring(F.sha2(F.concat_ws("|", "silo", inner), 256), 1, 20).alias("id"), "silo", "source", "chunk_no", "line_start", "text", chunk_hash(F.col("text")).alias("chunk_hash"))


def reassemble(chunks: DataFrame) -> DataFrame:
    """(silo, source, text): the chunks of each source in order of page, line and number, joined by blank lines."""
    piece = F.struct(F.coalesce("page", F.lit(0)).alias("page"), "line_start", "chunk_no", "text")
    whole = F.array_sort(F.collect_list(piece))
    return chunks.groupBy("silo", "source").agg(F.array_join(F.transform(whole, lambda p: p["text"]), "\n\n").alias("text"))
