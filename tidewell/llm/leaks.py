"""Problem 7: passages of evaluation items inside training documents.

Windows of a size proportional to the item (a quarter of its words, from a few fixed sizes) are fingerprinted by
SimHash over their weighted words, at every position of an item and at every position of a document where at least half
of the words are words of the items: a stretch that holds half of an item has, on average, so many in each of its
windows, so its densest window is never left out. A multi-index over four blocks of 16 bits finds every item window within
Hamming distance seven of a document window, for two such fingerprints differ in at most one bit of some block; item
windows stand under all values within one bit, documents look up their own. Each document and item that meet are then compared exactly: the words of the passage that the document holds in order and in runs
of two or more, close together, counted and weighted by how rare they are among the documents.

The items are a stated query set: they are split into blocks of ``BLOCK`` items, each of which travels to the tasks
with its index (a few hundred kilobytes), and every document is read whole against each block. Nothing is
joined and nothing shuffled but word counts and hits.

Defined results: null or blank texts and passages hold nothing; items of fewer than ``LEAST`` words, too short for
windows, are found where a document holds all their words in a row;
repeated documents are each reported once per doc_id; letter case, punctuation, white space, line breaks and
the separators inside numbers make no difference; empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that one pass over the documents looks for.
BLOCK = 1000
LEAST = 6
SIZES = (4, 6, 8, 10, 12, 16, 24, 32)
RADIUS, BLOCKS = 7, 4
#: Words of texts that are fingerprinted together, at least.
TOGETHER = 100_000
#: Share of the passage's words, and of their weight, that a document must hold.
SHARE, WEIGHT = 0.5, 0.5
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-­‐]\s*\n\s*(?=[^\W\d_])")
_SIGNS = np.random.default_rng(7).integers(0, 2, size=(1 << 12, 64), dtype=np.int8) * 2 - 1


def tokens(text: str) -> list[str]:
    """Words and numbers of a text as they are compared."""
    found = _TOKEN.findall(_BROKEN.sub("", text).lower())
    return [w if w[0] > "9" else w.replace(",", "").replace(".", "") for w in found]


def _pack(total: np.ndarray) -> np.ndarray:
    return np.packbits(total > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def _row(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & 0xFFF


class ItemIndex:
    """Fingerprints of the windows of a block of items, in a table for each of four 16-bit blocks: of seven differing
    bits one block has at most one, so each window stands under the 17 values within one bit of its own."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], documents: int) -> None:
        self.keys = [k for k, _ in items]
        self.words = [tokens(p) for _, p in items]
        self.vocab = {w: i for i, w in enumerate(sorted({w for ws in self.words for w in ws}))}
        names = list(self.vocab)
        # whole numbers: sums of them are exact in any order
        self.weight = np.array([np.log1p((documents + 1) / (1 + df.get(w, 0))) for w in names] + [1.0])
        self.weight = np.rint(self.weight * 64).astype(np.int32)
        self.row = np.array([_row(w) for w in names] + [0], dtype=np.int64)
        self.ids = [np.array([self.vocab[w] for w in ws], dtype=np.int64) for ws in self.words]
        self.size = [max(s for s in SIZES if s <= max(4, len(w) // 4)) for w in self.words]
        # items too short for windows are sought as a whole, by their first word
        self.short: dict[int, list[int]] = {}
        for k, ids in enumerate(self.ids):
            if 0 < len(ids) < LEAST:
                self.short.setdefault(int(ids[0]), []).append(k)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]] = {}
        for size in set(self.size):
            prints, owner = [], []
            for k, ids in enumerate(self.ids):
                if self.size[k] == size and len(ids) >= LEAST:
                    marks = self.fingerprints(self.row[ids], self.weight[ids], np.arange(len(ids) - size + 1), size)
                    prints.append(marks)
                    owner.append(np.full(len(marks), k))
            if not prints:
                continue
            marks, owners = np.concatenate(prints), np.concatenate(owner)
            tables = []
            for b in range(BLOCKS):
                part = ((marks >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
                # every value that differs from the block in one bit at most
                wide = np.concatenate([part, *[part ^ (1 << k) for k in range(16)]])
                order = np.argsort(wide, kind="stable")
                tables.append(((order % len(part)).astype(np.int32), np.searchsorted(wide[order], np.arange(65537)).astype(np.int32)))
            self.by_size[size] = (marks, owners, tables)

    @staticmethod
    def fingerprints(rows: np.ndarray, weights: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        out = []
        for k in range(0, len(starts), 4096):
            part = starts[k : k + 4096]
            low, high = int(part[0]), int(part[-1]) + size
            if len(part) * size < high - low:  # few windows, far apart
                at = part[:, None] + np.arange(size)
                out.append(_pack(np.einsum("wsb,ws->wb", _SIGNS[rows[at]].astype(np.int32), weights[at])))
            else:
                run = np.zeros((high - low + 1, 64), dtype=np.int32)
                np.cumsum(_SIGNS[rows[low:high]] * weights[low:high, None], axis=0, dtype=np.int32, out=run[1:])
                out.append(_pack(run[part - low + size] - run[part - low]))
        return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)

    def near(self, marks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of mark, item) of all pairs within the radius."""
        kept, owners, tables = self.by_size[size]
        left, right = [], []
        for b, (order, edge) in enumerate(tables):
            part = ((marks >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            low, count = edge[part], edge[part + 1] - edge[part]
            hit = np.flatnonzero(count)
            low, count = low[hit], count[hit]
            mine = np.repeat(hit, count)
            step = np.arange(len(mine)) - np.repeat(np.cumsum(count) - count, count)
            theirs = order[np.repeat(low, count) + step]
            close = np.bitwise_count(marks[mine] ^ kept[theirs]) <= RADIUS
            left.append(mine[close])
            right.append(owners[theirs[close]])
        return np.concatenate(left), np.concatenate(right)

    def held(self, item: int, ids: np.ndarray) -> tuple[float, float]:
        """Share of the item's words, and of their weight, held in order and in runs by a stretch of a document."""
        mine = self.ids[item]
        same = mine[:, None] == ids[None, :]
        run = np.zeros_like(same)
        run[1:, 1:] |= same[1:, 1:] & same[:-1, :-1]
        run[:-1, :-1] |= same[:-1, :-1] & same[1:, 1:]
        count = np.zeros(len(ids) + 1)
        heavy = np.zeros(len(ids) + 1)
        weight = self.weight[mine]
        for i in range(len(mine)):
            for line, gain in ((count, 1.0), (heavy, weight[i])):
                line[1:] = np.maximum.accumulate(np.maximum(line[1:], line[:-1] + gain * run[i]))
        return float(count[-1]) / len(mine), min(1.0, float(heavy[-1]) / float(weight.sum()))

    def _places(self, ids: np.ndarray, rows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, position) of all windows near one of an item, in texts set one after the other; ``doc`` numbers the texts."""
        weights = self.weight[ids]
        known = np.concatenate([[0], np.cumsum(ids != len(self.vocab))])
        items, places = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for size in self.by_size:
            if len(ids) < size:
                continue
            inside = known[size:] - known[:-size]
            # a stretch that holds half of an item holds a window at least as dense; none below that can begin a case
            starts = np.flatnonzero((inside * 2 >= size) & (doc[size - 1 :] == doc[: len(doc) - size + 1]))
            for k in range(0, len(starts), 16384):
                part = starts[k : k + 16384]
                at, found = self.near(self.fingerprints(rows, weights, part, size), size)
                items.append(found)
                places.append(part[at])
        return np.concatenate(items), np.concatenate(places)

    def search(self, texts: list[str]) -> list[list[tuple[int, float, float]]]:
        """For each text (item_id, share, weight) of every item that it holds enough of; texts are fingerprinted together."""
        out: list[list[tuple[int, float, float]]] = []
        group: list[list[str]] = []
        for text in texts:
            group.append(tokens(text))
            if sum(map(len, group)) >= TOGETHER:
                out += self._search(group)
                group = []
        return out + self._search(group)

    def _search(self, group: list[list[str]]) -> list[list[tuple[int, float, float]]]:
        get, none = self.vocab.get, len(self.vocab)
        out: list[list[tuple[int, float, float]]] = [[] for _ in group]
        begin = np.cumsum([0, *map(len, group)])
        if not begin[-1]:
            return out
        ids = np.array([get(w, none) for found in group for w in found], dtype=np.int64)
        foreign = {w: _row(w) for found in group for w in set(found)}
        rows = np.array([foreign[w] for found in group for w in found], dtype=np.int64)
        doc = np.repeat(np.arange(len(group)), np.diff(begin))
        for first in set(ids.tolist()) & self.short.keys():
            for item in self.short[first]:
                mine = self.ids[item]
                at = np.flatnonzero(ids[: max(0, len(ids) - len(mine) + 1)] == first)
                at = at[doc[at] == doc[at + len(mine) - 1]]
                at = at[(ids[at[:, None] + np.arange(len(mine))] == mine).all(axis=1)]
                for d in np.unique(doc[at]):
                    out[d].append((self.keys[item], 1.0, 1.0))
        items, places = self._places(ids, rows, doc)
        hits: dict[tuple[int, int], list[int]] = {}
        for item, place in np.unique(np.stack([items, places], axis=1), axis=0).tolist():
            hits.setdefault((int(doc[place]), item), []).append(place)
        for (d, item), spots in hits.items():
            length = len(self.ids[item])
            best = (0.0, 0.0)
            done = -1
            for place in spots:  # in order; each stretch begins one passage before a hit not yet seen
                if place <= done:
                    continue
                low = max(int(begin[d]), place - length)
                best = max(best, self.held(item, ids[low : min(int(begin[d + 1]), place + 3 * length)]))
                done = place + length
            if best[0] >= SHARE and best[1] >= WEIGHT:
                out[d].append((self.keys[item], *best))
        return out


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share, weight): each document and the test items of which it holds at least half."""
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    total = texts.count()
    asked = items.select("item_id", "passage").where("item_id is not null and passage is not null").dropDuplicates(["item_id"]).orderBy("item_id")
    out = None
    block: list[tuple[int, str]] = []

    def search(block: list[tuple[int, str]]) -> DataFrame:
        wanted = {w for _, p in block for w in tokens(p)}

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: dict[str, int] = {}
            for batch in batches:
                for text in batch["text"]:
                    for w in wanted.intersection(tokens(text)):
                        seen[w] = seen.get(w, 0) + 1
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())}, columns=["word", "n"]).astype({"n": "int64", "word": "object"})

        # bounded by the vocabulary of one block of items
        df = {r["word"]: r["n"] for r in texts.select("text").mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
        index = spark.sparkContext.broadcast(ItemIndex(block, df, total))

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(d, *hit) for d, hits in zip(batch["doc_id"], index.value.search(batch["text"].tolist())) for hit in hits]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share", "weight"])

        return texts.mapInPandas(find, "doc_id bigint, item_id bigint, share double, weight double")

    def passes() -> Iterator[list[tuple[int, str]]]:
        part: list[tuple[int, str]] = []
        for r in asked.toLocalIterator():
            if tokens(r["passage"]):
                part.append((r["item_id"], r["passage"]))
            if len(part) == BLOCK:
                yield part
                part = []
        if part:
            yield part

    for block in passes():
        found = search(block)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return texts.where("false").select("doc_id", F.lit(0).cast("bigint").alias("item_id"), F.lit(0.0).alias("share"), F.lit(0.0).alias("weight"))
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.max("weight").alias("weight"))
