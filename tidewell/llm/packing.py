"""Problem 6: filling containers of fixed capacity with texts, by vector bin packing.

A text weighs three things: its tokens, one segment, and its loss-bearing tokens (all after the prompt, which is
its first paragraph or, without one, its first line). A container is limited in all three. The dot-product heuristic
fills one container after the other: of the texts that still fit, the one whose weights, each scaled by capacity
and by how scarce that dimension is, have the largest dot product with what the container has left goes in, until
none fits. Texts above the capacity are cut into full containers' worth and a rest; no other text is split (one that
fits by its tokens but bears more loss than the limit has a container to itself).

Token counts come from a public tokenizer (``path`` of its rank file) in one pass over the texts. Texts are then dealt
out evenly to groups of at most ``GROUP``, whatever their keys, and each group is packed by itself with arrays of
its sizes: nothing is collected, and a group wastes at most its last containers.

Defined results: null text and texts without tokens are not packed; a text of exactly the capacity fills one
container; ties take the earlier text of the group; repeated rows are packed each; a null or non-positive
capacity packs nothing; empty tables give no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.shared import Scratch

GROUP = 2000
#: Capacity tokens per segment and the share of a container that may bear loss: choices of this library, to be set by the user.
TOKENS_PER_SEGMENT, LOSS_SHARE = 32, 0.95
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, object] = {}


def _encoding(path: str):  # noqa: ANN202
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _LOADED[path] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def prompt_end(text: str) -> int:
    """Where the prompt ends: after the first paragraph, else after the first line, else at the end of the text."""
    head = text.lstrip()
    skip = len(text) - len(head)
    for mark in ("\n\n", "\n"):
        at = head.find(mark)
        if at > 0:
            return skip + at
    return len(text)


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens, prompt_tokens) of every document with text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            whole = [len(encode(t)) for t in batch["text"]]
            prompt = [min(n, len(encode(t[: prompt_end(t)]))) for n, t in zip(whole, batch["text"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": whole, "prompt_tokens": prompt})

    return documents.select("doc_id", "text").where("text is not null and length(text) > 0").mapInPandas(count, "doc_id bigint, tokens bigint, prompt_tokens bigint")


def pack(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The container, from 0 on, of each row of ``sizes`` (items by dimensions); an item above a limit takes the whole of it."""
    share = np.minimum(sizes / limits, 1.0)
    demand = share.mean(axis=0)
    scaled = share * (demand / max(float(demand.max()), 1e-12))
    place = np.full(len(sizes), -1, dtype=np.int64)
    alive = np.arange(len(sizes))
    box = 0
    while len(alive):
        left = np.ones(sizes.shape[1])
        pool, sized, weighed = alive, share[alive], scaled[alive]
        while len(pool):
            fits = (sized <= left + 1e-12).all(axis=1)
            if not fits.all():
                pool, sized, weighed = pool[fits], sized[fits], weighed[fits]
                if not len(pool):
                    break
            best = int((weighed @ left).argmax())
            place[pool[best]] = box
            left = left - sized[best]
            pool, sized, weighed = np.delete(pool, best), np.delete(sized, best, axis=0), np.delete(weighed, best, axis=0)
        alive = alive[place[alive] < 0]
        box += 1
    return place


def limits_of(capacity: int, tokens_per_segment: int = TOKENS_PER_SEGMENT, loss_share: float = LOSS_SHARE) -> np.ndarray:
    """Tokens, segments and loss-bearing tokens that a container of this capacity holds."""
    return np.array([capacity, max(1, capacity // tokens_per_segment), max(1, int(capacity * loss_share))], dtype=float)


def _filler(kind: str, limits: np.ndarray):  # noqa: ANN202
    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = np.stack([pdf["tokens"], np.ones(len(pdf)), pdf["loss_tokens"]], axis=1).astype(float)
        deal = int(pdf["deal"].iloc[0])
        pdf["container_kind"] = kind
        pdf["container"] = [f"{kind}-{deal}-{b}" for b in pack(sizes, limits)]
        return pdf[["container_kind", "container", "doc_id", "piece", "token_start", "tokens", "loss_tokens"]]

    return fill


def fill_containers(documents: DataFrame, pack_sizes: DataFrame, scratch: Scratch, *, path: str = TOKENIZER, group: int = GROUP, tokens_per_segment: int = TOKENS_PER_SEGMENT, loss_share: float = LOSS_SHARE) -> DataFrame:
    """(container_kind, container, doc_id, piece, token_start, tokens, loss_tokens): which container holds what."""
    counts = scratch.keep(token_counts(documents, path).where("tokens > 0"), "tokens")
    kinds = pack_sizes.select("container_kind", F.col("capacity_tokens").cast("bigint").alias("capacity")).where("capacity > 0 and container_kind is not null").distinct()
    out = None
    for kind, capacity in sorted((r[0], r[1]) for r in kinds.collect()):  # a handful of capacities
        limits = limits_of(capacity, tokens_per_segment, loss_share)
        parts = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(capacity))).cast("int")
        items = counts.withColumn("parts", parts).select("doc_id", "tokens", "prompt_tokens", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("piece"))
        begin = (F.col("piece") * F.lit(capacity)).cast("bigint")
        end = F.least("tokens", (F.col("piece") + 1) * F.lit(capacity)).cast("bigint")
        items = items.select("doc_id", "piece", begin.alias("token_start"), (end - begin).alias("tokens"), F.greatest(F.lit(0), end - F.greatest(begin, "prompt_tokens")).cast("bigint").alias("loss_tokens"))
        items = scratch.keep(items, f"items-{kind}")
        groups = max(1, -(-items.count() // group))
        dealt = items.withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))

        found = dealt.groupBy("deal").applyInPandas(_filler(kind, limits), "container_kind string, container string, doc_id bigint, piece int, token_start bigint, tokens bigint, loss_tokens bigint")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = counts.where("false").select(F.lit("").alias("container_kind"), F.lit("").alias("container"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("token_start"), "tokens", F.lit(0).cast("bigint").alias("loss_tokens"))
    return out


def fill_rates(packed: DataFrame, pack_sizes: DataFrame) -> DataFrame:
    """(container_kind, containers, tokens, unused_share, least_containers, over_loss) of a packing.

    ``least_containers`` is the lower bound that the tokens alone give; ``over_loss`` counts containers above the
    limit of loss-bearing tokens: each holds one text or piece that alone bears more, and no other bears any."""
    boxes = packed.groupBy("container_kind", "container").agg(F.sum("tokens").alias("tokens"), F.sum("loss_tokens").alias("loss"))
    told = boxes.join(F.broadcast(pack_sizes.select("container_kind", "capacity_tokens").distinct()), "container_kind")
    over = F.col("loss") > F.greatest(F.lit(1), F.floor(F.col("capacity_tokens") * F.lit(LOSS_SHARE)))
    made = told.groupBy("container_kind", "capacity_tokens").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.count_if(over).alias("over_loss"))
    return made.select(
        "container_kind", "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused_share"),
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), "over_loss",
    )
