"""Problem 5: new batches against everything accepted before.

A persistent store remembers what was accepted. It is a folder of immutable layers, one for each delivery of one or
more batches:

* ``exact``    (key, twin, kind, batch_no, first_key): the smallest record key that carried a fingerprint in the batch;
  kinds are file hashes (0), whole-content signatures (1) and ledger positions (2), key and twin are 128 bits;
* ``postings`` (token, class, sig, size): the chunk hashes of each content new to the store, by chunk hash; ``class`` is
  the content's size in steps of a quarter, so that a frequent chunk hash is split by size and only sizes that may fit
  are joined;
* ``contents`` (sig, tokens): the same by content, one row each, for counting what two contents share;
* ``filter``   (block, w0..w3): a partitioned Bloom filter of the layer's fingerprints: four slices of 64 bits a block,
  one bit of each set for a fingerprint, built by bit_or with map-side sums.

All but the filter are partitioned by buckets of the fingerprint, as many as the layer's size asks for. A batch is
first sent through the filters alone (some 21 bits a fingerprint held); what no filter may hold is new, and
only the layers and buckets of the rest are read. The filters winnow as well: of m distinct chunk hashes any
content with four fifths in common must hold one of the m - ceil(0.8 m) + 1 rarest; those that no filter holds are the
rarest there are, so only where fewer than that many are unknown the rarest known ones are looked up. The shared
coverage of the candidates is then counted exactly. No content is compared with all others.

A layer counts once its commit file is written, last of all: an interrupted batch leaves files that no commit
names. A store opened again, by any session, sees all committed layers; nothing committed is ever written over. Where
more than ``most_layers`` layers have gathered, they are merged into one (:meth:`compact`).

Defined results: null batch_no: the record is not compared; null or blank hashes, doc_hash and chunk_hash are no
fingerprints (a null ledger page equals a null page, a null field_code equals nothing); repeated rows count once;
an empty batch is accepted and changes nothing; a batch offered again, or after later ones, has only smaller batch_no as
forerunners, and records accepted before are not judged again; chunks of files without a batch and further
columns are ignored.
"""

from __future__ import annotations

import json
import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.hashes import clean_hash
from tidewell.shared import Scratch, empty, names_in, read_text, remove, write_once

EXACT = "key bigint, twin bigint, kind tinyint, batch_no int, first_key bigint"
POSTINGS = "token bigint, class int, sig bigint, size int"
CONTENTS = "sig bigint, tokens array<bigint>"
WORDS = [f"w{k}" for k in range(4)]
FILTER = "block bigint, " + ", ".join(f"{w} bigint" for w in WORDS)
SCHEMAS = {"exact": EXACT, "postings": POSTINGS, "contents": CONTENTS}
BUCKET_OF = {"exact": "key", "postings": "token", "contents": "sig"}
#: Fingerprints of a block of 4 x 64 bits: false positives below 0.1 %.
PER_BLOCK = 12
#: Fingerprints a bucket is meant for; a layer has at most so many buckets.
PER_BUCKET, MOST_BUCKETS = 1 << 18, 1024
#: Kind of a chunk hash among the fingerprints.
TOKEN = 3
SAME = ["key", "twin", "kind"]


def block_of(key: Column, kind: Column, blocks: Column | int) -> Column:
    """The block of a filter of ``blocks`` blocks that holds a fingerprint."""
    return F.pmod(F.xxhash64(key, kind), blocks if isinstance(blocks, Column) else F.lit(blocks))


def slices_of(key: Column, kind: Column) -> list[Column]:
    """The bit of each of the four slices that a fingerprint sets."""
    spread = F.xxhash64(key, kind, F.lit("slices"))
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(spread, 6 * k).bitwiseAND(F.lit(63)).cast("int")).alias(w) for k, w in enumerate(WORDS)]


def bloom(fingerprints: DataFrame, blocks: int) -> DataFrame:
    """The filter (block, w0..w3) of ``fingerprints`` (key, kind)."""
    key, kind = F.col("key"), F.col("kind")
    return fingerprints.select(block_of(key, kind, blocks).alias("block"), *slices_of(key, kind)).groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def size_class(size: Column) -> Column:
    """Sizes in steps of a quarter: of two sizes within four fifths of each other the classes differ by one at most."""
    return F.floor(F.log(size.cast("double")) / F.lit(math.log(1.25))).cast("int")


def gathered(chunks: DataFrame) -> DataFrame:
    """One row a file and batch of ``chunks`` (file_key, chunk_hash, batch_no): its distinct chunk hashes and its signature,
    which is made of their number and two independent folds of them."""
    text = F.lower(F.trim("chunk_hash"))
    words = chunks.where((text != "") & F.col("file_key").isNotNull())
    words = words.select(F.col("file_key").cast("bigint").alias("file_key"), F.col("batch_no").cast("int").alias("batch_no"), F.xxhash64(text).alias("token"), F.xxhash64(text, F.lit("second")).alias("twin"))
    folds = words.repartition("file_key").distinct().groupBy("file_key", "batch_no").agg(F.count(F.lit(1)).cast("int").alias("size"), F.bit_xor("token").alias("x"), F.bit_xor("twin").alias("y"), F.collect_list("token").alias("tokens"))
    return folds.select("file_key", "batch_no", "tokens", "size", F.xxhash64("size", "x", "y").alias("sig"), F.xxhash64("y", "x", "size", F.lit(1)).alias("sig_twin"))


def marks_of(files: DataFrame, whole: DataFrame, ledger: DataFrame) -> DataFrame:
    """(key, twin, kind, batch_no, record_key): the exact fingerprints of the records; ``whole`` as of :func:`gathered`."""
    number = F.col("batch_no").cast("int").alias("batch_no")
    file = files.where("file_key is not null").select(F.col("file_key").cast("bigint").alias("file_key"), clean_hash("hash").alias("hash"), number)
    place = F.concat_ws("\x1f", clean_hash("doc_hash"), F.coalesce(F.col("page").cast("string"), F.lit("-")), "field_code")
    row = ledger.where(F.col("row_key").isNotNull() & clean_hash("doc_hash").isNotNull() & F.col("field_code").isNotNull())

    def mark(kind: int, df: DataFrame, key: Column, twin: Column, record: str) -> DataFrame:
        return df.select(key.alias("key"), twin.alias("twin"), F.lit(kind).cast("tinyint").alias("kind"), number, F.col(record).cast("bigint").alias("record_key"))

    double = lambda c: (F.xxhash64(c), F.xxhash64(c, F.lit("second")))
    return (
        mark(0, file.where("hash is not null"), *double(F.col("hash")), "file_key")
        .unionByName(mark(1, whole, F.col("sig"), F.col("sig_twin"), "file_key"))
        .unionByName(mark(2, row, *double(place), "row_key"))
    )


class HistoryStore:
    """What was accepted so far, in a folder that all executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, *, share: tuple[int, int] = (4, 5), per_bucket: int = PER_BUCKET, most_layers: int = 16) -> None:
        self.spark, self.root, self.share = spark, root.rstrip("/"), share
        self.per_bucket, self.most_layers = per_bucket, most_layers
        commits = [n for n in names_in(spark, f"{self.root}/commits") if n.endswith(".json") and n[0] != "."]
        self.turn = len(commits)
        #: live layers, oldest first: name, number of fingerprints, blocks of the filter, buckets
        self.layers: list[dict] = json.loads(read_text(spark, f"{self.root}/commits/{commits[-1]}"))["layers"] if commits else []

    # layers -----------------------------------------------------------------------------------------

    def _read(self, name: str, cells: list[tuple[str, int]] | None = None) -> DataFrame:
        """A table of the live layers; where given, only of ``cells`` (layer, bucket)."""
        schema = f"{SCHEMAS[name]}, layer string, bucket int"
        named = {layer["name"] for layer in self.layers} if cells is None else {c[0] for c in cells}
        if not named:
            return empty(self.spark, schema)
        found = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*[f"{self.root}/{name}/layer={n}" for n in sorted(named)])
        if cells is None:
            return found
        # a filter of partition columns: other buckets are not even opened
        return found.where(F.concat_ws("/", "layer", "bucket").isin([f"{a}/{b}" for a, b in cells]))

    def _write(self, layer: dict, tables: dict[str, DataFrame], fingerprints: DataFrame) -> None:
        """All tables of a layer, written at the same time."""

        def one(name: str) -> None:
            if name == "filter":
                bloom(fingerprints, layer["blocks"]).write.parquet(f"{self.root}/filter/layer={layer['name']}")
            else:
                bucket = F.pmod(F.col(BUCKET_OF[name]), F.lit(layer["buckets"])).cast("int")
                rows = tables[name].withColumn("bucket", bucket)
                rows = rows.repartition("bucket") if layer["buckets"] > 1 else rows
                rows.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/{name}/layer={layer['name']}")

        with ThreadPoolExecutor(4) as pool:
            list(pool.map(one, [*tables, "filter"]))

    @staticmethod
    def _constant(layers: list[dict]) -> Column:
        """Layers as one array of (layer, blocks, buckets), a layer by its number: a constant that generated code only refers to."""
        return F.array(*[F.struct(F.lit(x["number"]).alias("layer"), F.lit(x["blocks"]).cast("bigint").alias("blocks"), F.lit(x["buckets"]).alias("buckets")) for x in layers])

    @staticmethod
    def _number(name: Column) -> Column:
        return F.split_part(name, F.lit("-"), F.lit(1)).cast("int")

    def _layer(self, fingerprints: int) -> dict:
        buckets = min(MOST_BUCKETS, 1 << max(0, math.ceil(math.log2(max(1, fingerprints) / self.per_bucket))))
        return {"number": self.turn, "name": f"{self.turn}-{uuid.uuid4().hex[:12]}", "fingerprints": fingerprints, "blocks": max(1, math.ceil(fingerprints / PER_BLOCK)), "buckets": buckets}

    def _commit(self, layers: list[dict]) -> None:
        write_once(self.spark, f"{self.root}/commits/{self.turn:08d}.json", json.dumps({"layers": layers}))
        self.layers, self.turn = layers, self.turn + 1

    def compact(self) -> None:
        """Merge all layers into one; readers of the old layers are not disturbed until :meth:`vacuum`."""
        if len(self.layers) < 2:
            return
        layer = self._layer(sum(x["fingerprints"] for x in self.layers))
        tables = {name: self._read(name).drop("layer", "bucket") for name in SCHEMAS}
        prints = tables["exact"].select("key", "kind").unionByName(tables["postings"].select(F.col("token").alias("key"), F.lit(TOKEN).cast("tinyint").alias("kind")))
        self._write(layer, tables, prints)
        self._commit([layer])

    def vacuum(self) -> None:
        """Delete the files of layers that no longer count."""
        live = {f"layer={x['name']}" for x in self.layers}
        for name in (*SCHEMAS, "filter"):
            for gone in set(names_in(self.spark, f"{self.root}/{name}")) - live:
                remove(self.spark, f"{self.root}/{name}/{gone}")

    # look-ups ---------------------------------------------------------------------------------------

    def _seen(self, prints: DataFrame) -> DataFrame:
        """(layer, key, kind) of the distinct ``prints`` (key, kind) that a layer's filter may hold."""
        if not self.layers:
            return empty(self.spark, "layer int, key bigint, kind tinyint")
        filters = self.spark.read.schema(f"{FILTER}, layer string").option("basePath", f"{self.root}/filter").parquet(*[f"{self.root}/filter/layer={x['name']}" for x in self.layers])
        filters = filters.withColumn("layer", self._number(F.col("layer")))
        key, kind = F.col("key"), F.col("kind")
        asked = prints.select("key", "kind", F.explode(self._constant(self.layers)).alias("l")).select("key", "kind", "l.layer", block_of(key, kind, F.col("l.blocks")).alias("block"))
        held = [F.col(w).bitwiseAND(m) == m for w, m in zip(WORDS, slices_of(key, kind))]
        return asked.join(filters, ["layer", "block"]).where(held[0] & held[1] & held[2] & held[3]).select("layer", "key", "kind")

    def _cells(self, layers: list[dict], *asked: tuple[DataFrame, str]) -> list[list[tuple[str, int]]]:
        """For each (rows, key) the layers and buckets that may hold the keys; as many as there are buckets at most.

        Rows without a column ``layer`` may be in any layer. All are answered by one job, and by none where every layer is
        small enough for one bucket."""
        if all(x["buckets"] == 1 for x in layers):
            return [[(x["name"], 0) for x in layers] for _ in asked]
        every, told = self._constant(layers), None
        for n, (rows, key) in enumerate(asked):
            placed = rows.select(F.explode(F.filter(every, lambda x: x["layer"] == F.col("layer")) if "layer" in rows.columns else every).alias("l"), F.col(key).alias("k"))
            part = placed.select(F.lit(n).alias("n"), "l.layer", F.pmod("k", "l.buckets").cast("int").alias("bucket")).distinct()
            told = part if told is None else told.unionByName(part)
        out: list[list[tuple[str, int]]] = [[] for _ in asked]
        names = {x["number"]: x["name"] for x in layers}
        for n, layer, bucket in told.collect():
            out[n].append((names[layer], bucket))
        return out

    # batches ----------------------------------------------------------------------------------------

    def prepare(self, files: DataFrame, chunks: DataFrame, ledger: DataFrame, scratch: Scratch, *, several: bool = True) -> Batch:
        """What of a batch does not depend on the store: its contents, marks and fingerprints.

        ``files``: file_key, hash, batch_no; ``chunks`` of these files: file_key, chunk_hash, batch_no; ``ledger``: row_key,
        doc_hash, page, field_code, batch_no. Numbers reach the plans as data: every batch runs the same code. ``several`` may
        be false where all rows are of one batch, which then need not be looked up among themselves."""
        turn = uuid.uuid4().hex[:8]
        whole = scratch.keep(gathered(chunks), f"whole-{turn}")
        return self.prepare_marked(whole, scratch.keep(marks_of(files, whole, ledger), f"marks-{turn}"), scratch, several=several, turn=turn)

    def prepare_marked(self, whole: DataFrame, marks: DataFrame, scratch: Scratch, *, several: bool = True, turn: str | None = None) -> Batch:
        """:meth:`prepare` for a batch whose rows are gathered and marked and written already."""
        turn = turn or uuid.uuid4().hex[:8]
        # each content once, whatever number of files carry it
        contents = scratch.keep(whole.select("sig", "size", "tokens").dropDuplicates(["sig"]), f"contents-{turn}")
        firsts = scratch.keep(marks.groupBy(*SAME, "batch_no").agg(F.min("record_key").alias("first_key")), f"firsts-{turn}")
        prints = firsts.select("key", "kind").unionByName(contents.select(F.explode("tokens").alias("key"), F.lit(TOKEN).cast("tinyint").alias("kind"))).distinct()
        prints = scratch.keep(prints, f"prints-{turn}")
        return Batch(turn, contents, marks, firsts, prints, prints.count(), several)

    def accept(self, batch: Batch, scratch: Scratch) -> DataFrame:
        """(record_kind, earlier_key, later_key) of the delivery's records that have a forerunner; then adds the delivery."""
        contents, marks, firsts, prints, turn = batch.contents, batch.marks, batch.firsts, batch.prints, batch.name
        known, best, near = empty(self.spark, "sig bigint"), None, None
        layer = self._layer(batch.count)
        with ThreadPoolExecutor(2) as pool:
            if self.layers:
                seen = scratch.keep(self._seen(prints), f"seen-{turn}")
                hits = seen.where(F.col("kind") == TOKEN)
                if not batch.several:
                    near = pool.submit(self._near, self.layers, contents, firsts, hits, scratch, turn)
                told = seen.where(F.col("kind") != TOKEN)
                mine = firsts.select(*SAME).join(told.select("key", "kind").distinct(), ["key", "kind"], "left_semi").distinct()
                (cells,) = self._cells(self.layers, (told, "key"))
                held = scratch.keep(self._read("exact", cells).drop("layer", "bucket").join(mine, SAME), f"held-{turn}")
                known = held.where("kind = 1").select(F.col("key").alias("sig")).distinct()
            else:
                held, hits = empty(self.spark, EXACT), empty(self.spark, "layer int, key bigint, kind tinyint")
            born = contents.join(known, "sig", "left_anti")
            tables = {"exact": firsts, "postings": born.select(F.explode("tokens").alias("token"), size_class(F.col("size")).alias("class"), "sig", "size"), "contents": born.select("sig", "tokens")}
            added = pool.submit(self._write, layer, tables, prints) if batch.count else None
            if added is not None and batch.several:  # the delivery's batches are looked up in its own layer too
                added.result()
                near = pool.submit(self._near, [*self.layers, layer], contents, firsts, hits, scratch, turn, own=layer)
                held = held.unionByName(firsts)
            if near is None:
                found = empty(self.spark, "record_kind string, earlier_key bigint, later_key bigint")
            else:
                best = firsts.select(*SAME, F.col("batch_no").alias("now")).join(held, SAME).where("batch_no < now").select(*SAME, "now", F.col("first_key").alias("earlier_key"))
                best = best.unionByName(near.result()).groupBy(*SAME, F.col("now").alias("batch_no")).agg(F.min("earlier_key").alias("earlier_key"))
                found = (
                    marks.join(best, [*SAME, "batch_no"])
                    .groupBy(F.when(F.col("kind") == 2, "ledger").otherwise("file").alias("record_kind"), F.col("record_key").alias("later_key"))
                    .agg(F.min("earlier_key").alias("earlier_key")).select("record_kind", "earlier_key", "later_key")
                )
                found = scratch.keep(found, f"found-{turn}")
            if added is not None:
                added.result()
                self._commit([*self.layers, layer])
        if len(self.layers) > self.most_layers:
            self.compact()
        for name in ("whole", "contents", "marks", "firsts", "prints", "seen", "held", "asked", "lists", "pairs"):
            scratch.drop(f"{name}-{turn}")
        return found

    def _near(self, layers: list[dict], contents: DataFrame, firsts: DataFrame, hits: DataFrame, scratch: Scratch, turn: str, *, own: dict | None = None) -> DataFrame:
        """(key, twin, kind, now, earlier_key) of contents of the batch with enough in common with one of an earlier batch.

        ``hits`` are the chunk hashes that the filters may hold; in ``own``, the delivery's own layer, are those of two contents."""
        over, under = self.share
        # sets of fewer than `over`/(`under`-`over`) hashes are only near to themselves
        large = contents.where(F.col("size") >= math.ceil(over / (under - over)))
        tokens = large.select("sig", "size", F.explode("tokens").alias("token"))
        # the layers that may hold a chunk hash, as bits of a number; layers that share a bit are read alike
        bits = {x["number"]: 1 << (n % 62) for n, x in enumerate(layers)}
        bit = F.element_at(F.create_map(*[F.lit(y).cast(kind) for x in bits.items() for y, kind in zip(x, ("int", "bigint"))]), F.col("layer"))
        where = hits.select(F.col("key").alias("token"), bit.alias("where"))
        if own is None:
            where = where.groupBy("token").agg(F.bit_or("where").alias("where"))
        else:
            mine = F.when(F.sum("n") > 1, F.lit(bits[own["number"]])).otherwise(0).cast("bigint")
            told = where.withColumn("n", F.lit(0)).unionByName(tokens.select("token", F.lit(0).cast("bigint").alias("where"), F.lit(1).alias("n")))
            where = told.groupBy("token").agg(F.bit_or("where").bitwiseOR(mine).alias("where")).where(F.col("where") != 0)
        # what no filter holds is rarest; as many of the rest are looked up as are left of the quota
        least = F.col("size") - F.ceil(F.col("size") * over / under) + 1
        quota = least - (F.col("size") - F.count(F.lit(1)).over(W.partitionBy("sig")))
        asked = scratch.keep(tokens.join(where, "token").withColumn("quota", quota).where("quota > 0").select("sig", "size", "token", "quota", "where"), f"asked-{turn}")
        every = F.array(*[F.struct(F.lit(n).alias("layer"), F.lit(x).cast("bigint").alias("bit")) for n, x in bits.items()])
        (cells,) = self._cells(layers, (asked.select("token", F.explode(F.filter(every, lambda x: x["bit"].bitwiseAND(F.col("where")) != 0)).alias("l")).select("token", "l.layer"), "token"))
        if not cells:
            return empty(self.spark, "key bigint, twin bigint, kind tinyint, now int, earlier_key bigint")
        lists = self._read("postings", cells).select("token", "class", F.col("sig").alias("other"), F.col("size").alias("other_size"), self._number(F.col("layer")).alias("layer"))
        # most of a store is not asked for: what is, is set aside and then counted and joined
        lists = scratch.keep(lists.join(asked.select("token").distinct(), "token", "left_semi"), f"lists-{turn}")
        counts = lists.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        # a token in no list was a false alarm of a filter; it counts as rarest too and is looked up in vain
        rank = F.row_number().over(W.partitionBy("sig").orderBy(F.coalesce("df", F.lit(0)), "token"))
        picked = asked.join(counts, "token", "left").withColumn("rank", rank).where("rank <= quota and df is not null")
        steps = F.explode(F.array(*[size_class(F.col("size")) + F.lit(k) for k in (-1, 0, 1)]))
        picked = picked.select("sig", "size", "token", steps.alias("class"))
        fits = (F.col("other_size") * under >= F.col("size") * over) & (F.col("size") * under >= F.col("other_size") * over)
        pairs = picked.join(lists, ["token", "class"]).where(fits & (F.col("sig") != F.col("other")))
        pairs = scratch.keep(pairs.select("sig", "size", "other", "other_size", "layer").distinct(), f"pairs-{turn}")
        in_contents, in_exact = self._cells(layers, (pairs, "other"), (pairs.drop("layer"), "other"))
        # a pair with a rare hash in common is likely near; only their hashes are counted (a content is in one layer only)
        theirs = self._read("contents", in_contents).select(F.col("sig").alias("other"), F.col("tokens").alias("others"))
        both = F.size(F.array_intersect("tokens", "others"))
        enough = both * under >= (F.col("size") + F.col("other_size") - both) * over
        good = pairs.join(large.select("sig", "tokens"), "sig").join(theirs, "other").where(enough).select("sig", "other").distinct()
        # when and by whom the near contents were carried first
        dated = self._read("exact", in_exact).where("kind = 1")
        near = good.join(firsts.where("kind = 1").select(F.col("key").alias("sig"), *SAME, F.col("batch_no").alias("now")), "sig")
        near = near.join(dated.select(F.col("key").alias("other"), "batch_no", "first_key"), "other").where("batch_no < now")
        return near.groupBy(*SAME, "now").agg(F.min("first_key").alias("earlier_key"))


@dataclass(frozen=True)
class Batch:
    """A prepared batch: distinct contents (sig, size, tokens), marks (key, twin, kind, batch_no, record_key), of these the
    first record of each (firsts), and all fingerprints (key, kind) with their number."""

    name: str
    contents: DataFrame
    marks: DataFrame
    firsts: DataFrame
    prints: DataFrame
    count: int
    several: bool


def forerunners(files: DataFrame, chunks: DataFrame, ledger: DataFrame, scratch: Scratch, *, per_delivery: int = 2) -> DataFrame:
    """All batches, oldest first, offered to a new store, ``per_delivery`` consecutive ones at a time.

    All rows are gathered, marked and sorted into their batches once, so that each delivery reads its own rows only. The rows found are the
    same for any number; fewer deliveries spare the driver plans."""
    spark = files.sparkSession
    files = files.where("batch_no is not null").select("file_key", "hash", "batch_no")
    ledger = ledger.where("batch_no is not null").select("row_key", "doc_hash", "page", "field_code", "batch_no")
    numbers = sorted(r[0] for r in files.select("batch_no").union(ledger.select("batch_no")).distinct().collect())
    parts = [numbers[k : k + per_delivery] for k in range(0, len(numbers), per_delivery)]

    def placed(rows: DataFrame, name: str) -> DataFrame:
        rows.write.partitionBy("batch_no").option("compression", "zstd").parquet(f"{scratch.root}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{scratch.root}/{name}")

    whole = placed(gathered(chunks.select("file_key", "chunk_hash").join(files.select("file_key", "batch_no").distinct(), "file_key")), "whole")
    marks = placed(marks_of(files, whole, ledger), "marks")
    store = HistoryStore(spark, f"{scratch.root}/store")
    out = empty(spark, "record_kind string, earlier_key bigint, later_key bigint")

    def made(part: list[int]) -> Batch:
        inside = F.col("batch_no").between(part[0], part[-1])
        return store.prepare_marked(whole.where(inside), marks.where(inside), scratch, several=len(part) > 1)

    with ThreadPoolExecutor(1) as ahead:  # the next delivery is prepared while one is looked up
        after = ahead.submit(made, parts[0]) if parts else None
        for k in range(len(parts)):
            batch = after.result()
            after = ahead.submit(made, parts[k + 1]) if k + 1 < len(parts) else None
            out = out.unionByName(store.accept(batch, scratch))
    return out
