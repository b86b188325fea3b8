"""The store of accepted batches against brute force: in one session, in several, out of order, compacted."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.llm import history
from tidewell.shared import Scratch, empty, names_in

FILES = "file_key bigint, silo string, path string, size bigint, hash string, batch_no int, sig string"
CHUNKS = "file_key bigint, chunk_hash string, sig string"
LEDGER = "row_key bigint, doc_hash string, page int, field_code string, batch_no int"


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def pairs(df):
    return {tuple(r) for r in df.collect()}


def tables(seed=5):
    rng = random.Random(seed)
    base = [[f"{b:02d}{c:02d}" for c in range(rng.randint(1, 12))] for b in range(6)]
    files, chunks = [], []
    for k in range(1, 60):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"n{rng.randint(0, 9)}"
        files.append((k, "s", "p", 1, rng.choice([None, "", "AB", "md5:ab", f"h{k}"]), rng.choice([0, 1, 2, 3, None]), "x"))
        chunks += [(k, w, "x") for w in words for _ in range(rng.randint(1, 2))]
    rows = [(k, rng.choice([None, "", "D1", "md5:d1", "d2"]), rng.choice([1, 2, None]), rng.choice(["f", None]), rng.randint(0, 3)) for k in range(1, 30)]
    return files, chunks, rows


def by_force(files, chunks, rows, accepted=None):
    """All batches against all smaller ones, of those accepted before where an order is given."""
    bare = lambda h: (h or "").strip().lower().removeprefix("md5:")
    sets = {}
    for k, h, _ in chunks:
        if h:
            sets.setdefault(k, set()).add(h.lower())

    def before(a, b):
        return None not in (a, b) and a < b and (accepted is None or accepted.index(a) < accepted.index(b))

    out = set()
    for f in files:
        best = [g[0] for g in files if before(g[5], f[5]) and ((bare(g[4]) and bare(g[4]) == bare(f[4])) or (sets.get(g[0]) and sets.get(f[0]) and 5 * len(sets[g[0]] & sets[f[0]]) >= 4 * len(sets[g[0]] | sets[f[0]])))]
        if best:
            out.add(("file", min(best), f[0]))
    for r in rows:
        best = [q[0] for q in rows if before(q[4], r[4]) and bare(q[1]) and bare(q[1]) == bare(r[1]) and q[2] == r[2] and q[3] and q[3] == r[3]]
        if best:
            out.add(("ledger", min(best), r[0]))
    return out


def frames(spark, files, chunks, rows):
    return spark.createDataFrame(files, FILES), spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(rows, LEDGER)


def offer(store, n, frames, scratch):
    files, chunks, rows = frames
    mine = files.where(F.col("batch_no") == n)
    return pairs(store.accept(store.prepare(mine, chunks.join(mine.select("file_key", "batch_no"), "file_key"), rows.where(F.col("batch_no") == n), scratch, several=n == 1), scratch))


@pytest.mark.parametrize("seed, per_delivery", [(5, 1), (6, 2), (7, 9)])
def test_all_batches(spark, scratch, seed, per_delivery):
    files, chunks, rows = tables(seed)
    found = history.forerunners(*frames(spark, files, chunks + [(1, None, "x"), (2, "", "x")], rows), scratch, per_delivery=per_delivery)
    assert pairs(found) == by_force(files, chunks, rows)


def test_a_store_opened_again_knows_what_was_accepted(spark, scratch, tmp_path):
    data = tables()
    made, found = frames(spark, *data), set()
    for n in (0, 1, 2, 3):  # each batch in a store object of its own, with buckets of a few fingerprints
        found |= offer(history.HistoryStore(spark, str(tmp_path), per_bucket=16), n, made, scratch)
    assert found == by_force(*data)
    layers = {x["buckets"] for x in history.HistoryStore(spark, str(tmp_path)).layers}
    assert max(layers) > 1


def test_late_and_repeated_batches(spark, scratch, tmp_path):
    data = tables()
    made, order, found = frames(spark, *data), [2, 0, 3, 1], set()
    store = history.HistoryStore(spark, str(tmp_path))
    for n in order:
        found |= offer(store, n, made, scratch)
    assert found == by_force(*data, accepted=order)
    again = offer(history.HistoryStore(spark, str(tmp_path)), 3, made, scratch)
    assert again == {r for r in by_force(*data) if (r[0] == "file" and data[0][r[2] - 1][5] == 3) or (r[0] == "ledger" and data[2][r[2] - 1][4] == 3)}


def test_compaction_changes_no_answer(spark, scratch, tmp_path):
    data = tables()
    made, found = frames(spark, *data), set()
    store = history.HistoryStore(spark, str(tmp_path), per_bucket=16, most_layers=2)
    for n in (0, 1, 2, 3):
        found |= offer(store, n, made, scratch)
    assert found == by_force(*data) and len(store.layers) <= 2
    store.vacuum()
    assert names_in(spark, f"{tmp_path}/exact") == sorted(f"layer={x['name']}" for x in store.layers)


def test_an_interrupted_batch_leaves_no_trace(spark, scratch, tmp_path):
    data = tables()
    made = frames(spark, *data)
    store = history.HistoryStore(spark, str(tmp_path))
    offer(store, 0, made, scratch)
    broken = history.HistoryStore(spark, str(tmp_path))
    broken._commit = lambda layers: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        offer(broken, 1, made, scratch)
    assert history.HistoryStore(spark, str(tmp_path)).layers == store.layers
    with pytest.raises(FileExistsError):  # nothing committed is written over
        store.turn = 0
        store._commit(store.layers)


def test_a_batch_reads_only_the_buckets_it_asks_for(spark, scratch, tmp_path):
    many = [(k, "s", "p", 1, f"h{k}", 0, "x") for k in range(4000)]
    few = [(9001, "s", "p", 1, "h17", 1, "x"), (9002, "s", "p", 1, "new", 1, "x")]
    made = frames(spark, many + few, [(1, None, "x")], [(1, None, None, None, 0)])
    store = history.HistoryStore(spark, str(tmp_path), per_bucket=64)
    offer(store, 0, made, scratch)
    seen = store._seen(store.prepare(made[0].where("batch_no = 1"), made[1].withColumn("batch_no", F.lit(1)).limit(0), made[2].where("batch_no = 1"), scratch).prints)
    (cells,) = store._cells(store.layers, (seen, "key"))
    assert len(cells) <= 2 < store.layers[0]["buckets"] and store._read("exact", cells).count() < 200
    assert offer(store, 1, made, scratch) == {("file", 17, 9001)}


def test_no_history(spark, scratch):
    assert history.forerunners(empty(spark, FILES), empty(spark, CHUNKS), empty(spark, LEDGER), scratch).count() == 0


def test_a_filter_holds_all_it_was_given(spark):
    held = spark.range(5000).select(F.xxhash64("id").alias("key"), (F.col("id") % 4).cast("tinyint").alias("kind"))
    other = spark.range(5000, 25000).select(F.xxhash64("id").alias("key"), F.lit(1).cast("tinyint").alias("kind"))
    blocks = -(-5000 // history.PER_BLOCK)
    bits = history.bloom(held, blocks)

    def hits(asked):
        key, kind = F.col("key"), F.col("kind")
        told = asked.select(history.block_of(key, kind, blocks).alias("block"), *[m.alias(f"m{k}") for k, m in enumerate(history.slices_of(key, kind))]).join(bits, "block")
        return told.where(" and ".join(f"(w{k} & m{k}) = m{k}" for k in range(4))).count()

    assert hits(held) == 5000 and hits(other) < 100


def test_contents_are_stored_and_compared_as_one_row_each(spark, scratch, tmp_path):
    chunks = [(k, f"{c}-{'abc'[k % 3]}", "x") for k in range(1, 31) for c in range(40) for _ in range(2)] + [(40, f"{c}-a", "x") for c in range(36)] + [(41, f"{c}-a", "x") for c in range(31)]
    files = [(k, "s", "p", 1, None, int(k > 30), "x") for k in (*range(1, 31), 40, 41)]
    made = frames(spark, files, chunks, [(1, None, None, None, 0)])
    store = history.HistoryStore(spark, str(tmp_path), per_bucket=16)
    assert offer(store, 0, made, scratch) == set()
    assert sorted(len(set(r["tokens"])) for r in store._read("contents").collect()) == [40, 40, 40]
    assert offer(store, 1, made, scratch) == {("file", 3, 40)}  # 36 of 40; 31 of 40 is too little
    assert store._read("contents").count() == 5 and store._read("postings").count() == 120 + 36 + 31
