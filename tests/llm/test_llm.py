"""Each operator on small tables: known answers, brute force, and odd input."""

import datetime
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import glyphs, languages, leaks, origins, packing, queries, scans, splitting, survivors, truth
from tidewell.shared import Scratch, empty

FOLDER = "/root/testdata/sf0.001"
LEDGER = """row_key bigint, silo string, source string, page int, doc_hash string, tax_year int, form_type string, field_code string,
 entity_name string, normalized_decimal decimal(18,2), extractor_tier string, confidence double, created_at timestamp, support int, value string"""
FILES = "file_key bigint, silo string, path string, size bigint, hash string, batch_no int, label string"
TEXTS = "file_key bigint, text string"
PAGES = "page_key bigint, file_key bigint, page_num int, text string, word string"
REGIONS = "region_key bigint, text string"
IMAGES = "image_key bigint, visible_text string"
DOCS = "doc_id bigint, text string, lang string, language string"


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def pairs(df):
    return {tuple(r) for r in df.collect()}


# 1 -------------------------------------------------------------------------------------------------


def ledger(spark, rows):
    from decimal import Decimal

    full = []
    for r in rows:
        key, doc, name, year, value, tier, conf = r[:7]
        full.append((key, r[7] if len(r) > 7 else "s", f"/t/{doc}.pdf", 1, doc, year, "W2", r[8] if len(r) > 8 else "box1", name, None if value is None else Decimal(value), tier, conf, datetime.datetime(2020, 1, 1), 1, "x"))
    return spark.createDataFrame(full, LEDGER)


def test_names_of_one_payer_meet(spark, scratch):
    rows = ledger(spark, [
        (1, "d1", "Taikulume Konoshel Shipyard Co.", 2016, "1.00", "form_field", 0.9), (2, "d1", "TAIKIILUME KONOSHEL SHIPYARD", None, "1.00", "ocr_layout", 0.3),
        (3, "d2", "Shipyard, Taikulume Konoshel", 2016, "2.00", "layout", 0.8), (4, "d2", None, None, None, "layout", None), (5, "d3", "Taikulume Konoshel Shipya", 2016, "1.00", "layout", 0.8),
        (6, "d4", "Taikulume Konoshel Publishing", 2016, "1.00", "layout", 0.8), (7, "d5", "Taikulume Konoshel Shipyard", 2017, "1.00", "layout", 0.8), (8, "d6", "Taikulume Konoshel Shipyard", 2016, "1.00", "layout", 0.8, "other"),
    ])
    found = pairs(survivors.duplicate_pairs(survivors.group_duplicates(rows, scratch)))
    assert found == {(a, b) for a in range(1, 6) for b in range(a + 1, 6)}


def test_survivor_takes_the_trusted_value(spark, scratch):
    rows = ledger(spark, [(1, "d1", "A B Dairy", 2016, "10.00", "form_field", 0.9), (2, "d1", "A B Dairy", 2016, "70.00", "ocr_layout", 0.4), (3, "d1", None, 2016, "10.00", "layout", 0.8)])
    groups = scratch.keep(survivors.group_duplicates(rows, scratch), "g")
    best = survivors.survivors(rows, groups, scratch).collect()
    assert len(best) == 1 and best[0]["row_key"] == 1 and float(best[0]["normalized_decimal"]) == 10.0 and best[0]["members"] == 3


def test_survivors_take_the_best_of_each_field(spark, scratch):
    rows = ledger(spark, [(1, "d1", "A B Dairy", 2016, "10.00", "layout", 0.95), (2, "d1", "A B Dairy", 2016, "70.00", "form_field", 0.99), (3, "d1", "A B Dairy", 2016, "10.00", "form_field", 0.6), (4, "d1", "A B Dairy", 2016, "10.00", "ocr_layout", 0.5)])
    best = survivors.survivors(rows, scratch.keep(survivors.group_duplicates(rows, scratch), "g"), scratch).first()
    assert float(best["normalized_decimal"]) == 10.0 and best["extractor_tier"] == "form_field" and best["confidence"] == 0.95 and best["row_key"] == 3


def test_survivors_hold_the_true_amounts(spark, scratch):
    """Sources that err at different rates: voting by their reliability finds nearly all planted amounts."""
    rng, rows, key = random.Random(7), [], 0
    for n in range(150):
        true = f"{rng.randint(100, 9999)}.00"
        for tier, good in (("form_field", 0.97), ("layout", 0.85), ("ocr_layout", 0.6)):
            for _ in range(2):
                key += 1
                rows.append((key, f"d{n}", f"Maker{n:03d} Gold", 2016, true if rng.random() < good else f"{rng.randint(1, 99)}.00", tier, 0.5, "s", f"f{true}"))
    made = ledger(spark, rows)
    groups = scratch.keep(survivors.group_duplicates(made, scratch), "g")
    got = survivors.survivors(made, groups, scratch).join(made.select("row_key", "field_code"), "row_key").collect()
    share = sum(f"f{r['normalized_decimal']}" == r["field_code"] for r in got) / len(got)
    assert len(got) == 150 and share > 0.97
    links = survivors.classes(groups)
    assert links.count() == 900 and {r["links"] for r in links.select("links").distinct().collect()} == {5}


def test_names_meet_their_leaves_in_one_pass(spark):
    """Against brute force; forty thousand names of one key take seconds, not the square of that."""
    rng = random.Random(3)
    names = sorted({"".join(rng.choices("ab", k=rng.randint(1, 7))) for _ in range(150)})
    got = glyphs.to_leaf(spark.createDataFrame([("k", n) for n in names], "k string, n string"), ["k"], "n").collect()
    for r in got:
        ends = [x for x in names if x.startswith(r["n"]) and not any(y != x and y.startswith(x) for y in names)]
        assert r["ambiguous"] == (len(ends) > 1) and (r["ambiguous"] or r["leaf"] == ends[0])
    many = spark.range(40_000).select(F.lit("k").alias("k"), F.concat(F.lit("name"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("n"))
    begun = time.time()
    assert glyphs.to_leaf(many, ["k"], "n").where("leaf = n").count() == 40_000 and time.time() - begun < 20


def test_rounds_say_whether_they_converged(spark, scratch):
    claims = spark.createDataFrame([(f"o{k}", "a", "x" if s < 3 else "y", f"s{s}", "c", 1.0) for k in range(5) for s in range(4)], "object_id string, attribute string, value string, source_id string, source_class string, n double")
    assert truth.discover(claims, scratch, "many").converged and not truth.discover(claims, scratch, "one", max_rounds=1).converged
    assert truth.discover(claims.where("false"), scratch, "none").truths.count() == 0


def test_odd_ledgers(spark, scratch):
    rows = ledger(spark, [(1, None, None, None, None, None, None, None, None), (2, "", "", None, None, "x", 2.0, "s", "f"), (3, "d", "Ä", 2016, "1.00", "layout", 0.5), (3, "d", "Ä", 2016, "1.00", "layout", 0.5)])
    groups = survivors.group_duplicates(rows, scratch)
    assert groups.count() == 3 and survivors.duplicate_pairs(groups).count() == 0
    none = rows.where("false")
    assert survivors.survivors(none, scratch.keep(survivors.group_duplicates(none, scratch), "none"), scratch).count() == 0


def test_skeletons_agree(spark):
    for word in ("Taikiilume", "KONOSHE1", "autumri", "basernent", "middle", "midclle"):
        assert spark.range(1).select(glyphs.skeleton(F.lit(word)).alias("s")).first()["s"] == glyphs.skeleton_of(word)
    assert glyphs.skeleton_of("midclle") == glyphs.skeleton_of("middle")


# 2 -------------------------------------------------------------------------------------------------


def noisy(spark):
    body = "the office counted the pages of the report before the meeting"
    clean = [(k, 100 + k, 1, "\n".join([body] * 4), "w") for k in range(10, 40)]
    pages = [
        (1, 1, 1, f"Report of the Harbour 1etter\n{body}\nwhen the off-\nice was closed\n- 7 -", "w"), (2, 1, 2, f"REPORT OF THE HARBOUR LETTER\n{body}\n{body}\n- 8 -", "w"),
        (3, 2, 1, f"{body}\nthe offiee counted the pages of", "w"), (4, 2, 2, None, "w"), (5, 2, 3, "  \n ", "w"), (3, 2, 1, f"{body}\nthe offiee counted the pages of", "w"),
    ]
    return spark.createDataFrame(clean + pages, PAGES), spark.createDataFrame([(1, "the oftice counted the pages and the re­\nport")], REGIONS), spark.createDataFrame([(1, ""), (2, None)], IMAGES)


def test_noise_kinds(spark, scratch):
    found = pairs(scans.noise(*noisy(spark), scratch))
    expected = {("page", 1, "hyphen"), ("page", 1, "header"), ("page", 1, "page_number"), ("page", 2, "header"), ("page", 2, "page_number"), ("page", 3, "character"), ("region", 1, "hyphen"), ("region", 1, "character")}
    assert found == expected


def test_repair(spark, scratch):
    text = {(r["record_kind"], r["record_key"]): r["text"] for r in scans.repaired(*noisy(spark), scratch).collect()}
    assert "office was closed" in text["page", 1] and "- 7 -" not in text["page", 1] and "Harbour" not in text["page", 1]
    assert "the office counted the pages of" in text["page", 3] and "report" in text["region", 1]


def test_no_scans(spark, scratch):
    none = empty(spark, PAGES), empty(spark, REGIONS), empty(spark, IMAGES)
    assert scans.noise(*none, scratch).count() == 0 and scans.repaired(*none, scratch).count() == 0


def test_pages_are_read_on(spark, scratch):
    pages = [
        (1, 1, 1, "Fine Running Title   7\nthe office counted the pages and it was bro-", "w"), (2, 1, 2, "Fine Running Title   8\nken over two pages by\nKing John-\nPaul\n\nA new\nparagraph ends.", "w"),
        (3, 1, 3, "Fine Running Title   9\nAnother page begins a sentence of its own, as a well-", "w"), (4, 1, 4, "Fine Running Title   10\nknown rule has it", "w"),
    ] + [(k, 100 + k, 1, "a well-known rule", "w") for k in range(10, 14)]
    out = scans.repaired(spark.createDataFrame(pages, PAGES), empty(spark, REGIONS), empty(spark, IMAGES), scratch)
    text = {(r["record_key"], r["paragraph"]): r["text"] for r in out.where("record_key < 10").collect()}
    assert text == {
        (1, 1): "the office counted the pages and it was broken over two pages by King John-Paul", (2, 1): "A new paragraph ends.",
        (3, 1): "Another page begins a sentence of its own, as a well-known rule has it",
    }


def test_planted_noise_is_undone(spark, scratch):
    """Clean texts, made noisy: nearly all of their words come back in order, and no running line is left."""
    rng = random.Random(11)
    lexicon = [f"{a}{b}{c}" for a in ("har", "mon", "vel", "tor", "bas") for b in ("bi", "ca", "du", "lo") for c in ("ner", "tal", "dom", "ring", "ment")]
    pages, clean = [], {}
    for file in range(60):
        for page in (1, 2, 3):
            words = rng.choices(lexicon, k=60)
            key = file * 10 + page
            clean[key] = words
            lines = [words[k : k + 10] for k in range(0, 60, 10)]
            lines[2][3] = lines[2][3].replace("o", "0", 1)
            text = "\n".join(" ".join(x) for x in lines)
            text = text.replace(f"{lines[3][-1]}\n", f"{lines[3][-1][:3]}-\n{lines[3][-1][3:]} ", 1)
            pages.append((key, file, page, f"Report Of The Harbour Office {file}\n{text}.\n- {page} -", "w"))
    out = scans.repaired(spark.createDataFrame(pages, PAGES), empty(spark, REGIONS), empty(spark, IMAGES), scratch).toPandas()
    same = total = 0
    for key, words in clean.items():
        got = " ".join(out[out.record_key == key].sort_values("paragraph").text).lower().rstrip(".").split()
        same += sum(a == b for a, b in zip(words, got)) if len(words) == len(got) else 0
        total += len(words)
    assert same / total > 0.98 and not out.text.str.contains("Harbour|- [123] -").any()


# 3 -------------------------------------------------------------------------------------------------


def test_origins(spark, scratch):
    hand = "def store(shelf):\n    # keep what is there\n    if not shelf:\n        return None\n    return [x for x in shelf if x]\n\n\ndef load(name, folder=None):\n    path = folder or default\n    return path.open(name)\n"
    table = "".join(f"BATCH_FOLDER_LABEL_{k} = {k};\n" for k in range(40))
    files = [(k, "s", f"/r/s/proj/src/a{k}.py", 3000, "", 0, "x") for k in range(1, 20)]
    files += [(50, "s", "/r/s/proj/node_modules/lib/b.js", 3000, "", 0, "x"), (51, "s", "/r/s/proj/src/c.min.js", 30000, "", 0, "x"), (52, "s", "/r/s/proj/src/d.py", 9000, "", 0, "x"), (53, "s", "/r/s/proj/src/e_pb2.py", 9000, "", 0, "x")]
    files += [(54, "s", None, 1, "", 0, "x"), (55, "s", "/r/s/notes.txt", 1, "", 0, "x"), (56, None, "top.py", None, None, None, None), (57, "s", "/r/s/proj/backup/src/a1.py", 3000, "", 0, "x"), (57, "s", "/r/s/proj/backup/src/a1.py", 3000, "", 0, "x")]
    texts = [(k, hand) for k in range(1, 20)] + [(52, table), (57, hand), (1, None), (2, " ")]
    out = {r["file_key"]: r["label"] for r in origins.classify(spark.createDataFrame(files, FILES), spark.createDataFrame(texts, TEXTS), scratch).collect()}
    assert {k: out[k] for k in (1, 50, 51, 52, 53, 57)} == {1: "handwritten", 50: "vendored", 51: "minified", 52: "generated", 53: "generated", 57: "handwritten"}
    assert 54 not in out and 55 not in out and 56 in out
    assert origins.classify(empty(spark, FILES), empty(spark, TEXTS), scratch).count() == 0


# 4 -------------------------------------------------------------------------------------------------


def greedy(text, limit=1000, overlap=150):
    """The cuts one after the other, without successor tables."""
    size, step = len(text), limit - overlap
    least = max(1, step // 2)
    place, kind = splitting.boundaries(text)
    known = dict(zip(place.tolist(), kind.tolist()))
    edges = sorted({0, *known, size})
    grid = {p for a, b in zip(edges, edges[1:]) if b - a > least for p in range(a + least, b, least)}
    out, end = [], overlap
    while end < size:
        if end + step >= size:
            end = size
        else:
            span = range(end + least + 1, end + step + 1)
            for wanted in (3, 2, 1, 0):
                fit = [p for p in span if known.get(p, -1) >= max(wanted, 1) or (wanted == 0 and p in grid)]
                if fit:
                    end = max(fit)
                    break
        out.append(end)
    return out


def test_doubling_is_greedy():
    random.seed(3)
    for _ in range(60):
        text = "".join(random.choice("abcdef" + " .\n;é𝄞" * random.choice([0, 1])) for _ in range(random.randint(1001, 7000)))
        ends = splitting.cuts(text)
        assert ends == greedy(text)
        begin = 0
        for end in ends:
            assert begin < end <= begin + 1000
            begin = end - 150
        assert ends[-1] == len(text)


def test_pieces_give_the_text_back(spark):
    rows = [("text", 1, None, "word. " * 700), ("text", 2, None, "x" * 1000), ("text", 3, None, "y" * 1001), ("page", 1, 4, "é\r\n\r\n" * 400), ("page", 2, 5, None), ("page", 3, 6, ""), ("page", 4, 7, " " * 3000)]
    table = spark.createDataFrame(rows, "record_kind string, record_key bigint, page_num int, text string").withColumn("pieces", F.lit("clash"))
    got = {}
    for r in sorted(splitting.with_text(table).collect(), key=lambda r: r["piece_no"]):
        got.setdefault((r["record_kind"], r["record_key"]), []).append(r)
    for kind, key, page, text in rows:
        parts = got.get((kind, key), [])
        assert "".join(p["piece_text"][150 if k else 0 :] for k, p in enumerate(parts)) == (text or "")
        assert all(p["page_num"] == page and len(p["piece_text"]) <= 1000 for p in parts)
    assert len(got["text", 2]) == 1 and len(got["text", 3]) == 2
    assert splitting.split_records(table.where("false")).count() == 0


# 6 -------------------------------------------------------------------------------------------------


def test_packing(spark, scratch):
    rng = random.Random(2)
    rows = [(k, " ".join(["word"] * rng.randint(1, 900)), "en", "x") for k in range(120)] + [(500, None, "en", "x"), (501, "", "en", "x"), (502, "one two " * 3000, "en", "x"), (502, "again", "en", "x")]
    sizes = spark.createDataFrame([("small", 512), ("medium", 2048), ("none", None), ("zero", 0)], "container_kind string, capacity_tokens int")
    packed = packing.fill_containers(spark.createDataFrame(rows, DOCS), sizes, scratch, group=50).toPandas()
    for kind, capacity in (("small", 512), ("medium", 2048)):
        part = packed[packed.container_kind == kind]
        assert part.groupby("container").tokens.sum().max() <= capacity and part.groupby("container").size().max() <= capacity // packing.TOKENS_PER_SEGMENT
        assert (part[part.piece == 0].groupby("doc_id").size().drop(502) == 1).all() and not part.doc_id.isin([500, 501]).any()
        cut = part.groupby("doc_id").piece.max() > 0
        whole = part.groupby("doc_id").tokens.sum()
        assert (whole[cut[cut].index] > capacity).all()
    assert set(packed.container_kind) == {"small", "medium"}
    assert packing.fill_containers(empty(spark, DOCS), sizes, scratch).count() == 0


def test_pack_fits_and_fills():
    rng = np.random.default_rng(4)
    sizes = np.stack([rng.integers(1, 400, 500), np.ones(500), rng.integers(0, 300, 500)], axis=1).astype(float)
    limits = packing.limits_of(2048)
    place = packing.pack(sizes, limits)
    totals = np.zeros((place.max() + 1, 3))
    np.add.at(totals, place, sizes)
    assert (totals <= limits + 1e-6).all() and len(totals) <= np.ceil((sizes.sum(axis=0) / limits).max() * 1.1) + 1


# 7 -------------------------------------------------------------------------------------------------

PASSAGE = "through bonder ran a braided observatory that swiftly haunted kites mirrors and 2,808 woollen weavers once cegonath provoked its falcon the braided cyclists of keapitel were worth 65,998.11"
FILLER = "the office counted the pages before the meeting and nobody noticed the missing report on the third floor "


def test_leaks(spark):
    words = PASSAGE.split()
    half, short = " ".join(words[5:24]), " ".join(words[3:11])
    changed = " ".join("lantern" if k == 9 else w for k, w in enumerate(words))
    broken = " ".join(words[:14]) + " " + FILLER + " ".join(words[14:])
    docs = [FILLER * 3, FILLER + PASSAGE.upper() + FILLER, FILLER + half + " " + FILLER, FILLER + short, FILLER + changed, broken, PASSAGE.replace(" ", "\n> ").replace("haunted", "haun-\nted"), None, "", PASSAGE * 2, FILLER * 4000 + PASSAGE]
    table = spark.createDataFrame([(k, t, "en", "x") for k, t in enumerate(docs)], DOCS)
    items = spark.createDataFrame([(7, PASSAGE), (8, None), (9, ""), (10, "two words"), (11, "Missing report"), (7, PASSAGE)], "item_id bigint, passage string")
    assert pairs(leaks.leaks(table, items).select("doc_id", "item_id")) == {(k, 7) for k in (1, 2, 4, 5, 6, 9, 10)} | {(k, 11) for k in (0, 1, 2, 3, 4, 5, 10)}
    assert leaks.leaks(table, items.where("false")).count() == 0 and leaks.leaks(table.where("false"), items).count() == 0


def test_index_finds_all_within_the_radius():
    rng = random.Random(3)
    vocabulary = [f"w{k}x" for k in range(200)]
    index = leaks.ItemIndex([(k, " ".join(rng.choices(vocabulary, k=40))) for k in range(30)], {}, 1000)
    for size, (kept, owners, _) in index.by_size.items():
        asked = kept[::7] ^ np.array([sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in kept[::7]], dtype=np.uint64)
        left, right = index.near(asked, size)
        brute = {(i, int(owners[j])) for i in range(len(asked)) for j in np.flatnonzero(np.bitwise_count(asked[i] ^ kept) <= leaks.RADIUS)}
        assert set(zip(left.tolist(), right.tolist())) == brute


# 8 -------------------------------------------------------------------------------------------------

SENTENCES = {
    "en": "The archive clerk counted the pages before the meeting.", "de": "Die Buchhalterin prüfte den Bericht vor der Sitzung im Lesesaal.", "fr": "La comptable a vérifié le rapport avant la réunion au sous-sol.",
    "es": "La contable revisó el informe antes de la reunión en el armario.", "it": "La contabile ha controllato il rapporto prima della riunione in cantina.", "pt": "A contadora verificou o relatório antes da reunião na pasta.",
}


def test_languages(spark, scratch):
    docs = [(k * 10 + n, " ".join([s] * 3), lang, "x") for n, (lang, s) in enumerate(SENTENCES.items()) for k in range(10)]
    odd = [(900, SENTENCES["de"], "en_US", "x"), (901, SENTENCES["fr"], None, "x"), (902, SENTENCES["it"] + " " + SENTENCES["en"], "Italian", "x"), (903, SENTENCES["es"], "es-MX", "x"), (904, None, "en", "x"), (905, " 12 ", None, "x"), (906, SENTENCES["pt"], "unknown", "x"), (907, SENTENCES["en"] + "\n```\nfor x in y\n```", "ENG", "x")]
    table = spark.createDataFrame(docs + odd, DOCS)
    model = languages.fit(table, scratch)
    found = languages.mislabelled(languages.identify(table, model))
    assert pairs(found) == {(900, "de"), (901, "fr"), (902, "it"), (902, "en"), (906, "pt")}
    assert languages.identify(empty(spark, DOCS), languages.fit(empty(spark, DOCS), scratch)).count() == 0
    assert languages.segment_languages(table, model).where("doc_id = 902").select("language").distinct().count() == 2


def test_held_out_accuracy(spark, scratch):
    rows = spark.read.parquet(f"{FOLDER}/../sf0.01/documents.parquet").where(languages.named_language(F.col("lang")).isNotNull())
    # by text, so that no copy of a fitted text is scored
    fitted = F.pmod(F.xxhash64("text"), F.lit(2)) == 0
    model = languages.fit(rows.where(fitted), scratch)
    told = languages.identify(rows.where(~fitted), model).where("languages = 1 and sentences >= 3").toPandas()
    assert len(told) > 100
    assert (told.named == told.language).mean() > 0.85  # labels themselves are wrong now and then


# all ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, name):
    found = queries.queries()[name](spark, FOLDER).toPandas()
    sql = queries.oracle_sql().get(name)
    if sql is not None:
        from oracle import rows, tables

        assert rows(found) == rows(tables(FOLDER).execute(sql).df())
