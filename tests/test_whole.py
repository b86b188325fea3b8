"""Operators that have to see every row, against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from tidewell.operators import ranked, rerank
from tidewell.plans import registry
from tidewell.shared import Scratch

FOLDER = "/root/testdata/sf0.001"


def chunks(spark):
    cols = ["id", "file_key", "chunk_no", "source", "silo", "page", "line_start"]
    rows = sorted({tuple(r) for r in spark.read.parquet(f"{FOLDER}/chunks.parquet").select(*cols).collect()}, key=lambda r: (r[1], r[2], r[0]))
    return [dict(zip(cols, r)) | {"pos": n, "dist": round(r[6] % 97 / 97.0, 6)} for n, r in enumerate(rows)]


def ask(spark, name):
    return registry.queries()[name](spark, FOLDER).collect()


def test_numbered(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"))
    out = ranked.numbered(rows, Scratch(spark, "test"), "v").collect()
    assert len(out) == 5000 and all(r["v"] == r["pos"] for r in out)


def test_footer_has_every_source(spark):
    expected = {}
    for r in chunks(spark):
        first, best, pages = expected.get(r["source"], (r["pos"], r["dist"], set()))
        expected[r["source"]] = (first, min(best, r["dist"]), pages | ({r["page"]} - {None}))
    got = {r["source"]: (r["first_pos"], r["best"], set(r["pages"])) for r in ask(spark, "source_footer")}
    assert len(got) > 71 and got == expected


def test_silos_by_best_has_every_chunk(spark):
    rows = chunks(spark)
    best = {s: min(r["dist"] for r in rows if r["silo"] == s) for s in {r["silo"] for r in rows}}
    expected = [r["id"] for r in sorted(rows, key=lambda r: (best[r["silo"]], r["silo"], r["pos"]))]
    assert len(expected) > 400 and [r["id"] for r in sorted(ask(spark, "silos_by_best"), key=lambda r: r["pos"])] == expected


@pytest.mark.parametrize("name", ["sources_by_extension_hint", "year_first"])
def test_top_is_of_every_chunk(spark, name):
    rows = chunks(spark)
    if name == "year_first":
        found = {r[0] for r in spark.createDataFrame([(r["source"],) for r in rows], "source string").where(r"source rlike '(^|[^0-9])2014([^0-9]|$)'").collect()}
        key, k = lambda r: (r["source"] not in found, "readme" in r["source"].lower(), r["dist"], r["pos"]), 50
    else:
        best = {s: min(r["dist"] for r in rows if r["source"] == s) for s in {r["source"] for r in rows}}
        hint = lambda s: 0 if s.lower().endswith(".pdf") else 1 if s.lower().endswith(".py") else 2
        key, k = lambda r: (hint(r["source"]), best[r["source"]], r["source"], r["dist"], r["pos"]), 60
    got = sorted(ask(spark, f"{name}"), key=lambda r: r["pos"])
    assert [r["id"] for r in got] == [r["id"] for r in sorted(rows, key=key)[:k]]


def test_near_and_named_falls_back(spark):
    rows = [("a", "x/lease.txt", 0.9), ("b", "x/other.txt", 0.1), ("c", "x/third.txt", 0.2), ("d", "x/fourth.txt", 0.3)]
    stream = spark.createDataFrame(rows, "id string, source string, dist double")
    assert {r["id"] for r in rerank.near_and_named(stream, "the lease", 0.5).collect()} == {"b", "c"}
    assert {r["id"] for r in rerank.near_and_named(stream, "the lease", 0.95).collect()} == {"a"}


def test_near_named_sources_reads_every_chunk(spark):
    rows = chunks(spark)
    best = {s: min(r["dist"] for r in rows if r["source"] == s) for s in {r["source"] for r in rows}}
    asked = {"lease", "survey", "the", "signed"}
    named = {s for s in best if best[s] <= 0.5 and asked & set(re.findall(r"[a-z0-9]{3,}", re.sub(r"[^A-Za-z0-9]+", " ", s).lower()))}
    kept = named or set(sorted(best, key=lambda s: (best[s], s))[:2])
    assert {(r["id"], r["source"]) for r in ask(spark, "near_named_sources")} == {(r["id"], r["source"]) for r in rows if r["source"] in kept}
