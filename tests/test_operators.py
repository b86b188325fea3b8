"""Operators on small tables with known answers."""

import io
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewell.functions import dates
from tidewell.operators import catalog, chunking, evidence, joins, ranked
from tidewell.sources import extract, listing, sinks


def stream(spark, rows, columns="pos bigint, source string, silo string, dist double, chunk_hash string"):
    return spark.createDataFrame(rows, columns)


def values(df, column):
    return [r[column] for r in df.orderBy("pos").collect()]


def test_source_cap(spark):
    rows = [(k, s, None, (k + 1) / 10, None) for k, s in enumerate("AAABB")]
    assert values(ranked.cap_per_key(stream(spark, rows), "source", 2), "dist") == [0.1, 0.2, 0.4, 0.5]


def test_missing_silo_is_its_own(spark):
    rows = [(k, "s", None, 0.1, None) for k in range(3)]
    assert ranked.cap_per_key(stream(spark, rows), "silo", 1).count() == 3


def test_first_of_hash(spark):
    rows = [(0, "a", "x", 0.1, "h1"), (1, "b", "x", 0.2, "h1"), (2, "c", "x", 0.3, None), (3, "d", "x", 0.4, "h2")]
    assert values(ranked.first_of_hash(stream(spark, rows)), "source") == ["a", "c", "d"]


def test_fusion(spark):
    v = spark.createDataFrame([("v1", 0.1, 0), ("v2", 0.2, 1)], "id string, dist double, pos bigint")
    x = spark.createDataFrame([("v2", 0), ("l3", 1)], "id string, pos bigint")
    out = ranked.reciprocal_rank(v, x, 3).orderBy("pos").collect()
    assert [r["id"] for r in out] == ["v2", "v1", "l3"]
    assert out[2]["dist"] is None


def test_least_coverage(spark):
    rows = [(0, "", "a", 0.05, ""), (1, "", "a", 0.06, ""), (2, "", "a", 0.07, ""), (3, "", "b", 0.5, ""), (4, "", "g", 0.6, "")]
    assert set(values(ranked.least_coverage(stream(spark, rows), "silo", 4, 3), "silo")) == {"a", "b", "g"}


def test_soft_promotion(spark):
    near = [(k, "", "a", 0.10 + k / 100, "") for k in range(4)] + [(4, "", "b", 0.15, ""), (5, "", "g", 0.16, "")]
    assert set(values(ranked.promote_diversity(stream(spark, near), "silo", 4), "silo")) == {"a", "b", "g"}
    far = near[:4] + [(4, "", "b", 0.45, "")]
    assert values(ranked.promote_diversity(stream(spark, far), "silo", 4), "silo") == ["a"] * 4


def test_skip_greedy_budget(spark):
    rows = spark.createDataFrame([(0, 30), (1, 70), (2, 40)], "pos bigint, size int")
    assert sorted(r["size"] for r in ranked.skip_greedy_budget(rows, F.col("size"), 80).collect()) == [30, 40]


def test_fallback_filter(spark):
    rows = stream(spark, [(0, "a", "x", 0.1, ""), (1, "b", "y", 0.2, "")])
    assert ranked.fallback_filter(rows, F.col("source") == "a").count() == 1
    assert ranked.fallback_filter(rows, F.col("source") == "z").count() == 2


@pytest.mark.parametrize("path,expected", [("/a/2026-05-04.md", ("2026-05-04", "day")), ("/a/x_20260504.txt", ("2026-05-04", "day")), ("/a/May 4, 2026 plan.txt", ("2026-05-04", "day")), ("/a/n-2014-01.pptx", ("2014-01-01", "month")), ("/a/2026-02-30.md", (None, None)), ("/a/b.md", (None, None))])
def test_name_dates(spark, path, expected):
    d = spark.range(1).select(dates.name_date(F.lit(path)).alias("d")).first()["d"]
    assert (str(d["date"]) if d["date"] else None, d["precision"]) == expected


def test_change_set(spark):
    now = spark.createDataFrame([("s", "a", 1, 1.0), ("s", "b", 2, 1.0), ("s", "d", 1, None)], "silo string, path string, size bigint, mtime double")
    old = spark.createDataFrame([("s", "a", 1, 1.0), ("s", "b", 1, 1.0), ("s", "c", 1, 1.0), ("s", "d", 1, None)], now.schema)
    assert {(r["path"], r["action"]) for r in catalog.change_set(now, old).collect()} == {("a", "unchanged"), ("b", "update"), ("c", "delete"), ("d", "unchanged")}


def test_line_chunks():
    assert chunking.line_chunks("  \n ") == []
    lines = [n for _, n in chunking.line_chunks("\n".join(f"line {k}" for k in range(10)), 20, 6)]
    assert lines == sorted(lines) and lines[0] == 1
    long = chunking.line_chunks("x" * 2500, 1000, 100)
    assert 3 <= len(long) <= 5 and {n for _, n in long} == {1}


def test_a_tail_that_reaches_the_first_line_makes_no_double_chunk():
    text = "\n".join("x" * 90 for _ in range(60))
    assert max(len(c) for c, _ in chunking.line_chunks(text, 200, 150)) <= 290
    assert chunking.chunk_params(5000, 4000) == (4000, 2000) and chunking.chunk_params(10, -3) == (100, 0)


def test_resolution(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.8), ("b", 1.0, 0.8), ("b", 2.0, 0.9), ("c", 1.0, 0.2), ("d", None, 0.9)], "g string, v double, confidence double")
    got = {r["g"]: r["status"] for r in evidence.resolve(rows, ["g"], value="v").collect()}
    assert got == {"a": "ok", "b": "conflict", "c": "low_confidence", "d": "no_value"}


def test_consensus(spark):
    rows = spark.createDataFrame([("q", "a", 3.0, False), ("q", "b", 0.5, False), ("r", "a", 1.0, False), ("r", "b", 1.5, False), ("s", "a", 1.0, True)], "q string, value string, score double, canonical boolean")
    assert {r["q"]: r["value"] for r in evidence.consensus(rows, ["q"]).collect()} == {"q": "a", "r": None, "s": "a"}


def test_as_of(spark):
    left = spark.createDataFrame([("k", 5, "x"), ("k", 1, "y"), ("j", 9, "z")], "k string, t int, n string")
    right = spark.createDataFrame([("k", 2, "a"), ("k", 4, "b"), ("k", 6, "c")], "k string, rt int, v string")
    assert {r["n"]: r["v"] for r in joins.as_of(left, right, ["k"], "t", "rt", ["v"]).collect()} == {"x": "b", "y": None, "z": None}


def test_salted_join_loses_nothing(spark):
    left = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, v string")
    assert joins.salted(left, right, "k", 7).count() == 1000


def test_html_and_csv():
    page = "<head><title>x</title></head><body><nav>menu</nav><h1>One</h1><p>a &amp; b</p><script>bad()</script></body>"
    assert extract.html_text(page) == "§SECTION: One§\na & b"
    assert extract.csv_rows("a,b\n1,2\n\n3,4,5\n") == ["CSV row 1: a=1 | b=2", "CSV row 3: c1=3 | c2=4 | c3=5"]
    assert extract.html_text("<nav><h1>Menu</h1></nav><p>x</p>") == "x"


def test_archives_and_databases(tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("in/a.txt", "hello")
        z.writestr("../evil.txt", "no")
        z.writestr("nested.zip", "no")
    assert extract.read("x.zip", data.getvalue()) == [("x.zip > in/a.txt", 1, "hello")]
    assert extract.read("broken.docx", b"no archive") == [("broken.docx", 0, None)]
    path = tmp_path / "t.db"
    base = sqlite3.connect(path)
    base.execute("create table t (a, b)")
    base.execute("insert into t values (1, null)")
    base.commit()
    base.close()
    assert extract.read("t.db", path.read_bytes()) == [("t.db", 1, "Table: t\na | b\n1 | ")]


def test_listing_and_extraction(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("alpha")
    (tmp_path / "sub" / "b.csv").write_text("h\n1\n")
    (tmp_path / ".hidden").write_text("no")
    found = listing.list_folder(spark, str(tmp_path), exclude=["*.md"])
    texts = {r["text"] for r in extract.extract(found).collect()}
    assert texts == {"alpha", "CSV row 1: h=1"}


def test_repeated_append_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "id string, v int")
    path = str(tmp_path / "t")
    assert sinks.append_new(rows, path, "id", ["v"]).count() == 2
    assert sinks.append_new(rows, path, "id", ["v"]).count() == 2
    assert sinks.missing_ids(rows, spark.read.parquet(path), "id").count() == 0


def test_replace_sources(spark):
    old = spark.createDataFrame([("a.zip > x", 1), ("a.zip", 2), ("b", 3)], "source string, v int")
    new = spark.createDataFrame([("a.zip", 9)], old.schema)
    assert sorted(r["v"] for r in sinks.replace_sources(old, new, "source").collect()) == [3, 9]


def test_nested_paths(spark):
    silos = spark.createDataFrame([("a", "/x"), ("b", "/x/y/"), ("c", "/x"), ("d", "/xy")], "slug string, path string")
    got = {(r["inner"], r["outer"], r["relation"]) for r in catalog.nested_paths(silos).collect()}
    assert got == {("b", "a", "nested"), ("b", "c", "nested"), ("a", "c", "same_path")}
