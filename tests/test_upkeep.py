"""Changes applied to a library, logs, kinds of questions, requests, rows and blocks of images."""

import datetime as dt
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from tidewell.functions import quality, requests
from tidewell.operators import images, ingest
from tidewell.sources import extract, sinks
from tidewell.streaming import feeds

CHANGES = "action string, seq int, path string, size int"


def test_changes_apply_once(spark, tmp_path):
    library = ingest.Library("path string, size int", str(tmp_path / "lib"), ["path"])
    assert library.read(spark).count() == 0
    first = spark.createDataFrame([("update", 1, "a", 1), ("update", 2, "a", 2), ("update", 3, "b", 1), ("delete", 4, "c", None)], CHANGES)
    second = spark.createDataFrame([("delete", 5, "b", None), ("update", 6, "c", 7), ("delete", 7, "d", None), ("update", 8, "d", 9)], CHANGES)
    library.apply(first, 0)
    library.apply(second, 1)
    want = {("a", 2), ("c", 7), ("d", 9)}
    assert {tuple(r) for r in library.read(spark).collect()} == want
    library.apply(first, 1)  # an epoch delivered again changes nothing
    assert {tuple(r) for r in library.read(spark).collect()} == want and library.versions(spark) == [0, 1]
    library.vacuum(spark, keep=1)
    assert library.versions(spark) == [1]


def test_a_feed_of_changes_fills_a_library(spark, tmp_path):
    rows = [("update", k, f"p{k % 7}", k) for k in range(30)] + [("delete", 31, "p3", None)]
    spark.createDataFrame(rows, CHANGES).write.parquet(str(tmp_path / "feed"))
    library = ingest.Library("path string, size int", str(tmp_path / "lib"), ["path"])
    seen = feeds.Telemetry()
    spark.streams.addListener(seen)
    stream = spark.readStream.schema(CHANGES).parquet(str(tmp_path / "feed"))
    feeds.apply_changes(stream, library.apply, str(tmp_path / "checkpoint"))
    feeds.apply_changes(stream, library.apply, str(tmp_path / "checkpoint"))
    spark.streams.removeListener(seen)
    assert {r["path"]: r["size"] for r in library.read(spark).collect()} == {"p0": 28, "p1": 29, "p2": 23, "p4": 25, "p5": 26, "p6": 27}
    for _ in range(50):
        if sum(e["event"] == "ended" for e in seen.events) == 2:
            break
        time.sleep(0.1)
    assert sum(e.get("rows", 0) for e in seen.events if e["event"] == "batch") == 31


def test_upsert_keeps_unknown_fields(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, note string")
    new = spark.createDataFrame([("b", 5, True), ("c", None, False)], "k string, n int, hot boolean")
    got = {r["k"]: (r["n"], r["note"], r["hot"]) for r in ingest.upserted(old, new, ["k"]).collect()}
    assert got == {"a": (1, "x", None), "b": (5, "y", True), "c": (None, None, False)}


def test_audit_log_by_day(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = spark.createDataFrame([(dt.datetime(2020, 1, d), ["q" * 900], {"k": "v", "n": None}) for d in (2, 1, 2)], "ts timestamp, queries array<string>, params map<string,string>")
    sinks.append_audit(rows, path)
    (tmp_path / "audit" / "day=2020-01-02" / "broken.json").write_text("{no json\n")
    got = sinks.read_audit(spark, path, "ts timestamp, queries array<string>, params map<string,string>").where("ts is not null").collect()
    assert [r["ts"].day for r in got] == [1, 2, 2] and all(len(r["queries"][0]) == 500 and r["params"] == {"k": "v"} for r in got)


@pytest.mark.parametrize("question,label", [
    ("which formats are supported formats here", "CAPABILITIES"), ("show my notes from yesterday", "FILENAME_DATE_LOOKUP"), ("what did i write about notes yesterday", "LOOKUP"), ("list files from 2021", "FILE_LIST"),
    ("number of documents by month", "METADATA_ONLY"), ("timeline of events", "TIMELINE"), ("folder structure please, with files", "STRUCTURE"), ("how many .docx files", "STRUCTURE"), ("my main language in 2020", "CODE_LANGUAGE"),
    ("primary coding language", "CODE_LANGUAGE"), ("2020 form 1040 line 9", "FIELD_LOOKUP"), ("what were my wages in 2019", "MONEY_YEAR_TOTAL"), ("how many 1099 forms", "LOOKUP"), ("tax withheld in 2018", "TAX_QUERY"),
    ("how many projects are there", "PROJECT_COUNT"), ("please reflect on that entry", "REFLECT"), ("how do i handle stress", "EVIDENCE_PROFILE"), ("courses i completed", "ACADEMIC_HISTORY"), ("which courses should i have completed", "LOOKUP"),
    ("the total of everything", "AGGREGATE"), ("where is the harbour", "LOOKUP"), ("", "LOOKUP"), (None, "LOOKUP"),
])
def test_kinds_of_questions(spark, question, label):
    assert spark.range(1).select(quality.intent(F.lit(question).cast("string")).alias("i")).first()["i"] == label


def test_requests_for_times():
    now = dt.datetime(2024, 5, 1, 12, tzinfo=dt.timezone.utc)
    assert requests.since("24h", now) == now - dt.timedelta(days=1) and requests.since("2024-01-02", now).isoformat() == "2024-01-02T00:00:00+00:00" and requests.since("soon", now) is None
    assert requests.day_range("2024-02-01..2024-01-01") == (dt.date(2024, 1, 1), dt.date(2024, 2, 1)) and requests.day_range("x:y") is None
    assert [requests.range_label(*map(dt.date.fromisoformat, p)) for p in (("2024-02-01", "2024-02-29"), ("2024-01-01", "2024-12-31"), ("2024-01-05", "2024-01-05"), ("2024-01-05", "2024-01-07"))] == ["2024-02", "2024", "2024-01-05", "2024-01-05 to 2024-01-07"]


def test_bookmarks(tmp_path):
    base = sqlite3.connect(tmp_path / "places.sqlite")
    base.executescript("""create table moz_places (id integer, url text); create table moz_bookmarks (id integer, type int, fk int, parent int, title text, dateAdded int);
      insert into moz_places values (1, 'http://a'), (2, 'http://b'); insert into moz_bookmarks values (10, 2, null, 0, 'menu', 0), (11, 1, 2, 10, 'B', 2), (12, 1, 1, 10, 'A', 1), (13, 1, 1, 99, null, 3);""")
    base.commit()
    base.close()
    text = extract.read("/x/places.sqlite", (tmp_path / "places.sqlite").read_bytes())[0][2]
    assert text.split("\n") == [" |  | http://a", "menu | A | http://a", "menu | B | http://b"]


def test_rows_compare_with_their_first_observation(spark):
    seen = [(1, 0.1, 0.900, 0.1, 0.01, "a", 1), (1, 0.3, 0.892, 0.1, 0.01, "b", 2), (1, 0.12, 0.884, 0.1, 0.01, "c", 3), (1, 0.1, 0.5, 0.2, 0.01, " ", 4), (1, 0.1, 0.2, 0.2, 0.01, "d", 5)]
    rows = images.row_bands(spark.createDataFrame(seen, "image int, x double, y double, w double, h double, text string, key int"), "image")
    assert [r["text"] for r in rows.orderBy("row").collect()] == ["a b", "c", "d"]
    assert [r["text"] for r in images.blocks(rows, "image").orderBy("block").collect()] == ["a b\nc", "d"]
