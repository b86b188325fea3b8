"""Marks are found wherever in a text they stand."""

from pyspark.sql import functions as F

from tidewell.llm import origins, scans
from tidewell.shared import Scratch, empty


def test_marks_after_a_long_head(spark):
    head = "".join(f"// clause {'x' * (n % 9)} of the licence\n" for n in range(80))
    texts = [("banner", head + "// Code generated by a tool\n"), ("footer", head + "// DO NOT EDIT\n"), ("holder", head + "// Copyright (c) 2019 Acme contributors\n"), ("none", head)]
    rows = spark.createDataFrame(texts, "name string, text string").withColumn("project", F.lit("own"))
    got = {r["name"]: (r["_marked"], r["_holder"]) for r in origins.text_features(rows).collect()}
    assert len(head) > 1200
    assert got == {"banner": (True, ""), "footer": (True, ""), "holder": (False, "acme"), "none": (False, "")}


def test_compounds_keep_their_hyphen(spark):
    texts = ["a well-known man", "one well-known inn", "the well-known sea", "he is well-\nknown here", "a bro-\nken word"]
    pages = spark.createDataFrame([(n, n, 1, t) for n, t in enumerate(texts)], "page_key bigint, file_key bigint, page_num int, text string")
    out = scans.repaired(pages, empty(spark, "region_key bigint, text string"), empty(spark, "image_key bigint, visible_text string"), Scratch(spark, "test"))
    got = {r["record_key"]: r["text"] for r in out.collect()}
    assert got[3] == "he is well-known here" and got[4] == "a broken word"
