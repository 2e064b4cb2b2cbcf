from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from pagetide.functions import dates as D
from pagetide.operators import deadlines as L

AS_OF = "2026-01-31"
FIRST, LAST = "2026-01-01", "2027-12-31"


def day(text):
    return F.lit(text).cast("date")


def extract(spark, main, snippets=(), first=FIRST, last=LAST):
    df = spark.createDataFrame([(1, list(snippets), main)], "page_id int, snippets array<string>, main_text string")
    rows = L.extract_deadlines(df, "page_id", day(AS_OF), day(first), day(last)).collect()
    return [(d["date"], d["type"], d["confidence"], d["source_text"]) for d in rows[0]["deadlines"]] if rows else []


@pytest.mark.parametrize("text, wanted", [
    ("Due March 15, 2026", "2026-03-15"), ("due 15 March 2026", "2026-03-15"), ("due 15th of March, 2026", "2026-03-15"),
    ("due Mar 3rd 2026", "2026-03-03"), ("due Sept 9, 2026", "2026-09-09"), ("due 2026-03-15", "2026-03-15"), ("due 3/15/2026", "2026-03-15"),
    ("due 15/3/2026", "2026-03-15"), ("due February 2026", "2026-02-28"), ("due March 15", "2026-03-15"), ("due 15 March", "2026-03-15"),
    ("due February 30, 2026", None), ("closes tomorrow", "2026-02-01"), ("closes in 10 days", "2026-02-10"), ("closes in 2 weeks", "2026-02-14"),
    ("you may submit 15 papers", None), ("nothing here", None),
    ("due 2026-03-15T23:59", "2026-03-15"), ("due 2026/03/15", "2026-03-15"), ("due 15-Mar-2026", "2026-03-15"), ("due 3/15/26", "2026-03-15"),
    ("due July 5-8, 2027", "2027-07-05"), ("due March 15 - 17, 2027", "2027-03-15"), ("due 5-8 July 2027", "2027-07-05"),
    ("tickets are sold today only", None), ("tickets are sold in 10 days", None), ("we meet tomorrow", None), ("due today", None),
])
def test_formats(spark, text, wanted):
    df = spark.createDataFrame([(text,)], "sentence string")
    row = D.with_date(df, day(AS_OF)).first()
    assert (str(row["date"]) if row["date"] else None) == wanted


def test_types_confidence_and_source(spark):
    got = extract(spark, "Abstract submission deadline: March 15, 2026")
    assert got == [(date(2026, 3, 15), "abstract", 1.0, "Abstract submission deadline: March 15, 2026")]
    assert extract(spark, "Full paper due April 15, 2026")[0][1:3] == ("paper", 0.9)
    assert extract(spark, "", ["Registration closes May 1, 2026"])[0][1:3] == ("registration", 1.0)
    assert extract(spark, "Camera-ready due June 1, 2026")[0][1] == "camera-ready"
    assert extract(spark, "The event starts July 1, 2026")[0][1] == "general"
    assert extract(spark, "Registration closes in 10 days for all")[0][2] == 0.7


@pytest.mark.parametrize("text", [
    "Copyright 2026. All rights reserved", "Last updated: February 14, 2026", "Page 3 of 9 from 1 March 2026", "© 2026 March 1, 2026",
    "Deadline was January 1, 2020", "Deadline is May 1, 2031", "",
])
def test_nothing_found(spark, text):
    assert extract(spark, text) == []


def test_sorted_distinct_and_snippet_first(spark):
    main = "Paper deadline: April 30, 2026\nAbstract deadline: March 15, 2026\nRegistration closes: May 15, 2026\nAbstract deadline: 2026-03-15"
    got = extract(spark, main, ["The abstract deadline: March 15, 2026 for all"])
    assert [(str(d), t) for d, t, _, _ in got] == [("2026-03-15", "abstract"), ("2026-04-30", "paper"), ("2026-05-15", "registration")]
    assert got[0][3] == "The abstract deadline: March 15, 2026 for all"


def test_window_is_inclusive(spark):
    first, last = "2026-06-15", "2026-06-16"
    text = "Due June 14, 2026. Due June 15, 2026. Due June 16, 2026. Due June 17, 2026"
    assert [str(d[0]) for d in extract(spark, text, first=first, last=last)] == ["2026-06-15", "2026-06-16"]


def test_long_text_is_read_to_its_end(spark):
    text = "Some filler sentence here. " * 40000 + "Paper deadline: April 30, 2026"
    assert [str(d[0]) for d in extract(spark, text)] == ["2026-04-30"]
