"""Scalar columns."""

from __future__ import annotations

from urllib.parse import quote

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from anchorage.functions import extract, text, urls


def column(spark, values, expression, kind="string"):
    return [r.out for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").orderBy("k").select(expression.alias("out")).collect()]


def test_truncation_agrees_with_extraction(spark):
    values = ["", "short", "a b" * 40, "x" * 90, "word " * 30, "tail" + " y" * 50, "p" * 59 + " q", "p" * 60 + " q"]
    for keep_end in (True, False):
        assert column(spark, values, text.truncate_words(F.col("v"), 60, keep_end)) == [extract.truncate_words(v, 60, keep_end) for v in values]


def test_percent_encoding(spark):
    values = ["a b-c,d*~/é+_.", "100% & more", "日本", ""]
    assert column(spark, values, text.percent_encode(F.col("v"))) == [quote(v, safe="").replace("-", "%2D") for v in values]


def test_hosts_and_slugs(spark):
    values = ["https://A.test:8080/x/y/", "mailto:a@b", "http://u@h_x.test", "", None]
    assert column(spark, values, urls.host("v")) == ["a.test:8080", "", "u@h_x.test", "", None]
    assert column(spark, values, urls.slug("v"))[:3] == ["y", "mailto:a@b", "u@h_x.test"]
    assert column(spark, ["http:/a.test/x", "HTTPS:/b", "http://c"], urls.repair_scheme("v")) == ["http://a.test/x", "HTTPS://b", "http://c"]


def test_resolve_and_unescape(spark):
    rows = spark.createDataFrame([("https://a.test/x/", "../y", "A &amp; B"), ("https://a.test/", "http://[bad/", None), (None, "x", "")], "b string, h string, t string")
    got = rows.select(urls.resolve("b", "h").alias("u"), urls.unescape("t").alias("t")).collect()
    assert [(r.u, r.t) for r in got] == [("https://a.test/y", "A & B"), (None, None), (None, "")]


def test_day_numbers(spark):
    assert column(spark, ["", "day7", "week12", "Day 3", "dayx", None], text.day_number(F.col("v"))) == [None, 7, 0, 3, 0, None]


def test_deep_links(spark):
    rows = [("p", "day1", "one two three", "before it", None), ("p", "", "one two", None, None), ("p", None, "a-b c d e f", None, "g"), ("p", "day2", None, "a b c d e f", None)]
    frame = spark.createDataFrame(rows, "p string, d string, t string, b string, a string")
    got = [r.h for r in frame.select(text.deep_link(*(F.col(c) for c in "pdtba")).alias("h")).collect()]
    assert got == ["p#day1:~:text=before%20it-,one%20two%20three", "p", "p#:~:text=a%2Db%20c%20d%20e%20f,-g", "p#day2"]


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n", max_size=200), st.integers(1, 80), st.booleans())
def test_truncation_is_a_part_without_broken_words(value, limit, keep_end):
    out = extract.truncate_words(value, limit, keep_end)
    assert len(out) <= limit and (value.endswith(out) if keep_end else value.startswith(out))
