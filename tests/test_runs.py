"""Store, crawl, check, report and stream, end to end without a network."""

from __future__ import annotations

import socket
import ssl
from datetime import UTC, datetime, timedelta

import pytest

from anchorage import schemas
from anchorage.operators import state
from anchorage.plans import runs
from anchorage.sources import listing, probe
from anchorage.sources.retry import get, retry_after, waits
from anchorage.sources.store import Store

NOW = datetime(2024, 5, 1, 12)
INDEX = '<div class="entry-content"><a href="/maths/">Maths</a><a href="/gone">Gone</a></div>'
MATHS = '<div id="day1">Day 1</div><p>Read the <a href="https://x.test/a">first text</a> today.</p><a href="/extra">more</a>'
EXTRA = '<p><a href="https://y.test/b">Other</a> <a href="https://x.test/a">Again</a></p>'


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.init([("school", "https://s.test", "https://s.test/all")])
    return s


def inputs(spark, version="v1"):
    entries = spark.createDataFrame([("maths", "https://s.test/maths/", version), ("extra", "https://s.test/extra/", "v1"), ("alone", "https://s.test/alone/", "v1")], "slug string, link string, modified_gmt string")
    bodies = spark.createDataFrame([("maths", "https://s.test/maths/", "Maths", MATHS), ("extra", "https://s.test/extra/", "Extra", EXTRA), ("alone", "https://s.test/alone/", "Alone", EXTRA)], "slug string, url string, title string, html string")
    return entries, bodies


def test_whole_run(spark, store, tmp_path):
    totals = runs.crawl(store, 1, INDEX, *inputs(spark), NOW)
    assert totals == runs.CrawlTotals(2, 1, 1, 1, True)
    assert sorted(r.url for r in store.read("links").collect()) == ["https://x.test/a", "https://y.test/b"]
    places = {(r.link_text, r.day_context, r.context_before) for r in store.read("page_links").collect()}
    assert places == {("first text", "day1", "Read the"), ("Other", "", None), ("Again", "", "Other")}
    again = runs.crawl(store, 1, INDEX, *inputs(spark), NOW + timedelta(hours=1))
    assert again == totals and store.read("page_links").count() == 3
    clock = NOW
    for k in range(3):
        clock += timedelta(days=2)
        assert runs.drain(store, lambda: clock, 10, ask=lambda url: (404, None) if "x.test" in url else (200, None), jitter_share=0) == (2 if k == 0 else 1)
    links = {r.url: (r.status, r.consecutive_failures) for r in store.read("links").collect()}
    assert links == {"https://x.test/a": ("broken", 3), "https://y.test/b": ("ok", 0)}
    assert store.read("link_checks").count() == 4 and store.read("domain_claims").count() == 0
    text = runs.write_report(store, str(tmp_path / "out.html"))
    assert "[broken] https://x.test/a (404, 3 in a row)" in text and "1 link to look at" in text
    html = (tmp_path / "out.html").read_text()
    assert html.index("<h4>Maths") < html.index("<h3>Other pages") < html.index("<h4>Extra") and "#day1:~:text=" in html
    assert runs.requeue_broken(store, clock) == 1


def test_unreachable_pages_are_pruned(spark, store):
    runs.crawl(store, 1, INDEX, *inputs(spark), NOW)
    entries, bodies = inputs(spark, "v2")
    from pyspark.sql import functions as F

    bodies = bodies.withColumn("html", F.when(F.col("slug") == "maths", "<p>empty</p>").otherwise(F.col("html")))
    runs.crawl(store, 1, INDEX, entries, bodies, NOW)
    assert store.read("page_links").count() == 0 and store.read("links").count() == 2
    assert not runs.crawl(store, 1, "<p>no list</p>", entries, bodies, NOW).complete


def test_listing(spark):
    bodies = ['[{"id":1,"slug":"a","link":"https://s.test/a","modified_gmt":"t","title":{"rendered":"A &amp; B"},"content":{"rendered":"<p>x</p>"}}]', "[]", '{"code":"x","message":"y"}', None]
    answers = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert [tuple(r) for r in listing.listed(answers).collect()] == [(1, "a", "https://s.test/a", "t")]
    assert [(r.title, r.html) for r in listing.page_records(answers).collect()] == [("A & B", "<p>x</p>")]


def test_retries():
    assert waits() == [5, 10, 20, 40, 80]
    now = datetime(2024, 1, 1, tzinfo=UTC)
    assert retry_after("3.5", now) == 3.5 and retry_after("-1", now) == 0 and retry_after("soon", now) is None
    assert retry_after("Mon, 01 Jan 2024 00:00:30 GMT", now) == 30
    answers, slept = [(429, {"retry-after": "2"}, ""), (429, {}, ""), (200, {}, "ok")], []
    assert get(lambda: answers.pop(0), slept.append, lambda: now, pick=lambda a, b: 1)[2] == "ok" and slept == [2, 11]
    with pytest.raises(ConnectionError):
        get(lambda: (429, {}, ""), slept.append, lambda: now)
    with pytest.raises(ConnectionError):
        get(lambda: (500, {}, ""), slept.append, lambda: now)


def test_buckets_and_schemes():
    def caused(cause):
        error = OSError("x")
        error.__cause__ = cause
        return error

    for cause, name in (
        (TimeoutError(), "timeout"), (socket.gaierror(), "dns_error"), (ConnectionRefusedError(), "connection_refused"),
        (ssl.SSLCertVerificationError(), "bad_ssl_cert"), (probe.TooManyRedirects(), "too_many_redirects"), (ValueError(), "other"),
    ):
        assert probe.bucket(caused(cause)) == name
    asked = []
    assert probe.secure_first("http://x.test/", lambda u: asked.append(u) or ((None, "timeout") if u.startswith("https") else (200, None))) == (200, None)
    assert asked == ["https://x.test/", "http://x.test/"]
    assert probe.secure_first("http://x.test/", lambda u: (404, None)) == (404, None)


def test_stream_equals_batch(spark, tmp_path):
    import random

    from anchorage.streaming import state_stream

    r = random.Random(5)
    choices = [(200, None), (404, None), (None, "timeout"), (410, None)]
    rows = [(k, r.randrange(12), NOW + timedelta(minutes=k), *r.choice(choices), 5, 0) for k in range(120)]
    schema = schemas.struct(schemas.LINK_CHECKS)
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={part}"))
    spark.conf.set(*state_stream.ROCKSDB)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = state_stream.link_states(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    latest = {}
    for row in sorted(spark.sql("select * from states").collect(), key=lambda x: x.last_checked_at):
        latest[row.link_id] = (row.status, row.consecutive_failures, row.last_checked_at)
    batch = {x.link_id: (x.status, x.consecutive_failures, x.last_checked_at) for x in state.fold(spark.createDataFrame(rows, schema)).collect()}
    assert latest == batch
