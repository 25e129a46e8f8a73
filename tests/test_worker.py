"""The worker's loops against a server on this machine, and what the page of the report can do."""

from __future__ import annotations

import json
import logging
import threading
import time
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from anchorage import __main__ as command
from anchorage.plans import runs, worker
from anchorage.settings import Pace
from anchorage.sources import listing
from anchorage.sources.store import Store

PAGES = {
    "maths": ("Maths", '<div id="day1">Day 1</div><p>Read <a href="https://x.test/a">first</a> now.</p><a href="/extra/">more</a>'),
    "extra": ("Extra", '<p><a href="https://y.test/b">Other</a></p><a href="/deep/">deep</a>'),
    "deep": ("Deep", '<p><a href="https://z.test/c">Third</a></p>'),
    "alone": ("Alone", '<p><a href="https://never.test/d">Unseen</a></p>'),
}


class Site(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def do_GET(self):  # noqa: N802
        url = urlsplit(self.path)
        asked = parse_qs(url.query)
        if url.path == "/all":
            body = '<div class="entry-content"><a href="/maths/">Maths</a></div>'
        elif "slug" in asked:
            slug = asked["slug"][0]
            self.server.lookups.append(slug)
            title, html = PAGES[slug]
            body = json.dumps([{"id": 1, "slug": slug, "link": f"{self.server.base}/{slug}/", "title": {"rendered": title}, "content": {"rendered": html}, "modified_gmt": self.server.tokens[slug]}])
        else:
            body = json.dumps([{"id": k, "slug": s, "link": f"{self.server.base}/{s}/", "modified_gmt": self.server.tokens[s]} for k, s in enumerate(PAGES)])
        data = body.encode()
        self.send_response(200)
        self.send_header("X-WP-TotalPages", "1")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)


@pytest.fixture
def site():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    s.base, s.lookups, s.tokens = f"http://127.0.0.1:{s.server_port}", [], dict.fromkeys(PAGES, "v1")
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


@pytest.fixture
def store(spark, tmp_path, site):
    s = Store(spark, str(tmp_path / "store"))
    s.init([("school", site.base, f"{site.base}/all")])
    return s


def now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def test_only_changed_pages_that_are_reached_are_fetched(store, site):
    (row,) = store.read("sites").collect()
    totals = command._crawl_site(store, row, None, False)
    assert totals == runs.CrawlTotals(3, 1, 2, 0, True) and sorted(site.lookups) == ["deep", "extra", "maths"]
    assert {r.url for r in store.read("links").collect()} == {"https://x.test/a", "https://y.test/b", "https://z.test/c"}
    site.lookups.clear()
    site.tokens["extra"] = "v2"
    assert command._crawl_site(store, row, None, False) == totals and site.lookups == ["extra"]
    site.lookups.clear()
    command._crawl_site(store, row, None, True)
    assert sorted(site.lookups) == ["deep", "extra", "maths"]


def test_lookups_run_on_workers_and_wait(spark, site):
    wanted = spark.createDataFrame([(s,) for s in PAGES], "slug string")
    got = listing.fetch_pages(wanted, site.base, at_once=2, delay=0)
    assert {r.slug: r.title for r in got.collect()} == {s: t for s, (t, _) in PAGES.items()}


def test_loops_run_side_by_side_and_stop(store, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    crawls, slow = [], threading.Event()

    def crawl(row):
        crawls.append(row.slug)
        if len(crawls) == 1:
            command._crawl_site(store, row, None, False)
            raise OSError("the site is down")
        slow.wait(60)  # checks and reports go on meanwhile
        return runs.CrawlTotals(0, 0, 0, 0, True)

    page = tmp_path / "out.html"
    pace = Pace(crawl_seconds=0.1, idle_seconds=0.2, busy_seconds=0.1, report_seconds=0.5, progress_seconds=0.5, room=2)
    w = worker.Worker(store, crawl, lambda url: (404, None) if "x.test" in url else (200, None), now, str(page), pace=pace)
    runner = threading.Thread(target=w.run)
    runner.start()
    deadline = time.time() + 150
    while time.time() < deadline and not (len(crawls) > 1 and store.read("link_checks").count() == 3 and w.rounds["progress"] and w.rounds["report"] > 1):
        time.sleep(0.5)
    w.stop.set()
    slow.set()
    runner.join(60)
    assert not runner.is_alive()
    assert store.read("link_checks").count() == 3 and store.read("domain_claims").count() == 0
    assert "crawl of school failed" in caplog.text and "progress: " in caplog.text
    assert page.read_text().startswith("<!DOCTYPE html>")


def test_a_failing_round_does_not_end_its_loop(store, monkeypatch):
    calls = []

    def broken(*args, **kwargs):
        calls.append(1)
        if len(calls) == 3:
            w.stop.set()
        raise RuntimeError("database is gone")

    monkeypatch.setattr(runs, "check", broken)
    w = worker.Worker(store, None, None, now, pace=Pace(idle_seconds=0.01))
    w.check_loop()
    assert len(calls) == 3 and w.rounds["check"] == 3


def test_page_of_the_report(spark, store, site, tmp_path):
    (row,) = store.read("sites").collect()
    command._crawl_site(store, row, None, False)
    clock = datetime(2030, 1, 1)
    for k in range(3):
        runs.check(store, clock.replace(day=1 + 2 * k), 10, ask=lambda url: (404, None), jitter_share=0)
    page = tmp_path / "out.html"
    runs.write_report(store, str(page))
    html = page.read_text()
    assert html.count("<tr data-id=") == 3 and "data-status='broken'" in html and "data-checked='2030-01-05T00:00:00'" in html
    assert "Link: &quot;first&quot;\nStatus: broken (404)\nURL: https://x.test/a\nContext: …Read [first] now.…\nFound on: " in html
    assert html.index("<h4>Maths") < html.index("<h3>Other pages") < html.index("<h4>Deep")
    for part in ("id='words'", "data-act='dismiss'", "data-act='restore'", "data-act='copy'", "<time datetime='2030-01-05T00:00:00'>", "<section id="):
        assert part in html
