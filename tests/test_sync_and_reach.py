"""Merging crawls, and reachability."""

from __future__ import annotations

from datetime import datetime

import pytest

from anchorage import schemas
from anchorage.operators import reach, sync

NOW = datetime(2024, 5, 1, 12)


def frame(spark, rows, name):
    return spark.createDataFrame(rows, schemas.struct(schemas.TABLES[name]))


@pytest.fixture
def state(spark):
    return {
        "sites": frame(spark, [(1, "s", "https://s.test", None)], "sites"),
        "pages": frame(spark, [(5, 1, "https://s.test/a", "a", "A", NOW, "v1", "course", 0, NOW)], "pages"),
        "links": frame(spark, [(7, "https://x.test/old", "x.test", NOW, NOW, NOW, 404, None, 2, "ok")], "links"),
        "page_links": frame(spark, [(9, 5, 7, "", None, "old", None, None, NOW)], "page_links"),
        "page_internal_links": frame(spark, [(5, "https://s.test/gone")], "page_internal_links"),
    }


FOUND = "site_id long, page_url string, ord int, url string, text string, day_context string, day_label string, context_before string, context_after string"


def crawl(spark, found, pages=(("https://s.test/a", "a"), ("https://s.test/b", "b")), site=1):
    crawled = spark.createDataFrame(
        [(site, url, slug, slug.upper(), NOW, "v2", "course", 0, NOW) for url, slug in pages], schemas.struct(schemas.PAGES.replace("id bigint, ", "", 1))
    )
    children = spark.createDataFrame([(site, "https://s.test/a", "https://s.test/b")], "site_id long, page_url string, child_url string")
    return crawled, spark.createDataFrame(found, FOUND), children


def test_sync(spark, state):
    found = [
        (1, "https://s.test/a", 0, "https://x.test/new", "New", None, None, None, None),
        (1, "https://s.test/a", 1, "https://x.test/new", "Again", None, None, None, None),
        (1, "https://s.test/b", 0, "https://x.test/old", "Old", "day1", "Day 1", "b", "a"),
    ]
    after = sync.sync_pages(state, *crawl(spark, found), NOW)
    assert sorted((r.id, r.url, r.modified_gmt) for r in after["pages"].collect()) == [(5, "https://s.test/a", "v2"), (6, "https://s.test/b", "v2")]
    links = {r.url: (r.id, r.status, r.consecutive_failures) for r in after["links"].collect()}
    assert links == {"https://x.test/old": (7, "ok", 2), "https://x.test/new": (8, "pending", 0)}
    places = sorted((r.page_id, r.link_id, r.day_context, r.link_text) for r in after["page_links"].collect())
    assert places == [(5, 8, "", "New"), (6, 7, "day1", "Old")]
    assert [tuple(r) for r in after["page_internal_links"].collect()] == [(5, "https://s.test/b")]
    again = sync.sync_pages(after, *crawl(spark, found), NOW)
    assert sorted(r.id for r in again["page_links"].collect()) == sorted(r.id for r in after["page_links"].collect())


def test_unknown_site(spark, state):
    with pytest.raises(ValueError, match="unknown site 3"):
        sync.sync_pages(state, *crawl(spark, [], site=3), NOW)


def test_unchanged_and_touched(spark, state):
    listing = spark.createDataFrame([(1, "a", "v1"), (1, "b", "v1")], "site_id long, slug string, modified_gmt string")
    assert [r.id for r in sync.unchanged(state["pages"], listing).collect()] == [5]
    assert sync.unchanged(state["pages"], listing, force=True).count() == 0
    later = datetime(2025, 1, 1)
    touched = sync.touch_pages(state["pages"], sync.unchanged(state["pages"], listing), later).first()
    assert (touched.last_crawled_at, touched.modified_gmt, touched.kind) == (later, "v1", "course")


def test_old_tables(spark):
    old = spark.createDataFrame([(2, 1, None, "b"), (1, 1, "day2", "a")], "page_id long, link_id long, day_context string, link_text string")
    rows = sync.rekey_occurrences(old).collect()
    assert sorted((r.id, r.page_id, r.day_context) for r in rows) == [(1, 1, "day2"), (2, 2, "")]
    assert "kind" in sync.add_missing_column(old, "kind", "string", "course").columns
    assert sync.add_missing_column(old, "page_id", "long").columns == old.columns


def test_reach(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "node long")
    full = reach.reach(seeds, edges)
    assert not full.truncated and {tuple(r) for r in full.nodes.collect()} == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)}
    part = reach.reach(seeds, edges, 2)
    assert part.truncated and {r.node for r in part.nodes.collect()} == {1, 2, 3}


def test_crawl_site(spark):
    courses = spark.createDataFrame([(0, "https://s.test/a/", "A"), (1, "https://s.test/gone", "G")], "ord int, url string, title string")
    listing = spark.createDataFrame([("a", "v"), ("b", "v"), ("c", "v")], "slug string, modified_gmt string")
    children = spark.createDataFrame([("a", "https://s.test/x/b"), ("a", "https://s.test/file.pdf"), ("b", "https://s.test/a")], "slug string, child_url string")
    got = reach.crawl_site(courses, listing, children)
    assert {(r.slug, r.depth, r.kind) for r in got.pages.collect()} == {("a", 0, "course"), ("b", 1, "other")}
    assert [r.slug for r in got.missing.collect()] == ["gone"] and got.complete
    assert not reach.crawl_site(courses, listing, children, limit=1).complete
    assert not reach.crawl_site(courses.limit(0), listing, children).complete


def test_prune(spark, state):
    sites = spark.createDataFrame([(1,)], "site_id long")
    nothing = spark.createDataFrame([], "id long")
    assert sync.prune(state["page_links"], state["pages"], nothing, sites).count() == 0
    assert sync.prune(state["page_links"], state["pages"], state["pages"].select("id"), sites).count() == 1
