"""Queries against their SQL where several pages have one URL."""

from __future__ import annotations

import pytest

from anchorage.operators import sync
from anchorage.plans import lesson_queries  # noqa: F401 - registers its queries
from anchorage.plans.queries import ORACLES, QUERIES
from tests.test_queries import duckdb, values
from tests.test_sync_and_reach import NOW, crawl, state  # noqa: F401 - a fixture

#: Pages by number: the first URL is there for every remainder by 2, 3 and 6, the second and third for some.
REPEATED = {**dict.fromkeys(range(6), 0), 7: 1, 10: 1, 8: 2, 14: 2}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = []
    for k in range(20):
        links = "".join(f'<a href="/{(k * 3 + j) % 11}">{k} {j}</a>' for j in range(4))
        rows.append((k, f"https://h{k % 2 if k not in REPEATED else 0}.test/{REPEATED.get(k, k + 100)}", f"<title>T{k}</title>{links}"))
    path = tmp_path_factory.mktemp("repeated")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["upsert_pages", "synced_pages", "wanted_lookups"])
def test_query_equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("pages", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got, expected = QUERIES[name](spark, folder).toPandas(), con.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns)
    assert values(got) == values(expected)


def test_pages_of_one_url_apart(spark, state):
    """The second page of a URL is crawled: the first one keeps its place, link and edge."""
    pages = state["pages"].selectExpr("*", "0L copy")
    second = pages.selectExpr("id + 1 id", *[c for c in pages.columns if c not in ("id", "copy")], "1L copy")
    stored = {**state, "pages": pages.unionByName(second)}
    found = [(1, "https://s.test/a", 0, "https://x.test/new", "New", None, None, None, None)]
    crawled, found, children = (x.selectExpr("*", "1L copy") for x in crawl(spark, found, (("https://s.test/a", "a"),)))
    after = sync.sync_pages(stored, crawled, found, children, NOW, ("copy",))
    assert sorted((r.id, r.url, r.modified_gmt) for r in after["pages"].collect()) == [(5, "https://s.test/a", "v1"), (6, "https://s.test/a", "v2")]
    assert sorted((r.page_id, r.link_id, r.link_text) for r in after["page_links"].collect()) == [(5, 7, "old"), (6, 8, "New")]
    assert sorted(tuple(r) for r in after["page_internal_links"].collect()) == [(5, "https://s.test/gone"), (6, "https://s.test/b")]
