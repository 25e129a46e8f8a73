"""The link-health tables as derived from the test tables, in Spark and as SQL common table expressions.

Hosts of page URLs are sites, pages with even ids are courses, anchors are
occurrences, and events are checks of links.  Nothing here depends on when it
runs: the present is a fixed time.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorage.functions.urls import host, slug
from anchorage.operators.admission import at
from anchorage.operators.state import classified_broken, with_folded_state
from anchorage.operators.sync import first_of_each, with_new_state
from anchorage.plans.materialize import cut, numbered
from anchorage.settings import COURSE, OTHER

NOW = datetime(2024, 1, 31)
CRAWLED = datetime(2024, 1, 1)
#: An href of the test pages starts at the root of its host.
ANCHOR = '<a href="([^"]*)">([^<]*)</a>'


def _decoded(text: Column) -> Column:
    for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


class Model:
    """Tables of one folder; each is worked out when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def sites(self) -> DataFrame:
        hosts = self.raw("pages").select(host("url").alias("slug")).distinct()
        base = F.concat(F.lit("https://"), "slug")
        return numbered(hosts, ["slug"]).select("id", "slug", base.alias("base_url"), F.concat(base, F.lit("/courses/")).alias("course_index_url"))

    @cached_property
    def pages(self) -> DataFrame:
        """Pages but for ``sort_order``; ``html`` rides along, and what is made of it is made before the join, so that it can stay behind."""
        raw = self.raw("pages").select(
            host("url").alias("slug_of_site"), (F.col("page_id") + 1).alias("id"), "url", slug("url").alias("slug"),
            _decoded(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), at(CRAWLED).alias("last_crawled_at"),
            F.md5(F.col("html")).alias("modified_gmt"), F.when(F.col("page_id") % 2 == 0, COURSE).otherwise(OTHER).alias("kind"),
            at(CRAWLED).alias("internal_links_synced_at"), "html",
        )
        sites = self.sites.select(F.col("id").alias("site_id"), F.col("slug").alias("slug_of_site"))
        return raw.join(sites, "slug_of_site").select("id", "site_id", *[c for c in raw.columns if c not in ("id", "slug_of_site")])

    @cached_property
    def ordered_pages(self) -> DataFrame:
        """Pages with ``sort_order``: the place of a course among its site's."""
        courses = numbered(self.pages.filter(F.col("kind") == COURSE).select("site_id", "id"), ["site_id", "id"], "place", 0)
        first = courses.groupBy("site_id").agg(F.min("place").alias("first"))
        order = courses.join(first, "site_id").select("id", (F.col("place") - F.col("first")).cast("int").alias("sort_order"))
        return self.pages.drop("html").join(order, "id", "left")

    @cached_property
    def pages_apart(self) -> DataFrame:
        """Ordered pages with ``copy``, which tells pages of one URL apart: 0 for the first of them, as for all others."""
        first = self.pages.groupBy("site_id", "url").agg(F.min("id").alias("first"))
        told = self.ordered_pages.join(first, ["site_id", "url"]).withColumn("copy", F.col("id") - F.col("first")).drop("first")
        return cut(told)  # a stored table, as page_links

    @cached_property
    def anchors(self) -> DataFrame:
        """(page_id, ord, url, text, day_context) of every anchor."""
        origin = F.regexp_extract("url", "^([^:/?#]+://[^/?#]*)", 1)
        found = self.raw("pages").select(
            (F.col("page_id") + 1).alias("page_id"), origin.alias("origin"),
            F.posexplode(F.regexp_extract_all("html", F.lit("(" + ANCHOR + ")"), F.lit(1))).alias("ord", "anchor"),
        )
        return found.select(
            "page_id", "ord", F.concat("origin", F.regexp_extract("anchor", ANCHOR, 1)).alias("url"),
            _decoded(F.regexp_extract("anchor", ANCHOR, 2)).alias("text"), F.lit(None).cast("string").alias("day_context"),
        )

    @cached_property
    def unchecked_links(self) -> DataFrame:
        return with_new_state(numbered(self.anchors.select("url").distinct(), ["url"]), CRAWLED)

    @cached_property
    def page_links(self) -> DataFrame:
        placed = first_of_each(self.anchors).join(self.unchecked_links.select(F.col("id").alias("link_id"), "url"), "url")
        nothing = F.lit(None).cast("string")
        stored = placed.select(
            (F.col("page_id") * 100_000 + F.col("ord")).alias("id"), "page_id", "link_id", "day_context", nothing.alias("day_label"),
            F.col("text").alias("link_text"), nothing.alias("context_before"), nothing.alias("context_after"), at(CRAWLED).alias("last_seen_at"),
        )
        return cut(stored)  # a stored table: read more than once by most queries

    @cached_property
    def checks(self) -> DataFrame:
        kind = F.col("event_type")
        status = F.when(kind == "view", 200).when(kind == "click", 403).when(kind == "purchase", 500).when(kind == "signup", 404)
        error = F.when(kind == "error", "timeout")
        return self.raw("events").select(
            F.col("event_id").alias("id"), (F.col("user_id") + 1).alias("link_id"), F.col("ts").alias("checked_at"), status.alias("http_status"),
            error.alias("error_type"), F.floor(F.col("value") * 10).cast("int").alias("response_time_ms"),
            classified_broken(status, error).alias("classified_broken"),
        )

    @cached_property
    def links(self) -> DataFrame:
        """Links with the state of their history, without jitter."""
        return cut(with_folded_state(self.unchecked_links, self.checks, jitter_share=0))

    @cached_property
    def hosts_checked(self) -> DataFrame:
        return self.checks.join(self.unchecked_links.select(F.col("id").alias("link_id"), "host"), "link_id")

    @cached_property
    def clock(self) -> DataFrame:
        return self.hosts_checked.groupBy("host").agg(F.max("checked_at").alias("last_request_started_at"))

    @cached_property
    def claims(self) -> DataFrame:
        """A lease for every seventh link, from the time of its last check."""
        chosen = self.hosts_checked.filter(F.col("link_id") % 7 == 0)
        return chosen.groupBy("link_id", "host").agg(F.max("checked_at").alias("claimed_at")).select(F.col("link_id").alias("id"), "link_id", "host", "claimed_at")

    @cached_property
    def edges(self) -> DataFrame:
        """(src, dst) between page ids: a cyclic graph."""
        ids = self.raw("pages").select("page_id")
        n = F.lit(ids.count())
        a = ids.select(F.col("page_id").alias("src"), ((F.col("page_id") * 3 + 1) % n).alias("dst"))
        b = ids.filter("page_id % 4 <> 0").select(F.col("page_id").alias("src"), ((F.col("page_id") + 7) % n).alias("dst"))
        return a.unionByName(b).distinct()


_TEXT = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&#x27;', ''''), '&amp;', '&')"

#: The same tables for DuckDB; follow with a query.
SQL = f"""
WITH raw_pages AS (
  SELECT page_id, url, html, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS host,
         regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) AS origin FROM pages),
m_sites AS (
  SELECT CAST(row_number() OVER (ORDER BY host) AS BIGINT) AS id, host AS slug, 'https://' || host AS base_url,
         'https://' || host || '/courses/' AS course_index_url FROM (SELECT DISTINCT host FROM raw_pages)),
m_pages AS (
  SELECT p.page_id + 1 AS id, s.id AS site_id, p.url, regexp_extract(rtrim(p.url, '/'), '([^/]*)$', 1) AS slug,
         {_TEXT.format("regexp_extract(p.html, '<title>([^<]*)</title>', 1)")} AS title,
         TIMESTAMP '2024-01-01' AS last_crawled_at, md5(p.html) AS modified_gmt,
         CASE WHEN p.page_id % 2 = 0 THEN 'course' ELSE 'other' END AS kind,
         CASE WHEN p.page_id % 2 = 0 THEN CAST(count(CASE WHEN p.page_id % 2 = 0 THEN 1 END) OVER (PARTITION BY s.id ORDER BY p.page_id) - 1 AS INTEGER) END AS sort_order
  FROM raw_pages p JOIN m_sites s ON s.slug = p.host),
found AS (
  SELECT page_id + 1 AS page_id, origin, unnest(regexp_extract_all(html, '{ANCHOR}')) AS anchor,
         unnest(range(len(regexp_extract_all(html, '{ANCHOR}')))) AS ord FROM raw_pages),
anchors AS (
  SELECT page_id, ord, origin || regexp_extract(anchor, '{ANCHOR}', 1) AS url,
         {_TEXT.format(f"regexp_extract(anchor, '{ANCHOR}', 2)")} AS text FROM found),
urls AS (SELECT CAST(row_number() OVER (ORDER BY url) AS BIGINT) AS id, url FROM (SELECT DISTINCT url FROM anchors)),
m_page_links AS (
  SELECT a.page_id * 100000 + min(a.ord) AS id, a.page_id, u.id AS link_id, '' AS day_context, arg_min(a.text, a.ord) AS link_text
  FROM anchors a JOIN urls u USING (url) GROUP BY a.page_id, u.id),
m_checks AS (
  SELECT event_id AS id, user_id + 1 AS link_id, ts AS checked_at,
         CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 403 WHEN 'purchase' THEN 500 WHEN 'signup' THEN 404 END AS http_status,
         CASE WHEN event_type = 'error' THEN 'timeout' END AS error_type,
         CASE event_type WHEN 'error' THEN 'unreachable' WHEN 'signup' THEN 'broken' ELSE 'ok' END AS class FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY checked_at DESC, id DESC) AS back FROM m_checks),
last_ok AS (SELECT link_id, min(back) AS ok_back FROM ranked WHERE class = 'ok' GROUP BY link_id),
folded AS (
  SELECT r.link_id, r.class, r.checked_at, r.http_status, r.error_type, o.ok_back IS NOT NULL AS had_ok,
         coalesce(o.ok_back - 1, (SELECT count(*) FROM ranked x WHERE x.link_id = r.link_id)) AS streak
  FROM ranked r LEFT JOIN last_ok o ON o.link_id = r.link_id WHERE r.back = 1),
state AS (
  SELECT link_id, CASE WHEN class = 'ok' OR streak >= 3 THEN class WHEN had_ok THEN 'ok' ELSE 'pending' END AS status,
         CAST(CASE WHEN class = 'ok' THEN 0 ELSE least(streak, 3) END AS INTEGER) AS consecutive_failures,
         checked_at AS last_checked_at, http_status AS last_http_status, error_type AS last_error_type FROM folded),
m_links AS (
  SELECT u.id, u.url, lower(regexp_extract(u.url, '^[^:/?#]+://([^/?#]*)', 1)) AS host, TIMESTAMP '2024-01-01' AS first_seen_at,
         s.last_checked_at, CASE WHEN s.link_id IS NULL THEN TIMESTAMP '2024-01-01' WHEN s.consecutive_failures = 0 THEN s.last_checked_at + INTERVAL 7 DAY
           WHEN s.consecutive_failures >= 3 THEN s.last_checked_at + INTERVAL 1 DAY WHEN s.consecutive_failures = 1 THEN s.last_checked_at + INTERVAL 60 MINUTE
           ELSE s.last_checked_at + INTERVAL 1440 MINUTE END AS next_check_at,
         s.last_http_status, s.last_error_type, coalesce(s.consecutive_failures, 0) AS consecutive_failures, coalesce(s.status, 'pending') AS status
  FROM urls u LEFT JOIN state s ON s.link_id = u.id),
hosts_checked AS (SELECT c.*, l.host FROM m_checks c JOIN m_links l ON l.id = c.link_id),
m_clock AS (SELECT host, max(checked_at) AS last_request_started_at FROM hosts_checked GROUP BY host),
m_claims AS (SELECT link_id AS id, link_id, host, max(checked_at) AS claimed_at FROM hosts_checked WHERE link_id % 7 = 0 GROUP BY link_id, host),
m_edges AS (
  SELECT page_id AS src, (page_id * 3 + 1) % (SELECT count(*) FROM pages) AS dst FROM pages
  UNION SELECT page_id, (page_id + 7) % (SELECT count(*) FROM pages) FROM pages WHERE page_id % 4 <> 0)
"""
