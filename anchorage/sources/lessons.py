"""Lesson pages made of the test pages: sections, labels and prose around links, in Spark and as SQL.

A page p has a section with its own text, one whose title follows in bold, and,
if p is divisible by 3, the first one again, so that it is no sure place.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorage.functions import extract
from anchorage.operators.admission import at
from anchorage.plans.materialize import cut, numbered
from anchorage.sources.derive import CRAWLED, SQL, Model

CHECKED = datetime(2024, 1, 20)
BASE = "https://school.test"


def _words(start: str, n: Column, factor: int) -> Column:
    """Words in a row, as many as ``n`` says."""
    p = F.col("page_id")
    words = F.array_join(F.transform(F.sequence(F.lit(1).cast("bigint"), n), lambda k: F.concat(F.lit(start), (p * k * factor % 1000).cast("string"))), " ")
    return F.when(n > 0, words).otherwise("")


class Lessons(Model):
    """The tables of a site whose pages are lessons; pages and sites are those of the test data."""

    @cached_property
    def lessons(self) -> DataFrame:
        """(page_id, url, html, base_url)."""
        p = F.col("page_id")
        text = lambda *parts: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in parts])
        html = text(
            '<div id="day', p % 9, '">Lesson ', p % 9, "* of the day</div><p>", _words("b", p % 25 + 1, 7), ' <a href="https://x', p % 7, ".test/", p, '">link ',
            p, "</a> ", _words("c", p % 20, 11), '</p><div id="week', p % 5, '"><ul><li>list</li></ul></div><strong>Title ', p % 5,
            '</strong><p><a href="https://y.test/', p % 40, '">second</a> tail &amp; end</p>',
            F.when(p % 3 == 0, text('<div id="day', p % 9, '">again</div>')).otherwise(""),
            '<li><a href="//z.test/', p % 100, '#part">third <b>', p, '</b></a></li><a href="/other/', p % 11, '/">own</a><a href="mailto:a@b.c">mail</a><a href="https://e.test/"> </a>',
        )
        return self.raw("pages").select("page_id", text(BASE, "/lesson/", p).alias("url"), html.alias("html"), F.lit(BASE).alias("base_url"))

    @cached_property
    def found(self) -> DataFrame:
        """(page_id, external links) as extracted."""
        return cut(extract.external(self.lessons))

    @cached_property
    def lesson_links(self) -> DataFrame:
        """Links of the lessons with a state that follows from their number; no link is pending."""
        urls = numbered(self.found.select("url").distinct(), ["url"])
        k = F.col("id")
        status = F.when(k % 3 == 0, "broken").when(k % 3 == 1, "unreachable").otherwise("ok")
        failures = F.when(k % 3 == 2, k % 2).otherwise(3).cast("int")
        return cut(
            urls.select(
                "id", "url", F.lower(F.regexp_extract("url", "^[^:/?#]+://([^/?#]*)", 1)).alias("host"), at(CRAWLED).alias("first_seen_at"),
                at(CHECKED).alias("last_checked_at"), at(CHECKED).alias("next_check_at"), F.when(k % 3 == 0, 404).alias("last_http_status"),
                F.when(k % 3 == 1, "timeout").alias("last_error_type"), failures.alias("consecutive_failures"), status.alias("status"),
            )
        )

    @cached_property
    def lesson_places(self) -> DataFrame:
        """Occurrences with their sections, labels and prose."""
        placed = self.found.join(self.lesson_links.select(F.col("id").alias("link_id"), "url"), "url")
        return cut(
            placed.select(
                (F.col("page_id") * 10 + F.col("ord")).alias("id"), (F.col("page_id") + 1).alias("page_id"), "link_id",
                F.coalesce("day_context", F.lit("")).alias("day_context"), "day_label", F.col("text").alias("link_text"), "context_before", "context_after",
                at(CRAWLED).alias("last_seen_at"),
            )
        )

    @property
    def tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Sites, pages and occurrences."""
        return self.sites, self.ordered_pages, self.lesson_places


def _sql_words(start: str, n: str, factor: int) -> str:
    return f"array_to_string(list_transform(range(1, {n} + 1), lambda k: '{start}' || (page_id * k * {factor} % 1000)), ' ')"


_SHORT = """CASE WHEN length({0}) <= 60 THEN {0} WHEN contains({1}({0}, 60), ' ') THEN {2} ELSE {1}({0}, 60) END"""
_END = _SHORT.format("b", "right", "substr(right(b, 60), strpos(right(b, 60), ' ') + 1)")
_START = _SHORT.format("c", "left", "regexp_replace(left(c, 60), ' [^ ]*$', '')")

#: The same for DuckDB, on top of the derived tables; follow with a query.
LESSONS = f"""{SQL}, prose AS (SELECT page_id, {_sql_words('b', 'page_id % 25 + 1', 7)} AS b, {_sql_words('c', 'page_id % 20', 11)} AS c FROM pages),
x_found AS (
  SELECT page_id, 0 AS ord, 'https://x' || (page_id % 7) || '.test/' || page_id AS url, 'link ' || page_id AS text,
    CASE WHEN page_id % 3 <> 0 THEN 'day' || (page_id % 9) END AS day_context, CASE WHEN page_id % 3 <> 0 THEN 'Lesson ' || (page_id % 9) || '*' END AS day_label,
    {_END} AS context_before, nullif({_START}, '') AS context_after FROM prose
  UNION ALL SELECT page_id, 1, 'https://y.test/' || (page_id % 40), 'second', 'week' || (page_id % 5), 'Title ' || (page_id % 5), NULL, 'tail & end' FROM pages
  UNION ALL SELECT page_id, 2, 'https://z.test/' || (page_id % 100), 'third ' || page_id, CASE WHEN page_id % 3 <> 0 THEN 'week' || (page_id % 5) END,
    CASE WHEN page_id % 3 <> 0 THEN 'Title ' || (page_id % 5) END, NULL, NULL FROM pages),
x_links AS (
  SELECT id, url, CASE id % 3 WHEN 0 THEN 'broken' WHEN 1 THEN 'unreachable' ELSE 'ok' END AS status, CASE WHEN id % 3 = 2 THEN id % 2 ELSE 3 END AS failures,
    CASE WHEN id % 3 = 0 THEN 404 END AS http, CASE WHEN id % 3 = 1 THEN 'timeout' END AS error
  FROM (SELECT row_number() OVER (ORDER BY url) AS id, url FROM (SELECT DISTINCT url FROM x_found))),
x_places AS (
  SELECT f.page_id * 10 + f.ord AS id, f.page_id + 1 AS page_id, l.id AS link_id, coalesce(f.day_context, '') AS day_context, f.day_label, f.text AS link_text,
    f.context_before, f.context_after, CASE WHEN f.day_context LIKE 'day%' THEN CAST(substr(f.day_context, 4) AS BIGINT) WHEN f.day_context IS NOT NULL THEN 0 END AS day
  FROM x_found f JOIN x_links l ON l.url = f.url),
x_keys AS (
  SELECT link_id, min_by(slug || ': ' || title, (slug, title)) AS course_key FROM (
    SELECT o.link_id, s.slug, p.title FROM x_places o JOIN m_pages p ON p.id = o.page_id JOIN m_sites s ON s.id = p.site_id) GROUP BY link_id),
x_problems AS (
  SELECT l.*, k.course_key, row_number() OVER (ORDER BY l.status, k.course_key NULLS FIRST, l.failures DESC, l.url) AS rank
  FROM x_links l JOIN x_keys k ON k.link_id = l.id WHERE l.status IN ('broken', 'unreachable')),
x_refs AS (
  SELECT o.*, s.id AS site_id, s.slug AS site_slug, p.title AS page_title, p.url AS page_url, p.kind AS page_kind, p.sort_order, l.url, l.status, l.failures, l.http, l.error
  FROM x_places o JOIN m_pages p ON p.id = o.page_id JOIN m_sites s ON s.id = p.site_id JOIN x_links l ON l.id = o.link_id)
"""
