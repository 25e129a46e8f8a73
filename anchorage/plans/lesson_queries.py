"""Queries over lesson pages, whose links have sections, labels and prose, and over whole runs; with the SQL that each must equal."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anchorage.functions import extract
from anchorage.functions.text import day_display, pluralized, text_display
from anchorage.functions.urls import unescape
from anchorage.operators import admission, reach, report, rules, state, sync
from anchorage.operators.admission import at
from anchorage.plans.materialize import cut, numbered, shared_folder
from anchorage.plans.queries import TEST_ADMISSION, query
from anchorage.settings import Admission
from anchorage.sources import listing
from anchorage.sources.derive import CRAWLED, NOW, SQL, Model
from anchorage.sources.lessons import LESSONS, Lessons
from anchorage.sources.store import Store


def lesson(sql: str):
    """Register a function of ``Lessons``."""
    return query(sql, of=Lessons, tables=LESSONS)


# ---------------------------------------------------------------- extraction


@lesson("SELECT page_id, ord, url, text, day_context, day_label, context_before, context_after FROM x_found")
def section_links(m: Lessons) -> DataFrame:
    return m.found.select("page_id", "ord", "url", "text", "day_context", "day_label", "context_before", "context_after")


@lesson("SELECT id, page_id, link_id, day_context, day_label, link_text, context_before, context_after FROM x_places")
def section_places(m: Lessons) -> DataFrame:
    return m.lesson_places.drop("last_seen_at")


@query("""SELECT index_url, CAST(row_number() OVER (PARTITION BY index_url ORDER BY first) - 1 AS INTEGER) AS ord, url, title FROM (
  SELECT 'https://' || host || '/courses/' AS index_url, 'https://' || host || '/c/' || (page_id % 10) AS url, min(page_id) AS first, 'Page ' || min(page_id) AS title
  FROM raw_pages GROUP BY host, page_id % 10)""")
def course_discovery(m: Model) -> DataFrame:
    own = F.concat(F.lit('<a href="/c/'), (F.col("page_id") % 10).cast("string"), F.lit('/#x"> <b>Page '), F.col("page_id").cast("string"), F.lit("</b></a>"))
    names = m.sites.select(F.col("id").alias("site_id"), "base_url", F.col("course_index_url").alias("index_url"))
    pages = m.pages.select("site_id", (F.col("id") - 1).alias("page_id"))
    rows = pages.groupBy("site_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", own.alias("a")))), lambda x: x["a"]), "").alias("links"))
    html = F.concat(F.lit('<a href="/outside">no</a><div class="post entry-content"><a href="/courses/">self</a><a href="https://far.test/x">far</a>'), "links", F.lit("</div>"))
    return extract.listed(rows.join(names, "site_id").select(html.alias("html"), "index_url", "base_url"))


@query("SELECT page_id, replace(replace(title, '&', '&amp;'), '<', '&lt;') AS raw, title FROM (SELECT id - 1 AS page_id, title FROM m_pages)")
def unescaped_titles(m: Model) -> DataFrame:
    raw = F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return m.pages.select((F.col("id") - 1).alias("page_id"), raw.alias("raw"), unescape(raw).alias("title"))


# ---------------------------------------------------------------- order and report


@lesson("SELECT id, rank, status, course_key FROM x_problems")
def problem_order(m: Lessons) -> DataFrame:
    return report.with_rank(report.problem_links(*m.tables, m.lesson_links)).select("id", "rank", "status", "course_key")


@lesson("""SELECT l.id, row_number() OVER (ORDER BY k.course_key NULLS FIRST, l.failures DESC, l.url) AS rank FROM x_links l JOIN x_keys k ON k.link_id = l.id
  WHERE l.failures > 0 AND l.status NOT IN ('broken', 'unreachable')""")
def watch_order(m: Lessons) -> DataFrame:
    return report.with_watch_rank(report.watch_links(*m.tables, m.lesson_links)).select("id", "rank")


@lesson("""SELECT link_id, id AS page_link_id, day AS day_number, day_label, context_before,
  row_number() OVER (PARTITION BY link_id ORDER BY site_id, page_id, day IS NULL, day, id) AS place FROM x_refs WHERE status IN ('broken', 'unreachable')""")
def page_refs_by_day(m: Lessons) -> DataFrame:
    nested = report.with_pages(*m.tables, report.problem_links(*m.tables, m.lesson_links))
    flat = nested.select(F.col("id").alias("link_id"), F.posexplode("pages").alias("k", "page"))
    return flat.select(
        "link_id", *[f"page.{c}" for c in ("page_link_id", "day_number", "day_label", "context_before")], (F.col("k") + 1).cast("long").alias("place")
    )


_GROUPS = """, x_groups AS (
  SELECT site_slug, page_title, page_url, max(page_kind) AS kind, max(CASE WHEN page_kind = 'course' THEN (site_id, 0, CAST(coalesce(sort_order, 0) AS BIGINT)) ELSE (site_id, 1, page_id) END) AS position,
    count(DISTINCT link_id) AS n_links, count(*) AS n_occurrences FROM x_refs WHERE status IN ('broken', 'unreachable') GROUP BY site_slug, page_title, page_url)"""


def _groups(m: Lessons) -> DataFrame:
    return report.page_groups(*m.tables, report.with_rank(report.problem_links(*m.tables, m.lesson_links)))


@lesson(f"{_GROUPS} SELECT page_url, page_title, kind, n_links, n_occurrences, row_number() OVER (ORDER BY position, page_title, page_url) AS place FROM x_groups")
def group_order(m: Lessons) -> DataFrame:
    chosen = _groups(m).select("position", "page_title", "page_url", "kind", "n_links", "n_occurrences")
    return numbered(chosen, ["position", "page_title", "page_url"], "place").drop("position")


@lesson("""SELECT r.page_url, r.page_title, r.id AS page_link_id, r.link_id, r.day AS day_number, r.day_context,
  row_number() OVER (PARTITION BY r.site_slug, r.page_title, r.page_url ORDER BY r.day IS NULL, r.day, p.rank, r.id) AS place
  FROM x_refs r JOIN x_problems p ON p.id = r.link_id""")
def entry_order(m: Lessons) -> DataFrame:
    flat = _groups(m).select("page_url", "page_title", F.posexplode("entries").alias("k", "e"))
    return flat.select("page_url", "page_title", *[f"e.{c}" for c in ("page_link_id", "link_id", "day_number", "day_context")], (F.col("k") + 1).cast("long").alias("place"))


_PERCENT = "replace(replace(url_encode({}), '-', '%2D'), '+', '%20')"
_HREF = f"""page_url || CASE WHEN day_context = '' AND words < 5 THEN '' ELSE '#' || day_context || CASE WHEN words < 5 THEN '' ELSE ':~:text='
  || CASE WHEN context_before IS NULL THEN '' ELSE {_PERCENT.format('context_before')} || '-,' END || {_PERCENT.format('link_text')}
  || CASE WHEN context_after IS NULL THEN '' ELSE ',-' || {_PERCENT.format('context_after')} END END END"""
_LINKED = """(SELECT *, len(list_filter(string_split(concat_ws(' ', context_before, link_text, context_after), ' '), lambda w: w <> '')) AS words FROM x_refs) """


@lesson(f"SELECT id AS page_link_id, {_HREF} AS href FROM {_LINKED}")
def section_deep_links(m: Lessons) -> DataFrame:
    return report.with_deep_links(report.occurrences(*m.tables, m.lesson_links)).select("page_link_id", "href")


@lesson(f"""SELECT id AS page_link_id, concat_ws(chr(10), site_slug || ': ' || page_title, 'Link: "' || link_text || '"',
  'Status: ' || status || coalesce(' (' || coalesce(error, CAST(http AS VARCHAR)) || ')', ''), 'URL: ' || url,
  CASE WHEN context_before IS NOT NULL OR context_after IS NOT NULL THEN 'Context: …' || coalesce(context_before || ' ', '') || '[' || link_text || ']' || coalesce(' ' || context_after, '') || '…' END,
  'Found on: ' || {_HREF}) AS info FROM {_LINKED}""")
def info_blurbs(m: Lessons) -> DataFrame:
    links = m.lesson_links.select(F.col("id").alias("link_id"), "url", "status", "last_http_status", "last_error_type")
    places = report.with_deep_links(report.occurrences(*m.tables, m.lesson_links)).join(links, "link_id")
    return report.info(places).select("page_link_id", "info")


@lesson("""SELECT id AS page_link_id, CASE WHEN id % 4 = 0 THEN '(no link text)' ELSE link_text END AS shown, CASE WHEN id % 5 = 0 THEN nullif(day_context, '') ELSE coalesce(day_label, nullif(day_context, '')) END AS section,
  (link_id % 4) || CASE WHEN link_id % 4 = 1 THEN ' place' ELSE ' places' END AS counted FROM x_places""")
def displayed(m: Lessons) -> DataFrame:
    k = F.col("id")
    text, label = F.when(k % 4 != 0, F.col("link_text")).otherwise(""), F.when(k % 5 != 0, F.col("day_label"))
    return m.lesson_places.select(
        k.alias("page_link_id"), text_display(text).alias("shown"), day_display(label, F.col("day_context")).alias("section"), pluralized(F.col("link_id") % 4, "place").alias("counted")
    )


@lesson("""SELECT id AS page_link_id, page_url || '::' || link_id || '::' || day_context AS occurrence_id FROM x_refs WHERE link_id % 2 = 1 OR id % 2 = 1 OR day_context = ''""")
def undismissed_sections(m: Lessons) -> DataFrame:
    """Dismissed: every second place of every second link, by its section; those without one had been checked since."""
    times = m.lesson_links.select(F.col("id").alias("link_id"), "last_checked_at")
    places = report.occurrences(*m.tables, m.lesson_links).join(times, "link_id")
    name = F.concat_ws("::", "page_url", F.col("link_id").cast("string"), "day_context")
    when = F.when(F.col("day_context") == "", F.col("last_checked_at") - F.expr("interval 1 day")).otherwise(F.col("last_checked_at"))
    dismissed = places.filter("link_id % 2 = 0 and page_link_id % 2 = 0").select(name.alias("occurrence_id"), when.alias("last_checked_at"))
    return report.undismissed(places, dismissed).select("page_link_id", "occurrence_id")


@query("""SELECT slug, kind, row_number() OVER (ORDER BY slug, kind) AS rank FROM m_sites, (VALUES ('course'), ('other')) k(kind)""")
def summary_order(m: Model) -> DataFrame:
    found = report.site_summaries(m.sites, m.pages, m.page_links, m.links)
    return numbered(found.select("slug", "kind"), ["slug", "kind"], "rank")


@query("""SELECT * FROM (VALUES ('archive', 'Links into an archive of the web are kept as they are.'), ('citation', 'Links that only name a source are citations.'),
  ('no text', 'Links without text, such as images, are not extracted: nobody could find them on the page.'), ('own site', 'Links within a site are followed, not checked.'),
  ('no request', 'Jumps within a page and mail, telephone and script links ask for no page.'), ('orphans', 'Links that no page has any more are kept, but neither checked nor reported.')) r(rule, reason)""", model=False)
def documented_rules(m: Model) -> DataFrame:
    return m.spark.createDataFrame(rules.documented(), "rule string, reason string")


# ---------------------------------------------------------------- listing answers


@query("""SELECT id, slug, 'https://s.test/' || slug AS link, modified_gmt FROM m_pages WHERE id % 10 <> 0""")
def listed_entries(m: Model) -> DataFrame:
    """Ten pages an answer; one answer is an error."""
    entry = F.struct("id", "slug", F.concat(F.lit("https://s.test/"), "slug").alias("link"), "modified_gmt")
    answers = m.pages.groupBy((F.col("id") % 10).alias("part")).agg(F.to_json(F.collect_list(entry)).alias("entries"))
    return listing.listed(answers.select(F.when(F.col("part") == 0, F.lit('{"code": "no", "message": "such page"}')).otherwise(F.col("entries")).alias("body")))


@query("""SELECT id AS wp_id, slug, url, title, 'body ' || id AS html, modified_gmt FROM m_pages WHERE id % 7 <> 0""")
def looked_up_pages(m: Model) -> DataFrame:
    """An answer a page, the first of two in it counts; some slugs have no page."""
    escaped = F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.struct(
        "id", "slug", F.col("url").alias("link"), F.struct(escaped.alias("rendered")).alias("title"),
        F.struct(F.concat(F.lit("body "), F.col("id").cast("string")).alias("rendered")).alias("content"), "modified_gmt",
    )
    other = page.withField("id", F.lit(-1).cast("long"))
    return listing.page_records(m.pages.select(F.when(F.col("id") % 7 == 0, F.lit("[]")).otherwise(F.to_json(F.array(page, other))).alias("body")))


@query("SELECT id, slug, url FROM m_pages WHERE kind = 'course'")
def wanted_lookups(m: Model) -> DataFrame:
    courses = m.pages.filter("kind = 'course'")
    return listing.wanted(courses.select("id", "url")).select("id", "slug", "url")


# ---------------------------------------------------------------- crawl


def _crawl_sql(depth: int, limit: str = "") -> str:
    """Pages reached from courses, level by level; pages divisible by 13 are not listed."""
    levels = [f""", c_courses AS (SELECT page_id AS node, page_id // 50 AS ord FROM pages WHERE page_id % 50 = 0 OR page_id = 13),
      c_edges AS (SELECT src, dst FROM m_edges WHERE src % 13 <> 0 AND dst % 13 <> 0), r0 AS (SELECT node FROM c_courses WHERE node % 13 <> 0 {limit})"""]
    levels += [f", r{k} AS (SELECT DISTINCT e.dst AS node FROM r{k - 1} r JOIN c_edges e ON e.src = r.node)" for k in range(1, depth + 1)]
    union = " UNION ALL ".join(f"SELECT node, {k} AS depth FROM r{k}" for k in range(depth + 1))
    return "".join(levels) + f""", reached AS (SELECT node, min(depth) AS depth FROM ({union}) GROUP BY node),
      crawled AS (SELECT 'p' || r.node AS slug, r.depth, CASE WHEN c.node IS NULL THEN 'other' ELSE 'course' END AS kind, c.ord AS sort_order
        FROM reached r LEFT JOIN c_courses c ON c.node = r.node) """


def _inputs(m: Model, children=None):
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    ids = m.raw("pages").select("page_id")
    p = F.col("page_id")
    courses = ids.filter("page_id % 50 = 0 or page_id = 13").select((p / 50).cast("long").alias("ord"), F.concat(F.lit("https://s.test/"), name(p), F.lit("/")).alias("url"), F.lit("t").alias("title"))
    # Every page is listed twice; the entry with the least id counts.
    once = ids.filter("page_id % 13 <> 0").select(name(p).alias("slug"), p.alias("id"), name(p % 4).alias("modified_gmt"))
    listed = once.unionByName(once.select("slug", (F.col("id") + 1_000_000).alias("id"), F.lit("later").alias("modified_gmt")))
    links = m.edges.filter("src % 13 <> 0").select(name(F.col("src")).alias("slug"), F.concat(F.lit("https://s.test/"), name(F.col("dst")), F.lit("/")).alias("child_url"))
    return courses, listed, (links if children is None else lambda level: children(level, links))


@query(f"{_crawl_sql(8)} SELECT c.slug, c.depth, c.kind, c.sort_order, 'p' || (CAST(substr(c.slug, 2) AS BIGINT) % 4) AS modified_gmt FROM crawled c")
def crawled_site(m: Model) -> DataFrame:
    return reach.crawl_site(*_inputs(m)).pages.select("slug", "depth", "kind", "sort_order", "modified_gmt")


@query(f"{_crawl_sql(8)} SELECT 'p' || node AS slug, ord AS sort_order FROM c_courses WHERE node % 13 = 0")
def missing_courses(m: Model) -> DataFrame:
    return reach.crawl_site(*_inputs(m)).missing.select("slug", "sort_order")


@query(f"{_crawl_sql(8, 'AND ord < 2')} SELECT slug, depth, kind, sort_order FROM crawled")
def limited_crawl(m: Model) -> DataFrame:
    return reach.crawl_site(*_inputs(m), limit=2).pages.select("slug", "depth", "kind", "sort_order")


_TOTALS = "SELECT {} AS depth, count(*) AS found, count(*) FILTER (WHERE kind = 'course') AS courses, EXISTS (SELECT 1 FROM r{} d WHERE d.node NOT IN (SELECT node FROM {})) AS truncated FROM {}"


@query(f"{_crawl_sql(9)}, within AS (SELECT * FROM crawled WHERE depth <= 8), near AS (SELECT * FROM crawled WHERE depth <= 2)"
  f" {_TOTALS.format(8, 9, '(SELECT node FROM reached WHERE depth <= 8)', 'within')} UNION ALL {_TOTALS.format(2, 3, '(SELECT node FROM reached WHERE depth <= 2)', 'near')}")
def crawl_totals(m: Model) -> DataFrame:
    """Counts of a crawl, and whether its depth cut something off: then it is not complete."""
    out = None
    for depth in (8, 2):
        got = reach.crawl_site(*_inputs(m), max_depth=depth)
        counts = got.pages.agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("kind") == "course").alias("courses"))
        row = counts.select(F.lit(depth).alias("depth"), "found", "courses", F.lit(not got.complete).alias("truncated"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"{_crawl_sql(8)} SELECT slug, 'p' || (CAST(substr(slug, 2) AS BIGINT) % 4) <> 'p1' AS fetched FROM crawled")
def fetched_pages(m: Model) -> DataFrame:
    """Of pages reached, those whose token has changed are fetched, the others touched."""
    asked: list[DataFrame] = []
    courses, listed, children = _inputs(m, lambda level, links: asked.append(level) or links.join(level, "slug", "left_semi"))
    first = listed.groupBy("slug").agg(F.min(F.struct("id", "modified_gmt"))["modified_gmt"].alias("modified_gmt"))
    stored = first.select(
        F.monotonically_increasing_id().alias("id"), F.lit(1).cast("long").alias("site_id"), "slug", F.lit("p1").alias("modified_gmt"), at(CRAWLED).alias("internal_links_synced_at")
    )
    known = sync.unchanged(stored, first.withColumn("site_id", F.lit(1).cast("long"))).select("slug", F.lit(False).alias("fetched"))
    reach.crawl_site(courses, listed, children)
    levels = asked[0]
    for level in asked[1:]:
        levels = levels.unionByName(level)
    return levels.join(known, "slug", "left").select("slug", F.coalesce("fetched", F.lit(True)).alias("fetched"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN TIMESTAMP '2024-01-31' ELSE last_crawled_at END AS last_crawled_at, title FROM m_pages")
def touched_pages(m: Model) -> DataFrame:
    return sync.touch_pages(m.ordered_pages, m.pages.filter("id % 4 = 0").select("id"), NOW).select("id", "last_crawled_at", "title")


@query("""SELECT page_id, url, link_text FROM (SELECT o.page_id, u.url, o.link_text FROM m_page_links o JOIN urls u ON u.id = o.link_id WHERE o.page_id % 2 = 1
  UNION ALL SELECT page_id, url, arg_min(text, ord) FROM anchors WHERE page_id % 2 = 0 AND ord % 2 = 0 GROUP BY page_id, url)""")
def synced_pages(m: Model) -> DataFrame:
    """Pages with even ids are crawled again and have lost every second link."""
    edges = m.spark.createDataFrame([], "page_id bigint, child_url string")
    tables = {"sites": m.sites, "pages": m.pages_apart, "links": m.unchecked_links, "page_links": m.page_links, "page_internal_links": edges}
    crawled = m.pages_apart.filter("id % 2 = 0").drop("id")
    urls = m.pages_apart.select(F.col("id").alias("page_id"), "site_id", F.col("url").alias("page_url"), "copy")
    nothing = F.lit(None).cast("string")
    found = m.anchors.filter("page_id % 2 = 0 and ord % 2 = 0").join(urls, "page_id").select(
        "site_id", "page_url", "copy", "ord", "url", "text", "day_context", nothing.alias("day_label"), nothing.alias("context_before"), nothing.alias("context_after")
    )
    children = urls.limit(0).select("site_id", "page_url", "copy", F.lit("").alias("child_url"))
    after = sync.sync_pages(tables, crawled, found, children, NOW, ("copy",))
    links = after["links"].select(F.col("id").alias("link_id"), "url")
    return after["page_links"].join(links, "link_id").select("page_id", "url", "link_text")


@query("""SELECT row_number() OVER (ORDER BY page_id, link_id, day) AS id, page_id, link_id, day AS day_context FROM (
  SELECT page_id, link_id, CASE WHEN link_id % 2 = 0 THEN 'day1' ELSE '' END AS day FROM m_page_links)""")
def rekeyed_occurrences(m: Model) -> DataFrame:
    old = m.page_links.withColumn("day_context", F.when(F.col("link_id") % 2 == 0, "day1"))
    return sync.rekey_occurrences(old).select("id", "page_id", "link_id", "day_context")


# ---------------------------------------------------------------- claims and history


_TAKEN = f"""first_links AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY next_check_at, id) AS rk FROM m_links WHERE next_check_at <= TIMESTAMP '2024-01-31'),
  taken AS (SELECT *, row_number() OVER (ORDER BY next_check_at, id) AS k FROM first_links WHERE rk = 1)"""


def _taken(m: Model) -> DataFrame:
    """The first due link of each host."""
    first = F.row_number().over(Window.partitionBy("host").orderBy("next_check_at", "id"))
    return admission.due(m.links, NOW).withColumn("rk", first).filter("rk = 1").drop("rk")


@query(f", {_TAKEN} SELECT coalesce(c.host, t.host) AS host, CASE WHEN t.host IS NULL THEN c.last_request_started_at ELSE TIMESTAMP '2024-01-31' END AS last_request_started_at FROM m_clock c FULL JOIN taken t ON t.host = c.host")
def clock_after_claim(m: Model) -> DataFrame:
    return admission.after_claim(m.clock, m.claims, _taken(m), NOW, TEST_ADMISSION)[0]


@query(f""", {_TAKEN}, fresh AS (SELECT * FROM m_claims WHERE claimed_at >= TIMESTAMP '2024-01-31' - INTERVAL 1 DAY)
  SELECT id, link_id, host, claimed_at FROM fresh UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM fresh) + k, id, host, TIMESTAMP '2024-01-31' FROM taken""")
def leases_after_claim(m: Model) -> DataFrame:
    return admission.after_claim(m.clock, m.claims, _taken(m), NOW, TEST_ADMISSION)[1]


@query("""SELECT id, true AS within, true AS again, CASE WHEN id % 2 = 0 THEN 7 * 86400 ELSE 3600 END AS usual FROM m_links""")
def jittered_checks(m: Model) -> DataFrame:
    """Due times of successes are within a tenth of a week, first failures wait exactly an hour; a rerun agrees."""
    links = m.links.withColumn("consecutive_failures", F.lit(0))
    results = m.links.select(F.col("id").alias("link_id"), at(NOW).alias("checked_at"), F.when(F.col("id") % 2 == 0, 200).otherwise(404).alias("http_status"), F.lit(None).cast("string").alias("error_type"))
    one, two = (state.step(links, results).select("id", F.col("next_check_at").alias(name)) for name in ("one", "two"))
    usual = F.when(F.col("id") % 2 == 0, 7 * 86400).otherwise(3600)
    wait = F.timestamp_diff("SECOND", at(NOW), F.col("one"))
    close = F.abs(wait - usual) <= F.when(F.col("id") % 2 == 0, F.lit(0.1) * usual + 1).otherwise(0)
    return one.join(two, "id").select("id", close.alias("within"), (F.col("one") == F.col("two")).alias("again"), usual.alias("usual"))


def _store(m: Model) -> Store:
    store = Store(m.spark, f"{shared_folder(m.spark)}/store-{uuid.uuid4()}")
    store.init([("one", "https://one.test", "https://one.test/all")])
    return store


@query("SELECT id, link_id, checked_at, http_status, error_type FROM m_checks")
def appended_history(m: Model) -> DataFrame:
    """A history that came in three parts, of which only the new rows were written each time."""
    store, checks = _store(m), cut(m.checks)
    for part in range(3):
        store.commit(appended={"link_checks": checks.filter(F.col("id") % 3 == part)})
    return store.read("link_checks").select("id", "link_id", "checked_at", "http_status", "error_type")


@query("""SELECT id, url, CASE WHEN id % 6 = 0 THEN 'broken' WHEN id % 3 = 0 THEN 'ok' ELSE status END AS status FROM m_links""")
def patched_links(m: Model) -> DataFrame:
    """Links of which some were patched, and some of these again."""
    store = _store(m)
    store.commit({"links": m.links})
    for step, value in ((3, "ok"), (6, "broken")):
        store.commit(patched={"links": store.read("links").filter(F.col("id") % step == 0).withColumn("status", F.lit(value))})
    return store.read("links").select("id", "url", "status")


@query("SELECT 1 AS id, 'one' AS slug, 'https://new.test' AS base_url, 'https://one.test/all' AS course_index_url UNION ALL SELECT 2, 'two', 'https://two.test', 'https://two.test/all'", model=False)
def configured_sites(m: Model) -> DataFrame:
    """Sites after a second start with another configuration."""
    store = _store(m)
    store.init([("one", "https://new.test", "https://one.test/all"), ("two", "https://two.test", "https://two.test/all")])
    return store.read("sites")


@query("SELECT link_id, status, consecutive_failures, last_checked_at FROM state")
def streamed_states(m: Model) -> DataFrame:
    """The last state that the stream gives of each link, its checks read as one file after the other."""
    from anchorage.streaming import state_stream

    folder = f"{shared_folder(m.spark)}/stream-{uuid.uuid4()}"
    m.checks.repartitionByRange(4, "checked_at", "id").sortWithinPartitions("checked_at", "id").write.parquet(f"{folder}/in")
    name, provider = state_stream.ROCKSDB
    before = m.spark.conf.get(name)
    m.spark.conf.set(name, provider)
    try:
        checks = m.spark.readStream.schema(m.checks.schema).parquet(f"{folder}/in")
        out = state_stream.link_states(checks).writeStream.outputMode("update").foreachBatch(
            lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={k}")
        )
        out.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        m.spark.conf.set(name, before)
    newest = m.spark.read.parquet(f"{folder}/out").groupBy("link_id").agg(F.max_by(F.struct("status", "consecutive_failures", "last_checked_at"), "batch").alias("s"))
    return newest.select("link_id", "s.*")


@query(f"SELECT id FROM m_links WHERE next_check_at <= TIMESTAMP '2024-01-31' AND EXISTS (SELECT 1 FROM m_page_links o WHERE o.link_id = m_links.id) AND host NOT IN ('web.archive.org') ORDER BY next_check_at, id LIMIT 200")
def polled_links(m: Model) -> DataFrame:
    """What polls claim one after the other, without an interval between requests of a host, adds up to what is due first."""
    links, places, clock, claims = m.links, m.page_links, m.clock.limit(0), m.claims.limit(0)
    free = Admission(1_000_000, timedelta(0), timedelta(days=1))
    one = cut(admission.claim(links, places, clock, claims, NOW, 120, free))
    clock, claims = (cut(t) for t in admission.after_claim(clock, claims, one, NOW, free))
    two = admission.claim(links, places, clock, claims, NOW, 80, free)
    return one.select("id").unionByName(two.select("id"))
