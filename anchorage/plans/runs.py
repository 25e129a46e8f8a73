"""Runs over stored tables: take in a crawl, check what is due, report."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.functions import extract
from anchorage.operators import admission, reach, report, state, sync
from anchorage.operators.admission import at
from anchorage.plans.materialize import cut
from anchorage.plans.render import html_lines, text_report
from anchorage.settings import Admission
from anchorage.sources import probe
from anchorage.sources.store import Conflict, Store, Tables


@dataclass(frozen=True)
class CrawlTotals:
    found: int
    courses: int
    other: int
    missing: int
    complete: bool


class Checked(int):
    """How many links a poll claimed, and of these how many were not ok."""

    not_ok: int

    def __new__(cls, claimed: int, not_ok: int = 0) -> Checked:
        out = super().__new__(cls, claimed)
        out.not_ok = not_ok
        return out


def _committing(store: Store, work, tries: int = 5):
    """``work`` on the tables of the current version, again where someone else has committed meanwhile."""
    for left in range(tries - 1, -1, -1):
        try:
            return work(store.read_all())
        except Conflict:
            if not left:
                raise


def crawl(store: Store, site_id: int, index_html: str, listing: DataFrame, bodies, now: datetime, limit: int | None = None, force: bool = False) -> CrawlTotals:
    """Take one site's pages in.

    ``listing`` is (slug, link, modified_gmt) of landed answers.  ``bodies`` is
    (slug, url, title, html), or a function that gives them for (slug, link): it
    is asked, level by level, for pages that were reached and whose version
    token is not known, and only for these.  Other pages are only touched.  A
    complete crawl prunes pages that nothing leads to any more.
    """
    return _committing(store, lambda tables: _crawl(store, tables, site_id, index_html, listing, bodies, now, limit, force))


def _crawl(store: Store, tables: Tables, site_id: int, index_html: str, listing: DataFrame, bodies, now: datetime, limit: int | None, force: bool) -> CrawlTotals:
    site = tables["sites"].filter(F.col("id") == site_id).first()
    if site is None:
        raise ValueError(f"unknown site {site_id}")
    spark = store.spark
    fetch = bodies if callable(bodies) else lambda wanted: bodies.join(wanted.select("slug"), "slug", "left_semi")
    rows = extract.listed_pages(index_html, site.course_index_url, site.base_url)
    courses = spark.createDataFrame([(r["ord"], r["url"], r["title"]) for r in rows], "ord int, url string, title string")
    listing = listing.withColumn("site_id", F.lit(site_id).cast("bigint"))
    known = cut(sync.unchanged(tables["pages"], listing, force))
    links = tables["page_internal_links"].withColumnRenamed("page_id", "id")
    fetched: list[DataFrame] = []
    parsed: list[DataFrame] = []

    def children(level: DataFrame) -> DataFrame:
        """(slug, child_url) of a level's pages; those that have changed are fetched and read."""
        wanted = listing.join(level, "slug", "left_semi").join(known.select("slug"), "slug", "left_anti")
        fresh = cut(fetch(wanted.select("slug", "link")).select("slug", "url", "title", "html", F.lit(site.base_url).alias("base_url")))
        read = cut(extract.extract(fresh.select(F.col("slug").alias("page_id"), "url", "html", "base_url")).withColumnRenamed("page_id", "slug"))
        fetched.append(fresh.select("slug", "url", "title"))
        parsed.append(read)
        stored = known.join(level, "slug", "left_semi").join(links, "id").select("slug", "child_url")
        return read.select("slug", F.explode("internal").alias("child_url")).unionByName(stored)

    got = reach.crawl_site(courses, listing, children, limit)
    pages = cut(got.pages.select("slug", "kind", "sort_order", "depth", "modified_gmt"))
    fresh, read = reduce(DataFrame.unionByName, fetched), reduce(DataFrame.unionByName, parsed)
    crawled = pages.join(fresh, "slug").select(
        F.lit(site_id).cast("bigint").alias("site_id"), "url", "slug", "title", at(now).alias("last_crawled_at"), "modified_gmt", "kind",
        F.col("sort_order").cast("int").alias("sort_order"), at(now).alias("internal_links_synced_at"),
    )
    urls = crawled.select("slug", "site_id", F.col("url").alias("page_url"))
    found = read.select("slug", F.inline("external")).join(urls, "slug").drop("slug")
    edges = read.select("slug", F.explode("internal").alias("child_url")).join(urls, "slug").drop("slug")
    after = sync.sync_pages(tables, crawled, found, edges, now)
    touched = known.join(pages.select("slug"), "slug", "left_semi")
    after["pages"] = sync.touch_pages(after["pages"], touched, now)
    if got.complete:
        reached = after["pages"].filter(F.col("site_id") == site_id).join(pages.select("slug"), "slug", "left_semi").select("id")
        only = spark.createDataFrame([(site_id,)], "site_id bigint")
        after["page_links"] = sync.prune(after["page_links"], after["pages"], reached, only)
    store.commit({name: after[name] for name in ("pages", "links", "page_links", "page_internal_links")}, base=tables.version)
    counts = pages.agg(F.count(F.lit(1)), F.count_if(F.col("kind") == "course")).first()
    return CrawlTotals(counts[0], counts[1], counts[0] - counts[1], got.missing.count(), got.complete)


def check(store: Store, now: datetime, limit: int, ask=probe.request, rules: Admission = Admission(), jitter_share: float = 0.1, recover=None) -> Checked:
    """Claim due links, ask for each, record outcomes and release the leases; also where asking fails.

    ``recover`` may try again after a bad certificate.  Returns the number
    claimed, which tells how many of them were not ok.
    """

    def claim(tables: Tables) -> DataFrame:
        claimed = cut(admission.claim(tables["links"], tables["page_links"], tables["domain_state"], tables["domain_claims"], now, limit, rules))
        if not claimed.isEmpty():
            clock, claims = admission.after_claim(tables["domain_state"], tables["domain_claims"], claimed, now, rules)
            store.commit({"domain_state": clock, "domain_claims": claims}, base=tables.version)
        return claimed

    claimed = _committing(store, claim)
    n = claimed.count()
    if not n:
        return Checked(0)
    try:
        results = cut(probe.probe(claimed, ask, recover).withColumn("checked_at", at(now)))
        record(store, results, jitter_share)
    except BaseException:
        finished = claimed.select(F.col("id").alias("link_id"))
        _committing(store, lambda t: store.commit({"domain_claims": admission.release(t["domain_claims"], finished)}, base=t.version))
        raise
    return Checked(n, report.progress(results).first()["not_ok"])


def record(store: Store, results: DataFrame, jitter_share: float = 0.1) -> None:
    """Append outcomes (link_id, checked_at, http_status, error_type, response_time_ms), move link states, release leases.

    Only the new rows of the history and the links that were asked for are written.
    """

    def write(tables: Tables) -> None:
        history = tables["link_checks"]
        top = history.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
        http, error = F.col("http_status"), F.col("error_type")
        numbered = results.withColumn("classified_broken", state.classified_broken(http, error))
        # Ids leave gaps: they only have to be new and to rise with time.
        new = numbered.crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.monotonically_increasing_id() + 1)
        asked = tables["links"].join(results.select(F.col("link_id").alias("id")), "id", "left_semi")
        moved = state.step(asked, results, jitter_share)
        claims = admission.release(tables["domain_claims"], results)
        store.commit({"domain_claims": claims}, {"link_checks": new.select(*history.columns)}, {"links": moved}, tables.version)

    _committing(store, write)


def requeue_broken(store: Store, now: datetime) -> int:
    """Make broken and unreachable links due now; returns how many moved."""

    def move(tables: Tables) -> int:
        links, moved = admission.pull_forward(tables["links"], now)
        n = moved.count()
        if n:
            store.commit(patched={"links": links.join(moved.select("id"), "id", "left_semi")}, base=tables.version)
        return n

    return _committing(store, move)


def write_report(store: Store, path: str | None = None) -> str:
    """The text report; with a path, the HTML report goes there in one step."""
    tables = store.read_all()
    if path is not None:
        target = Path(path)
        staged = target.with_name(f".{target.name}.{uuid.uuid4()}")
        with staged.open("w", encoding="utf-8") as out:
            out.writelines(f"{line}\n" for line in html_lines(tables))
        os.replace(staged, target)
    return text_report(tables)


def drain(store: Store, now, limit: int, **options) -> int:
    """Check until nothing is due or ``limit`` links were claimed; ``now`` is a function giving the time."""
    claimed = 0
    while claimed < limit:
        n = check(store, now(), limit - claimed, **options)
        if not n:
            break
        claimed += n
    return claimed
