"""Merging a crawl into the stored pages, links and occurrences.

Every function takes tables and gives the tables that follow; nothing is
changed in place.  A full outer join on the key is the upsert, since plain
Parquet tables have no MERGE.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorage.functions.urls import host
from anchorage.operators.admission import at
from anchorage.plans.materialize import numbered
from anchorage.settings import PENDING


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], overwrite: list[str], order: list[str] | None = None) -> DataFrame:
    """``stored`` with the rows of ``incoming``: known keys get the columns of ``overwrite``, new keys a row and the next ids.

    ``incoming`` has one row a key and no id; its other columns are those of
    ``stored``.  Ids of new rows follow ``order``, by default the key.
    """
    known = stored.select(*key, "id")
    new = numbered(incoming.join(known.select(*key), key, "left_anti"), order or key, "number", 0)
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))  # one row
    added = new.crossJoin(F.broadcast(top)).withColumn("id", F.col("number") + F.col("top") + 1)
    fresh = incoming.select(*key, *[F.col(c).alias(f"new_{c}") for c in overwrite], F.lit(True).alias("hit"))
    kept = stored.join(fresh, key, "left")
    values = [F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in overwrite else F.col(c) for c in stored.columns]
    return kept.select(*values).unionByName(added.select(*stored.columns))


def upsert_sites(sites: DataFrame, configured: DataFrame) -> DataFrame:
    """Sites by slug, with URLs as configured."""
    return upsert(sites, configured, ["slug"], ["base_url", "course_index_url"])


def upsert_pages(pages: DataFrame, crawled: DataFrame, apart: tuple[str, ...] = ()) -> DataFrame:
    """Pages by (site_id, url), and by the columns ``apart`` where several pages of a site have one URL; a crawl tells everything else."""
    key = ["site_id", "url", *apart]
    rest = [c for c in pages.columns if c != "id" and c not in key]
    return upsert(pages, crawled, key, rest)


def with_new_state(urls: DataFrame, now: datetime) -> DataFrame:
    """Distinct URLs (url, and id if they have one) as links: unchecked and due at once."""
    nothing = F.lit(None)
    return urls.select(
        *[c for c in urls.columns if c == "id"], "url", host("url").alias("host"), at(now).alias("first_seen_at"), nothing.cast("timestamp_ntz").alias("last_checked_at"),
        at(now).alias("next_check_at"), nothing.cast("int").alias("last_http_status"), nothing.cast("string").alias("last_error_type"),
        F.lit(0).alias("consecutive_failures"), F.lit(PENDING).alias("status"),
    )


def upsert_links(links: DataFrame, found: DataFrame, now: datetime) -> DataFrame:
    """Links with those of ``found`` (url) that were not there; the state of known links stays."""
    return upsert(links, with_new_state(found.select("url").distinct(), now), ["url"], [])


def first_of_each(found: DataFrame) -> DataFrame:
    """Of occurrences (page_id, ord, url, day_context, ...) the first for each page, URL and section; no section is ''."""
    key = ["page_id", "url", "day_context"]
    rows = found.withColumn("day_context", F.coalesce("day_context", F.lit("")))
    rest = [c for c in rows.columns if c not in key and c != "ord"]
    first = rows.groupBy(*key).agg(F.min(F.struct("ord", *rest)).alias("first"))
    return first.select(*key, F.col("first.ord").alias("ord"), *[F.col(f"first.{c}").alias(c) for c in rest])


def upsert_occurrences(page_links: DataFrame, current: DataFrame) -> DataFrame:
    """Occurrences by (page_id, link_id, day_context), with text and time as just seen."""
    rest = [c for c in page_links.columns if c not in ("id", "page_id", "link_id", "day_context")]
    return upsert(page_links, current, ["page_id", "link_id", "day_context"], rest)


def stale_occurrences(page_links: DataFrame, current: DataFrame, synced: DataFrame) -> DataFrame:
    """Stored occurrences of synced pages (page_id) that the pages no longer have."""
    of_synced = page_links.join(synced.select("page_id").distinct(), "page_id", "left_semi")
    return of_synced.join(current.select("page_id", "link_id", "day_context"), ["page_id", "link_id", "day_context"], "left_anti")


def replace_edges(edges: DataFrame, current: DataFrame, synced: DataFrame) -> DataFrame:
    """Edges with all those of synced pages (page_id) replaced."""
    others = edges.join(synced.select("page_id").distinct(), "page_id", "left_anti")
    return others.select("page_id", "child_url").unionByName(current.select("page_id", "child_url").distinct())


def sync_pages(
    state: dict[str, DataFrame], crawled: DataFrame, found: DataFrame, children: DataFrame, now: datetime, apart: tuple[str, ...] = ()
) -> dict[str, DataFrame]:
    """All tables after a crawl.

    ``crawled`` has pages without id (with site_id); ``found`` the external
    links (site_id, page_url, ord, url, text, day_context, day_label,
    context_before, context_after); ``children`` the internal ones (site_id,
    page_url, child_url).  All of them, and the stored pages, have the columns
    ``apart`` where several pages of a site have one URL.  Raises ValueError
    where a page's site is unknown.
    """
    unknown = crawled.join(state["sites"].select(F.col("id").alias("site_id")), "site_id", "left_anti").select("site_id").take(1)
    if unknown:
        raise ValueError(f"unknown site {unknown[0][0]}")
    pages = upsert_pages(state["pages"], crawled, apart)
    links = upsert_links(state["links"], found, now)
    key = ["site_id", "page_url", *apart]
    ids = pages.withColumnsRenamed({"id": "page_id", "url": "page_url"}).select("page_id", *key)
    placed = first_of_each(found.join(ids, key).drop(*key))
    current = placed.join(links.select(F.col("id").alias("link_id"), "url"), "url").select(
        "page_id", "link_id", "day_context", "day_label", F.col("text").alias("link_text"), "context_before", "context_after", at(now).alias("last_seen_at")
    )
    synced = crawled.withColumnRenamed("url", "page_url").select(*key).join(ids, key).select("page_id")
    merged = upsert_occurrences(state["page_links"], current)
    gone = stale_occurrences(state["page_links"], current, synced).select("id")
    edges = children.join(ids, key).select("page_id", "child_url")
    return {
        **state, "pages": pages, "links": links, "page_links": merged.join(gone, "id", "left_anti").select(*merged.columns),
        "page_internal_links": replace_edges(state["page_internal_links"], edges, synced),
    }


def touch_pages(pages: DataFrame, unchanged: DataFrame, now: datetime) -> DataFrame:
    """Pages with the time of unchanged ones (id) moved; nothing else of them changes."""
    hit = unchanged.select("id", F.lit(True).alias("hit")).distinct()
    time = F.when(F.col("hit"), at(now)).otherwise(F.col("last_crawled_at"))
    return pages.join(hit, "id", "left").withColumn("last_crawled_at", time).select(*pages.columns)


def occurrence_counts(page_links: DataFrame) -> DataFrame:
    """(page_id, n)."""
    return page_links.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


def unchanged(pages: DataFrame, listing: DataFrame, force: bool = False) -> DataFrame:
    """Known pages whose version token is the listing's (site_id, slug, modified_gmt) and whose edges are stored.

    Of several pages with one slug the one with the least id counts.
    """
    known = pages.groupBy("site_id", "slug").agg(F.min(F.struct("id", "modified_gmt", "internal_links_synced_at")).alias("page"))
    same: Column = (F.col("page.modified_gmt") == F.col("modified_gmt")) & F.col("page.internal_links_synced_at").isNotNull()
    out = listing.join(known, ["site_id", "slug"]).filter(same & (not force))
    return out.select(F.col("page.id").alias("id"), "site_id", "slug")


def prune(page_links: DataFrame, pages: DataFrame, reached: DataFrame, site_ids: DataFrame) -> DataFrame:
    """Occurrences without those on pages of the sites (site_id) that were not reached (id)."""
    lost = pages.join(site_ids.select("site_id"), "site_id", "left_semi").join(reached.select("id"), "id", "left_anti")
    return page_links.join(lost.select(F.col("id").alias("page_id")), "page_id", "left_anti").select(*page_links.columns)


def add_missing_column(table: DataFrame, name: str, kind: str, default=None) -> DataFrame:
    """``table`` with a column, if it is not there yet."""
    return table if name in table.columns else table.withColumn(name, F.lit(default).cast(kind))


def rekey_occurrences(old: DataFrame) -> DataFrame:
    """Occurrences keyed by page and link made ones keyed by section too: no section is '', ids are new."""
    filled = old.withColumn("day_context", F.coalesce("day_context", F.lit("")))
    return numbered(filled.drop("id"), ["page_id", "link_id", "day_context"])


def marker_runs(rows: DataFrame, group: str, value: str, order: list[str]) -> DataFrame:
    """(group, value, runs): how many runs of equal neighbours each value has in its group's order."""
    from pyspark.sql import Window

    before = F.lag(value).over(Window.partitionBy(group).orderBy(*order))
    starts = rows.withColumn("starts", (~F.col(value).eqNullSafe(before) | before.isNull()).cast("int"))
    return starts.groupBy(group, value).agg(F.sum("starts").alias("runs"))
