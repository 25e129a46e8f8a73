"""Aggregates and lists of the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorage.functions.text import day_number, deep_link, occurrence_id
from anchorage.operators.rules import RULES, apply_rules
from anchorage.operators.rules import kept as rules_kept
from anchorage.operators.state import classify
from anchorage.plans.materialize import numbered
from anchorage.settings import COURSE, KINDS, NOT_OK

STATUSES = ("ok", "broken", "unreachable", "pending")


def watching(failures: Column, status: Column) -> Column:
    """Failing, but not confirmed."""
    return (failures > 0) & ~status.isin(*NOT_OK)


def site_summaries(sites, pages, page_links, links, rules=RULES) -> DataFrame:
    """Distinct links by status for every site and page kind, zeros included; a link counts wherever it stands.

    Links are made distinct per (site, kind) first, so that all counts are
    plain and combine before the shuffle.
    """
    placed = page_links.select("page_id", "link_id").join(pages.select(F.col("id").alias("page_id"), "site_id", "kind"), "page_id")
    distinct = placed.select("site_id", "kind", "link_id").distinct()
    kept = apply_rules(links, page_links, rules).select(F.col("id").alias("link_id"), "status", "consecutive_failures")
    counts = (
        distinct.join(kept, "link_id")
        .groupBy("site_id", "kind")
        .agg(
            *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
            F.count_if(watching(F.col("consecutive_failures"), F.col("status"))).alias("watching"),
        )
    )
    grid = sites.select(F.col("id").alias("site_id"), "slug").withColumn("kind", F.explode(F.array(*[F.lit(k) for k in KINDS])))
    names = (*STATUSES, "watching")
    out = grid.join(counts, ["site_id", "kind"], "left").select("slug", "kind", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in names])
    return out.withColumn("total", F.col("ok") + F.col("broken") + F.col("unreachable") + F.col("pending"))


def check_progress(page_links, links, rules=RULES) -> DataFrame:
    """(total, checked, percent) over links that pages have and rules keep; one row, zeros for none."""
    counted = rules_kept(links, page_links, rules).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("last_checked_at").isNotNull()).alias("checked")
    )
    percent = F.when(F.col("total") > 0, F.lit(100.0) * F.col("checked") / F.col("total")).otherwise(F.lit(0.0))
    return counted.withColumn("percent", percent)


def course_keys(sites, pages, page_links) -> DataFrame:
    """(link_id, course_key): site and title of the first page a link stands on, by site and title; null for a null title."""
    named = page_links.select("link_id", "page_id").join(pages.select(F.col("id").alias("page_id"), "site_id", "title"), "page_id")
    placed = named.join(sites.select(F.col("id").alias("site_id"), "slug"), "site_id")
    least = placed.groupBy("link_id").agg(F.min(F.struct("slug", "title")).alias("first"))
    return least.select("link_id", F.concat(F.col("first.slug"), F.lit(": "), F.col("first.title")).alias("course_key"))


def listed(sites, pages, page_links, links, rules=RULES) -> DataFrame:
    """Live links that rules keep, with ``course_key``."""
    kept = rules_kept(links, page_links, rules)
    keys = course_keys(sites, pages, page_links).withColumnRenamed("link_id", "id")
    return kept.join(keys, "id", "left")


def problem_links(sites, pages, page_links, links, rules=RULES) -> DataFrame:
    """Broken and unreachable links in the order of the report."""
    chosen = listed(sites, pages, page_links, links.filter(F.col("status").isin(*NOT_OK)), rules)
    return chosen.orderBy("status", F.col("course_key").asc_nulls_first(), F.desc("consecutive_failures"), "url")


def watch_links(sites, pages, page_links, links, rules=RULES) -> DataFrame:
    """Links that fail without being confirmed, in the order of the report."""
    chosen = listed(sites, pages, page_links, links.filter(watching(F.col("consecutive_failures"), F.col("status"))), rules)
    return chosen.orderBy(F.col("course_key").asc_nulls_first(), F.desc("consecutive_failures"), "url")


def occurrences(sites, pages, page_links, chosen: DataFrame) -> DataFrame:
    """Every place of the chosen links (id, ...), with the page, site and day number of each."""
    keys = chosen.select(F.col("id").alias("link_id"))
    places = page_links.join(keys, "link_id", "left_semi").withColumnRenamed("id", "page_link_id")
    on_pages = places.join(
        pages.select(
            F.col("id").alias("page_id"), "site_id", F.col("title").alias("page_title"), F.col("url").alias("page_url"),
            F.col("last_crawled_at").alias("page_last_crawled_at"), F.col("kind").alias("page_kind"), F.col("sort_order").alias("page_sort_order"),
        ),
        "page_id",
    )
    placed = on_pages.join(sites.select(F.col("id").alias("site_id"), F.col("slug").alias("site_slug")), "site_id")
    return placed.withColumn("day_number", day_number(F.col("day_context"))).select(
        "link_id", "site_id", "site_slug", "page_id", "page_title", "page_url", "page_kind", "page_sort_order", "page_last_crawled_at",
        "page_link_id", "day_context", "day_number", "day_label", "link_text", "context_before", "context_after",
    )


def with_pages(sites, pages, page_links, chosen: DataFrame) -> DataFrame:
    """Chosen links with ``pages``: their places by site, page, and day with those without a day last."""
    places = occurrences(sites, pages, page_links, chosen)
    ref = F.struct(
        "site_id", "page_id", F.col("day_number").isNull().alias("no_day"), "day_number", "page_link_id", "site_slug", "page_title", "page_url",
        "page_kind", "page_sort_order", "page_last_crawled_at", "day_context", "day_label", "link_text", "context_before", "context_after",
    )
    lists = places.groupBy("link_id").agg(F.array_sort(F.collect_list(ref)).alias("pages"))
    return chosen.join(lists.withColumnRenamed("link_id", "id"), "id", "left")


def page_groups(sites, pages, page_links, ranked: DataFrame) -> DataFrame:
    """One row a page with problems: its entries by day, those without a day last, then in the order of ``ranked`` (id, rank, ...).

    Groups come by site, course pages in their order before other pages in
    theirs.  A group is as long as its page has links.
    """
    extra = [c for c in ("url", "status", "last_http_status", "last_error_type", "consecutive_failures") if c in ranked.columns]
    places = occurrences(sites, pages, page_links, ranked).join(
        ranked.select(F.col("id").alias("link_id"), "rank", *[F.col(c).alias(f"link_{c}") for c in extra]), "link_id"
    )
    is_course = F.col("page_kind") == COURSE
    position = F.struct(
        F.col("site_id").alias("site"), F.when(is_course, 0).otherwise(1).alias("part"),
        F.when(is_course, F.coalesce(F.col("page_sort_order"), F.lit(0)).cast("long")).otherwise(F.col("page_id")).alias("place"),
    )
    entry = F.struct(
        F.col("day_number").isNull().alias("no_day"), "day_number", "rank", "page_link_id", "link_id", "day_context", "day_label", "link_text",
        "context_before", "context_after", *[f"link_{c}" for c in extra],
    )
    return (
        places.groupBy("site_slug", "page_title", "page_url")
        .agg(
            F.max(position).alias("position"), F.max("page_kind").alias("kind"), F.max("page_last_crawled_at").alias("last_crawled_at"),
            F.array_sort(F.collect_list(entry)).alias("entries"), F.count_distinct("link_id").alias("n_links"), F.count(F.lit(1)).alias("n_occurrences"),
        )
        .orderBy("position", "page_title", "page_url")
    )


def with_rank(problems: DataFrame) -> DataFrame:
    """Problem links with their place in the report, by a range sort."""
    return numbered(problems, ["status", F.col("course_key").asc_nulls_first(), F.desc("consecutive_failures"), "url"], "rank")


def with_watch_rank(watched: DataFrame) -> DataFrame:
    """Links under watch with their place in the report."""
    return numbered(watched, [F.col("course_key").asc_nulls_first(), F.desc("consecutive_failures"), "url"], "rank")


def with_deep_links(places: DataFrame) -> DataFrame:
    """Occurrences with ``href``, which leads to the place itself."""
    c = F.col
    return places.withColumn("href", deep_link(c("page_url"), c("day_context"), c("link_text"), c("context_before"), c("context_after")))


def searched(places: DataFrame, status: str | None, words: str) -> DataFrame:
    """Occurrences of one status, or any, whose text, URL, page or context contains ``words`` in any case."""
    text = F.lower(F.concat_ws(" ", "link_text", "url", "page_title", "day_label", "context_before", "context_after"))
    found = places.filter(F.contains(text, F.lower(F.lit(words))))
    return found.filter(F.col("status") == status) if status else found


def undismissed(places: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Occurrences but those dismissed since their last check; ``dismissed`` is (occurrence_id, last_checked_at)."""
    keyed = places.withColumn("occurrence_id", occurrence_id(F.col("page_url"), F.col("link_id"), F.col("day_context")))
    same = (keyed["occurrence_id"] == dismissed["occurrence_id"]) & keyed["last_checked_at"].eqNullSafe(dismissed["last_checked_at"])
    return keyed.join(dismissed, same, "left_anti")


def reconciled(dismissed: DataFrame, places: DataFrame) -> DataFrame:
    """Dismissals (occurrence_id, last_checked_at) that still hold: their place is still listed and was not checked since.

    An id of an older form, without a section, stands for the place without one.
    """
    sections = F.size(F.split("occurrence_id", "::"))
    whole = dismissed.withColumn("occurrence_id", F.when(sections == 2, F.concat("occurrence_id", F.lit("::"))).otherwise(F.col("occurrence_id")))
    now = places.select(occurrence_id(F.col("page_url"), F.col("link_id"), F.col("day_context")).alias("occurrence_id"), F.col("last_checked_at").alias("now"))
    same = (whole["occurrence_id"] == now["occurrence_id"]) & whole["last_checked_at"].eqNullSafe(now["now"])
    return whole.join(now, same, "left_semi")


def progress(results: DataFrame) -> DataFrame:
    """(checked, not_ok) of a batch of outcomes."""
    return results.agg(*progress_metrics())


def progress_metrics() -> list[Column]:
    """The two counters, for ``observe`` on a stream or ``agg`` on a batch."""
    bad = classify(F.col("http_status"), F.col("error_type")) != "ok"
    return [F.count(F.lit(1)).alias("checked"), F.count_if(bad).alias("not_ok")]


def info(places: DataFrame) -> DataFrame:
    """A blurb to copy for each occurrence: page, link, status with its reason, URL, and where known the context and the place."""

    def given(value: Column) -> Column:
        return F.nullif(value, F.lit(""))

    c = F.col
    reason = F.coalesce(given(c("last_error_type")), c("last_http_status").cast("string"))
    before, after = F.coalesce(F.concat(given(c("context_before")), F.lit(" ")), F.lit("")), F.coalesce(F.concat(F.lit(" "), given(c("context_after"))), F.lit(""))
    around = F.concat(F.lit("Context: …"), before, F.lit("["), F.coalesce("link_text", F.lit("")), F.lit("]"), after, F.lit("…"))
    has_context = given(c("context_before")).isNotNull() | given(c("context_after")).isNotNull()
    lines = [
        F.concat(c("site_slug"), F.lit(": "), c("page_title")),
        F.concat(F.lit('Link: "'), F.coalesce(given(c("link_text")), F.lit("(no visible link text)")), F.lit('"')),
        F.concat(F.lit("Status: "), c("status"), F.coalesce(F.concat(F.lit(" ("), reason, F.lit(")")), F.lit(""))),
        F.concat(F.lit("URL: "), c("url")),
        F.when(has_context, around),
        F.concat(F.lit("Found on: "), given(c("href"))),
    ]
    return places.withColumn("info", F.concat_ws("\n", *lines))
