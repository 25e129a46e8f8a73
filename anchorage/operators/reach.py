"""Reachability over a site's pages, level by level."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.functions.urls import slug
from anchorage.plans.materialize import cut
from anchorage.settings import COURSE, MAX_DEPTH, OTHER


@dataclass(frozen=True)
class Reached:
    """(node, depth) with the least depth of each node, and whether the depth bound cut something off."""

    nodes: DataFrame
    truncated: bool


def reach(seeds: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], max_depth: int = MAX_DEPTH) -> Reached:
    """Nodes that seeds (node) lead to over edges (src, dst) in at most ``max_depth`` steps; cycles are fine.

    ``edges`` may be a function that gives those from a level's nodes, for each level in turn.

    Each level is one join of the frontier and one anti-join with what was
    seen, written to the shared folder; one number a level reaches the driver.
    """
    frontier = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    seen, depth = frontier, 0
    while True:
        out = edges(frontier) if callable(edges) else edges
        step = frontier.join(out, frontier["node"] == out["src"]).select(F.col("dst").alias("node")).distinct()
        new = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth + 1)))
        if new.isEmpty():
            return Reached(seen, False)
        if depth == max_depth:
            return Reached(seen, True)
        seen, frontier, depth = cut(seen.unionByName(new)), new, depth + 1


@dataclass(frozen=True)
class Crawl:
    """Pages reached (slug, depth, kind, sort_order, page columns of the listing), courses that are not there, and completeness."""

    pages: DataFrame
    missing: DataFrame
    complete: bool


def crawl_site(
    courses: DataFrame, listing: DataFrame, children: DataFrame | Callable[[DataFrame], DataFrame], limit: int | None = None, max_depth: int = MAX_DEPTH
) -> Crawl:
    """Follow a site's courses (ord, url, title) through the links between its pages.

    ``listing`` has the site's pages (slug, ...) and ``children`` their links
    (slug, child_url), or gives those of a level's pages (slug).  Pages are told
    apart by slug; of several with one slug that with the least id counts, or
    without ids the one whose columns are least.  A course that the listing
    lacks is reported; any other URL that it lacks is no page.  A crawl is
    complete unless ``limit`` or ``max_depth`` cut it, or no course is listed;
    only a complete one may prune.
    """
    ranked = courses.withColumn("slug", slug("url"))
    first = ranked.groupBy("slug").agg(F.min("ord").alias("sort_order"))
    seeds = first.filter(F.col("sort_order") < limit) if limit is not None else first
    order = sorted((c for c in listing.columns if c != "slug"), key=lambda c: c != "id")
    one = listing.groupBy("slug").agg(F.min(F.struct(*order)).alias("page")) if order else listing.select("slug").distinct()
    pages = one.select("slug", *[F.col(f"page.{c}").alias(c) for c in order])

    def edges_from(found: DataFrame) -> DataFrame:
        edges = found.select(F.col("slug").alias("src"), slug("child_url").alias("dst")).distinct()
        return edges.join(pages.select(F.col("slug").alias("dst")), "dst", "left_semi")

    edges = (lambda level: edges_from(children(level.select(F.col("node").alias("slug"))))) if callable(children) else edges_from(children)
    start = seeds.join(pages.select("slug"), "slug", "left_semi").select(F.col("slug").alias("node"))
    found = reach(start, edges, max_depth)
    out = found.nodes.withColumnRenamed("node", "slug").join(pages, "slug").join(first, "slug", "left")
    out = out.withColumn("kind", F.when(F.col("sort_order").isNotNull(), COURSE).otherwise(OTHER))
    missing = seeds.join(pages.select("slug"), "slug", "left_anti")
    counts = courses.count()
    cut_off = limit is not None and counts > limit
    return Crawl(out, missing, not cut_off and not found.truncated and counts > 0)
