"""Page listings of a site's JSON interface.

Answers land as rows (url, body) with the body as text; parsing is declarative.
``ListingSource`` reads the interface itself, one Spark partition for each
page of the listing.
"""

from __future__ import annotations

import json
import math
import urllib.error
import urllib.request
from collections.abc import Iterator
from datetime import UTC, datetime
from time import sleep
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from anchorage.functions.urls import slug, unescape
from anchorage.settings import CRAWL_CONCURRENCY, CRAWL_DELAY, LISTING_PAGE
from anchorage.sources.retry import get

ENTRY = "id bigint, slug string, link string, modified_gmt string"
PAGE = "id bigint, slug string, link string, title struct<rendered: string>, content struct<rendered: string>, modified_gmt string"


def _array(body: Column, of: str) -> Column:
    """A JSON array, null for any other JSON: an error object is no list of one."""
    struct = of.replace(" struct", ": struct").replace(" bigint", ": bigint").replace(" string", ": string").replace(":: ", ": ")
    parsed = F.from_json(body, f"array<struct<{struct}>>")
    return F.when(F.startswith(F.ltrim(body), F.lit("[")), parsed)


def listed(answers: DataFrame) -> DataFrame:
    """Entries of listing answers (body), each (id, slug, link, modified_gmt)."""
    return answers.select(F.inline(_array(F.col("body"), ENTRY)))


def page_records(answers: DataFrame) -> DataFrame:
    """First page of each answer to a lookup by slug (body): id, slug, URL, decoded title, html, version token; none for no such page."""
    found = answers.select(_array(F.col("body"), PAGE).alias("pages")).filter(F.size("pages") > 0).select(F.col("pages")[0].alias("p"))
    return found.select(
        F.col("p.id").alias("wp_id"), F.col("p.slug").alias("slug"), F.col("p.link").alias("url"), unescape(F.col("p.title.rendered")).alias("title"),
        F.col("p.content.rendered").alias("html"), F.col("p.modified_gmt").alias("modified_gmt"),
    )


def wanted(courses: DataFrame) -> DataFrame:
    """(slug, url, ...) to look up for course URLs (url, ...): a row each, with what else is known of it."""
    return courses.select(slug("url").alias("slug"), *[c for c in courses.columns if c != "slug"])


def fetch(url: str, timeout: float = 20.0) -> tuple[int, dict[str, str], str]:
    """One GET that follows redirects: status, headers with lower-case names, body."""
    request = urllib.request.Request(url, headers={"User-Agent": "anchorage"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, {k.lower(): v for k, v in answer.headers.items()}, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, ""


def fetch_pages(wanted: DataFrame, base_url: str, at_once: int = CRAWL_CONCURRENCY, delay: float = CRAWL_DELAY, ask=fetch) -> DataFrame:
    """Page records of wanted slugs (slug, ...), looked up on the workers, at most ``at_once`` at a time and ``delay`` seconds apart in each."""
    base = base_url.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for name in batch.column(0).to_pylist():
                url = f"{base}/wp-json/wp/v2/pages?slug={quote(name, safe='')}"
                bodies.append(get(lambda u=url: ask(u), sleep, lambda: datetime.now(UTC))[2])
                sleep(delay)
            yield pa.record_batch([pa.array(bodies, pa.string())], names=["body"])

    return page_records(wanted.select("slug").repartition(at_once).mapInArrow(run, "body string"))


class ListingPart(InputPartition):
    def __init__(self, page: int) -> None:
        self.page = page


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.base, self.size = options["base_url"].rstrip("/"), int(options.get("page_size", LISTING_PAGE))
        self.fetch = fetch

    def _url(self, page: int) -> str:
        return f"{self.base}/wp-json/wp/v2/pages?per_page={self.size}&page={page}&_fields=id,slug,link,modified_gmt"

    def _get(self, page: int) -> tuple[int, dict[str, str], str]:
        return get(lambda: self.fetch(self._url(page)), sleep, lambda: datetime.now(UTC))

    def partitions(self) -> list[ListingPart]:
        _, headers, _ = self._get(1)
        return [ListingPart(k + 1) for k in range(int(headers.get("x-wp-totalpages", 1)))]

    def read(self, partition: ListingPart) -> Iterator[tuple]:
        _, _, body = self._get(partition.page)
        for entry in json.loads(body):
            yield entry["id"], entry["slug"], entry["link"], entry.get("modified_gmt")


class ListingSource(DataSource):
    """``spark.read.format("site_listing").option("base_url", ...)``: the pages a site lists."""

    @classmethod
    def name(cls) -> str:
        return "site_listing"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ListingSource)


def n_pages(entries: int, size: int = LISTING_PAGE) -> int:
    """Answers that a listing takes."""
    return max(1, math.ceil(entries / size))
