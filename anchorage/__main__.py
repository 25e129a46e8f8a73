"""Commands over a store: ``python -m anchorage COMMAND --store PATH``."""

from __future__ import annotations

import argparse
import logging
import sys
import time
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from anchorage.functions.extract import external_links, listed_pages
from anchorage.functions.html_dom import parse
from anchorage.plans import runs
from anchorage.plans.materialize import cut
from anchorage.plans.worker import Worker
from anchorage.settings import Pace
from anchorage.sources import certificates, listing, probe
from anchorage.sources.store import Store


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def _crawl_site(store: Store, site, limit: int | None, force: bool) -> runs.CrawlTotals:
    """Read the site's listing and index, and of its pages those that have changed, on the workers."""
    listing.register(store.spark)
    entries = cut(store.spark.read.format("site_listing").option("base_url", site.base_url).load())
    _, _, index = listing.get(lambda: listing.fetch(site.course_index_url), time.sleep, lambda: datetime.now(UTC))
    return runs.crawl(store, site.id, index, entries, lambda wanted: listing.fetch_pages(wanted, site.base_url), _now(), limit, force)


def _crawl(store: Store, limit: int | None, force: bool) -> None:
    for site in store.read("sites").orderBy("slug").collect():
        try:
            print(site.slug, _crawl_site(store, site, limit, force))
        except Exception as e:  # one site's failure leaves the others
            print(f"{site.slug}: {e}", file=sys.stderr)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="anchorage")
    p.add_argument("command", choices=["init", "discover", "preview", "crawl", "check", "requeue-broken", "report", "run"])
    p.add_argument("--store", required=True)
    p.add_argument("--site", action="append", default=[], help="slug=base_url=index_url, for init")
    p.add_argument("--limit", type=int)
    p.add_argument("--force", action="store_true")
    p.add_argument("--html")
    p.add_argument("--every", type=float, default=900.0, help="seconds between crawls, for run")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("anchorage").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, a.store)
    if a.command == "init":
        store.init([tuple(s.split("=", 2)) for s in a.site])
    elif a.command in ("discover", "preview"):
        for site in store.read("sites").collect():
            found = listed_pages(listing.fetch(site.course_index_url)[2], site.course_index_url, site.base_url)
            for row in found if a.command == "discover" else found[: a.limit or 3]:
                print(row["url"], row["title"])
                if a.command == "preview":
                    for link in external_links(parse(listing.fetch(row["url"])[2]), row["url"], site.base_url):
                        print("   ", link["url"], link["text"])
    elif a.command == "crawl":
        _crawl(store, a.limit, a.force)
    elif a.command == "check":
        print(runs.drain(store, _now, a.limit or 50, recover=certificates.recovered), "claimed")
    elif a.command == "requeue-broken":
        print(runs.requeue_broken(store, _now()), "due now")
    elif a.command == "report":
        print(runs.write_report(store, a.html), end="")
    else:
        logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
        pace = Pace(crawl_seconds=a.every)
        Worker(store, lambda site: _crawl_site(store, site, a.limit, a.force), probe.request, _now, a.html, certificates.recovered, pace).run()
    return 0


if __name__ == "__main__":
    sys.exit(main())
