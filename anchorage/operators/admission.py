"""Which due links to check now: fair between hosts, within their concurrency and rate."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from anchorage.operators.rules import RULES, kept
from anchorage.settings import NOT_OK, Admission


def at(now: datetime) -> Column:
    """A time as a column without time zone."""
    return F.lit(now.replace(tzinfo=None).isoformat(sep=" ")).cast(TimestampNTZType())


def due(links: DataFrame, now: datetime) -> DataFrame:
    """Links due at ``now`` or before."""
    return links.filter(F.col("next_check_at") <= at(now))


def due_links(links: DataFrame, page_links: DataFrame, now: datetime, limit: int, rules=RULES) -> DataFrame:
    """The ``limit`` links due first, of those that pages have and rules keep; ties by id."""
    chosen = kept(due(links, now), page_links, rules)
    return chosen.orderBy("next_check_at", "id").limit(limit)


def fresh_claims(claims: DataFrame, now: datetime, admission: Admission = Admission()) -> DataFrame:
    """Leases that are not stale."""
    return claims.filter(F.col("claimed_at") >= at(now - admission.stale_after))


def stale_claims(claims: DataFrame, now: datetime, admission: Admission = Admission()) -> DataFrame:
    """Leases to purge."""
    return claims.filter(F.col("claimed_at") < at(now - admission.stale_after))


def inflight(claims: DataFrame) -> DataFrame:
    """(host, inflight)."""
    return claims.groupBy("host").agg(F.count(F.lit(1)).alias("inflight"))


def _candidates(links, page_links, clock, claims, now, admission, rules) -> DataFrame:
    """Claimable links with (last_request_started_at, has_clock) of their host; ``claims`` are fresh."""
    hosts = clock.select("host", "last_request_started_at", F.lit(True).alias("has_clock"))
    open_links = kept(due(links, now), page_links, rules).join(
        claims.select(F.col("link_id").alias("id")), "id", "left_anti"
    )
    started = F.col("last_request_started_at")
    return open_links.join(hosts, "host", "left").filter(started.isNull() | (started <= at(now - admission.interval)))


def claimable_hosts(links, page_links, clock, claims, now: datetime, admission: Admission = Admission(), rules=RULES) -> DataFrame:
    """Hosts with a link that can be claimed and whose last request is long enough ago."""
    fresh = fresh_claims(claims, now, admission)
    return _candidates(links, page_links, clock, fresh, now, admission, rules).select("host").distinct()


def claim(links, page_links, clock, claims, now: datetime, limit: int, admission: Admission = Admission(), rules=RULES) -> DataFrame:
    """The links that one poll claims.

    A host offers as many of its first due links as it has room for; of all
    offers the first ``limit`` are tried in order, and each claim moves its
    host's clock to now.  So with an interval a host gets one link a poll, and
    its other offers have used up places.  A host whose clock row holds no time
    offers links but is never claimed.  The literal bound on the rank lets
    Spark cut each host's rows before the shuffle.
    """
    fresh = fresh_claims(claims, now, admission)
    room = F.lit(admission.per_host) - F.coalesce("inflight", F.lit(0))
    rank = F.row_number().over(Window.partitionBy("host").orderBy("next_check_at", "id"))
    offers = (
        _candidates(links, page_links, clock, fresh, now, admission, rules)
        .withColumn("rank", rank)
        .filter(F.col("rank") <= admission.per_host)
        .join(inflight(fresh), "host", "left")
        .filter(F.col("rank") <= room)
        .orderBy("next_check_at", "id")
        .limit(limit)
    )
    won = offers.filter(F.col("has_clock").isNull() | F.col("last_request_started_at").isNotNull())
    if admission.interval.total_seconds() > 0:
        first = F.row_number().over(Window.partitionBy("host").orderBy("next_check_at", "id"))
        won = won.withColumn("turn", first).filter("turn = 1")
    return won.select(*links.columns)


def after_claim(clock: DataFrame, claims: DataFrame, claimed: DataFrame, now: datetime, admission: Admission = Admission()) -> tuple[DataFrame, DataFrame]:
    """Clock and leases once ``claimed`` has been claimed at ``now``; stale leases are gone."""
    hosts = claimed.select("host").distinct().withColumn("now", at(now))
    new_clock = clock.join(hosts, "host", "full").select("host", F.coalesce("now", "last_request_started_at").alias("last_request_started_at"))
    fresh = fresh_claims(claims, now, admission)
    top = fresh.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    order = F.row_number().over(Window.orderBy("next_check_at", "id"))  # of at most one poll's limit
    new = claimed.withColumn("k", order).crossJoin(top).select(
        (F.col("k") + F.col("top")).cast("long").alias("id"), F.col("id").alias("link_id"), "host", at(now).alias("claimed_at")
    )
    return new_clock, fresh.unionByName(new)


def release(claims: DataFrame, finished: DataFrame) -> DataFrame:
    """Leases without those of finished links (link_id)."""
    return claims.join(finished.select("link_id"), "link_id", "left_anti").select(*claims.columns)


def pull_forward(links: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Links with broken and unreachable ones due at once, and those moved."""
    moved = F.col("status").isin(*NOT_OK) & (F.col("next_check_at") > at(now))
    changed = links.withColumn("next_check_at", F.when(moved, at(now)).otherwise(F.col("next_check_at")))
    return changed, links.filter(moved)
