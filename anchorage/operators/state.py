"""From raw outcomes to link states: classification, confirmation before flagging, and folds of whole histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorage.settings import (
    BROKEN, CONFIRM_AFTER, CONFIRMED_DAYS, GONE, HEALTHY_DAYS, JITTER, OK, PENDING, UNCONFIRMED_MINUTES, UNREACHABLE,
)


def classify(http_status: Column, error_type: Column) -> Column:
    """unreachable for a failed request, broken for a page that is gone, ok for all else."""
    return F.when(error_type.isNotNull(), UNREACHABLE).when(http_status.isin(*GONE), BROKEN).otherwise(OK)


def outcome(http_status: Column, error_type: Column) -> Column:
    """What a check came to in a word: the error, or else the status."""
    return F.coalesce(error_type, http_status.cast("string"), F.lit("None"))


def classified_broken(http_status: Column, error_type: Column) -> Column:
    """1 for broken; an unreachable page is not broken."""
    return (classify(http_status, error_type) == BROKEN).cast("int")


def jitter(link_id: Column, checked_at: Column, share: float = JITTER) -> Column:
    """A factor within ``share`` of 1 that depends on link and time alone, so reruns agree."""
    if not share:
        return F.lit(1.0)
    step = F.pmod(F.xxhash64(link_id, checked_at), F.lit(20001)) / F.lit(10000.0)
    return 1 + (step - 1) * F.lit(share)


def _after(time: Column, seconds: Column) -> Column:
    return time + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def next_check(status: Column, failures: Column, time: Column, factor: Column) -> Column:
    """When a link with this new state is due: soon while unconfirmed, in days else."""
    minutes = F.lit(0)
    for n, wait in enumerate(UNCONFIRMED_MINUTES, 1):
        minutes = F.when(failures == n, wait).otherwise(minutes)
    seconds = (
        F.when(status == OK, F.lit(float(HEALTHY_DAYS * 86400)) * factor)
        .when(failures >= CONFIRM_AFTER, F.lit(float(CONFIRMED_DAYS * 86400)) * factor)
        .otherwise((minutes * 60).cast("double"))
    )
    return _after(time, seconds)


def step(links: DataFrame, results: DataFrame, jitter_share: float = JITTER) -> DataFrame:
    """State of links after one check each; ``results`` is (link_id, checked_at, http_status, error_type).

    A success makes a link ok.  A failure counts; only the third in a row
    changes the status, to what that check says.  Links without a result stay.
    """
    new = results.select(
        F.col("link_id").alias("id"), "checked_at", "http_status", "error_type", classify(F.col("http_status"), F.col("error_type")).alias("class")
    )
    joined = links.join(new, "id", "left")
    checked = F.col("checked_at").isNotNull()
    failures = F.when(F.col("class") == OK, 0).otherwise(F.least(F.col("consecutive_failures") + 1, F.lit(CONFIRM_AFTER)))
    status = F.when((F.col("class") == OK) | (failures >= CONFIRM_AFTER), F.col("class")).otherwise(F.col("status"))
    # Due times follow the check's class: a failure of an ok link is due soon.
    due = next_check(F.when(F.col("class") == OK, OK).otherwise(BROKEN), failures, F.col("checked_at"), jitter(F.col("id"), F.col("checked_at"), jitter_share))
    changed = {
        "last_checked_at": F.col("checked_at"), "next_check_at": due, "last_http_status": F.col("http_status"),
        "last_error_type": F.col("error_type"), "consecutive_failures": failures, "status": status,
    }
    return joined.select(*[F.when(checked, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in links.columns])


def fold(checks: DataFrame) -> DataFrame:
    """State of every link after its whole history, from pending, in order of (checked_at, id).

    Gives (link_id, status, consecutive_failures, last_checked_at,
    last_http_status, last_error_type).  Two aggregations that combine before
    the shuffle: the last success, then what came after it; a link with a long
    history needs no task of its own.
    """
    order = F.struct("checked_at", "id")
    judged = checks.withColumn("class", classify(F.col("http_status"), F.col("error_type")))
    last = judged.groupBy("link_id").agg(
        F.max(F.when(F.col("class") == OK, order)).alias("last_ok"),
        F.max(F.struct("checked_at", "id", "class", "http_status", "error_type")).alias("last"),
    )
    since = judged.filter(F.col("class") != OK).join(last.select("link_id", "last_ok"), "link_id")
    streaks = (
        since.filter(F.col("last_ok").isNull() | (order > F.col("last_ok"))).groupBy("link_id").agg(F.count(F.lit(1)).alias("streak"))
    )
    streak = F.coalesce("streak", F.lit(0))
    status = F.when((F.col("last.class") == OK) | (streak >= CONFIRM_AFTER), F.col("last.class")).otherwise(
        F.when(F.col("last_ok").isNotNull(), OK).otherwise(PENDING)
    )
    failures = F.when(F.col("last.class") == OK, 0).otherwise(F.least(streak, F.lit(CONFIRM_AFTER))).cast("int")
    return last.join(streaks, "link_id", "left").select(
        "link_id", status.alias("status"), failures.alias("consecutive_failures"), F.col("last.checked_at").alias("last_checked_at"),
        F.col("last.http_status").alias("last_http_status"), F.col("last.error_type").alias("last_error_type"),
    )


def with_folded_state(links: DataFrame, checks: DataFrame, jitter_share: float = JITTER) -> DataFrame:
    """Links with the state their history gives them; links without one stay pending and due as they were."""
    state = fold(checks).withColumnsRenamed({"link_id": "id", **{c: f"new_{c}" for c in (
        "status", "consecutive_failures", "last_checked_at", "last_http_status", "last_error_type")}})
    joined = links.join(state, "id", "left")
    known = F.col("new_last_checked_at").isNotNull()
    failing = F.when(F.col("new_consecutive_failures") == 0, OK).otherwise(BROKEN)
    due = next_check(
        failing, F.col("new_consecutive_failures"), F.col("new_last_checked_at"), jitter(F.col("id"), F.col("new_last_checked_at"), jitter_share)
    )
    values = {c: F.col(f"new_{c}") for c in ("status", "consecutive_failures", "last_checked_at", "last_http_status", "last_error_type")}
    values["next_check_at"] = due
    return joined.select(*[F.when(known, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in links.columns])


def reclassified(checks: DataFrame) -> DataFrame:
    """History with classes computed anew from raw outcomes."""
    http, error = F.col("http_status"), F.col("error_type")
    return checks.select(
        "id", "link_id", classify(http, error).alias("class"), outcome(http, error).alias("outcome"), classified_broken(http, error).alias("classified_broken")
    )


def choose_scheme(secure: DataFrame, plain: DataFrame) -> DataFrame:
    """Of probes over https and http (link_id, http_status, error_type, response_time_ms), the plain one only where the secure one failed."""
    names = ("http_status", "error_type", "response_time_ms")
    other = plain.select("link_id", F.lit(True).alias("tried"), *[F.col(c).alias(f"plain_{c}") for c in names])
    use_plain = F.col("error_type").isNotNull() & F.col("tried").isNotNull()
    joined = secure.join(other, "link_id", "left")
    return joined.select("link_id", *[F.when(use_plain, F.col(f"plain_{c}")).otherwise(F.col(c)).alias(c) for c in names])
