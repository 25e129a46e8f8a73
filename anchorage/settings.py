"""Settings, statuses and rules that results depend on."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

# Statuses and page kinds.
OK, BROKEN, UNREACHABLE, PENDING = "ok", "broken", "unreachable", "pending"
NOT_OK = (BROKEN, UNREACHABLE)
COURSE, OTHER = "course", "other"
KINDS = (COURSE, OTHER)

# Error buckets of a request.
TIMEOUT, TOO_MANY_REDIRECTS, DNS, REFUSED, BAD_CERT, OTHER_ERROR = (
    "timeout", "too_many_redirects", "dns_error", "connection_refused", "bad_ssl_cert", "other"
)

# HTTP statuses that mean a page is gone.
GONE = (404, 410)

# When to look at a link again.
CONFIRM_AFTER = 3
UNCONFIRMED_MINUTES = (60, 1440)
HEALTHY_DAYS = 7
CONFIRMED_DAYS = 1
JITTER = 0.1

# Crawling.
MAX_DEPTH = 8
LISTING_PAGE = 100
RETRIES, RETRY_DELAY = 5, 5.0
CONTEXT_CHARS = 60
LEAST_LINK_WORDS = 5


@dataclass(frozen=True)
class Admission:
    """How many requests a host may have in flight, how far apart they start, and when a lease is stale."""

    per_host: int = 3
    interval: timedelta = timedelta(seconds=0.5)
    stale_after: timedelta = timedelta(seconds=300)


@dataclass(frozen=True)
class Pace:
    """Seconds between rounds of the continuous worker, and how many links one poll may claim."""

    crawl_seconds: float = 900.0
    idle_seconds: float = 300.0
    busy_seconds: float = 1.0
    report_seconds: float = 300.0
    progress_seconds: float = 30.0
    room: int = 50


# Fetching pages.
CRAWL_CONCURRENCY = 5
CRAWL_DELAY = 0.2
