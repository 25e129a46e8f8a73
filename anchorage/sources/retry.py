"""How long to wait before a request is tried again."""

from __future__ import annotations

import random
from collections.abc import Callable
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

from anchorage.settings import RETRIES, RETRY_DELAY


def retry_after(header: str | None, now: datetime) -> float | None:
    """Seconds that a Retry-After header asks for, given as a number or a date; None if it says neither."""
    if header is None:
        return None
    try:
        return max(0.0, float(header))
    except ValueError:
        pass
    try:
        then = parsedate_to_datetime(header)
    except (TypeError, ValueError):
        return None
    then = then if then.tzinfo else then.replace(tzinfo=UTC)
    return max(0.0, (then - now).total_seconds())


def waits(first: float = RETRY_DELAY, retries: int = RETRIES) -> list[float]:
    """Least waits before each retry; each is twice the one before."""
    return [first * 2**k for k in range(retries)]


def get(request: Callable[[], tuple[int, dict[str, str], str]], sleep: Callable[[float], None], now: Callable[[], datetime], pick=random.uniform):
    """(status, headers, body) of a request, tried again while it is answered with 429 and retries are left.

    The server's wait counts; without one, the wait is between once and twice
    the least.  Raises ConnectionError on any other error status and when
    retries run out.
    """
    for wait in [*waits(), None]:
        status, headers, body = request()
        if status != 429:
            if status >= 400:
                raise ConnectionError(f"status {status}")
            return status, headers, body
        if wait is not None:
            asked = retry_after(headers.get("retry-after"), now())
            sleep(asked if asked is not None else wait + pick(0, wait))
    raise ConnectionError("status 429")
