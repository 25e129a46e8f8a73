"""Link states kept up to date from a stream of checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

from anchorage.operators.report import progress_metrics
from anchorage.settings import BROKEN, CONFIRM_AFTER, CONFIRMED_DAYS, GONE, HEALTHY_DAYS, OK, PENDING, UNCONFIRMED_MINUTES, UNREACHABLE

STATE = "status string, consecutive_failures int"
OUTPUT = "link_id bigint, status string, consecutive_failures int, last_checked_at timestamp_ntz, last_http_status int, last_error_type string"


def advance(status: str, failures: int, http_status: int | None, error_type: str | None) -> tuple[str, int]:
    """A link's next state after one outcome."""
    found = UNREACHABLE if error_type is not None else BROKEN if http_status in GONE else OK
    if found == OK:
        return OK, 0
    failures = min(failures + 1, CONFIRM_AFTER)
    return (found if failures == CONFIRM_AFTER else status), failures


class LinkStates(StatefulProcessor):
    """One value of state a link; checks of one batch are taken in order of (checked_at, id)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        checks = pd.concat(list(rows)).sort_values(["checked_at", "id"])
        status, failures = self.state.get() if self.state.exists() else (PENDING, 0)
        for http, error in zip(checks["http_status"], checks["error_type"], strict=True):
            status, failures = advance(status, int(failures), None if pd.isna(http) else int(http), None if pd.isna(error) else error)
        self.state.update((status, failures))
        last = checks.iloc[-1]
        yield pd.DataFrame(
            {
                "link_id": [key[0]], "status": [status], "consecutive_failures": [failures], "last_checked_at": [last["checked_at"]],
                "last_http_status": pd.array([None if pd.isna(last["http_status"]) else int(last["http_status"])], "Int32"),
                "last_error_type": [None if pd.isna(last["error_type"]) else last["error_type"]],
            }
        )

    def close(self) -> None:
        pass


def link_states(checks: DataFrame) -> DataFrame:
    """Newest state of each link in a batch of the stream ``checks``.

    Needs the RocksDB state store.  Checks that arrive in a later batch than
    younger ones are taken as they come; the batch fold orders all.
    """
    return checks.groupBy("link_id").transformWithStateInPandas(LinkStates(), OUTPUT, "Update", "None")


DUE = "link_id bigint, due_at timestamp_ntz, status string"
#: Event times are compared with epoch milliseconds.
_EPOCH = pd.Timestamp(0)


class DueTimers(StatefulProcessor):
    """A timer a link, set anew by every check to when the link is due; a link comes out when the watermark passes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        checks = pd.concat(list(rows)).sort_values(["checked_at", "id"])
        status, failures = self.state.get() if self.state.exists() else (PENDING, 0)
        for http, error in zip(checks["http_status"], checks["error_type"], strict=True):
            status, failures = advance(status, int(failures), None if pd.isna(http) else int(http), None if pd.isna(error) else error)
        self.state.update((status, failures))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = checks["checked_at"].iloc[-1].tz_localize(None)
        self.handle.registerTimer(int((last + wait(failures) - _EPOCH) // pd.Timedelta(milliseconds=1)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = _EPOCH + pd.Timedelta(milliseconds=expiredTimerInfo.getExpiryTimeInMs())
        yield pd.DataFrame({"link_id": [key[0]], "due_at": [due], "status": [self.state.get()[0]]})

    def close(self) -> None:
        pass


def wait(failures: int) -> pd.Timedelta:
    """How long after a check a link is due, without jitter."""
    if not failures:
        return pd.Timedelta(days=HEALTHY_DAYS)
    if failures >= CONFIRM_AFTER:
        return pd.Timedelta(days=CONFIRMED_DAYS)
    return pd.Timedelta(minutes=UNCONFIRMED_MINUTES[failures - 1])


def due_links(checks: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """(link_id, due_at, status) of links as they become due, by timers in event time; needs the RocksDB state store.

    ``checks`` has ``checked_at`` as a timestamp; what comes later than ``lateness`` behind the youngest is dropped.
    """
    timed = checks.withWatermark("checked_at", lateness)
    return timed.groupBy("link_id").transformWithStateInPandas(DueTimers(), DUE, "Update", "EventTime")


class Heartbeat(StreamingQueryListener):
    """Passes on (checked, not_ok) of every batch that ``counted`` observes, and that a stream has ended."""

    def __init__(self, say: Callable[[str], None], name: str = "progress") -> None:
        self.say, self.name = say, name

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is not None and row["checked"]:
            self.say(f"batch {event.progress.batchId}: {row['checked']} checked, {row['not_ok']} not ok")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.say("stream ended" if event.exception is None else f"stream failed: {event.exception}")


def counted(checks: DataFrame, name: str = "progress") -> DataFrame:
    """The stream itself, with (checked, not_ok) of every batch among its progress metrics."""
    return checks.observe(name, *progress_metrics())


ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
