"""The continuous worker: crawls, checks, reports and progress, each at its own pace until it is told to stop.

Every loop is a thread with jobs of its own, so a long crawl does not hold up
checks; what goes wrong in one round is logged and the next round comes.  A stop
is honoured between rounds: what has been claimed is asked for and recorded
first.  Loops share nothing but the store, whose commits start over where
another loop has come before.
"""

from __future__ import annotations

import logging
import signal
import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from anchorage.operators import report
from anchorage.plans import runs
from anchorage.settings import Pace
from anchorage.sources.store import Conflict, Store

log = logging.getLogger(__name__)


@dataclass
class Worker:
    """``crawl_site`` takes a row of the table ``sites``; ``ask`` makes one request; ``now`` gives the time without zone."""

    store: Store
    crawl_site: Callable
    ask: Callable
    now: Callable[[], datetime]
    html: str | None = None
    recover: Callable | None = None
    pace: Pace = Pace()
    stop: threading.Event = field(default_factory=threading.Event)
    #: What each loop has done.
    rounds: dict[str, int] = field(default_factory=lambda: {"crawl": 0, "check": 0, "report": 0, "progress": 0})
    checked: int = 0
    not_ok: int = 0

    def _safely(self, name: str, work: Callable[[], None]) -> None:
        try:
            work()
        except Exception:
            log.exception("%s failed", name)
        self.rounds[name] += 1

    def _crawl(self) -> None:
        for site in self.store.read("sites").orderBy("slug").collect():
            if self.stop.is_set():
                return
            try:
                totals = self.crawl_site(site)
                log.info("%s: crawled %d pages, %d missing", site.slug, totals.found, totals.missing)
            except Exception:  # one site's failure leaves the others
                log.exception("crawl of %s failed", site.slug)
        self._report()
        try:
            self.store.compact()
        except Conflict:  # a check was recorded meanwhile; the next round tidies up
            pass
        self.store.vacuum()

    def _report(self) -> None:
        if self.html:
            runs.write_report(self.store, self.html)

    def _check(self) -> int:
        """One poll; returns the number claimed."""
        claimed = runs.check(self.store, self.now(), self.pace.room, self.ask, recover=self.recover)
        self.checked, self.not_ok = self.checked + claimed, self.not_ok + getattr(claimed, "not_ok", 0)
        return claimed

    def crawl_loop(self) -> None:
        while not self.stop.is_set():
            self._safely("crawl", self._crawl)
            self.stop.wait(self.pace.crawl_seconds)

    def check_loop(self) -> None:
        """While there is work the next poll comes soon, else after the idle time."""
        while not self.stop.is_set():
            claimed = [0]
            self._safely("check", lambda c=claimed: c.__setitem__(0, self._check()))
            self.stop.wait(self.pace.busy_seconds if claimed[0] else self.pace.idle_seconds)

    def report_loop(self) -> None:
        self._safely("report", self._report)
        while not self.stop.wait(self.pace.report_seconds):
            if self.checked:
                log.info("checked %d links, %d not ok", self.checked, self.not_ok)
                self.checked = self.not_ok = 0
            self._safely("report", self._report)

    def _progress(self) -> None:
        tables = self.store.read_all()
        row = report.check_progress(tables["page_links"], tables["links"]).first()
        log.info("progress: %d of %d links checked (%.1f %%)", row.checked, row.total, row.percent)

    def progress_loop(self) -> None:
        while not self.stop.wait(self.pace.progress_seconds):
            self._safely("progress", self._progress)

    def run(self) -> None:
        """All loops until ``stop`` is set, by a signal for one; returns when each has ended its round."""
        if threading.current_thread() is threading.main_thread():
            for number in (signal.SIGINT, signal.SIGTERM):
                signal.signal(number, lambda *_: self.stop.set())
        loops = [threading.Thread(target=f, name=f.__name__) for f in (self.crawl_loop, self.check_loop, self.report_loop, self.progress_loop)]
        for loop in loops:
            loop.start()
        for loop in loops:
            while loop.is_alive():  # with a limit, so that signals are seen
                loop.join(1.0)
