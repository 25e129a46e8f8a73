"""Requests to links: one GET each, timed, put into buckets of outcomes."""

from __future__ import annotations

import socket
import ssl
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from time import monotonic

import pyarrow as pa
from pyspark.sql import DataFrame

from anchorage.settings import BAD_CERT, DNS, OTHER_ERROR, REFUSED, TIMEOUT, TOO_MANY_REDIRECTS

# Limits of a request.
SECONDS, REDIRECTS = 15, 10


class TooManyRedirects(Exception):
    """A request was redirected more often than allowed."""


def bucket(error: BaseException) -> str:
    """What went wrong, by the first cause that tells."""
    seen: list[BaseException] = []
    cause: BaseException | None = error
    while cause is not None and cause not in seen:
        seen.append(cause)
        reason = getattr(cause, "reason", None)
        cause = cause.__cause__ or (reason if isinstance(reason, BaseException) else None) or cause.__context__
    for kinds, name in (
        ((TooManyRedirects,), TOO_MANY_REDIRECTS),
        ((TimeoutError,), TIMEOUT),
        ((ssl.SSLCertVerificationError,), BAD_CERT),
        ((socket.gaierror,), DNS),
        ((ConnectionRefusedError, ConnectionResetError), REFUSED),
    ):
        if any(isinstance(e, kinds) for e in seen):
            return name
    return OTHER_ERROR


class _Redirects(urllib.request.HTTPRedirectHandler):
    max_redirections = REDIRECTS

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if len(getattr(req, "redirect_dict", {})) >= REDIRECTS:
            raise TooManyRedirects
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def request(url: str, context: ssl.SSLContext | None = None) -> tuple[int | None, str | None]:
    """Status or error bucket of one GET; the body is not read.  ``context`` says what to trust instead of the system's roots."""
    try:
        opener = urllib.request.build_opener(_Redirects, *([urllib.request.HTTPSHandler(context=context)] if context else []))
        with opener.open(urllib.request.Request(url, headers={"User-Agent": "anchorage"}), timeout=SECONDS) as answer:
            return answer.status, None
    except urllib.error.HTTPError as e:
        return e.code, None
    except Exception as e:  # any failure of a request is an outcome
        return None, bucket(e)


def secure_first(url: str, ask: Callable[[str], tuple[int | None, str | None]]) -> tuple[int | None, str | None]:
    """Outcome over https, and of a plain URL over http only if https failed on the way; a bad status is an answer."""
    head, _, rest = url.partition("://")
    if head.lower() != "http":
        return ask(url)
    status, error = ask(f"https://{rest}")
    return (status, error) if error is None else ask(url)


def probe(claimed: DataFrame, ask: Callable[[str], tuple[int | None, str | None]] = request, recover=None) -> DataFrame:
    """(link_id, http_status, error_type, response_time_ms) for claimed links (id, url), each asked once.

    ``recover(url)`` may try again after a bad certificate, for example with
    certificates that the server left out; its outcome counts if it has a
    status.  Both functions run on the workers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for link, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                began = monotonic()
                status, error = secure_first(url, ask)
                if error == BAD_CERT and recover is not None:
                    again = recover(url)
                    status, error = again if again[1] is None else (status, error)
                rows.append((link, status, error, round(1000 * (monotonic() - began))))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.record_batch(columns, names=["link_id", "http_status", "error_type", "response_time_ms"])

    return claimed.select("id", "url").mapInArrow(run, "link_id bigint, http_status int, error_type string, response_time_ms int")
