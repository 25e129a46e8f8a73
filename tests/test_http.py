"""The sources that make requests, against a server on this machine."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from anchorage.sources import listing, probe


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def _answer(self, status, body="", **headers):
        data = body.encode()
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):  # noqa: N802
        url = urlsplit(self.path)
        if url.path == "/wp-json/wp/v2/pages":
            k = int(parse_qs(url.query)["page"][0])
            if k == 2 and not self.server.refused:
                self.server.refused = True
                return self._answer(429, Retry_After="0")
            rows = [{"id": 10 * k + j, "slug": f"s{k}{j}", "link": f"/s{k}{j}", "modified_gmt": "t"} for j in range(2)]
            return self._answer(200, json.dumps(rows), X_WP_TotalPages="3")
        if url.path == "/loop":
            return self._answer(302, Location="/loop?" + "x" * (1 + len(url.query)))
        if url.path == "/moved":
            return self._answer(302, Location="/fine")
        return self._answer(200 if url.path == "/fine" else 404)


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.refused = False
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_listing_source(spark, server):
    listing.register(spark)
    rows = spark.read.format("site_listing").option("base_url", server).option("page_size", "2").load()
    assert rows.rdd.getNumPartitions() == 3
    assert sorted(r.slug for r in rows.collect()) == ["s10", "s11", "s20", "s21", "s30", "s31"]


def test_requests(server):
    assert probe.request(f"{server}/fine") == (200, None)
    assert probe.request(f"{server}/moved") == (200, None)
    assert probe.request(f"{server}/none") == (404, None)
    assert probe.request("http://127.0.0.1:9/") == (None, "connection_refused")
    assert probe.request("http://[bad/") == (None, "other")
    assert probe.request(f"{server}/loop")[1] == "too_many_redirects"


def test_probe_falls_back_to_plain(spark, server):
    links = spark.createDataFrame([(1, f"{server}/fine"), (2, f"{server}/none")], "id long, url string")
    got = {r.link_id: (r.http_status, r.error_type) for r in probe.probe(links).collect()}
    assert got == {1: (200, None), 2: (404, None)}


def test_recovered_certificates(spark):
    links = spark.createDataFrame([(1, "https://a.test/"), (2, "https://b.test/")], "id long, url string")
    got = probe.probe(links, lambda url: (None, "bad_ssl_cert"), lambda url: (200, None) if "a.test" in url else (None, "other"))
    assert {r.link_id: (r.http_status, r.error_type) for r in got.collect()} == {1: (200, None), 2: (None, "bad_ssl_cert")}
