"""Main text of web pages by nearest-URL page differencing, guarded by markup.

A page is read into lines, one for each block of text, template and all.  The
pages of a host are ordered by URL path and each is aligned with its nearest
neighbour by a longest common subsequence of lines; lines that both have are
template text and are deleted.  A neighbour with next to no text of its own is
a copy and not a page of one template; the other neighbour is taken then, and
between copies nothing is deleted.

Markup guards both sides, as pages of a host share sentences and differ in
their menus and adverts.  Running text inside a marked article is not deleted;
and of the lines that are not shared, those that the markup itself names as
menu, header, footer, sidebar, notice, advert, form or comment are left out,
as is what stands outside of the article of a page that marks one.

The order of pages is a distributed sort; neighbours meet in a join on their
rank, so a host of any size spreads over all tasks.  Only hashes of lines
travel; page texts are built in a second reading.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anchorage.llm.common import discard, list_column, map_batches, stash

# HTML's elements by how they matter here.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp", "noembed", "noframes", "math", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
LEFT_OUT = {"nav", "footer", "aside", "form", "head", "menu", "button", "select", "dialog", "fieldset", "datalist"}
ARTICLE = {"article", "main"}
#: Parts of class and id names of what is no article.
NAMES = {
    "ad", "ads", "adv", "advert", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
    "sidebar", "sidenav", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "topbar", "toolbar",
    "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "share", "sharing", "social", "related", "recommended",
    "widget", "pagination", "pager", "login", "search", "skip", "hidden",
}
HEADER_NAMES = {"header", "head"}
#: Parts that make a class tell of a state (has-sidebar, comments-open) and not of what the element is.
STATE_STARTS, STATE_ENDS = {"has", "no", "with", "without"}, {"open", "closed", "enabled", "disabled"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
WHOLE_PAGE = {"html", "body"}
#: Largest table of an alignment.
TABLE_BITS = 1 << 31
#: Two pages are copies where the shorter has no more text of its own than this part of it, and the longer has half in common.
COPY_PART = 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_MARKED = re.compile(r"<(?:article|main)[\s>]", re.I)
_PART = re.compile(r"[a-z]+")
_END_OF = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}


def _parts(value: str) -> set[str]:
    out: set[str] = set()
    for token in value.strip("\"'").lower().split():
        found = _PART.findall(token)
        if found and found[0] not in STATE_STARTS and found[-1] not in STATE_ENDS:
            out.update(found)
    return out


def _wraps(attributes: str) -> bool:
    """Whether an element that is set aside may be the wrapper of an article: one that only its class or id names, and not as comments."""
    kept = _ATTRIBUTE.sub(lambda m: "" if m[1].lower() in ("class", "id") else m[0], attributes)
    named = [_parts(value) for key, value in _ATTRIBUTE.findall(attributes) if key.lower() in ("class", "id")]
    return not any({"comment", "comments", "commentlist", "hidden"} & parts for parts in named) and not _set_aside("div", kept, True)


def _set_aside(name: str, attributes: str, in_article: bool) -> bool:
    """Whether the markup names an element as something else than article text."""
    if name in LEFT_OUT or name == "header" and not in_article:
        return True
    if not attributes or name in WHOLE_PAGE:
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key in ("class", "id"):
            parts = _parts(value)
            if parts & NAMES and name not in ARTICLE or "comment" in parts or "comments" in parts:
                return True
            if not in_article and parts & HEADER_NAMES and name not in ARTICLE:
                return True
        elif key == "role" and value.strip("\"'").lower() in ROLES:
            return True
        elif key == "hidden" or key == "aria-hidden" and "true" in value.lower():
            return True
        elif key == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def blocks(html: str, unwrap: bool = False) -> list[tuple[str, bool, bool, bool]]:
    """Blocks of text in page order, each with whether it is in a marked article, whether most of it is links, and whether it is set aside.

    With ``unwrap``, an article is read although elements around it have names of what is no article.
    """
    out: list[tuple[str, bool, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, set aside, article, may be a wrapper
    aside = article = links = 0
    text: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        if text:
            joined = "".join(text)
            if "&" in joined:
                joined = unescape(joined)
            words = " ".join(joined.split())
            if words:
                out.append((words, article > 0, 2 * linked > len(words), aside > 0))
            text.clear()
        linked = 0

    at, end = 0, len(html)
    while at < end:
        match = _TOKEN.search(html, at)
        start = match.start() if match else end
        if start > at:
            piece = html[at:start]
            text.append(piece)
            if links:
                linked += len(piece)
        if not match:
            break
        at = match.end()
        name = match[2]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                links = 0 if match[1] else 1
            elif name == "br":
                text.append(" ")
            elif not match[1] and match[3] and not aside and name not in VOID and _set_aside(name, match[3], article > 0):
                close_tag = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = close_tag.end() if close_tag else at
            continue
        if name in RAW:
            if not match[1] and not match[3].endswith("/"):
                closing = _END_OF[name].search(html, at)
                at = closing.end() if closing else end
            continue
        close()
        links = 0
        if name in VOID or name == "p" or name in WHOLE_PAGE:
            continue
        if match[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    for _, gone, was_article, _ in stack[k:]:
                        aside -= gone
                        article -= was_article
                    del stack[k:]
                    break
        elif not match[3].endswith("/"):
            gone = _set_aside(name, match[3], article > 0)
            if unwrap and name in ARTICLE and aside and not gone and all(may for _, was_gone, _, may in stack if was_gone):
                stack = [(n, False, was_article, may) for n, _, was_article, may in stack]
                aside = 0
            is_article = not gone and not aside and (name in ARTICLE or "role" in match[3] and "main" in match[3])
            stack.append((name, gone, is_article, unwrap and gone and name not in LEFT_OUT and name != "header" and _wraps(match[3])))
            aside += gone
            article += is_article
    close()
    return out


class Line(NamedTuple):
    """A line of a page; ``kept`` by the markup if it is not shared, ``free`` to be deleted if it is."""

    text: str
    kept: bool
    free: bool


def page_lines(html: str) -> list[Line]:
    """All lines of a page.

    The markup keeps the blocks of marked articles, or where a page marks none,
    all that are neither set aside nor links; running text of an article is not free.
    """
    found = blocks(html)
    marked = any(inside and not aside for _, inside, _, aside in found)
    if not marked and _MARKED.search(html):
        # An article in an element that is set aside: the page's article, if it is longer than what else there is.
        again = blocks(html, unwrap=True)
        wrapped = sum(len(text) for text, inside, _, aside in again if inside and not aside)
        if wrapped > sum(len(text) for text, _, links, aside in found if not links and not aside):
            found, marked = again, True
    out = []
    for text, inside, links, aside in found:
        kept = not aside and (inside if marked else not links)
        out.append(Line(text, kept, not (kept and inside and not links)))
    return out


def candidates(html: str) -> list[Line]:
    """The lines that a page's markup keeps."""
    return [line for line in page_lines(html) if line.kept]


def common_lines(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places in both of a longest common subsequence, by bit-parallel rows.

    Where the product of lines passes 2**31, the pages are divided at a place that
    a longest common subsequence goes through, so that no table grows beyond it.
    """
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    before = [(k, k) for k in range(low)]
    after = [(len(a) - k, len(b) - k) for k in range(high, 0, -1)]
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not a or not b:
        return before + after
    middle = _divided(a, b) if len(a) * len(b) > TABLE_BITS else _bit_rows(a, b)
    return before + [(i + low, j + low) for i, j in middle] + after


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` and each beginning of ``b``."""
    where: dict[int, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for line in a:
        hit = row & where.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), count=len(b), bitorder="little")
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _divided(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """``_bit_rows`` in linear memory, by Hirschberg's division."""
    if len(a) <= 1 or len(a) * len(b) <= TABLE_BITS:
        return _bit_rows(a, b)
    half = len(a) // 2
    at = int(np.argmax(_prefix_lengths(a[:half], b) + _prefix_lengths(a[half:][::-1], b[::-1])[::-1]))
    return _divided(a[:half], b[:at]) + [(i + half, j + at) for i, j in _divided(a[half:], b[at:])]


def _bit_rows(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    where: dict[int, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for line in a:
        hit = row & where.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    i, j, out = len(a), len(b), []
    while i and j:
        bit = 1 << (j - 1)
        if rows[i - 1] & bit:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] & bit:
                j -= 1
                out.append((i, j))
    return out[::-1]


def closeness(a: str, b: str) -> int:
    """How near two URL paths are: equal leading segments first, equal leading characters then."""
    x, y = a.split("/"), b.split("/")
    segments = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    characters = next((k for k, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
    return (segments << 16) + min(characters, 0xFFFF)


def are_copies(one: int, other: int, shared: int) -> bool:
    """Whether two pages are copies, by the sizes of the text that the markup keeps and of what of it they share."""
    less, more = sorted((one, other))
    return COPY_PART * (less - shared) <= less and 2 * shared >= more


def template_lines(lines: list[int], sizes: list[int], free: list[bool], pairs: list[int], shared_size: int, other_size: int) -> list[int]:
    """Which shared lines of a page to delete: all but running text of its article, none if the two pages are copies."""
    return [] if are_copies(sum(sizes), other_size, shared_size) else [k for k in pairs if free[k]]


def neighbours(pages: DataFrame) -> DataFrame:
    """(page_key, n_lines, deleted, kept) for each page with a neighbour: the lines to delete, and which of all lines the markup keeps.

    ``deleted`` are the lines that a page shares with its nearest neighbour and
    that are template text.  Of two neighbours as near, the one before counts,
    and one that is a copy only if both are.
    """
    url = F.coalesce("url", F.lit(""))
    keyed = pages.select(
        page_key().alias("page_key"),
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1).alias("path"),
        F.coalesce("html", F.lit("")).alias("html"),
    )

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines, sizes, free = [], [], []
        for html in batch.column(3):
            found = page_lines(html.as_py())
            lines.append(np.array([xxhash.xxh64_intdigest(b.text) for b in found], np.uint64).view(np.int64))
            sizes.append(np.array([len(b.text) if b.kept else 0 for b in found], np.int32))
            free.append(np.array([b.free for b in found], np.int8))
        arrays = [list_column(lines, pa.int64()), list_column(sizes, pa.int32()), list_column(free, pa.int8())]
        return pa.record_batch([*batch.columns[:3], *arrays], names=["page_key", "host", "path", "lines", "sizes", "free"])

    schema = "page_key long, host string, path string, lines array<long>, sizes array<int>, free array<tinyint>"
    read_pages = map_batches(keyed.filter("host <> ''"), read, schema)
    # Copies of a row have one key; one of them stands for all.
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_pages = read_pages.dropDuplicates(["page_key"]).orderBy("host", "path", "page_key")
    ordered = stash(sorted_pages.select("*", F.spark_partition_id().alias("part"), within.alias("at")))
    # One row a partition of the sort, however many pages there are.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = ordered.join(F.broadcast(parts), "part").withColumn("rank", F.col("before") + F.col("at")).drop("part", "at", "before")
    follower = ranked.select((F.col("rank") - 1).alias("rank"), *[F.col(c).alias(f"next_{c}") for c in read_pages.columns])
    pairs = ranked.join(follower, "rank").filter("host = next_host").select(
        "page_key", "path", "lines", "sizes", "free", "next_page_key", "next_path", "next_lines", "next_sizes", "next_free"
    )

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for key, path, a, a_sizes, a_free, next_key, next_path, b, b_sizes, b_free in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            shared = common_lines(a, b)
            size = sum(min(a_sizes[i], b_sizes[j]) for i, j in shared)
            differ = not are_copies(sum(a_sizes), sum(b_sizes), size)
            near = 2 * closeness(path, next_path)
            for own, own_sizes, free, own_near, pairs_of, other in (
                (key, a_sizes, a_free, near, [i for i, _ in shared], sum(b_sizes)),
                (next_key, b_sizes, b_free, near + 1, [j for _, j in shared], sum(a_sizes)),
            ):
                rows.append((own, differ, own_near, len(free), template_lines([], own_sizes, free, pairs_of, size, other), [x > 0 for x in own_sizes]))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.bool_()))
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.record_batch(columns, names=["page_key", "differ", "near", "n_lines", "deleted", "kept"])

    compared = map_batches(pairs, compare, "page_key long, differ boolean, near long, n_lines int, deleted array<int>, kept array<boolean>")
    best = F.max(F.struct("differ", "near", "n_lines", "deleted", "kept")).alias("best")
    out = stash(compared.groupBy("page_key").agg(best).select("page_key", "best.n_lines", "best.deleted", "best.kept"))
    discard(ordered)
    return out


def page_key():
    """A key of a page's row, as ids and URLs may repeat."""
    return F.xxhash64("page_id", "url", "html")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    A null html is empty and has the empty text; a page without a host, or
    alone on its host, has no neighbour and keeps what its markup leaves.
    Repeated rows have equal results; other columns are ignored; no rows give
    no rows.
    """
    # Deleted lines that the markup would leave out as well need not travel to the second reading.
    found = neighbours(pages)
    gone = F.filter("deleted", lambda k: F.element_at("kept", k + 1))
    deleted = stash(found.select("page_key", gone.alias("deleted")).filter("size(deleted) > 0"))
    discard(found)
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for html, shared in zip(batch.column(2), batch.column(3), strict=True):
            cut = set(shared.as_py() or ())
            texts.append("\n".join(line.text for k, line in enumerate(page_lines(html.as_py() or "")) if line.kept and k not in cut))
        sizes = pa.array([len(t) for t in texts], pa.int64())
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html", page_key().alias("page_key")).join(deleted, "page_key", "left")
    return map_batches(rows.select("page_id", "url", "html", "deleted"), read, f"page_id {kind}, url string, text string, n_chars long")
