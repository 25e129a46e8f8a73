"""Links of a page with the section, label and prose around them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.functions.html_dom import Node, parse
from anchorage.functions.urls import SKIPPED, join
from anchorage.settings import CONTEXT_CHARS

# Section markers, titles, and the elements that bound context and labels.
MARKER = re.compile(r"^(?:day|week)\d+$", re.I)
TITLE = re.compile(r"(?:lesson|day|week)\s*\d+\*?", re.I)
BLOCKS = frozenset("p li div td th dd dt blockquote h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset({"ol", "ul"})
LABEL_SIBLINGS = 5
CONTENT_CLASS = "entry-content"


def truncate_words(text: str, limit: int, keep_end: bool) -> str:
    """At most ``limit`` characters from one end, without a part of a word where a space allows that."""
    if len(text) <= limit:
        return text
    part = text[len(text) - limit :] if keep_end else text[:limit]
    head, space, tail = part.partition(" ") if keep_end else part.rpartition(" ")
    if not space:
        return part
    return tail if keep_end else head


def context(anchor: Node) -> tuple[str | None, str | None]:
    """Prose before and after the first place of the anchor's text in the nearest block around it."""
    block = next((n for n in anchor.ancestors() if n.name in BLOCKS), None)
    text = anchor.text()
    if block is None or not text:
        return None, None
    before, found, after = block.text().partition(text)
    if not found:
        return None, None
    left = truncate_words(before.strip(), CONTEXT_CHARS, keep_end=True)
    right = truncate_words(after.strip(), CONTEXT_CHARS, keep_end=False)
    return left or None, right or None


def _is_marker(node: Node) -> bool:
    return bool(MARKER.match(node.attributes.get("id", "")))


def _until(nodes: Iterable[Node], stop: Callable[[Node], bool]) -> list[Node]:
    out = []
    for node in nodes:
        if stop(node):
            break
        out.append(node)
    return out


def _bold(nodes: Iterable[Node]) -> list[str]:
    found = (n if n.name == "strong" else n.find({"strong"}) for n in nodes)
    return [text for n in found if n is not None and (text := n.text())]


def section_label(marker: Node) -> str | None:
    """A section's title: the marker's own text if it holds no list, else bold text in it, else bold text right after it."""
    own = marker.text()
    if own and marker.find(LISTS) is None:
        titles = [own]
    else:
        titles = _bold(_until(marker.elements, lambda n: n.name in LISTS))
    if not titles:
        titles = _bold(_until(marker.following(LABEL_SIBLINGS), lambda n: n.name in LISTS or _is_marker(n)))
    numbered = (m.group() for t in titles if (m := TITLE.search(t)))
    return next(numbered, titles[0] if titles else None)


def _resolved(anchor: Node, page_url: str) -> tuple[str, str] | None:
    """URL with its fragment and lower-case host of an anchor, if it is a link."""
    href = anchor.attributes.get("href", "").strip()
    if not href or href.startswith(SKIPPED):
        return None
    url = join(page_url, href)
    return None if url is None else (url, urlsplit(url.split("#", 1)[0]).netloc.lower())


def external_links(root: Node, page_url: str, base_url: str) -> list[dict]:
    """Links with text to other hosts, the first of each (url, section), in document order.

    A section counts only if all its markers stand in one run; a marker inside
    another is none.
    """
    home = urlsplit(base_url).netloc.lower()
    nodes = list(root.walk())
    markers = {id(n) for n in nodes if _is_marker(n) and not any(_is_marker(p) for p in n.ancestors())}
    names = [n.attributes["id"] for n in nodes if id(n) in markers]
    runs = Counter(name for k, name in enumerate(names) if not k or names[k - 1] != name)
    section = label = None
    found: dict[tuple[str, str | None], dict] = {}
    for node in nodes:
        if id(node) in markers:
            name = node.attributes["id"]
            if name != section:
                section, label = name, section_label(node)
        if node.name != "a" or (resolved := _resolved(node, page_url)) is None:
            continue
        url, host = resolved[0].split("#", 1)[0], resolved[1]
        if not url or host == home or not (text := node.text()):
            continue
        sure = section if section is not None and runs[section] == 1 else None
        if (url, sure) not in found:
            before, after = context(node)
            found[url, sure] = {
                "url": url, "text": text, "day_context": sure, "context_before": before, "context_after": after,
                "day_label": label if sure else None,
            }
    return [{"ord": k, **row} for k, row in enumerate(found.values())]


def _page(url: str) -> str:
    return url.split("#", 1)[0].rstrip("/")


def internal_links(root: Node, page_url: str, base_url: str) -> list[str]:
    """Other pages of the site that a page links to, without fragments, each once, in document order."""
    home, own = urlsplit(base_url).netloc.lower(), _page(page_url)
    found: dict[str, None] = {}
    for node in root.walk():
        if node.name == "a" and "href" in node.attributes and (resolved := _resolved(node, page_url)) is not None:
            page = _page(resolved[0])
            if resolved[1] == home and page and page != own:
                found[page] = None
    return list(found)


def listed_pages(html: str, index_url: str, base_url: str) -> list[dict]:
    """Pages that an index page's content lists on its own host (compared as written), each with its first title."""
    content = next((n for n in parse(html).walk() if CONTENT_CLASS in n.attributes.get("class", "").split()), None)
    home, own = urlsplit(base_url).netloc, _page(index_url)
    found: dict[str, str] = {}
    for node in content.walk() if content else ():
        if node.name != "a" or "href" not in node.attributes:
            continue
        url = join(index_url, node.attributes["href"].strip())
        if url is not None and _page(url) != own and urlsplit(url).netloc == home:
            title = "".join(part.strip() for part in _strings(node))
            found.setdefault(_page(url), title)
    return [{"ord": k, "url": url, "title": title} for k, (url, title) in enumerate(found.items())]


def _strings(node: Node) -> Iterable[str]:
    for child in node.children:
        if isinstance(child, str):
            yield child
        else:
            yield from _strings(child)


_EXTERNAL = pa.list_(
    pa.struct(
        [("ord", pa.int32())] + [(c, pa.string()) for c in ("url", "text", "day_context", "context_before", "context_after", "day_label")]
    )
)


def extract(pages: DataFrame) -> DataFrame:
    """Both kinds of links of every page in one reading.

    Takes (page_id, url, html, base_url) and gives (page_id, external, internal):
    arrays of structs and of URLs.  A null html or URL has no links.
    """

    def run(batches):
        for batch in batches:
            outside, inside = [], []
            for url, html, base in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                root = parse(html) if html is not None and url is not None else Node("#document")
                outside.append(external_links(root, url or "", base or ""))
                inside.append(internal_links(root, url or "", base or ""))
            columns = [batch.column(0), pa.array(outside, _EXTERNAL), pa.array(inside, pa.list_(pa.string()))]
            yield pa.record_batch(columns, names=["page_id", "external", "internal"])

    row = "ord int, url string, text string, day_context string, context_before string, context_after string, day_label string"
    kind = pages.schema["page_id"].dataType.simpleString()
    chosen = pages.select("page_id", "url", "html", "base_url")
    return chosen.mapInArrow(run, f"page_id {kind}, external array<struct<{row.replace(' ', ': ').replace(',:', ',')}>>, internal array<string>")


def external(pages: DataFrame) -> DataFrame:
    """One row for each external link of each page."""
    return extract(pages).select("page_id", F.inline("external"))


def internal(pages: DataFrame) -> DataFrame:
    """(page_id, ord, child_url), one row for each internal link of each page."""
    return extract(pages).select("page_id", F.posexplode("internal").alias("ord", "child_url"))


def listed(indexes: DataFrame) -> DataFrame:
    """``listed_pages`` of every index page (html, index_url, base_url): (index_url, ord, url, title).  A null html lists nothing."""

    def run(batches):
        for batch in batches:
            rows = []
            for html, index_url, base_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(index_url, r["ord"], r["url"], r["title"]) for r in (listed_pages(html, index_url, base_url) if html is not None else ())]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["index_url", "ord", "url", "title"])

    return indexes.select("html", "index_url", "base_url").mapInArrow(run, "index_url string, ord int, url string, title string")
