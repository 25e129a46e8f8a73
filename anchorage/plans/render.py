"""The report as text and as one HTML page.

Rows come to the driver partition by partition and are written as they come, so
the report holds no more than a partition of failing links in memory.  The page
works without a server: a search box and status buttons, groups to fold,
dismissals that the browser keeps until a link is checked again, blurbs to
copy, and times as how long ago they were.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.functions.text import day_display, occurrence_id, text_display
from anchorage.operators import report
from anchorage.operators.rules import RULES, documented

STYLE = (
    "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px;text-align:left}"
    "h4{cursor:pointer}section.folded table{display:none}tr.out{display:none}"
)

#: Rows carry what is searched, their status, their occurrence, the time of their last check and their blurb.
SCRIPT = """
const store = (key, value) => { try { if (value === undefined) return JSON.parse(localStorage.getItem(key) || '{}'); localStorage.setItem(key, JSON.stringify(value)); } catch (e) { return {}; } };
const rows = [...document.querySelectorAll('tr[data-id]')], parts = [...document.querySelectorAll('section')];
let gone = store('anchorage.dismissed') || {}, folded = store('anchorage.folded') || {}, status = '';
const listed = new Map(rows.map(r => [r.dataset.id, r.dataset.checked]));
// A dismissal holds while its place is listed and its link was not checked since; older ids have no section.
gone = Object.fromEntries(Object.entries(gone).map(([id, t]) => [id.split('::').length === 2 ? id + '::' : id, t]).filter(([id, t]) => listed.get(id) === t));
const ago = t => { const s = (Date.now() - Date.parse(t + 'Z')) / 1000; const [n, u] = s >= 86400 ? [86400, 'd'] : s >= 3600 ? [3600, 'h'] : s >= 60 ? [60, 'min'] : [1, 's']; return Math.floor(s / n) + ' ' + u + ' ago'; };
document.querySelectorAll('time').forEach(t => { t.title = t.dateTime; t.textContent = ago(t.dateTime); });
function show() {
  const words = document.getElementById('words').value.toLowerCase();
  rows.forEach(r => r.classList.toggle('out', r.dataset.id in gone || (status && r.dataset.status !== status) || !r.dataset.find.includes(words)));
  parts.forEach(p => { const left = p.querySelectorAll('tr[data-id]:not(.out)').length; p.hidden = !left; p.querySelector('.count').textContent = left; p.classList.toggle('folded', p.id in folded); });
  document.getElementById('dismissed').textContent = Object.keys(gone).length;
  store('anchorage.dismissed', gone); store('anchorage.folded', folded);
}
document.addEventListener('input', show);
document.addEventListener('click', e => {
  const act = e.target.dataset.act, row = e.target.closest('tr[data-id]');
  if (act === 'dismiss') gone[row.dataset.id] = row.dataset.checked;
  else if (act === 'restore') gone = {};
  else if (act === 'copy') navigator.clipboard.writeText(row.dataset.info);
  else if (act === 'status') status = e.target.dataset.status;
  else if (e.target.tagName === 'H4') { const p = e.target.closest('section'); if (p.id in folded) delete folded[p.id]; else folded[p.id] = 1; }
  show();
});
show();
"""


def _lists(state: dict[str, DataFrame], rules=RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    tables = (state["sites"], state["pages"], state["page_links"])
    summaries = report.site_summaries(*tables, state["links"], rules).orderBy("slug", "kind")
    problems = report.with_pages(*tables, report.with_rank(report.problem_links(*tables, state["links"], rules))).orderBy("rank")
    watched = report.watch_links(*tables, state["links"], rules)
    return summaries, problems, watched


def _reason(row) -> str:
    return row.last_error_type or str(row.last_http_status)


def text_lines(state: dict[str, DataFrame], rules=RULES) -> Iterator[str]:
    """Counts by site and kind, broken links with their places, and links under watch."""
    summaries, problems, watched = _lists(state, rules)
    yield f"{'site':>20} {'kind':>7} {'ok':>5} {'broken':>7} {'unreachable':>11} {'pending':>8} {'watching':>9} {'total':>6}"
    for s in summaries.toLocalIterator():
        yield f"{s.slug:>20} {s.kind:>7} {s.ok:>5} {s.broken:>7} {s.unreachable:>11} {s.pending:>8} {s.watching:>9} {s.total:>6}"
    n = problems.count()
    yield from ("", f"{n} link{'' if n == 1 else 's'} to look at")
    for link in problems.toLocalIterator():
        yield f"[{link.status}] {link.url} ({_reason(link)}, {link.consecutive_failures} in a row)"
        for p in link.pages or []:
            day = p.day_label or p.day_context
            text = f'"{p.link_text}"' if p.link_text else "no visible text"
            yield f"    {p.site_slug}: {p.page_title}{', ' + day if day else ''}: {text}"
    n = watched.count()
    yield from ("", f"{n} link{'' if n == 1 else 's'} under watch")
    for link in watched.toLocalIterator():
        yield f"[{link.status}] {link.url} ({_reason(link)}, {link.consecutive_failures} in a row)"


def text_report(state: dict[str, DataFrame], rules=RULES) -> str:
    """The lines of the text report."""
    return "\n".join(text_lines(state, rules)) + "\n"


def _entries(state: dict[str, DataFrame], rules) -> DataFrame:
    """One row a place of a problem link, in the order of the page: groups, then their entries."""
    tables = (state["sites"], state["pages"], state["page_links"])
    links = state["links"].select(F.col("id").alias("link_id"), "url", "status", "last_checked_at", "last_http_status", "last_error_type")
    ranked = report.with_rank(report.problem_links(*tables, state["links"], rules))
    places = report.info(report.with_deep_links(report.occurrences(*tables, ranked)).join(links, "link_id"))
    shown = places.select(
        "page_link_id", "href", "info", "last_checked_at", text_display(F.col("link_text")).alias("shown"),
        day_display(F.col("day_label"), F.col("day_context")).alias("section"), occurrence_id(F.col("page_url"), F.col("link_id"), F.col("day_context")).alias("occurrence_id"),
        F.lower(F.concat_ws(" ", "link_text", "url", "page_title", "day_label", "context_before", "context_after")).alias("find"),
    )
    groups = report.page_groups(*tables, ranked).select("position", "site_slug", "page_title", "page_url", "kind", "n_occurrences", F.posexplode("entries").alias("k", "e"))
    return groups.select("*", "e.*").join(shown, "page_link_id").orderBy("position", "page_title", "page_url", "k")


def html_lines(state: dict[str, DataFrame], rules=RULES) -> Iterator[str]:
    """Counts, then a table for each page with failing links, under its site, courses before other pages, and the rules in force."""
    summaries, _, watched = _lists(state, rules)
    yield "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Links</title><style>" + STYLE + "</style></head><body><h1>Links</h1><table><tr>"
    names = ("slug", "kind", "ok", "broken", "unreachable", "pending", "watching", "total")
    yield "".join(f"<th>{n}</th>" for n in names) + "</tr>"
    for s in summaries.toLocalIterator():
        yield "<tr>" + "".join(f"<td>{escape(str(s[n]))}</td>" for n in names) + "</tr>"
    yield "</table><p><input id='words' type='search' placeholder='Search'> "
    for value in ("", "broken", "unreachable"):
        yield f"<button data-act='status' data-status='{value}'>{value or 'all'}</button>"
    yield " <span id='dismissed'>0</span> dismissed <button data-act='restore'>restore</button></p>"
    site = part = page = None
    for e in _entries(state, rules).toLocalIterator():
        if (e.site_slug, e.page_title, e.page_url) != page:
            if page is not None:
                yield "</table></section>"
            if e.site_slug != site:
                yield f"<h2>{escape(e.site_slug)}</h2>"
                site, part = e.site_slug, None
            if e.kind == "other" and part != "other":
                yield "<h3>Other pages</h3>"
            part, page = e.kind, (e.site_slug, e.page_title, e.page_url)
            yield f"<section id='{escape(e.page_url, True)}'><h4>{escape(e.page_title or e.page_url)} (<span class='count'>{e.n_occurrences}</span>)</h4>"
            yield "<table><tr><th>section</th><th>link</th><th>status</th><th>reason</th><th>checked</th><th>place</th><th></th></tr>"
        checked = e.last_checked_at.isoformat() if e.last_checked_at else ""
        data = {"id": e.occurrence_id, "checked": checked, "status": e.link_status, "find": e.find, "info": e.info}
        yield "<tr " + " ".join(f"data-{k}='{escape(v, True)}'" for k, v in data.items()) + ">"
        yield f"<td>{escape(e.section or '')}</td><td><a href='{escape(e.link_url, True)}'>{escape(e.shown)}</a></td><td>{escape(e.link_status)}</td>"
        yield f"<td>{escape(e.link_last_error_type or str(e.link_last_http_status))}</td><td><time datetime='{checked}'>{checked}</time></td>"
        yield f"<td><a href='{escape(e.href, True)}'>page</a></td><td><button data-act='copy'>copy</button><button data-act='dismiss'>dismiss</button></td></tr>"
    if page is not None:
        yield "</table></section>"
    yield "<h2>Under watch</h2><ul>"
    for link in watched.toLocalIterator():
        yield f"<li>{escape(link.url)} ({escape(_reason(link))})</li>"
    yield "</ul><h2>Left out</h2><ul>" + "".join(f"<li>{escape(key)}: {escape(reason)}</li>" for key, reason in documented(rules))
    yield "</ul><script>" + SCRIPT + "</script></body></html>"


def html_report(state: dict[str, DataFrame], rules=RULES) -> str:
    """The lines of the HTML page."""
    return "\n".join(html_lines(state, rules))
