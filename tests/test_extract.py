"""Links, sections, labels and prose of hand-written pages."""

from __future__ import annotations

import pytest

from anchorage.functions.extract import external_links, internal_links, listed_pages, section_label, truncate_words
from anchorage.functions.html_dom import parse
from anchorage.functions.urls import join

PAGE, BASE = "https://school.test/maths/", "https://school.test"


def links(html: str) -> list[dict]:
    return external_links(parse(html), PAGE, BASE)


def urls(html: str) -> list[str]:
    return [row["url"] for row in links(html)]


def a(url: str, text: str = "link") -> str:
    return f'<a href="{url}">{text}</a>'


def test_only_real_links_to_other_hosts():
    html = a("#top") + a("mailto:x@y.z") + a("tel:1") + a("javascript:go()") + a("/own") + a("https://SCHOOL.test/own") + a("https://far.test/p#part")
    assert urls(html) == ["https://far.test/p"]


def test_prefixes_count_in_lower_case_only():
    assert urls(a("MAILTO:x@y.z")) == ["MAILTO:x@y.z"]


def test_malformed_href_is_skipped():
    assert urls(a("http://[oops/") + a("https://far.test/")) == ["https://far.test/"]


@pytest.mark.parametrize(
    ("base", "href", "url"),
    [
        ("https://a.test/x", "http:/b.test/y", "http://b.test/y"),
        ("https://a.test/x/", "y", "https://a.test/x/y"),
        ("https://a.test/x", "//b.test/y", "https://b.test/y"),
        ("http://a.test/x", "http:/b.test/y", "http://a.test/b.test/y"),
    ],
)
def test_join(base, href, url):
    assert join(base, href) == url


def test_links_without_text_are_dropped():
    assert urls('<a href="https://far.test/"><img src="x"></a><a href="https://far.test/2">   </a>') == []


def test_section_is_the_marker_before():
    html = f'{a("https://x.test/0")}<div id="day1">Day 1</div>{a("https://x.test/1")}<strong id="day2">Lesson 2</strong>{a("https://x.test/2")}'
    assert [(r["url"][-1], r["day_context"], r["day_label"]) for r in links(html)] == [("0", None, None), ("1", "day1", "Day 1"), ("2", "day2", "Lesson 2")]


def test_week_markers_count_too():
    assert links(f'<p id="Week12">Week 12</p>{a("https://x.test/")}')[0]["day_context"] == "Week12"


def test_repeated_marker_is_not_trusted_but_a_run_is():
    one, two = a("https://x.test/1"), a("https://x.test/2")
    split = f'<p id="day1">a</p>{one}<p id="day2">b</p>{two}<p id="day1">c</p>'
    assert [r["day_context"] for r in links(split)] == [None, "day2"]
    run = f'<p id="day1">Day 1</p><p id="day1">Things</p>{one}<p id="day2">b</p>{two}'
    assert [(r["day_context"], r["day_label"]) for r in links(run)] == [("day1", "Day 1"), ("day2", "b")]


def test_marker_inside_a_marker_is_none():
    html = f'<strong id="day2"><strong id="day1">Lesson</strong> 2*</strong>{a("https://x.test/")}'
    assert [(r["day_context"], r["day_label"]) for r in links(html)] == [("day2", "Lesson 2*")]


@pytest.mark.parametrize(
    ("html", "label"),
    [
        ('<div id="day3"><p><strong>Addition</strong></p><p><strong>Lesson 3* (note)</strong></p><ol><li><strong>Lesson 9</strong></li></ol></div>', "Lesson 3*"),
        ('<div id="day3"><strong>Fractions</strong><ul><li>lesson 1</li></ul></div>', "Fractions"),
        ('<div id="day3"></div><p><strong>Day 3</strong></p>', "Day 3"),
        ('<div id="day3"></div><ol></ol><p><strong>Day 3</strong></p>', None),
        ('<div id="day3"></div><p id="day4"><strong>Day 4</strong></p>', None),
    ],
)
def test_labels(html, label):
    marker = next(n for n in parse(html).walk() if n.attributes.get("id") == "day3")
    assert section_label(marker) == label


def test_one_row_for_each_url_and_section():
    x = a("https://x.test/")
    html = f'{x}{a("https://x.test/", "again")}<p id="day1">Day 1</p>{x}{x}'
    assert [(r["ord"], r["text"], r["day_context"]) for r in links(html)] == [(0, "link", None), (1, "link", "day1")]


def test_context_is_the_prose_of_the_block():
    html = f'<p>Before   the {a("https://x.test/", "big link")} and <b>after</b>.</p><p>Other</p>'
    assert [(r["context_before"], r["context_after"]) for r in links(html)] == [("Before the", "and after.")]


def test_context_is_cut_between_words_and_may_be_missing():
    words = " ".join(f"word{k}" for k in range(30))
    row = links(f'<li>{words} {a("https://x.test/", "HERE")} {words}</li>')[0]
    assert len(row["context_before"]) <= 60 and words.endswith(row["context_before"]) and row["context_before"].startswith("word")
    assert len(row["context_after"]) <= 60 and words.startswith(row["context_after"])
    assert (links(a("https://x.test/"))[0]["context_before"], links(a("https://x.test/"))[0]["context_after"]) == (None, None)


def test_truncation():
    assert truncate_words("abc def", 7, True) == "abc def"
    assert truncate_words("abc def", 5, True) == "def"
    assert truncate_words("abc def", 5, False) == "abc"
    assert truncate_words("abcdefgh", 5, True) == "defgh"


def test_internal_links():
    html = a("/a/#x") + a("/a") + a("https://SCHOOL.test/b") + a("https://far.test/c") + a("#y") + a("/maths") + '<a href="/img"><img></a>'
    assert internal_links(parse(html), PAGE, BASE) == ["https://school.test/a", "https://SCHOOL.test/b", "https://school.test/img"]


def test_listed_pages():
    html = f'<nav>{a("/no")}</nav><div class="page entry-content"><p>{a("/c1/", "One")}{a("/c1", "Again")}{a("#m")}{a("https://far.test/")}{a("/c2", " Two ")}</p></div>'
    rows = listed_pages(html, "https://school.test/all", BASE)
    assert [(r["url"], r["title"]) for r in rows] == [("https://school.test/c1", "One"), ("https://school.test/c2", "Two")]
    assert listed_pages("<p>nothing</p>", "https://school.test/all", BASE) == []


def test_null_and_broken_pages(spark):
    from anchorage.functions.extract import extract

    rows = [(1, PAGE, None, BASE), (2, None, "<a href='https://x.test/'>x</a>", BASE), (3, PAGE, "<p><a href='https://x.test/'>x", BASE)]
    got = {r.page_id: (len(r.external), len(r.internal)) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, base_url string")).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (1, 0)}
