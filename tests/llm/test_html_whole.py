"""Pages with little text of their own, wrapped articles and long pages."""

from __future__ import annotations

import random

from anchorage.llm import html_text


def test_template_text_goes_from_short_pages_too():
    # 80 of 100 characters are shared: still two pages of one template.  Copies keep all.
    assert html_text.template_lines([1, 2], [80, 20], [True, True], [0], 80, 100) == [0]
    assert html_text.template_lines([1, 2], [80, 900], [True, True], [0], 80, 95) == [0]
    assert html_text.template_lines([1, 2], [80, 20], [True, True], [0, 1], 100, 100) == []
    # A long page beside a stub of nothing but template text.
    assert html_text.template_lines([1, 2], [80, 900], [True, True], [0], 80, 80) == [0]


def test_articles_in_named_wrappers():
    def text(html: str) -> str:
        return "\n".join(b[0] for b in html_text.candidates(html))

    for start in ("<div class='layout has-sidebar'>", '<div class="content no-sidebar">', "<section id='search-page'>"):
        assert text(f"<body>{start}<nav>Menu</nav><article><p>Whole text</p></article></section></div></body>") == "Whole text"
    assert text("<article class='post comments-open'><p>Text</p><div class='comments'><p>Spam</p></div></article>") == "Text"
    assert text("<div class='related'><article><p>Teaser</p></article></div><article><p>Whole text</p></article>") == "Whole text"
    assert text("<div class='comments'><article><p>Spam at length</p></article></div><p>Text</p>") == "Text"


def test_long_pages_are_aligned_whole(monkeypatch):
    r = random.Random(9)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randrange(30))] for _ in range(2))
        whole = html_text.common_lines(a, b)
        with monkeypatch.context() as m:
            m.setattr(html_text, "TABLE_BITS", 8)
            pairs = html_text.common_lines(a, b)
        assert len(pairs) == len(whole) and all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_repeated_lines_of_very_long_pages():
    r = random.Random(2)
    a = [1, *([5] * 10), *(r.randrange(100, 200) for _ in range(47_000)), 2]
    b = [3, *([5] * 10), *(r.randrange(300, 400) for _ in range(47_000)), 4]
    assert len(html_text.common_lines(a, b)) == 10
