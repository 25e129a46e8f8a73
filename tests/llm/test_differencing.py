"""Differencing against a plain version: every pair of a host's pages, a table of lengths, no markup but paragraphs."""

from __future__ import annotations

import random

from anchorage.llm import html_text


def closest(k: int, paths: list[str]) -> list[int]:
    """Neighbours of a page in the order of paths, the nearer first."""
    order = sorted(range(len(paths)), key=lambda i: paths[i])
    at = order.index(k)
    beside = [order[i] for i in (at - 1, at + 1) if 0 <= i < len(order)]

    def near(other: int) -> tuple:
        a, b = paths[k].split("/"), paths[other].split("/")
        segments = 0
        while segments < min(len(a), len(b)) and a[segments] == b[segments]:
            segments += 1
        letters = 0
        while letters < min(len(paths[k]), len(paths[other])) and paths[k][letters] == paths[other][letters]:
            letters += 1
        return segments, letters, -beside.index(other)

    return sorted(beside, key=near, reverse=True)


def shared(a: list[str], b: list[str]) -> set[int]:
    """Places of ``a`` in a longest common subsequence; lines come once in a page."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = set()
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def site(r: random.Random, host: str, n: int) -> list[tuple[str, list[str]]]:
    """Pages of a few templates; template lines keep their order and some are missing."""
    templates = [[f"{host} template {t} line {k}" for k in range(6)] for t in range(2)]
    out = []
    for k in range(n):
        t = r.randrange(2)
        own = [f"{host} page {k} says {r.randrange(10**9)} at some length, with words of its own" for _ in range(r.randrange(2, 6))]
        top, bottom = ([x for x in part if r.random() < 0.8] for part in (templates[t][:3], templates[t][3:]))
        out.append((f"/t{t}/{r.randrange(3)}/{k:03}", top + own + bottom))
    return out


def test_against_a_plain_version(spark):
    r = random.Random(7)
    rows, expected = [], {}
    for h in range(4):
        pages = site(r, f"h{h}", 12)
        paths = [p for p, _ in pages]
        for k, (path, lines) in enumerate(pages):
            page_id = 100 * h + k
            rows.append((page_id, f"https://h{h}.test{path}", "<body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>"))
            other = pages[closest(k, paths)[0]][1]
            gone = shared(lines, other)
            expected[page_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {x.page_id: x.text for x in html_text.main_text(frame).collect()}
    assert got == expected
    assert sum(t.count("template") for t in got.values()) < sum(x.count("template") for _, _, x in rows) / 3
    lost = {x.page_key: x.deleted for x in html_text.neighbours(frame).collect()}
    assert len(lost) == len(rows) and all(lost.values())


def test_lines_that_markup_names_are_aligned_too(spark):
    def page(k: int) -> str:
        return (
            f"<body><nav><a href='/'>Home</a></nav><div class='ad'>Offer {k}</div><article><h1>Title {k}</h1><p>Shared motto of the house</p>"
            f"<p>Text {k}</p></article><footer>Imprint</footer></body>"
        )

    frame = spark.createDataFrame([(k, f"https://s.test/{k}", page(k)) for k in range(3)], "page_id long, url string, html string")
    for x in html_text.neighbours(frame).collect():
        assert (x.n_lines, sorted(x.deleted), x.kept) == (6, [0, 5], [False, False, True, True, True, False])
    assert {x.page_id: x.text for x in html_text.main_text(frame).collect()} == {k: f"Title {k}\nShared motto of the house\nText {k}" for k in range(3)}


def test_a_copy_is_passed_over(spark):
    def page(own: str) -> str:
        return f"<body><p>Welcome to the site of many pages</p><p>{own}</p><p>All rights reserved</p></body>"

    one, other = "The first text is long and has its own words from end to end", "Another text with entirely different contents, as long"
    rows = [(1, "https://c.test/a/1", page(other)), (2, "https://c.test/a/b/2", page(one)), (3, "https://c.test/a/b/3", page(one))]
    got = {x.page_id: x.text for x in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == other and got[2] == one


def test_clashing_columns_and_nulls(spark):
    schema = "page_id long, url string, html string, lines string, rank string, deleted string, page_key string, host string, part int, kept string"
    rows = [(1, "https://k.test/1", "<p>a</p>", "x", "x", "x", "x", "x", 1, "x"), (None, None, None, None, None, None, None, None, None, None), (2, "", "", "", "", "", "", "", 0, "")]
    got = html_text.main_text(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert {(x.page_id, x.url, x.text, x.n_chars) for x in got.collect()} == {(1, "https://k.test/1", "a", 1), (None, None, "", 0), (2, "", "", 0)}
