"""Page extraction on hand-written pages, and the classifier chain on planted words."""

from __future__ import annotations

import random
from functools import cache

import numpy as np
from pyspark.sql import functions as F

from anchorage.llm import html_text, toxicity


def page(article: str, nav: str = "Home", foot: str = "Imprint") -> str:
    return (
        f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p><p>no</p>';</script></head><body class='has-sidebar'>"
        f"<header><a href='/'>Site</a></header><nav><ul><li><a href='/x'>{nav}</a></li></ul></nav><!-- <p>no</p> -->"
        f"<div class='ad'>Buy</div><aside><p>Related</p></aside><form><label>Mail</label><input></form><article><h1>Title</h1>{article}</article>"
        f"<section id='comments'><p>First!</p></section><div class='cookie-notice'>We use cookies</div><footer>{foot}</footer></body></html>"
    )


def text(html: str) -> str:
    return "\n".join(b[0] for b in html_text.candidates(html))


def test_article_only():
    assert text(page("<p>One &amp; two</p><p>Thr<b>ee</b>  \n four<br>five</p><ul><li>six<li>seven</ul>")) == "Title\nOne & two\nThree four five\nsix\nseven"


def test_comments_inside_the_article_go():
    html = page("<p>Text</p><div class='comments'><article class='comment'><p>Spam</p></article></div><p>More</p><div class='share-buttons'>Share</div>")
    assert text(html) == "Title\nText\nMore"


def test_pages_without_an_article():
    html = "<html><body><div id='menu'><a href='/'>Home</a></div><div class='content'><p>Long text of the page.</p><p><a href='/n'>Next page here</a></p></div><div hidden>no</div></body></html>"
    assert text(html) == "Long text of the page."


def test_broken_markup():
    assert text("") == "" and text("plain < text & more") == "plain < text & more"
    assert text("<article><p>a<p><b>b<i>c</article>") == "a\nbc"
    assert text("<article><p>a</p><script>never closed <p>b</p>") == "a"
    assert text("<div><p>a</p></section></div></div><p>b &lt;p&gt; &nbsp;c&#x41;</p>") == "a\nb <p> cA"


@cache
def lcs(a: tuple, b: tuple) -> int:
    if not a or not b:
        return 0
    return lcs(a[1:], b[1:]) + 1 if a[0] == b[0] else max(lcs(a[1:], b), lcs(a, b[1:]))


def test_common_lines():
    r = random.Random(3)
    for _ in range(500):
        a, b = ([r.randrange(4) for _ in range(r.randrange(9))] for _ in range(2))
        pairs = html_text.common_lines(a, b)
        assert len(pairs) == lcs(tuple(a), tuple(b)) and all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_differencing_by_nearest_url(spark):
    def plain(k: int, host: str = "h.test", extra: str = "") -> str:
        return f"<body><p>Welcome to our site</p><p>Unique text number {k} is long enough to count as the page's own content, number {k}.</p>{extra}<p>All rights reserved</p></body>"

    rows = [(k, f"https://h.test/news/{k:02}", plain(k)) for k in range(6)]
    rows += [(20, "https://alone.test/a", plain(20)), (21, None, plain(21)), (22, "https://h.test/z", None), (23, "not a url", plain(23))]
    rows += [(30, "https://c.test/a?x=1", plain(30)), (31, "https://c.test/a?x=2", plain(30))]  # a copy
    rows += [(40, "https://d.test/1", page("<p>Shared motto</p><p>Own 1</p>")), (41, "https://d.test/2", page("<p>Shared motto</p><p>Own 2 which differs at length</p>"))]
    rows += [rows[0]]
    got = {}
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    for r in html_text.main_text(frame).collect():
        assert r.n_chars == len(r.text)
        got.setdefault(r.page_id, []).append(r.text)
    for k in range(6):
        assert set(got[k]) == {f"Unique text number {k} is long enough to count as the page's own content, number {k}."}
    assert len(got[0]) == 2 and got[22] == [""]
    for k in (20, 21, 23):
        assert got[k][0].startswith("Welcome to our site\nUnique") and got[k][0].endswith("reserved")
    assert got[30] == got[31] and got[30][0].count("\n") == 2
    assert got[40] == ["Title\nShared motto\nOwn 1"]
    assert html_text.main_text(frame.limit(0)).collect() == []


def labelled(spark, n=600):
    r = random.Random(8)
    docs, labels = [], []
    for k in range(n):
        words = [r.choice("amber birch cedar dune ember fjord grove heath".split()) + str(r.randrange(30)) for _ in range(60)]
        bad, rude = r.random() < 0.3, r.random() < 0.2
        if bad:
            words[5] = "zzjunk"
        if rude:
            words[9], words[30] = r.choice(["vilea", "vileb"]), "meanie"
        docs.append((k, " ".join(words), "en"))
        if k % 2:
            labels.append((k, int(not bad), int(rude) if r.random() > 0.03 else 1 - int(rude)))
    return spark.createDataFrame(docs, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs


def test_chain(spark):
    docs, labels, rows = labelled(spark)
    categories = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    params = toxicity.Params(max_rows=250, precision=0.8)
    chain = toxicity.train_on(docs, labels, categories, params)
    got = {r.doc_id: r for r in toxicity.predict(docs, chain, list(categories), params).collect()}
    held = [(k, t) for k, t, _ in rows if k % 2 == 0]
    assert sum(got[k].toxic == ("meanie" in t) for k, t in held) >= 0.98 * len(held)
    assert sum(got[k].low_quality == ("zzjunk" in t) for k, t in held) >= 0.98 * len(held)
    again = toxicity.train_on(docs.repartition(3), labels, categories, params)
    assert np.array_equal(chain[1].weights, again[1].weights) and chain[1].threshold == again[1].threshold
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x" * 50_000)], "doc_id long, text string")
    assert toxicity.predict(odd, chain, list(categories), params).count() == 4
    assert toxicity.predict(odd.limit(0), chain, list(categories), params).collect() == []
    none = toxicity.train_on(docs, labels.limit(0), categories, params)
    assert not any(r.toxic for r in toxicity.predict(docs, none, list(categories), params).collect())


def test_later_models_use_earlier_probabilities():
    r = np.random.default_rng(2)
    n = 400
    first = r.random(n) < 0.5
    row = np.arange(n)
    index = np.where(first, 1, 2).astype(np.int32)
    labels = np.column_stack((first, first)).astype(int)
    chain = toxicity.train(index, row, labels, toxicity.Params())
    assert chain[1].chained[0] > 0.3 and chain[0].chained.shape == (0,)


def test_threshold():
    p, y = np.array([0.9, 0.8, 0.7, 0.2]), np.array([1, 1, 0, 0])
    assert abs(toxicity.threshold(p, y, 0.99) - 0.75) < 1e-9
    assert toxicity.threshold(p, np.zeros(4), 0.5) == 1.1 and toxicity.threshold(np.zeros(0), np.zeros(0), 0.5) == 1.1
