"""The block labeller on generated pages it has not seen, on the pages' own structure, and on odd rows."""

import html
import random
import re
import time

import numpy as np

from prefmill.llm import htmltext as H


def test_held_out_accuracy():
    r = random.Random(99)
    made = [x for x in (H.made_page(r) for _ in range(300)) if x[0]]
    p = H.labeller().probabilities(H.Features([x[0] for x in made]))
    assert ((p > 0.5) == np.concatenate([x[1] for x in made])).mean() > 0.99


def test_gradient():
    """Back-propagation against a difference quotient."""
    r = random.Random(1)
    pages, labels = zip(*[x for x in (H.made_page(r) for _ in range(4)) if x[0]], strict=True)
    m = H.Labeller(3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    f, y = H.Features(list(pages)), np.concatenate(labels)
    before = {k: v.copy() for k, v in m.p.items()}

    def loss():
        q = m.probabilities(f).astype(np.float64)
        return -np.mean(np.log(np.where(y == 1, q, 1 - q)))

    start = loss()
    m.train(list(pages), list(labels), epochs=3, rate=0.01)
    assert loss() < start
    assert any((m.p[k] != before[k]).any() for k in m.p)


def test_pages(spark):
    def want(x):
        body = re.search(r"<article>(.*?)</article>", x, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", s.replace("<br>", " "))).split()) for s in re.split(r"</?(?:h1|p)[^>]*>", body)]
        return "\n".join(p for p in parts if p)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.extract_text(pages).collect()}
    assert {k: r.text for k, r in got.items()} == {r.page_id: want(r.html) for r in pages.collect()}
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_odd_rows(spark):
    rows = [(1, "u", None, "a"), (None, None, "", None), (2, "u", "<article><p>Tom &amp; Ann said so.</p><!-- open", "b"), (2, "u", "<p", "b"), (3, "u", "<script>var a=1", "b"), (4, "u", "</div></p>" * 50, "b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = H.extract_text(df).collect()
    assert len(out) == 6 and all(r.text is not None and r.n_chars == len(r.text) for r in out)
    assert [r.text for r in out if r.page_id == 3] == [""]
    assert H.extract_text(df.limit(0)).count() == 0


def test_blocks():
    found = H.blocks_of("<body><nav><a href=/x>One</a></nav><p>A  <b>b</b>&nbsp;c<br>d<p>e</body>")
    assert [b[1] for b in found] == ["One", "A b c d", "e"]
    assert found[0][2] == 1.0 and found[1][2] == 0.0


def texts(page):
    return [b[1] for b in H.blocks_of(page)]


def test_head_without_end_tag(spark):
    page = "<!DOCTYPE html><html><head><meta charset=utf-8><title>x</title><style>p{}</style>%s<body><article><h1>A heading here</h1><p>One sentence of the article, long enough.</article>"
    assert texts(page % "") == texts(page % "</head>") == ["A heading here", "One sentence of the article, long enough."]
    assert texts("<html><head><title>x</title><p>a<p>b") == ["a", "b"] and texts("<head><title>x</title> some <b>text</b>") == ["some text"]
    assert texts("<html><header><p>Top</p></header><body><p>a</body>") == ["Top", "a"]
    df = spark.createDataFrame([(1, "u", page % ""), (2, "u", page % "</head>")], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in H.extract_text(df).collect()}
    assert out[1] == out[2] and "One sentence" in out[1]


def test_skipped_elements_end_where_they_end():
    for odd in ("<svg width=1 />", "<math/>", "<select>", "<button>", "<object data=x>", "<SVG class='a>b'/>", "<svg><title/><path/></svg>", "<canvas><button>", "<svg><g>", "<template>"):
        assert texts(f"<div><p>a</p>{odd}</div><p>b</p><{odd[1:4]}x>") == ["a", "b"], odd
    assert texts("<article><p>a</p><svg/><p>b</p><svg><p>c</p><button><p>d</p></article>") == ["a", "b", "c", "d"]
    assert texts("<p>a</p><title-box>b</title-box><object-view>c</object-view>") == ["a", "b", "c"]
    assert texts("<p>a<template>no<template>no</template>no</template>b<script>if (a < '<p>') x</script >c<svg><style>no</style><title>no</title><text>d</text></svg>e") == ["a", "bcde"]
    assert texts("<p>So <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds.<noscript><p>b</p></noscript>") == ["So E=m holds.", "b"]
    assert texts("<select><option>no</select><p>a<iframe><p>no</iframe>b<xmp><p></xmp>") == ["ab<p>"]
    for raw in ("script", "style", "textarea", "title"):
        assert texts(f"<p>a</p><{raw}>no<p>no") == ["a"]


def test_stray_quotes_and_brackets():
    assert texts("<p title=it's>a</p><p title=\"x\"y\">b</p><p class='a>b'>c</p><p/ x = y >d</p><p =x>e") == ["a", "b", "c", "d", "e"]
    assert texts("a < b <3 c</>d<!-->e<!--->f<!x>g<?y?>h<a href=/x/>i</a>") == ["a < b <3 cdefghi"]
    assert texts("<p>a<b class=\"x") == ["a"] and texts("<p>a</p x='>'>b") == ["a", "b"]


def test_linear_time():
    for part in ("<a", "<a ", "<a b=", "<a b='", '<a b="', "</", "<!", "<!--", "<p>", "</p>", "<div>x", "<svg>", "</x>", "<a =", "<p a=b/ ", " <", "<title>", "<b><p></i>"):
        page = part * (1_000_000 // len(part))
        for html_text in (page, page + ">"):
            t = time.time()
            H.blocks_of(html_text)
            assert time.time() - t < 10, part
    t = time.time()
    assert H.blocks_of("<a" * 500_000) == [] and time.time() - t < 1
    assert len(H.blocks_of("<div>" * 50_000 + "x" + "</div>" * 50_000 + "<p>y")) == 2
