"""Main texts: what names and recurring parts may take away, importances by hand, costs; personal data: whole words as context."""

import math
import time

import pytest
from pyspark.sql import functions as F

from sensorloom.llm import html_extract, pii
from tests.llm.test_operators import docs

NAMES = [
    ("<article><p class='menu'>the menu was long</p></article>", "the menu was long"), ("<article><h2 class='banner'>t</h2><p id='ad'>p</p></article>", "t p"),
    ("<article><section id='related-work'><p>earlier work</p></section><p>x</p></article>", "earlier work x"), ("<article><div class='alert-systems'>on alarms</div><p>x</p></article>", "on alarms x"),
    ("<article><p>a</p><div class='social-history'><p>real article text</p></div></article>", "a real article text"), ("<article><p>a</p><div class='menu-planning'>b</div></article>", "a b"),
    ("<article><p>a</p><div class='related-posts'>b</div><div class='share-bar'>c</div><div class='newsletterSignup'>d</div></article>", "a"), ("<article><p>a</p><div class='social'>b</div></article>", "a"),
    ("<article><div class='menu'><p>only this</p></div></article>", "only this"), ("<article><p>a</p><div class='comments'>b</div><div id='comment-list'>c</div></article>", "a"),
    ("<article><div class='comments'>b</div></article>", ""), ("<div class='related-work'>b</div><p>a</p>", "a"), ("<main><div class='widget alarm-widget'>c</div><p>a</p></main>", "a"),
]


@pytest.mark.parametrize("source,want", NAMES)
def test_names_inside_of_articles(source, want):
    assert html_extract.main_text(source) == want


def pages(spark, texts):
    return spark.createDataFrame([(i, f"http://h/{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string")


def test_recurring_headings_stay_over_their_text(spark):
    shell = "<body><article><h1>Soup {0}</h1><h2>Ingredients</h2><ul><li>leek {0}</li></ul><h2>Method</h2><p>cook {0} hours</p>{1}</article></body>"
    tail = "<h3>Read on</h3><div class='z'><p>Our guide to soups</p></div>"
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, [shell.format(i, tail) for i in range(12)])).collect()}
    assert all(t == f"Soup {i} Ingredients leek {i} Method cook {i} hours" for i, t in got.items())


def test_held_headings():
    page = lambda source, low: html_extract.Page(source, low)
    path = lambda *styles: __import__("functools").reduce(html_extract._path, styles, 0)
    low = {path("article", "h2"), path("article", "div.x")}
    assert page("<article><h2>a</h2><h2>b</h2><p>c</p><h2>d</h2></article><p>e</p>", low).text() == "b c"
    assert page("<article><h2>a</h2><div class=x>gone</div><p>c</p></article>", low).text() == "c"
    assert page("<article><section><h2>a</h2></section><p>c</p></article>", {path("article", "section", "h2")}).text() == "c"
    assert page("<article><h2>a <b>bold</b></h2><p>c</p></article>", low).text() == "a bold c"


def importances(texts):
    """Composite importance of every node on enough pages, from entropies over the pages."""
    seen = {}
    for t in texts:
        for path, kind, feature in html_extract.Page(t, tree=True).nodes:
            seen.setdefault((path, kind), []).append(feature)
    out = {}
    for path in {p for p, _ in seen}:
        shown, said = seen[path, 0], seen.get((path, 1), [])
        m = len(shown)
        if m < html_extract.LEAST_PAGES or not said:
            continue
        share = [shown.count(f) / m for f in set(shown)]
        presentation = -sum(p * math.log(p, m) for p in share)
        content = 1 - sum(math.log(said.count(f), m) for f in said) / len(said)
        g = html_extract.ATTENUATION ** (len(share) if len(share) > 1 else 0)
        out[path] = (1 - g) * presentation + g * content
    return out


def test_importances_by_hand(spark):
    """Branches shared by all, most, half and few pages, and one whose shape varies."""
    part = lambda i, n, c, text: f"<div class='{c}'><p>{text if i % n else f'own {i}'}</p></div>"
    texts = [
        "<body>" + part(i, 100, "a", "on all") + part(i, 7, "b", "on most") + part(i, 2, "c", "on half") + f"<div class='d'>{'<i>x</i><b>y</b>' * (i % 4)}</div><p>story {i}</p></body>" for i in range(1, 29)
    ]
    want = importances(texts)
    low = {p for p, v in want.items() if v < html_extract.THRESHOLD}
    assert len(low) >= 3 and len(want) > len(low) + 3 and min(abs(v - html_extract.THRESHOLD) for v in want.values()) > 1e-6
    found = html_extract.unimportant(pages(spark, texts).selectExpr("'h' host", "html")).collect()
    assert [r.host for r in found] == ["h"] and {p + (1 << 63) for p in found[0].removed} == low


@pytest.mark.parametrize("source", ["<p>" + "<b>x</i>" * 60_000, "<p>" + "<b>x" * 60_000 + "</i>" * 60_000, "<div>" * 30_000 + "</p>" * 30_000, "<article>" + "<h2>a" * 20_000])
def test_time_is_linear(source):
    began = time.time()
    html_extract.main_text(source)
    assert time.time() - began < 10


@pytest.mark.parametrize("k", [5, 70, 500])
def test_context_is_the_whole_word(spark, k):
    """Words that only differ beyond any window of characters are different words."""
    word = lambda c: c * 4 + "k" * k
    rows = [(i, f"so {word('a')} user{i}@mail.org and more of it") for i in range(40)]
    rows += [(100, f"so {word('a')} thing@localhost then"), (101, f"so {word('b')} thing2@localhost then"), (102, f"so {'x' * k} {word('a')}   thing3@localhost")]
    got = {r.doc_id: r.spans for r in pii.find(docs(spark, rows)).collect() if r.doc_id >= 100}
    at = 3 + 4 + k + 1
    assert got == {100: f"email:{at}:{at + 15}", 101: "", 102: f"email:{at + k + 3}:{at + k + 3 + 16}"}


@pytest.mark.parametrize("gap,before,after", [
    ("", "", ""), ("word", "word", ""), ("a b ", "b", ""), (" a b", "b", "a"), (", a.", "a.", "a."), (" " * 100 + "far" + " " * 100, "far", "far"), ("x" * 200, "x" * 200, ""),
    (" " + "y" * 200 + " z", "z", "y" * 200), ("q " + "y" * 200, "y" * 200, ""), (")" * 90 + " w", "w", "w"), ("\t\n ", "", ""), ("é" * 63 + " " + "b" * 64, "b" * 64, ""),
])
def test_words_beside_a_gap(spark, gap, before, after):
    df = spark.createDataFrame([(gap,)], "g string")
    assert tuple(df.select(pii._word_before(F.col("g")), pii._word_after(F.col("g"))).first()) == (before, after)
