import re
import itertools
import random
import time

import pytest

from tapeflow.llm import html_text
from tapeflow.llm.html_text import WEIGHTS, extract_text, fit_costs, graph, label_blocks, main_part, main_text, min_cut, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div id="cookie-notice">We use cookies</div>
<!-- <p>hidden</p> --><aside class="sidebar"><p>Side text that is long enough to look like content of the page itself</p></aside>
<article><header><h1>Head &amp; line</h1></header><p>One <b>bo</b>ld
 word&nbsp;here<br>next<p>Two &lt;three&gt; &am<div class="ad">Buy now</div><ul><li>item <a href="x>y">link</a></ul>
<form><label>Mail</label><input></form><section id="comments"><p>Reader says hello to everyone in this long comment</p></section></article>
<footer>&copy; me</footer></body></html>"""


def test_article_alone():
    assert main_text(PAGE) == "Head & line One bold word here next Two <three> &am item link"


def test_pages_without_article():
    body = "This is a paragraph with a good number of words that stands in the page as its only long text of any kind."
    page = f"<div class=menu><a href=1>Home</a></div><div><h2>Title</h2><p>{body}</p><p>{body}</p></div><div><a href=2>More</a> <a href=3>Links</a></div>"
    assert main_text(page) == f"Title {body} {body}"
    assert main_text("<p>" + body) == body
    assert html_text.MOST_DEPTH >= 100


def test_odd_pages():
    for html in ("", None, "<", "<a", "<article", "<!--", "<script>x", "</p></div>", "<article></article>", "< >", "<div class='x"):
        assert main_text(html) in ("", "<", "< >")
    assert main_text("<article><p>cut of<p>f in a ta") == "cut of f in a ta"
    assert main_text("<article>" + "<div>" * 3000 + "<p>deep words" + "</div>" * 3000) == "deep words"
    assert main_text("<article>" + "<p>word</p>" * 5000) == " ".join(["word"] * 5000)
    assert main_text("<article><p>a < b and 1 &lt 2 &#x41;&eacute;</article>") == "a < b and 1 < 2 Aé"


def test_least_cut_equals_enumeration():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 8)
        scores = [rng.randint(-6, 6) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 7)) for _ in range(2 * n)]
        cost = lambda x: sum(abs(s) for s, y in zip(scores, x) if s and (s > 0) != y) + sum(w for a, b, w in edges if x[a] != x[b])
        least = min(cost(x) for x in itertools.product((False, True), repeat=n))
        assert cost(min_cut(scores, edges)) == least


TEXT = "This is a paragraph with a good number of words that stands in the page as one of its longer texts of any kind."


def test_the_cut_overrules_texts():
    """A short paragraph has the cost of boilerplate; the article around it, or its neighbours in a plain box, save it."""
    for tag in ("article", "div"):
        page = parse(f"<nav><a href=1>Home</a></nav><{tag}><p>{TEXT}</p><p>Short.</p><p>{TEXT}</p></{tag}>")
        scores, edges = graph(page)
        labels = label_blocks(page)
        assert [b.text for b, y in zip(page.blocks, labels) if y] == [TEXT, "Short.", TEXT]
        assert scores[2] < 0 and labels[2] and edges
    assert main_text("<p>Short.</p>") == ""


def test_a_teaser_article_does_not_hide_the_text():
    page = f"<div id=a><h2>Head</h2><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></div><article><h3>Other</h3><p>A few words</p></article>"
    assert main_text(page).startswith(f"Head {TEXT} {TEXT} {TEXT}")
    assert main_text(f"<div class='has-sidebar wrapper'><article><p>{TEXT}</p><p>{TEXT}</p></article></div>") == f"{TEXT} {TEXT}"


@pytest.mark.parametrize("html", ["<div>a " * 50_000, "<div>" * 50_000 + "</x>" * 50_000, "<b>" * 30_000 + "<br>x" * 30_000, f"<div>{TEXT}" * 4000 + "<div>a " * 4000, f"<p>{TEXT}<p>a" * 4000])
def test_deep_pages_take_seconds(html):
    began = time.process_time()
    main_text(html)
    assert time.process_time() - began < 15


def test_whole_pages_equal_brute_force(spark):
    """The text of random pages is the one of the least cost among all labellings of their blocks and elements."""
    rng = random.Random(8)
    parts = ["<p>", "</p>", "<div>", "</div>", "<article>", "</article>", "<nav>", "</nav>", "<div class=ad>", "<h2>", "</h2>", "<li>", "<a href=1>", "</a>", "<b>", "<br>", "<section>", "</section>"]
    pages = []
    while len(pages) < 60:
        html = "".join(rng.choice(parts) if rng.random() < 0.7 else " ".join(["word"] * rng.choice([1, 1, 3, 9, 30])) for _ in range(14))
        page = parse(html)
        if 0 < len(page.blocks) and len(page.blocks) + len(page.parent) <= 11:
            pages.append(html)
    found = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("page_id", "'u' AS url", "html")).collect()}
    flips = 0
    for i, html in enumerate(pages):
        page = parse(html)
        scores, edges = graph(page)
        cost = lambda x: sum(abs(s) for s, y in zip(scores, x) if s and (s > 0) != y) + sum(w for a, b, w in edges if x[a] != x[b])  # noqa: E731, B023
        texts: dict[str, int] = {}
        for x in itertools.product((False, True), repeat=len(scores)):
            text = " ".join(b.text for b, y in zip(page.blocks, x) if y)
            texts[text] = min(texts.get(text, 1 << 60), cost(x))
        assert texts[found[i]] == min(texts.values())
        flips += any((s > 0) != y for s, y in zip(scores, label_blocks(page)))
    assert flips > 5


def test_fitted_weights(spark):
    """The weights are what the fit finds on pages of this kind: signs hold, and labels on other pages are the same."""
    rng = random.Random(3)
    make = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    build = lambda: f"<nav><ul>{''.join(f'<li><a href=1>{make(1)}</a></li>' for _ in range(6))}</ul></nav><div class=ad>{make(8)}</div><article><h1>{make(7)}</h1>{''.join(f'<p>{make(rng.choice([1, 9, 40, 60]))}</p>' for _ in range(9))}</article><footer>{make(9)}</footer>"
    pages = [build() for _ in range(120)]
    weights = fit_costs(spark.createDataFrame([(p,) for p in pages], "html string"), 80)
    assert weights.keys() == WEIGHTS.keys()
    assert all(weights[k] * WEIGHTS[k] > 0 for k in ("words", "links", "marked", "article", "outside"))
    for p in pages[:40]:
        page = parse(p)
        assert label_blocks(page, weights) == label_blocks(page)
    assert set(fit_costs(spark.createDataFrame([], "html string")).values()) == {0.0}


def test_table(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars", "2 AS row")
    found = sorted((tuple(r) for r in extract_text(pages).collect()), key=str)
    text = main_text(PAGE)
    assert found == sorted([(1, "u", text, len(text)), (2, None, "", 0), (None, "v", "", 0), (1, "u", text, len(text))], key=str)
    assert extract_text(pages.limit(0)).count() == 0


def unmarked(html):
    """The page with its landmark elements as plain ones, and without class names, ids and roles."""
    html = re.sub(r"<(/?)(nav|aside|header|footer|form|article|main)(?=[\s>])", r"<\1div", html)
    return re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", html)


def test_pages_without_marks():
    """What most words stand in is told from what is around it by texts, links and place alone."""
    text = ["The first paragraph has some words of its own, enough to be read.", "A second one follows it, with as many words as the first has.", "Short one.", "And the last of them ends what the article says about its matter."]
    page = "<body><nav><a href=/a>Home</a><a href=/b>News</a></nav><div class=ad>Buy this thing now, it is good.</div><article><h1>A title</h1>" + "".join(f"<p>{t}</p>" for t in text) + "</article><footer>&copy; 2024 some.example.org &middot; All of the rights are reserved here.</footer></body>"
    want = " ".join(["A title", *text])
    assert main_text(page) == want
    assert main_text(unmarked(page)) == want
    assert main_text(unmarked(f"<body><div><div>{page[6:-7]}</div></div></body>")) == want  # wrappers hold all words and say nothing


def test_texts_stay_when_marks_go():
    import pyarrow.parquet as pq

    pages = [h for h in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist() if h]
    same = [main_text(h) == main_text(unmarked(h)) for h in pages]
    assert sum(same) >= 0.9 * len(same)


def test_main_part():
    page = parse("<body><div><p>one two three</p></div><div><p>a b c d</p><section><p>e f g h i</p><p>j k l m n o p q r s t u v w</p></section></div></body>")
    words = [b.text.count(" ") + 1 for b in page.blocks]
    best = main_part(page, words)
    assert best and sum(w for w, b in zip(words, page.blocks) if b.holder in {i for i in range(len(page.parent)) if i == best or page.parent[i] == best}) == 19
    assert main_part(parse("<p>one</p><p>two</p>"), [1, 1]) == 0 and main_part(parse(""), []) == 0
