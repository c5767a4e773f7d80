import re
import time

import pyarrow.parquet as pq
import pytest
from textweave.llm.text_density import FORMATS, Node, Page, block_text, composite_density, extract, main_text, measure, without_marked

ARTICLE = "<h1>Title</h1><p>First   paragraph of the &amp; article, long enough to count.<p>Second <b>bo</b>ld paragraph<br>after a break."
TEXT = "Title First paragraph of the & article, long enough to count. Second bold paragraph after a break."


@pytest.mark.parametrize(
    "html",
    [
        f"<html><body><nav><a href=x>Home</a></nav><article>{ARTICLE}</article><footer>&copy; me</footer></body></html>",
        f"<body><div class='site-header'>Logo words here</div><div id=main-text>{ARTICLE}</div><div class=comments><p>I disagree with every word of this article.</p></div>",
        f"<body><form><p>Your name and a long explanation of why we ask</form><div>{ARTICLE}</div><aside>More stories</aside><div class='cookie-notice'>We use cookies, lots of them</div>",
        f"<head><title>No</title><script>var t='</p>';</script></head><body><div>{ARTICLE}<div class='ad'>Buy now</div></div><ul class=menu><li><a>One</a><li><a>Two</a></ul>",
        f"<main><header>Top</header>{ARTICLE}<noscript>Enable scripts</noscript><style>p{{}}</style></main>".replace("<main><header>Top</header>", "<header>Top</header><main>"),
    ],
)
def test_article_without_the_rest(html):
    assert main_text(html) == TEXT


def test_sections_above_the_threshold_all_count():
    para = "<p>" + "many words of running text " * 5
    html = f"<body><div><section>{para}{para}</section><section>{para}</section></div><div class=sidebar>links</div>"
    assert main_text(html).count("running") == 15


@pytest.mark.parametrize("html", ["", "<", "<p", "</p></div>", "<script>never closed", "<!-- open", "<body></body>", "<a href=x>only a link</a>" * 0])
def test_broken_or_empty_pages(html):
    assert isinstance(main_text(html), str)


def test_deep_and_long_pages():
    assert main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert len(main_text("<body><article><p>" + "word " * 300_000)) == 5 * 300_000 - 1


def test_density_falls_with_links():
    assert composite_density(100, 2, 0, 0, 0.1) > composite_density(100, 2, 60, 1, 0.1)
    assert composite_density(0, 5, 0, 0, 0.0) == 0.0


def test_table(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", f"<article>{ARTICLE}</article>", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted(map(tuple, extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (2, None, "", 0), (None, "v", "", 0)], key=str)
    assert extract(pages.limit(0)).count() == 0


PARAS = "<p>" + "many words of running text " * 5 + "<p>" + "more words of running text " * 5


@pytest.mark.parametrize(
    "html",
    [
        f"<body><p class=notice>Our shop moved{PARAS}",
        f"<body><div><ul><li class=ad>Buy<li>one</ul>{PARAS}</div>",
        f"<body><ul><li class=ad>Buy<li>{PARAS}</ul>",
        f"<table><tr><td class=sidebar>menu<td>{PARAS}</table>",
        f"<table><tr class=ad><td>Buy<tr><td>{PARAS}</table>",
        f"<body><div><span class=ad>Buy</div><div>{PARAS}</div>",
        f"<head><title>No</title><div>{PARAS}</div>",
    ],
)
def test_dropped_parts_end_like_others(html):
    text = main_text(html)
    assert text.count("running") == 10 and "Buy" not in text and "menu" not in text and "shop" not in text


@pytest.mark.parametrize("name", ["class='content no-sidebar'", "class='layout with-sidebar'", "class=has-header", "class=search-results", "id=legal-news"])
def test_a_marked_wrapper_keeps_its_article(name):
    for article in (PARAS, f"<h1>Title</h1>{PARAS}", f"<article>{PARAS}</article>"):
        text = main_text(f"<body><div class=ad>Buy now</div><div {name}>{article}<div class=comments>I disagree</div></div><div class=footer>me</div>")
        assert text.count("running") == 10 and "Buy" not in text and "disagree" not in text
    assert "disagree" not in main_text(f"<body><div><h1>Title</h1>{PARAS}</div><div class=comments>{'<p>I disagree with all of it' * 20}</div>")


def plain_measure(node, share):
    """``(chars, tags, link_chars, link_tags, density, sum of the densities below)`` by the definitions, top down."""
    below = [plain_measure(i, share) for i in node.items if type(i) is Node]
    texts = [len(re.sub(r"\s", "", i)) for i in node.items if type(i) is str]
    chars = sum(texts) + sum(b[0] for b in below)
    tags = node.breaks + sum(b[1] for b in below) + sum(i.tag not in FORMATS for i in node.items if type(i) is Node)
    links = (chars, tags + 1) if node.tag == "a" else (sum(b[2] for b in below), sum(b[3] for b in below))
    density = composite_density(chars, tags, *links, share)
    total = sum(b[4] for b in below) + sum(composite_density(n, 1, 0, 0, share) for n in texts if node.tag != "a")
    return chars, tags, *links, density, total


def test_all_pages_by_density_give_their_article():
    """The parts that densities choose are the whole article of every given page; counts as by a second implementation."""
    for html in pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist():
        body = Page(html).body
        without_marked(body)
        nodes = measure(body)
        share = body.link_chars / max(body.chars, 1)
        for n in nodes:
            assert (n.chars, n.tags, n.link_chars, n.link_tags, n.density, n.total) == pytest.approx(plain_measure(n, share))
        article = next(n for n in nodes if n.tag == "article")
        assert main_text(html) == block_text(article)


def test_the_tag_alone_does_not_choose():
    linked = "<p><a href=x>Read this other story of ours</a></p>"
    text = main_text(f"<body><main><div><h1>A title</h1>{PARAS}</div><section>{linked * 9}</section></main>")
    assert text.count("running") == 10 and text.startswith("A title") and "story" not in text
    without = main_text(f"<body><div><h1>A title</h1>{PARAS}</div><article>short words</article>")
    assert without.count("running") == 10


def test_headings_and_loose_text_beside_the_heart():
    assert main_text(f"<body><h1>T</h1>Loose sentence<div>{PARAS}</div>").startswith("T Loose sentence many words")
    assert main_text(f"<body>Skip to content<div>{PARAS}</div>").startswith("many words")
    loose = "a long sentence that stands between the parts of a page " * 5
    assert loose.strip() in main_text(f"<body><div>{PARAS}</div>{loose}<div>{PARAS}</div>")


@pytest.mark.parametrize("html", ["<div>{0}</span></body>{1}", "<p><section>{0}<i></p>{1}", "<b><table>{0}</b></li>{1}"])
def test_broken_levels_in_linear_time(html):
    opened, closed = html.split("{0}")[0], html.split("{0}")[1].split("{1}")[0]
    begun = time.process_time()
    main_text(opened * 16_000 + "deep" + closed * 16_000)
    assert time.process_time() - begun < 4
