"""Blocks of odd markup, gradients of the LSTM, held-out accuracy, whole pages with known text, awkward rows."""

import html
import re

import numpy as np
import pytest
from oracle import DATA, HAVE
from pyspark.sql import functions as F

from contigbin.llm import block_lstm, html_extraction, page_layouts, queries
from contigbin.llm.html_leaves import leaves

ARTICLE = "<h1>The river in spring</h1><p>The river rose two metres in the night. Farmers moved their cattle to higher ground.</p><p>By noon the water had reached the old mill, and the road to the village was closed.</p><h2>What comes next</h2><p>More rain is expected before the week ends, the office said.</p>"
TEXT = "\n\n".join(re.sub(r"<[^>]*>", "", x) for x in re.findall(r"<(?:h1|h2|p)>.*?</(?:h1|h2|p)>", ARTICLE))
PAGES = {
    "blog": '<body class="single"><div id="masthead" class="site-header"><a href="/">My Blog</a><p>Notes on weather</p></div><div class="main-navigation"><ul><li><a href=/>Home</a></li><li><a href=/a>About me</a></li></ul></div>'
    '<div id="content"><div class="entry-content">{}</div><div id="comments" class="comments-area"><h2>2 thoughts</h2><ol class="comment-list"><li class="comment"><p>I saw the flood too. It was quite a sight.</p></li></ol>'
    '<form><label>Name</label><p>Your email will not be published.</p></form></div></div><div id="secondary" class="widget-area"><h2>Recent Posts</h2><ul><li><a href=1>Snow in May</a></li></ul></div><div class="site-footer">Proudly powered</div>',
    "news": '<body><header><h2>River Post</h2><nav><a href=/>Start</a><a href=/w>World</a></nav></header><div class="cookie-banner">We use cookies. <button>OK</button></div><main>{}<aside class="related"><h3>Related</h3><a href=/x>Older floods</a></aside></main><aside><div class="ad">Buy boats now!</div></aside><footer>Imprint</footer></body>',
    "notice": '<body><div class="alert">Our site will be down on Sunday.</div><div class="topnav"><a href=1>One</a></div><section class="story">{}</section><div class="newsletter-signup"><h3>Stay informed</h3><p>Get our weekly letter.</p></div><section id="reader-comments"><div><b>Ann</b><p>Great piece, thank you for writing it.</p></div></section></body>',
    "bare": "<body>{}</body>",
}


def test_blocks_of_odd_markup():
    of = lambda h: [b.text for b in leaves(h)]
    assert of("<p><b>one<br>two<br><p>three") == ["one two", "three"]
    assert of("a<div>b<p>c</div>d &amp; &#233;&nbsp;&eacute;x &am &unknown;") == ["a", "b", "c", "d & é éx &am &unknown;"]
    assert of("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>") == ["1", "2", "3", "4"]
    assert of("<table><tr><td>a<td>b<tr><th>c</table>d</td>") == ["a", "b", "c", "d"]
    assert of("<script>var t='</p>';</script><style>p{}</style><!-- no --><title>x</title>x<noscript>no</noscript>y<button>z</div>") == ["xy"]
    assert of("<div><select><option>no</div><p>yes") == ["yes"] and of("<p>cut <a href='x") == ["cut"]
    assert of("</div></p>stray</b>") == ["stray"] and of("") == [] == of(None) and of(" \n\t ") == []
    assert [b.link_chars for b in leaves("<p>ab<a>cd</a>e</p><p>f")] == [2, 0]


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    model = {k: v.astype(np.float64) for k, v in block_lstm.initial(6, 2, 5, 4).items()}
    x, lengths, labels = rng.standard_normal((3, 5, 6)), np.array([5, 2, 4]), (rng.random((3, 5)) > 0.5).astype(float)
    grads = block_lstm.gradients(model, x, lengths, labels)[1]
    for name, values in model.items():
        at = tuple(rng.integers(0, n) for n in values.shape)
        step, keep = 1e-2, values[at]
        values[at] = keep + step
        up = block_lstm.gradients(model, x, lengths, labels)[0]
        values[at] = keep - step
        down = block_lstm.gradients(model, x, lengths, labels)[0]
        values[at] = keep
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-4), name


def test_labels_do_not_depend_on_the_other_pages_of_a_batch():
    weights = block_lstm.initial(html_extraction.PATH + html_extraction.WORDS + html_extraction.FIGURES, 1)
    pages = [leaves(h) for h in page_layouts.pages(20, 5)] + [[]]
    together = html_extraction.label(weights, pages)
    for page, p in zip(pages, together, strict=True):
        assert html_extraction.label(weights, [page])[0] == pytest.approx(p, abs=1e-5) and len(p) == len(page)


def test_held_out_layouts():
    held = [page for page in (leaves(h, page_layouts.MARK) for h in page_layouts.pages(200, 99)) if page]
    chances = html_extraction.label(html_extraction.model(), held)
    right = [(p > 0.5) == np.array([b.mark == "1" for b in page]) for page, p in zip(held, chances, strict=True)]
    assert np.concatenate(right).mean() > 0.98 and np.mean([r.all() for r in right]) > 0.8


@pytest.mark.parametrize("name", sorted(PAGES))
def test_layouts_made_by_hand(name):
    assert html_extraction.texts(html_extraction.model(), [PAGES[name].format(ARTICLE)]) == [TEXT]


def article_text(page):
    """By regular expressions that know the supplied pages: the article's blocks."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    return "\n\n".join(x for x in (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks) if x)


@pytest.mark.skipif(not HAVE, reason="supplied tables are absent")
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_gives_the_articles_of_the_supplied_pages(spark, sf):
    folder = DATA.replace("sf0.001", sf)
    rows = queries.op13_html_extraction(spark, folder).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    assert {r["page_id"]: r["text"] for r in rows} == {k: article_text(r["html"]) for k, r in pages.items()}
    assert all(r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"] for r in rows) and len(rows) == len(pages)


def test_awkward_rows(spark):
    page = PAGES["news"].format(ARTICLE)
    long = PAGES["news"].format("<h1>Long</h1>" + "<p>The water rose again, and the old mill stood in it.</p>" * 6_000)
    rows = [(1, page), (1, page), (None, page), (2, None), (3, ""), (4, "   "), (5, "<html><nav><a>x</a></nav>"), (6, long)]
    df = spark.createDataFrame(rows, "page_id long, html string").repartition(4).withColumns({c: F.lit("own") for c in ("text", "n_chars", "row", "a.b", "url")})
    got = html_extraction.extract(df)
    assert set(got.columns) == set(df.columns) and [r["a.b"] for r in got.select("`a.b`").collect()] == ["own"] * 8
    texts = sorted((str(r["page_id"]), r["text"]) for r in got.collect())
    want = "\n\n".join(["Long", *["The water rose again, and the old mill stood in it."] * 6_000])
    assert texts == [("1", TEXT), ("1", TEXT), ("2", ""), ("3", ""), ("4", ""), ("5", ""), ("6", want), ("None", TEXT)]
    assert html_extraction.extract(df.limit(0)).count() == 0
