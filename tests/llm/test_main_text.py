import html as entities
import re

import pytest

from pagegrain.llm.main_text import extract, main_text
from pagegrain.llm.queries import op5_main_text

P = "Words of a paragraph, with commas, and some length to it so that it scores well."


def plain(markup):
    """For the table's template only: blocks of the one article element."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", markup or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", body[1]) if body else []
    blocks = [" ".join(entities.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


def test_query_equals_plain_reading_of_the_template(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op5_main_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == plain(pages[r["page_id"]]["html"])
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


@pytest.mark.parametrize(
    "junk",
    [
        f"<nav><p>{P}</p></nav>",
        f"<header><h2>Site</h2><p>{P}</p></header>",
        f"<footer>{P}</footer>",
        f"<aside><p>{P}</p></aside>",
        f"<div class='sidebar left'><p>{P}</p></div>",
        f"<div id=cookie-notice><p>{P}</p></div>",
        f"<div class='ad'>{P}</div>",
        f"<form><p>{P}</p><input><button>Go</button></form>",
        f"<section id='comments'><article><p>{P}</p></article><p>{P}</p></section>",
        f"<div role='navigation'><p>{P}</p></div>",
        "<script>var a = '<p>not, this, text</p>';</script><style>p{}</style><!-- <p>nor this</p> -->",
        "<ul class=links>" + "".join(f"<li><a href=/{i}>A link, of some length, to a page</a></li>" for i in range(30)) + "</ul>",
    ],
)
@pytest.mark.parametrize("shape", ["<article><h1>Title</h1><p>{0}</p><p>{1}</p></article>", "<div class=content><h1>Title</h1><p>{0}</p><p>{1}</p></div>", "<div><div><h1>Title</h1><p>{0}<p>{1}</div></div>"])
def test_junk_around_the_article_goes(junk, shape):
    body = shape.format(P, P[::-1])
    want = f"Title\n{P}\n{P[::-1]}"
    assert main_text(f"<html><body>{junk}{body}</body></html>") == want
    assert main_text(f"<html><body>{body}{junk}") == want


@pytest.mark.parametrize(
    "shape",
    [
        "<div class='wrapper has-sidebar'><article><h1>Title</h1><p>{0}</p><p>{1}</p></article></div>",
        "<div class='container no-sidebar'><div class='post hentry comments-open'><h1>Title</h1><p>{0}</p><p>{1}</p></div></div>",
        "<div class='layout sidebar-right'><article><h1>Title</h1><p>{0}</p><p>{1}</p></article><div class=sidebar><p>" + P + "</p></div></div>",
        "<div id=header-layout><div><h1>Title</h1><p>{0}</p><p>{1}</p><p>{1}</p></div></div>",
        "<div class=page><div class='article-header'><h1>Title</h1></div><p>{0}</p><p>{1}</p></div>",
        "<article><div class='page-header'><h1>Title</h1></div><p>{0}</p><section class='related-work'><p>{1}</p></section></article>",
        "<div class=content><header class=entry-header><h1>Title</h1></header><p>{0}</p><p>{1}</p></div>",
        "<div class=content><h1>Title</h1><p>{0}</p><p>{1}</p></div><div id=comments>" + f"<article><p>{P}</p></article>" * 9 + "</div>",
    ],
)
def test_names_of_wrappers_and_headings_drop_no_text(shape):
    first, second = P + " " + P, P[::-1] + " " + P
    want = ["Title", first, second, second] if "header-layout" in shape else ["Title", first, second]
    assert main_text(f"<html><body><nav>menu</nav><div class=ad>{P}</div>{shape.format(first, second)}<div class='related'><p>{P}</p></div></body></html>") == "\n".join(want)


@pytest.mark.parametrize(
    "page",
    [
        "<body><form id='aspnetForm' action='/x'><input type=hidden value=1><div class=menu>menu</div><article>{}</article><div class=footer>foot</div></form></body>",
        "<body><form id='aspnetForm'><div id=content>{}</div></form></body>",
        "<body><form><div><div>{}</div></div><button>Go</button></form></body>",
        "<main><fieldset>{}</fieldset></main>",
        "<body><div role=form><article>{}</article></div></body>",
        "<dialog open><article>{}</article></dialog>",
        "<body><form><table><tr><td>{}</td></tr></table></form><form><p>Your name</p><input></form></body>",
        "<body><form><article>{}</article><section id=comments>" + f"<p>{P}</p>" * 9 + "</section></form></body>",
    ],
)
def test_pages_wrapped_in_forms_keep_their_text(page):
    paragraphs = [f"{n} {P}" for n in range(6)]
    assert main_text(page.format("".join(f"<p>{p}</p>" for p in paragraphs))) == "\n".join(paragraphs)


def test_formulas_stay_in_their_paragraph():
    formula = "<math><semantics><mrow><mi>x</mi><mo>=</mo><msup><mi>y</mi><mn>2</mn></msup></mrow><annotation encoding='application/x-tex'>x=y^2</annotation></semantics></math>"
    assert main_text(f"<article><p>{P} Here {formula} holds.</p><p>{P}</p></article>") == f"{P} Here x=y2 holds.\n{P}"


def test_many_suspects_within_each_other():
    deep = "<div class=sidebar>" * 20_000 + f"<p>{P * 4}</p>" + "</div>" * 20_000
    assert main_text(deep) == P * 4


def test_blocks_references_and_white_space():
    page = "<article><p>a &amp; b&nbsp;\n c &lt;i&gt; &#233; <b>bold</b>text<br>next</p>loose <i>text</i><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>"
    assert main_text(page) == "a & b c <i> é boldtext next\nloose text\none\ntwo\nx\ny"


def test_sections_and_siblings_stay():
    page = f"<article><h1>T</h1><section><p>{P}</p><p>{P}</p></section><section><p>{P}</p></section><p>end</p></article>"
    assert main_text(page) == "\n".join(["T", P, P, P, "end"])


def test_odd_pages():
    assert main_text(None) == "" == main_text("") == main_text("<html><nav>menu</nav></html>")
    assert main_text("just text, no markup") == "just text, no markup"
    assert main_text("<p>unfinished <a href=") == "unfinished"
    assert main_text('<p title="a > b">kept</p>') == "kept"
    assert main_text("<p>a < b and c</p>") == "a < b and c"
    assert main_text("</div></p><p>x</p></body>") == "x"
    deep = "<div>" * 20_000 + f"<p>{P}</p>" + "</div>" * 20_000
    assert main_text(deep) == P
    long = "<article>" + f"<p>{P}</p>" * 20_000 + "</article>"
    assert len(main_text(long).split("\n")) == 20_000
    assert main_text("<b>" * 50_000 + "x" + "<p>" * 2000 + "y") == "x\ny"


def test_rows(spark):
    rows = [(1, "u", "<p>x</p>", "t"), (1, "u", "<p>x</p>", "t"), (None, None, None, None)]
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in out) == [(0, ""), (1, "x"), (1, "x")]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
