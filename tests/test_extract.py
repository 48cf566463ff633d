import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pagegrain import schemas, storage
from pagegrain.operators import extract, selectors
from pagegrain.operators.selectors import PageReader, compile_selector
from pagegrain.operators.walk import page_addresses, walk_pages, with_html
from pagegrain.plans.jobs import scrape, scrape_site, scrape_tasks

PAGE = (
    '<div id=a class="x  y"><p>one<b>two</b></p><p class=z>three &amp; four<br>five</p>'
    '<ul><li><a href="/1">A</a><li><a href=/2>B</a></ul>'
    '<script>var x="</p>"</script><!-- c --></div><p><b>u<br><p>v'
)


def texts(selector, kind="text", attribute=""):
    page = PageReader(PAGE)
    return [page.value(e, kind, attribute) for e in page.select(compile_selector(selector))]


@pytest.mark.parametrize(
    "selector, expected",
    [
        ("div p", ["onetwo", "three & fourfive"]),
        ("div > p.z", ["three & fourfive"]),
        ("p + p", ["three & fourfive"]),
        ("p ~ ul", ["AB"]),
        ("#a b, li li", ["two", "B"]),
        ("div.x.y", ["onetwothree & fourfiveAB"]),
        ('a[href="/2"], a[href^="/"]', ["A", "B"]),
        ("[href$='1']", ["A"]),
        ("[class~=y] a[href*=2]", ["B"]),
        ("p:first-child", ["onetwo"]),
        ("p:last-child", ["uv", "v"]),
        ("p:nth-child(2)", ["three & fourfive", "uv", "v"]),
        ("script", ['var x="</p>"']),
        ("video", []),
    ],
)
def test_selectors(selector, expected):
    assert texts(selector) == expected


def test_value_kinds():
    assert texts("p.z", "html") == ['<p class="z">three &amp; four<br/>five</p>']
    assert texts("ul", "html") == ['<ul><li><a href="/1">A</a><li><a href="/2">B</a></li></li></ul>']
    assert texts("b", "innerText") == ["two", ""]
    assert texts("a", "href") == ["/1", "/2"]
    assert texts("a", "src") == ["", ""]
    assert texts("div", "attribute", "class") == ["x y"]
    assert texts("b", "no such kind") == ["two", "uv"]


@pytest.mark.parametrize("bad", ["", "p:hover", "p >", "> p", "a,,b", "p::before", "[x", "p)"])
def test_selectors_outside_the_grammar_raise(bad):
    with pytest.raises(ValueError):
        compile_selector(bad)


def test_wide_pages_take_linear_time():
    page = PageReader("<ul>" + "<li><i>x</i>" * 20000, keep_markup=False)
    assert len(page.select(compile_selector("li i"))) == 20000
    assert len(page.select(compile_selector("li > li"))) == 19999


@pytest.mark.parametrize("piece", ["<", "<a ", "<!", "&", "<p>", "</p>", '<a href="', "<?", "<br>", "<p a="])
def test_degenerate_markup_ends(piece):
    page = PageReader("<i>x</i>" + piece * 20000, keep_markup=False)
    assert [page.value(e, "text", "") for e in page.select(compile_selector("i"))] == ["x"]


def test_text_behind_the_last_tag():
    page = PageReader("<p>a &lt; b &amp; c <d")
    assert page.value(1, "text", "") == "a < b & c <d"
    raw = PageReader("<script>a &lt; b")
    assert raw.value(1, "text", "") == "a &lt; b"


def test_any_markup_gives_items_or_none():
    rng = random.Random(1)
    pieces = (
        "< > </ <! <![ <!-- --> <? ?> <p <a_href='x' <a_href=' /> </p> <br> <br/> </br> <script> </script> <![CDATA[ ]]> "
        "<!DOCTYPE_html> &amp; & &#x41; text = <textarea> <title> <pre> <template> </template> [if <![endif]>"
    ).replace("_", " ").split(" ")
    every = selectors.compile_rules(
        [{"name": kind, "selector": "*", "type": kind, "multiple": True} for kind in ("text", "html", "innerText")]
    )
    for _ in range(3000):
        markup = "".join(rng.choices(pieces, k=rng.randint(1, 12)))
        for item in selectors.read_items(markup, every):
            assert len(item["text"]) == len(item["html"]) == len(item["innerText"])


def rules(*specs):
    return [dict(zip(("name", "selector", "type", "multiple", "container"), spec)) for spec in specs]


def test_container_and_single_items(spark):
    pages = spark.createDataFrame([Row(url="u", html=PAGE), Row(url="v", html="<p>none</p>"), Row(url="w", html=None)])
    many = rules(("container", "li"), ("t", "a", "text", False), ("all", "a", "href", True))
    rows = extract.extract_records(pages, {"selectors": many}).orderBy("_item").collect()
    # The unclosed outer li holds the inner one.
    assert [(r.url, r._item, r.t, r["all"]) for r in rows] == [("u", 0, "A", ["/1", "/2"]), ("u", 1, "B", ["/2"])]
    one = rules(("t", "a", "text", False), ("missing", "video", "text", False))
    assert [(r.url, r.t, r.missing) for r in extract.extract_records(pages, {"selectors": one}).collect()] == [("u", "A", None)]
    # An empty list is a value: the record counts.
    empty = rules(("none", "video", "text", True))
    found = extract.extract_records(pages, {"selectors": empty}).orderBy("url").collect()
    assert [(r.url, r.none) for r in found] == [("u", []), ("v", [])]
    assert extract.extract_records(pages, {"selectors": []}).count() == 0
    with pytest.raises(ValueError):
        extract.extract_records(pages, {"selectors": rules(("x", "a:hover"))})


def test_container_field_sees_ancestors_outside(spark):
    pages = spark.createDataFrame([Row(url="u", html="<nav><ul><li><a>1</a></li></ul></nav><ul><li><a>2</a></li></ul>")])
    found = extract.extract_records(pages, {"selectors": rules(("container", "li"), ("t", "nav a"))}).collect()
    assert [r.t for r in found] == ["1"]


CHAIN = [
    (1, "http://a.com/p?page=1", '<i>1</i><a class=n href="?page=2">x</a>'),
    (2, "http://a.com/?page=2", '<i>2</i><a class=n href="/p/three">x</a>'),
    (3, "http://a.com/p/three", "<i>3</i><button onclick=\"location.href='/four'\">x</button>"),
    (4, "http://a.com/loop", '<i>4</i><a class=n href="http://a.com/loop">x</a>'),
    (5, "http://a.com/p/three", "<i>copy</i>"),
    (6, "http://a.com/ping", '<i>6</i><a class=n href="/pong">x</a>'),
    (7, "http://a.com/pong", '<i>7</i><a class=n href="/ping">x</a>'),
]
LINK = {"selector": "a.n", "type": "link"}


def test_walk(spark):
    pages = spark.createDataFrame(CHAIN, schemas.PAGES)
    tasks = spark.createDataFrame(
        [("t1", "http://a.com/p?page=1", 5), ("t2", "http://a.com/loop", 5), ("t3", "http://a.com/ping", 4),
         ("t4", "http://a.com/none", 5), ("t5", "http://a.com/p?page=1", 2), ("t6", "http://a.com/p?page=1", None)],
        "task_id string, url string, pages int",
    )
    assert page_addresses(pages).count() == 6
    visits = walk_pages(tasks, pages, LINK)
    seen = {}
    for row in with_html(visits, pages).orderBy("task_id", "page_no").collect():
        seen.setdefault(row.task_id, []).append(row.page_id)
    assert seen == {"t1": [1, 2, 3], "t2": [4], "t3": [6, 7, 6, 7], "t5": [1, 2], "t6": [1]}


def test_walk_with_a_rule_per_task(spark):
    pages = spark.createDataFrame(CHAIN[:6] + [(9, "http://a.com/four", "<i>4</i>"), (10, "http://a.com/p?page=7", "<i>7</i>"),
                                               (11, "http://a.com/p?page=8", "<i>8</i>")], schemas.PAGES)
    tasks = spark.createDataFrame(
        [("b", "http://a.com/p/three", 3, ("button", "button", None)), ("p", "http://a.com/p?page=7", 9, ("i", "parameter", None)),
         ("n", "http://a.com/p?page=7", 9, None)],
        "task_id string, url string, pages int, pagination struct<selector string, type string, parameter string>",
    )
    got = {(r.task_id, r.page_no, r.page_id) for r in walk_pages(tasks, pages).collect()}
    assert got == {("b", 1, 3), ("b", 2, 9), ("p", 1, 10), ("p", 2, 11), ("n", 1, 10)}


def test_scrape_tasks(spark):
    pages = spark.createDataFrame(CHAIN, schemas.PAGES)
    tasks = spark.createDataFrame([("t1", "http://a.com/p?page=1", "d", 9), ("t9", "http://a.com/ping", "d", 1)],
                                  "task_id string, url string, data_description string, pages int")
    config = [("t1", [("v", "i", "text", None, False, None, None)], ("a.n", "link", None), None)]
    catalogue = spark.createDataFrame(config, schemas.CATALOGUE)
    rows = extract.record_columns(scrape_tasks(tasks, pages, catalogue), {"v": False}).orderBy("page_no").collect()
    assert [(r.task_id, r.page_no, r.v) for r in rows] == [("t1", 1, "1"), ("t1", 2, "2"), ("t1", 3, "3")]


def test_scrape_has_no_shuffle(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    job = scrape(pages, {"selectors": rules(("title", "h1"), ("links", "nav a", "href", True))}, processed_at="x")
    plan = job._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" not in plan
    assert job.count() == pages.count()
    assert job.schema["links"].dataType.simpleString() == "string"


def test_unknown_selectors_in_a_catalogue_match_nothing(spark):
    visits = spark.createDataFrame([("t", 1), ("c", 1), ("z", 1), ("t", 2)], "task_id string, page_id bigint")
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "page_id bigint, html string")
    catalogue = spark.createDataFrame(
        [("t", [("x", "a:hover", None, None, None, None, None), ("y", "a", "href", None, True, None, None)], None, None),
         ("c", [("container", "li:hover", None, None, None, None, None), ("y", "a", "href", None, True, None, None)], None, None)],
        schemas.CATALOGUE,
    )
    rows = extract.extract_by_task(visits, pages, catalogue).collect()
    assert [(r.task_id, r.page_id, r.record) for r in rows] == [("t", 1, {"y": ["/1", "/2"]})]


def test_a_page_is_read_once_per_rule_list(spark):
    """Many tasks with the same selectors meet on one page: one markup row is parsed."""
    visits = spark.range(500).selectExpr("cast(id as string) as task_id", "cast(id div 500 + 1 as int) as page_id")
    pages = spark.createDataFrame([(1, PAGE)], "page_id int, html string")
    rule = [("y", "li a", "href", None, False, None, None)]
    catalogue = spark.createDataFrame([(str(at), rule, None, None) for at in range(500)], schemas.CATALOGUE)
    found = extract.extract_by_task(visits, pages, catalogue)
    assert found.count() == 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    below_python = plan[plan.index("ArrowEvalPython"):]
    assert "BroadcastHashJoin" in below_python.split("Exchange")[0]


def test_markup_joins_without_a_broadcast_beyond_the_limit(spark, monkeypatch):
    narrow = spark.range(100).withColumn("t", F.lit("x"))
    assert "broadcast" in storage.broadcast_if_small(narrow)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in storage.broadcast_if_small(narrow, 100)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in storage.broadcast_if_small(narrow.limit(0))._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(storage.broadcast_if_small, "__defaults__", (0, None))
    test_walk(spark)
    test_scrape_tasks(spark)


def test_scrape_site(spark):
    pages = spark.createDataFrame(CHAIN, schemas.PAGES)
    config = {"selectors": rules(("label", "i")), "pagination": LINK}
    got = scrape_site(pages, config, "http://a.com/p?page=1", 3, "now").orderBy("page_no").collect()
    assert [(r.page_no, r.page_id, r.label) for r in got] == [(1, 1, "1"), (2, 2, "2"), (3, 3, "3")]
    alone = scrape_site(pages, {"selectors": rules(("label", "i"))}, "http://a.com/p?page=1", 3)
    assert [r.label for r in alone.collect()] == ["1"]
