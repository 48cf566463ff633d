"""Set join, doubled walk, snapshots, records without a schema, SQL function, map merge, wider selectors."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pagegrain import schemas
from pagegrain.operators import catalogue, records, selectors, set_join, walk
from pagegrain.sources import ragged, snapshots, table_function, writers


# -- selectors ---------------------------------------------------------------------------

PAGE = """<main id=m><p class="a x">1</p><div lang="en-US"><p>2</p><span>s</span><p class="b">3<b>k</b></p></div>
<p class=x>4</p><ul><li>u1<li>u2</ul><i></i></main>"""


@pytest.mark.parametrize(
    "selector, expected",
    [
        ("p:not(.x)", ["2", "3k"]), ("p:not(.x, .b)", ["2"]), ("p:not(div > p)", ["1", "4"]), ("p:not(:not(.x))", ["1", "4"]),
        ("p:nth-of-type(2)", ["3k", "4"]), ("p:nth-of-type(odd)", ["1", "2"]), ("p:nth-child(2n+1)", ["1", "2", "3k", "4"]),
        ("main > :nth-child(-n+2)", ["1", "2s3k"]), ("p:nth-last-child(1)", ["3k"]), ("p:nth-last-of-type(2)", ["1", "2"]),
        ("p:first-of-type", ["1", "2"]), ("p:last-of-type", ["3k", "4"]), ("b:only-child", ["k"]), ("span:only-of-type", ["s"]),
        ("div:has(b)", ["2s3k"]), ("p:has(> b)", ["3k"]), ("main:has(div p > b) > p.x", ["1", "4"]), ("p:has(+ span)", ["2"]), ("p:has(~ ul)", ["1", "4"]),
        ("div:has(ul)", []), ("[lang|=en]", ["2s3k"]), ('[LANG="EN-us" i]', ["2s3k"]), ("[class=X i]", ["4"]), ("p:is(.a, .b)", ["1", "3k"]),
        ("i:empty", [""]), ("main:root > p.x", ["1", "4"]), ("p:where(.b) > b", ["k"]), ("p:nth-child( 2N - 1 ):not(.a)", ["2", "3k", "4"]),
    ],
)
def test_wider_selectors(selector, expected):
    page = selectors.PageReader(PAGE)
    found = ["".join(page.value(e, "text", "").split()) for e in page.select(selectors.compile_selector(selector))]
    assert found == expected


@pytest.mark.parametrize("bad", ["p:hover", "p::before", "p:not(", "p:not()", "p:nth-child(x)", "p:has(> )", "p)", "a,", "", "p:nth-child(2 of .x)", "> p", "p:not(> a)"])
def test_outside_the_grammar(bad):
    with pytest.raises(ValueError):
        selectors.compile_selector(bad)


def test_wider_selectors_are_linear_in_the_page():
    def seconds(n):
        page = selectors.PageReader("<ul>" + "<li><a class=x>t</a></li><p>q</p>" * n + "</ul>", False)
        began = time.process_time()
        for text in ("li:not(:has(b)):nth-of-type(3n+1) > a:only-child", "ul:has(> li + p ~ li a.x) p:nth-last-of-type(2n)"):
            assert page.select(selectors.compile_selector(text))
        return time.process_time() - began

    seconds(2000)
    assert seconds(24_000) < 8 * seconds(6_000)


# -- similar sets ------------------------------------------------------------------------


def by_hand(asked, stored, least):
    best = {}
    for at, a in enumerate(asked):
        scored = [(-len(a[1] & b[1]) / max(len(a[1]), len(b[1])), task) for task, b in stored.items() if a[0] == b[0]]
        score, task = min(scored, default=(0, None))
        if -score > least:
            best[at] = (task, -score)
    return best


@pytest.mark.parametrize("many, widest", [(500, 6), (0, 6), (0, 1), (500, 3)])
def test_best_overlaps_equal_brute_force(spark, monkeypatch, many, widest):
    monkeypatch.setattr(set_join, "MANY", many)
    monkeypatch.setattr(set_join, "WIDEST", widest)
    rng = random.Random(many + widest)
    words = [f"w{i}" for i in range(25)]

    def one():
        return rng.choice(["h1", "h1", "h2"]), frozenset(rng.sample(words, rng.choice([1, 2, 3, 5, 8, 8, 9, 16, 17, 20])))

    asked = list(dict.fromkeys(one() for _ in range(250)))
    stored = {f"t{i:03}": s for i, s in enumerate(dict.fromkeys(one() for _ in range(250)))}
    rows = lambda sets: [(*key, h, sorted(s), len(s)) for key, (h, s) in sets]
    a = spark.createDataFrame(rows([((), s) for s in asked]), "domain string, common array<string>, size int")
    b = spark.createDataFrame(rows([((t,), s) for t, s in stored.items()]), "task_id string, domain string, common array<string>, size int")
    place = {(h, tuple(sorted(s))): i for i, (h, s) in enumerate(asked)}
    got = {place[r.domain, tuple(r.common)]: (r.task_id, r.score) for r in set_join.best_overlaps(a, b, 0.5).collect() if r.score > 0}
    best = {}
    for at, match in got.items():
        best[at] = match
    assert best == by_hand(asked, stored, 0.5) and len(best) > 50


def test_candidates_on_a_host_of_few_words_stay_few(spark):
    """Sets of 8 of 40 words: one word fits most pairs, the chosen width far fewer."""
    rng = random.Random(1)
    sets = list({tuple(sorted(rng.sample(range(40), 8))) for _ in range(1200)})
    rows = spark.createDataFrame([("h", [f"w{i:02}" for i in s], 8, str(s)) for s in sets], "domain string, common array<string>, size int, task_id string")
    families = set_join._families(rows, 0.5, 0.5)
    widths = set_join._widths(families, families)
    assert widths.first().width > 1
    met = lambda w: set_join._keyed(families, w).join(set_join._keyed(families, w).select("domain", "family", "key"), ["domain", "family", "key"]).count()
    assert met(widths) < met(widths.withColumn("width", F.lit(1))) / 10


# -- walks ------------------------------------------------------------------------------


def walk_by_hand(tasks, links):
    out = set()
    for task, at, pages in tasks:
        for number in range(1, pages + 1):
            if at not in links:
                break
            out.add((task, number, at))
            if links[at] is None or links[at] == at:
                break
            at = links[at]
    return out


@pytest.mark.parametrize("most_rules", [64, 0])
def test_walk_equals_one_step_after_another(spark, monkeypatch, most_rules):
    monkeypatch.setattr(walk, "MOST_RULES", most_rules)
    rng = random.Random(3)
    hosts = ["http://a.com/", "http://b.com/"]
    urls = [f"{hosts[i % 2]}p{i}" for i in range(60)]
    one, two = ({u: rng.choice([*urls, None, "http://gone.com/x"]) for u in urls} for _ in range(2))
    anchor = lambda kind, to: f'<a class="{kind}" href="{to}">x</a>' if to else ""
    pages = spark.createDataFrame([(i, u, anchor("n", one[u]) + anchor("m", two[u])) for i, u in enumerate(urls)], schemas.PAGES)
    asked = [(f"t{i}", rng.choice(urls), rng.choice([1, 2, 5, 17]), rng.choice("nm")) for i in range(80)]
    tasks = spark.createDataFrame([(t, u, n, (f"a.{kind}", "link", None)) for t, u, n, kind in asked], "task_id string, url string, pages int, pagination struct<selector string, type string, parameter string>")
    got = {(r.task_id, r.page_no, r.url) for r in walk.walk_pages(tasks, pages).collect()}
    expected = walk_by_hand([(t, u, n) for t, u, n, kind in asked if kind == "n"], one) | walk_by_hand([(t, u, n) for t, u, n, kind in asked if kind == "m"], two)
    assert got == expected


def test_a_chain_of_a_thousand_pages_takes_twelve_rounds_and_one_scan(spark, monkeypatch):
    joins, scans = [], []
    monkeypatch.setattr(walk, "_host_links", lambda *a, f=walk._host_links: scans.append(1) or f(*a))
    monkeypatch.setattr(walk, "_raw_links", lambda *a, f=walk._raw_links: scans.append(1) or f(*a))
    monkeypatch.setattr(walk._Steps, "of", lambda self, here, f=walk._Steps.of: joins.append(1) or f(self, here))
    pages = spark.createDataFrame([(i, f"http://a.com/{i}", f'<a rel=next href="/{i + 1}">x</a>') for i in range(1000)], schemas.PAGES)
    tasks = spark.createDataFrame([("t", "http://a.com/0", 2000, ("a[rel=next]", "link", None)), ("u", "http://a.com/990", 5, ("a:not(.x)", "link", None))], "task_id string, url string, pages int, pagination struct<selector string, type string, parameter string>")
    got = sorted((r.task_id, r.page_no, r.page_id) for r in walk.walk_pages(tasks, pages).collect())
    assert got == [("t", n + 1, n) for n in range(1000)] + [("u", n + 1, 990 + n) for n in range(5)]
    assert scans == [1] and len(joins) == 1


# -- snapshots --------------------------------------------------------------------------


def config(spark, *rows):
    return spark.createDataFrame([(t, [], None, (at, f"http://{t}", text, None, None, None, None)) for t, at, text in rows], schemas.CATALOGUE)


def held(df):
    return {r.task_id: r.metadata.data_description for r in df.collect()}


def test_snapshots_keep_versions_and_touch_few_buckets(spark, tmp_path):
    kept = catalogue.catalogue_store(spark, str(tmp_path / "store"), buckets=8)
    assert kept.versions() == [] and kept.read().count() == 0
    first = kept.upsert(config(spark, *[(f"t{i}", 1.0, "old") for i in range(40)]))
    before = kept._manifest(first)["parts"]
    second = kept.upsert(config(spark, ("t3", 2.0, "new")))
    after = kept._manifest(second)["parts"]
    assert sum(before[b] != after[b] for b in before) == 1
    third = catalogue.remove(kept, spark.createDataFrame([("t3",), ("t4",), ("none",)], "task_id string"))
    assert (first, second, third) == (1, 2, 3) == tuple(kept.versions())
    assert held(kept.read(1))["t3"] == "old" and held(kept.read(2))["t3"] == "new" and set(held(kept.read())) == {f"t{i}" for i in range(40)} - {"t3", "t4"}
    again = catalogue.catalogue_store(spark, str(tmp_path / "store"), buckets=99)
    assert again.buckets == 8 and held(again.read()) == held(kept.read())
    last = held(kept.read())
    assert kept.forget(1) and kept.versions() == [3] and held(kept.read()) == last
    with pytest.raises(ValueError):
        kept.read(1)


def test_of_two_writers_the_later_fails(spark, tmp_path, monkeypatch):
    kept = catalogue.catalogue_store(spark, str(tmp_path / "store"), buckets=2)
    kept.upsert(config(spark, ("a", 1.0, "x")))
    late = catalogue.catalogue_store(spark, str(tmp_path / "store"))
    monkeypatch.setattr(late, "versions", lambda: [1])
    kept.upsert(config(spark, ("b", 1.0, "y")))
    with pytest.raises(snapshots.ConcurrentChange):
        late.upsert(config(spark, ("c", 1.0, "z")))
    assert held(kept.read()) == {"a": "x", "b": "y"} and not [p for p in (tmp_path / "store" / "manifests").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_deleting_everything_leaves_a_readable_version(spark, tmp_path):
    kept = catalogue.catalogue_store(spark, str(tmp_path / "store"), buckets=2)
    kept.upsert(config(spark, ("a", 1.0, "x")))
    catalogue.remove(kept, spark.createDataFrame([("a",)], "task_id string"))
    assert kept.read().count() == 0 and kept.read(1).count() == 1


# -- records without a schema ----------------------------------------------------------------


def test_ragged_records(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a":1,"b":"x","VOID":true}\n{"a":2.5,"c":null,"n":{"k":[1,2]}}\n\n{"a":"t","d\'e":true}\n{bad\n[1]\n')
    found = ragged.read_ragged(spark, str(tmp_path))
    assert sorted(r._corrupt_record for r in found.where("record is null").collect()) == ["[1]", "{bad"]
    schema = ragged.observed_schema(found)
    assert {f.name: f.dataType.simpleString() for f in schema} == {"a": "string", "b": "string", "c": "string", "d'e": "boolean", "n": "struct<k:array<bigint>>", "VOID": "boolean"}
    rows = {r.a: r for r in ragged.with_fields(found.where("record is not null"), schema, absent="missing").collect()}
    assert rows["1"].b == "x" and "c" in rows["1"].missing and "c" not in rows["2.5"].missing and rows["2.5"].c is None
    assert rows["2.5"].n.k == [1, 2] and rows["t"]["d'e"] is True and sorted(rows["t"].missing) == ["VOID", "b", "c", "n"]
    empty = found.where("record is null and _corrupt_record is null")
    assert ragged.observed_schema(empty).names == []


# -- SQL ------------------------------------------------------------------------------------


def test_extraction_in_sql(spark):
    table_function.register(spark)
    spark.createDataFrame([(1, "<div class=p><h2>A</h2><b>1</b><b>2</b></div><div class=p><h2>B</h2></div>"), (2, None), (3, "<p>")], "page_id int, html string").createOrReplaceTempView("some_pages")
    rules = '[{"name":"container","selector":"div.p"},{"name":"title","selector":"h2"},{"name":"n","selector":"b","multiple":true}]'
    found = spark.sql(f"select p.page_id, e.* from some_pages p, lateral extract_items(p.html, '{rules}') e")
    assert found.schema["n"].dataType.simpleString() == "array<string>"
    assert [tuple(r) for r in found.orderBy("page_id", "title").collect()] == [(1, "A", ["1", "2"]), (1, "B", [])]
    with pytest.raises(Exception, match="constant"):
        spark.sql("select e.* from some_pages p, lateral extract_items(p.html, p.html) e").collect()


# -- merge and formats -----------------------------------------------------------------------


def test_maps_merge_at_any_depth(spark):
    kind = "id int, m map<string,map<string,int>>, s struct<x:map<string,struct<p:int,q:int>>>"
    left = spark.createDataFrame([(1, {"a": {"x": 1, "y": 2}, "b": None}, ({"k": (1, None)},)), (2, None, None)], kind)
    right = spark.createDataFrame([(1, {"a": {"y": 3, "x": None}, "c": {"z": 1}}, ({"k": (None, 5), "l": (7, 8)},)), (3, {"d": {}}, None)], kind)
    got = {r.id: r for r in records.merge_records(left, right, ["id"]).collect()}
    assert got[1].m == {"a": {"x": 1, "y": 3}, "b": None, "c": {"z": 1}}
    assert {k: tuple(v) for k, v in got[1].s.x.items()} == {"k": (1, 5), "l": (7, 8)}
    assert got[2].m is None and got[3].m == {"d": {}}


def test_formats_come_from_one_computation(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(50).mapInArrow(told, "id long").withColumn("at", F.rand())
    done = writers.export_formats(rows, str(tmp_path / "out"), ["csv", "json"])
    assert read.value == 50 and set(done) == {"csv", "json"}
    a = {(int(r.id), float(r["at"])) for r in spark.read.option("header", True).csv(done["csv"]).collect()}
    assert a == {(r.id, r["at"]) for r in spark.read.json(done["json"]).collect()}


def test_row_numbers_with_ties_and_nulls(spark):
    rng = random.Random(2)
    keys = [None if i % 50 == 0 else rng.randint(0, 40) for i in range(3000)]
    numbered = records.with_row_number(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int").repartition(5), "k").collect()
    assert sorted(r._index for r in numbered) == list(range(3000))
    assert [r.k for r in sorted(numbered, key=lambda r: r._index)] == sorted(keys, key=lambda k: (k is not None, k or 0))
    chunked = records.with_chunks(spark.range(1000).withColumn("k", F.col("id") * 3), 64, "k", count="of").collect()
    assert all(r._chunk == r.id // 64 and r["of"] == 16 for r in chunked)
