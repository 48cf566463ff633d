import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pagegrain.operators import clean, process, records
from pagegrain.plans.jobs import type_and_clean


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_rule_dispatch():
    from pyspark.sql import types as T

    text, many = T.StringType(), T.ArrayType(T.StringType())
    names = ["PriceUSD", "candidate", "updated_at", "context", "operating", "image_url", "tags", "title", "created"]
    assert [process.rule_for(n, text) for n in names] == [
        "price", "date", "date", "text", "rating", "url", "strip", "strip", "date"]
    assert process.rule_for("tags", many) == "list" and process.rule_for("links", many) == "url"
    assert process.rule_for("n", T.LongType()) == "keep"


def test_process(spark):
    df = spark.createDataFrame(
        [Row(price="$5", price_n=7, prices=["1"], date=20240105, flag_date=True, body=["a'b", 'c"d', None],
             link=" x ", rating="8/10", rating_n=3.0, tags=[" a ", None], tag_prices_x=["$1"], name=" n ", n=1)]
    )
    out = process.process_records(df, "now", keep=("n",)).first()
    assert (out.price, out.price_n, out.prices, out.date, out.flag_date) == (5.0, 7.0, None, "20240105", "True")
    assert out.body == "[\"a'b\", 'c\"d', None]"
    assert (out.link, out.rating, out.rating_n, out.tags, out.name, out.n) == ("https://x", 4.0, 3.0, ["a", None], "n", 1)
    assert out._metadata.processed_at == "now" and out._metadata.processor_version == "1.0.0"


def test_clean_nested(spark):
    df = spark.createDataFrame(
        [(1, "<b> </b>", ["a&amp;b", "<i></i>", None], (" x ", ["&nbsp;"], ("",)), "&lt;keep&gt;", 0),
         (2, None, [], ("", [], None), None, None)],
        "n int, a string, l array<string>, s struct<t:string, u:array<string>, v:struct<w:string>>, _m string, z int",
    )
    out = {r.n: r for r in clean.clean_fields(df).collect()}
    assert out[1].a is None and out[1].l == ["a&b", None] and tuple(out[1].s) == ("x", None, None)
    assert out[1]._m == "&lt;keep&gt;" and out[1].z == 0
    assert tuple(out[2])[1:] == (None, None, None, None, None)
    assert clean.clean_records(df.drop("n")).count() == 1


def test_cleaning_twice_changes_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("text not like '%<%'")
    once = clean.clean_fields(docs)
    twice = clean.clean_fields(once)
    assert once.exceptAll(twice).isEmpty() and docs.count() > 0


def test_standard_names():
    assert clean.standard_names(["Name", "cost", "amount", "id", "x"]) == {
        "Name": "title", "cost": "price", "amount": "price", "id": "sku"}
    assert clean.standard_names(["title", "name", "desc"]) == {"desc": "description"}


def test_standardise(spark):
    df = spark.createDataFrame([("a", "b", None), ("a", None, "c"), ("a", "b", "c")], "name string, heading string, cost string")
    out = clean.standardise_fields(df)
    assert out.columns == ["title", "price"]
    assert rows(out) == [("b", None), ("a", "c"), ("b", "c")]


def test_remove_empty(spark):
    df = spark.createDataFrame([(" ", [], 1.0), ("x", ["a"], None), (None, [], None), (" ", None, None)],
                               "a string, l array<string>, z double").withColumn("never", F.lit(None).cast("string"))
    out = clean.remove_empty_fields(df, drop_columns=True)
    assert out.columns == ["a", "l", "z"]
    assert rows(out) == [(None, None, 1.0), ("x", ["a"], None)]
    nan = spark.createDataFrame([(float("nan"),)], "z double")
    assert clean.remove_empty_fields(nan).count() == 1


def test_field_cleaners(spark):
    df = spark.createDataFrame([("the end", "1,005", "a.b/c d", "<i>x</i>&lt;", 1.255)],
                               "title string, price string, url string, details string, cost double")
    out = clean.clean_html_fields(clean.clean_urls(clean.clean_prices(clean.normalise_case(df)))).first()
    assert (out.title, out.price, out.price_raw, out.url, out.details, out.cost) == (
        "The End", 1005.0, None, "https://a.b/c%20d", "x<", 1.25)
    free = clean.clean_prices(spark.createDataFrame([("Free",)], "price string")).first()
    assert (free.price, free.price_raw) == (None, "Free")


def test_consolidate(spark):
    df = spark.createDataFrame([(None, "b", "c", "d"), ("a", None, None, None)], "title string, name string, cost string, other string")
    out = records.consolidate_fields(df)
    assert out.columns == ["title", "price", "other"]
    assert rows(out) == [("b", "c", "d"), ("a", None, None)]
    own = records.consolidate_fields(df, {"other": ["name"]})
    assert rows(own.select("title", "other")) == [(None, "d"), ("a", None)]


def test_duplicates_keep_the_first(spark):
    data = [(at, random.Random(at).choice(["hot", "hot", None, f"k{at % 7}"]), at * 1.5) for at in range(500)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "_ord int, url string, v double").repartition(4)
    got = {tuple(r) for r in records.remove_duplicates(df, "_ord").select("_ord", "url").collect()}
    first = {}
    for at, url, _ in sorted(data):
        first.setdefault(url, at)
    assert got == {(at, url) for url, at in first.items()}
    assert records.guess_keys(["a", "id", "url"]) == ["url"] and records.guess_keys(["title", "price", "x"]) == ["title", "price"]
    assert records.guess_keys(["a", "b"]) == ["a", "b"]
    nested = spark.createDataFrame([(1, ["a"]), (2, ["a"]), (3, None)], "_ord int, l array<string>")
    assert {r._ord for r in records.remove_duplicates(nested, "_ord").collect()} == {1, 3}
    texts = spark.createDataFrame([(1, None), (2, "None")], "_ord int, id string")
    assert records.remove_duplicates(texts, "_ord").count() == 2
    assert records.remove_duplicates(texts, "_ord", string_key=True).count() == 1


def test_duplicates_shrink_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id as _ord", "id % 3 as id")
    plan = records.remove_duplicates(df, "_ord")._jdf.queryExecution().executedPlan().toString()
    before, after = plan.index("Exchange hashpartitioning"), plan.index("WindowGroupLimit")
    assert "Final" in plan[after:before] and "WindowGroupLimit" in plan[before:] and "Partial" in plan[before:]


def test_filter(spark):
    df = spark.createDataFrame([("a", 5, True), ("Ab", 7, False), (None, None, None)], "s string, n int, b boolean")
    pick = lambda cond: [r.s for r in records.filter_records(df, cond).orderBy("n").collect()]
    assert pick({"s": "a"}) == ["a"] and pick({"n": 5}) == ["a"] and pick({"b": False}) == ["Ab"]
    assert pick({"n": {"min": 5, "max": 6}}) == ["a"] and pick({"n": {"min": 5}}) == ["a", "Ab"]
    assert pick({"s": {"contains": "b"}}) == ["Ab"] and pick({"s": {"regex": "^a"}}) == ["a"]
    assert pick({"n": {"contains": "7"}}) == ["Ab"]
    assert pick({"missing": "x"}) == [] and pick({"n": "5"}) == [] and pick({"s": 5}) == []
    assert records.filter_records(df, {}).count() == 3
    assert records.filter_records(df, {"s": {"other": 1}}).count() == 2
    with pytest.raises(TypeError):
        records.filter_records(df, {"n": {"min": "5"}})
    plan = records.filter_records(df, {"n": {"min": 5}})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_sort_places_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "A"), (4, "a"), (5, "B")], "_ord int, s string")
    assert [r._ord for r in records.sort_records(df, "s", True, "_ord").collect()] == [3, 4, 1, 5, 2]
    assert [r._ord for r in records.sort_records(df, "s", False, "_ord").collect()] == [1, 5, 3, 4, 2]
    assert records.sort_records(df, "nope") is df


def test_merge_and_flatten(spark):
    left = spark.createDataFrame([(1, ("a", 1), "l"), (2, ("b", None), "l")], "id int, s struct<x:string,y:int>, v string")
    right = spark.createDataFrame([(2, (5, "z"), None), (3, (6, "w"), "r")], "id int, s struct<y:int,q:string>, v string")
    merged = records.merge_records(left, right, ["id"])
    flat = records.flatten_records(merged)
    assert flat.columns == ["id", "s_x", "s_y", "s_q", "v"]
    assert rows(flat, "id") == [(1, "a", 1, None, "l"), (2, "b", 5, "z", "l"), (3, None, 6, "w", "r")]


def test_union_of_ragged_tables(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("y", 2)], "b string, c int")
    assert rows(records.union_records(a, b), "b") == [(1, "x", None), (None, "y", 2)]


def test_row_numbers_and_chunks(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1009 as k").repartition(5)
    numbered = records.with_row_number(df, "k").orderBy("k").collect()
    assert [r._index for r in numbered] == list(range(1000))
    sizes = records.with_chunks(df, 300, "k").groupBy("_chunk").count().orderBy("_chunk").collect()
    assert [tuple(r) for r in sizes] == [(0, 300), (1, 300), (2, 300), (3, 100)]
    assert records.with_row_number(df.limit(0), "k").count() == 0


def test_chain_keeps_metadata_rows(spark):
    df = spark.createDataFrame([(1, " ", None)], "_ord int, name string, price string")
    out = type_and_clean(df, keep=("_ord",), processed_at="t").first()
    assert out.title is None and out._metadata.processed_at == "t"


# -- the order that rows come in ------------------------------------------------------------


def test_places_hold_when_the_sort_is_split_in_another_way_at_each_read(spark):
    """The key column alone fits fewer partitions than whole rows do, so ids given after a sort differ between two reads."""
    from checks.queries import placed

    key = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        rows = spark.range(0, 6000, 1, 6).select("id", (F.col("id") * 7919 % 6000).alias("rank"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
        got = placed(rows.orderBy("rank")).collect()
    finally:
        spark.conf.set(key, before)
    assert len(got) == 6000 and all(r.rank == r.place for r in got)
