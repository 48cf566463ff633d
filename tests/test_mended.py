"""Cases of the last review that the registered queries can't show: errors, plans, growth."""

import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from pagegrain.functions import text
from pagegrain.operators import catalogue, clean, extract, records


def test_text_equality_on_a_date_raises(spark):
    rows = spark.sql("select date'2024-01-02' as d, 1 as n")
    with pytest.raises(TypeError):
        records.filter_records(rows, {"d": "2024-01-02"})
    assert records.filter_records(rows, {"n": "1"}).count() == 0


def test_string_keys_print_numbers_like_python(spark):
    rows = spark.sql("select * from values (1, 12000000.0D), (2, 12000000.0D) t(i, price)")
    twin = rows.select(F.col("i") + 2, F.lit("12000000.0").alias("price")).toDF("i", "price")
    both = records.remove_duplicates(rows, "i", ["price"], string_key=True)
    assert [r["i"] for r in both.collect()] == [1]
    assert records.consolidate_fields(rows.join(twin.toDF("j", "cost")).limit(1), {"price": ["price", "cost"]}).columns


def test_nested_values_that_need_no_python_equal_those_that_do(spark):
    rows = spark.sql("select named_struct('_k', '<i>x</i>', 'v', array(' <b>a</b>  b ', null, '<p>')) as s, map('m', named_struct('t', '<b> c')) as m")
    more = rows.select(F.struct(F.col("s._k").alias("_k"), F.transform("s.v", lambda x: F.concat(x, F.lit("é"))).alias("v")).alias("s"))
    done = clean.clean_fields(rows).first()
    assert done["s"].asDict() == {"_k": "<i>x</i>", "v": ["a b", None]} and done["m"]["m"]["t"] == "c"
    assert clean.clean_fields(more).first()["s"]["v"] == ["a b é", None, "é"]


def test_unknown_nested_kinds_raise():
    import pyarrow as pa

    with pytest.raises(TypeError):
        text._map_leaves(pa.array(["a"]).dictionary_encode(), str.upper)
    assert text._map_leaves(pa.array([["a"], None], pa.large_list(pa.large_string())), str.upper).to_pylist() == [["A"], None]
    assert text._map_leaves(pa.array([[("k", "a"), ("_k", "a")]], pa.map_(pa.string(), pa.string())), str.upper).to_pylist() == [[("k", "A"), ("_k", "a")]]


def test_merge_takes_names_with_dots(spark):
    left, right = spark.sql("select 1 as `a.id`, 2 as `x.y`"), spark.sql("select 1 as `a.id`, 3 as `x.y`")
    assert tuple(records.merge_records(left, right, ["a.id"]).first()) == (1, 3)


def test_empty_stored_config_is_generated_anew(spark):
    config = "array<struct<name:string,selector:string>>"
    stored = spark.sql(f"select 'a' as task_id, cast(null as {config}) as selectors, cast(null as struct<selector:string>) as pagination, cast(null as struct<url:string>) as metadata union all select 'b', cast(array() as {config}), null, null")
    tasks = spark.sql("select * from values ('a'), ('b'), ('c') t(task_id)")
    assert {r["task_id"]: r["to_generate"] for r in catalogue.resolve(tasks, stored).collect()} == {"a": True, "b": False, "c": True}


def test_unusable_rules_list_bad_selectors_only(spark):
    rows = spark.sql("select 't' as task_id, array(named_struct('name', 'n', 'selector', 'li:nth-child(odd of .x)', 'container', cast(null as boolean)), named_struct('name', 'm', 'selector', 'li', 'container', cast(null as boolean))) as selectors union all select 'u', null")
    assert [tuple(r) for r in extract.unusable_rules(rows).collect()] == [("t", "n", "li:nth-child(odd of .x)", False)]


def test_chunks_shuffle_the_wide_rows_once(spark, sf):
    table = spark.read.parquet(f"{sf}/orders.parquet")
    plan = records.with_chunks(table, 100, "o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_bucket") == 1 and plan.count("Exchange") == 1


def test_row_numbers_with_ties_nulls_and_two_columns(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("b"), "id")
    out = records.with_row_number(rows, "a", "b").collect()
    assert sorted(r["_index"] for r in out) == list(range(1000))
    ranked = sorted(out, key=lambda r: r["_index"])
    keys = [(r["a"], -1 if r["b"] is None else r["b"]) for r in ranked]
    assert keys == sorted(keys)
    assert records.with_row_number(rows.limit(0), "id").count() == 0


def test_title_case_grows_with_the_words(spark):
    def seconds(words):
        rows = spark.range(20).select(F.repeat(F.lit("ab "), words).alias("t")).select(F.length(text.title_case(F.col("t"))).alias("n"))
        rows.collect()
        start = time.perf_counter()
        rows.collect()
        return time.perf_counter() - start

    assert seconds(8000) < 6 * seconds(2000) + 0.5


def test_fixed_rule_walk_reads_markup_once(spark, sf, monkeypatch):
    from pagegrain.operators import walk

    scans = []
    monkeypatch.setattr(walk, "_all_links", lambda pages, pagination, f=walk._all_links: scans.append(1) or f(pages, pagination))
    QUERIES["b8_pagination_walk"](spark, sf).count()
    assert len(scans) == 1


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_a_batch_of_texts_is_not_held_as_python_objects(kind):
    """Python's own memory stays at a few texts, however many a batch has; results and nulls are as before."""
    given = [None if at % 7 == 0 else f"é{at}" + "x" * 4000 for at in range(5000)]
    values = pa.array(given, kind)
    tracemalloc.start()
    got = text._map_leaves(values, str.upper)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 << 20
    assert got.type == kind and got.to_pylist() == [s and s.upper() for s in given]
    assert text._map_leaves(pa.array([], kind), str.upper).to_pylist() == []
