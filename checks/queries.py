"""One query per operator: ``(spark, sf_dir) -> DataFrame`` over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import inputs
from pagegrain import schemas, storage
from pagegrain.functions import text, urls, values
from pagegrain.operators import catalogue as store
from pagegrain.operators import clean, extract, records, walk
from pagegrain.operators import feedback as ratings
from pagegrain.operators.process import METADATA, process_field, process_records
from pagegrain.plans import jobs
from pagegrain.sources import ragged, readers, table_function, writers

QUERIES = {}

ITEM_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("name", "price", "rating", "link", "description")],
    ]
)
STAMP = "2024-01-01T00:00:00"
#: For many small scratch files on a local disk: no checksum file beside each, which is as large and takes a process (chmod) of its own.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": True}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.spread(readers.read_pages(spark, f"{sf}/pages.parquet"))


def placed(df: DataFrame) -> DataFrame:
    """Rows with their place in the order they come in; stored first, as their ids depend on how the sort was split, and numbering reads them twice."""
    came = storage.cut_lineage(df.withColumn("_came", F.monotonically_increasing_id()))
    return records.with_row_number(came, "_came", name="place").drop("_came")


def rule(name: str, selector: str, kind: str = "text", **more) -> dict:
    return {"name": name, "selector": selector, "type": kind, **more}


def config(*rules: dict) -> dict:
    return {"selectors": list(rules)}


# -- A: scans ----------------------------------------------------------------------


@query
def a1_page_scan(spark, sf):
    return pages(spark, sf).select(
        "page_id", "url", F.length("html").cast("bigint").alias("n_chars")
    )


def stored_catalogue(spark, sf) -> DataFrame:
    """A config per page task; every third one has no pagination."""
    made = inputs.tasks(spark, sf)
    one = F.struct(
        F.lit("title").alias("name"), F.lit("h1").alias("selector"), F.lit("text").alias("type"),
        F.lit("").alias("attribute"), F.lit(False).alias("multiple"), F.lit("").alias("post_processing"),
        F.lit(None).cast("boolean").alias("container"),
    )
    pagination = F.struct(
        F.lit("nav a").alias("selector"), F.lit("link").alias("type"), F.lit(None).cast("string").alias("parameter")
    )
    configs = made.select(
        "task_id", "url", "data_description", "page_id",
        F.array(one).alias("selectors"),
        F.when(F.col("page_id") % 3 != 0, pagination).alias("pagination"),
    )
    stamped = store.stamp(configs, F.col("page_id") + 1700000000.5, "given")
    return stamped.select(*schemas.CATALOGUE.names)


def flat_catalogue(df: DataFrame) -> DataFrame:
    first = F.get("selectors", F.lit(0))
    return df.select(
        "task_id",
        first["name"].alias("field"),
        first["selector"].alias("selector"),
        F.col("pagination.selector").alias("next_selector"),
        F.col("metadata.generated_at").alias("generated_at"),
        F.col("metadata.url").alias("url"),
        F.col("metadata.data_description").alias("data_description"),
    )


@query
def a2_catalogue_scan(spark, sf):
    path = storage.scratch_path(spark, "catalogue")
    writers.write_json(stored_catalogue(spark, sf), path)
    return flat_catalogue(readers.read_catalogue(spark, path, lines=True))


@query
def a3_feedback_scan(spark, sf):
    path = storage.scratch_path(spark, "feedback")
    writers.write_json(inputs.feedback(spark, sf), path)
    return readers.read_feedback(spark, path, lines=True).drop(readers.BAD)


@query
def a4_record_scan(spark, sf):
    path = storage.scratch_path(spark, "records")
    writers.write_json(inputs.items(spark, sf), path)
    return readers.read_records(spark, path, ITEM_SCHEMA, multi_line=False)


@query
def a4_bad_rows(spark, sf):
    """Every seventh line is cut short: no null records, and each bad line is listed."""
    path = storage.scratch_path(spark, "lines")
    raw = inputs.items(spark, sf)
    line = F.to_json(F.struct(*raw.columns))
    raw.select(F.when(F.col("id") % 7 == 0, F.left(line, F.lit(20))).otherwise(line)).write.text(path)
    good = readers.read_records(spark, path, ITEM_SCHEMA, multi_line=False)
    bad = readers.read_bad_records(spark, path, ITEM_SCHEMA, multi_line=False)
    return good.select("id", F.lit(None).cast("string").alias("bad")).unionByName(
        bad.select(F.lit(None).cast("bigint").alias("id"), F.col("text").alias("bad"))
    )


@query
def a2_broken_files(spark, sf):
    """One config per file, every fifth unreadable: its task is to be generated anew."""
    path = storage.scratch_path(spark, "configs")
    made = inputs.tasks(spark, sf)
    good = F.to_json(F.struct(F.array(F.struct(F.lit("t").alias("name"), F.lit("h1").alias("selector"))).alias("selectors")))
    text = F.when(F.col("page_id") % 5 == 0, F.lit('{"selectors": [')).otherwise(good)
    writers.write_each(made.select(text.alias("value")), path, **PLAIN_FILES)
    asked = readers.by_shelf(spark, path, lambda folders: spark.read.text(folders, wholetext=True).select(
        F.col("_metadata.file_name").alias("task_id"), F.col("value").startswith('{"selectors":[{').alias("readable")
    ))
    # File names fill a fraction of their size on disk: by that, Spark would send the catalogue through the driver.
    done = store.resolve(asked.hint("merge"), readers.read_catalogue(spark, path))
    return done.groupBy("readable", "to_generate").agg(F.count(F.lit(1)).alias("n"))


@query
def a5_json_scan(spark, sf):
    path = storage.scratch_path(spark, "props")
    inputs.table(spark, sf, "events").select("props").write.text(path)
    rows = readers.read_json(spark, path, T.StructType([T.StructField("k", T.LongType())]), multi_line=False)
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count(readers.BAD).alias("bad"))


# -- B: extraction -------------------------------------------------------------------


@query
def b1_container_items(spark, sf):
    rules = config(rule("container", "nav li"), rule("label", "a"), rule("href", "a", "href"))
    return extract.extract_records(pages(spark, sf), rules, ("page_id",)).withColumnRenamed("_item", "item")


@query
def b2_single_item(spark, sf):
    rules = config(rule("title", "title"), rule("h1", "article > h1"), rule("video", "video"))
    return extract.extract_records(pages(spark, sf), rules, ("page_id",)).drop("_item")


@query
def b3_one_and_all(spark, sf):
    rules = config(rule("one", "nav a", "href"), rule("many", "nav a", "href", multiple=True), rule("none", "video", multiple=True))
    found = extract.extract_records(pages(spark, sf), rules, ("page_id",))
    return found.select(
        "page_id", "one", F.array_join("many", "|").alias("many"),
        F.size("many").cast("bigint").alias("n_many"), F.size("none").cast("bigint").alias("n_none"),
    )


@query
def b4_value_kinds(spark, sf):
    ad = "body > div.ad"
    rules = config(
        rule("shown", ad), rule("markup", ad, "html"), rule("klass", ad, "attribute", attribute="class"),
        rule("inner", ad, "innerText"), rule("no_src", ad, "src"), rule("charset", "meta[charset]", "attribute", attribute="charset"),
        rule("style", "head style"), rule("other", ad, "unheard-of"),
    )
    return extract.extract_records(pages(spark, sf), rules, ("page_id",)).drop("_item")


@query
def b4_article_text(spark, sf):
    """Whole article text and every paragraph, nested as the markup leaves them."""
    rules = config(rule("article_words", "article"), rule("paragraphs", "article p", multiple=True))
    found = extract.extract_records(pages(spark, sf), rules, ("page_id",))
    return found.select(
        "page_id", F.col("article_words").alias("article"), F.size("paragraphs").cast("bigint").alias("n")
    )


@query
def b1_unusable_rules(spark, sf):
    """Catalogue rules outside the grammar, one of them a container."""
    one = F.struct(F.lit("a").alias("name"), F.lit("h1").alias("selector"), F.lit(None).cast("boolean").alias("container"))
    two = F.struct(F.concat(F.lit("f"), "page_id").alias("name"), F.lit("p:hover").alias("selector"), F.lit(None).cast("boolean").alias("container"))
    box = F.struct(F.lit("container").alias("name"), F.lit("li:nth-child(2 of .x)").alias("selector"), F.lit(True).alias("container"))
    made = inputs.tasks(spark, sf).select("task_id", F.when(F.col("page_id") % 2 == 0, F.array(one, two)).otherwise(F.array(box, one)).alias("selectors"))
    return extract.unusable_rules(made)


@query
def b5_next_by_link(spark, sf):
    following = extract.next_page_url(F.col("html"), F.col("url"), {"selector": "nav a", "type": "link"})
    return pages(spark, sf).select("page_id", following.alias("next_url"))


@query
def b6_next_by_button(spark, sf):
    """The navigation made a button that leads to a page beside or at the root."""
    target = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("p"), F.col("page_id"), F.lit(".html"))).otherwise(
        F.concat(F.lit("/root/"), F.col("page_id"))
    )
    button = F.concat(F.lit("<nav onclick=\"go(); location.href = '"), target, F.lit("'\">"))
    html = F.replace("html", F.lit("<nav>"), button)
    following = extract.next_page_url(html, F.col("url"), {"selector": "nav", "type": "button"})
    return pages(spark, sf).select("page_id", following.alias("next_url"))


@query
def b7_next_by_parameter(spark, sf):
    following = extract.next_page_url(F.col("html"), F.col("url"), {"selector": "nav a", "type": "parameter"})
    return pages(spark, sf).select("page_id", following.alias("next_url"))


@query
def b8_pagination_walk(spark, sf):
    """Every page a task that follows two links of a chain over all pages."""
    stored = pages(spark, sf)
    link = stored.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    chained = stored.join(link, "page_id", "left").select(
        "page_id",
        "url",
        F.coalesce(F.concat(F.lit('<a class="next" href="'), F.col("next_url"), F.lit('">next</a>'), F.col("html")), F.col("html")).alias("html"),
    )
    tasks = stored.select(F.col("page_id").cast("string").alias("task_id"), "url", F.lit(3).alias("pages"))
    visits = walk.walk_pages(tasks, chained, {"selector": "a.next", "type": "link"}, max_pages=3)
    return visits.select(F.col("task_id").cast("bigint").alias("task"), F.col("page_no").cast("bigint").alias("page_no"), "page_id")


# -- C: typed pass --------------------------------------------------------------------


@query
def c1_process(spark, sf):
    done = process_records(inputs.items(spark, sf), STAMP, keep=("id",))
    return done.select(
        "id", "name", "price", "rating", "link", "description",
        F.col(f"{METADATA}.processed_at").alias("processed_at"),
        F.col(f"{METADATA}.processor_version").alias("version"),
    )


@query
def c2_dispatch(spark, sf):
    """The same text under names that hit another rule than they seem to."""
    cols = {"candidate": "date", "context": "text", "operating": "rating", "image_url": "url", "unitPrice": "price", "headline": "strip"}
    raw = inputs.items(spark, sf).select("id", *[F.col("name").alias(name) for name in cols])
    return process_records(raw, keep=("id",), stamp=False)


@query
def c3_price(spark, sf):
    return inputs.items(spark, sf).select("id", values.parse_price(F.col("price")).alias("price"))


@query
def c4_date(spark, sf):
    return inputs.spread(inputs.dates(spark, sf)).select("id", values.parse_date(F.col("published_date")).alias("published_date"))


@query
def c5_text(spark, sf):
    return pages(spark, sf).select("page_id", text.normalise_text(F.col("html")).alias("body_text"))


@query
def c6_url(spark, sf):
    return inputs.items(spark, sf).select("id", values.with_scheme(F.col("link")).alias("link"))


@query
def c7_rating(spark, sf):
    return inputs.items(spark, sf).select("id", values.parse_rating(F.col("rating")).alias("rating"))


@query
def c8_list(spark, sf):
    lists = inputs.items(spark, sf).select(
        "id", F.array("name", "description").alias("tags"), F.array("price").alias("prices"), F.array("name", "rating").alias("links")
    )
    done = process_records(lists, keep=("id",), stamp=False)
    return done.select("id", F.array_join("tags", "|").alias("tags"), "prices", "links")


@query
def c9_default(spark, sf):
    kind = T.StringType()
    return inputs.items(spark, sf).select("id", process_field("name", F.concat(F.lit("\t\xa0"), "name"), kind).alias("name"))


@query
def c10_metadata(spark, sf):
    done = process_records(inputs.table(spark, sf, "customer").select("c_custkey"), STAMP)
    return done.select("c_custkey", f"{METADATA}.processed_at", f"{METADATA}.processor_version")


# -- D: relational ----------------------------------------------------------------------


@query
def d1_consolidate(spark, sf):
    raw = inputs.items(spark, sf).withColumns(
        {"heading": F.when(F.col("id") % 3 == 0, F.lit("Heading")), "cost": F.lit("9")}
    ).withColumn("name", F.when(F.col("id") % 2 == 0, F.col("name")))
    return records.consolidate_fields(raw)


@query
def d2_dedupe(spark, sf):
    events = inputs.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return records.remove_duplicates(events, "event_id", ["user_id", "event_type"])


@query
def d2_map_keys(spark, sf):
    """Equal maps whose entries come in two orders are one key."""
    a, b = F.lit("a"), F.lit("b")
    third = (F.col("event_id") % 3).cast("string")
    attributes = F.when(F.col("event_id") % 2 == 0, F.create_map(a, third, b, F.lit("x"))).otherwise(F.create_map(b, F.lit("x"), a, third))
    events = inputs.table(spark, sf, "events").select("event_id", attributes.alias("attributes"))
    return records.remove_duplicates(events, "event_id", ["attributes"]).select("event_id", F.col("attributes")["a"].alias("a"))


@query
def d1_number_beside_text(spark, sf):
    raw = inputs.items(spark, sf).select("id", (F.col("id") * 1000000.0).alias("price"), F.concat(F.lit("about "), "id").alias("cost"))
    raw = raw.withColumn("price", F.when(F.col("id") % 2 == 0, F.col("price")))
    as_text = records.consolidate_fields(raw, {"price": ["price", "cost"]}, keep=("id",))
    typed = records.consolidate_fields(raw, {"price": ["price", "cost"]}, keep=("id",), types={"price": "double"})
    return as_text.join(typed.select("id", F.col("price").alias("number")), "id")


@query
def d2_dedupe_guessed(spark, sf):
    return records.remove_duplicates(inputs.items(spark, sf).select(F.col("id").alias("_ord"), "name", "rating"), "_ord")


@query
def d3_filter(spark, sf):
    kept = records.filter_records(
        inputs.table(spark, sf, "part"),
        {"p_size": {"min": 5, "max": 40}, "p_name": {"contains": "ring"}, "p_brand": {"regex": "#1[0-9]?$"}},
    )
    return kept.select("p_partkey", "p_name", "p_brand", "p_size")


@query
def d4_sort(spark, sf):
    """All rows sorted by a text column, dearest first, nulls last, with the place each one got."""
    return placed(records.sort_records(inputs.items(spark, sf), "price", False, "id")).select("id", "price", "place")


@query
def d5_top(spark, sf):
    found = records.top_records(inputs.table(spark, sf, "orders"), "o_totalprice", 25, "o_orderkey")
    return found.select("o_orderkey", "o_totalprice")


@query
def d6_union(spark, sf):
    a = inputs.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), "c_mktsegment")
    b = inputs.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), "s_acctbal")
    return records.union_records(a, b)


def _merged(spark, sf):
    left = inputs.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("info"),
        F.col("c_mktsegment").alias("segment"),
    )
    right = inputs.table(spark, sf, "supplier").select(
        (F.col("s_suppkey") * 2).alias("id"),
        F.struct(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"), F.col("s_nationkey").alias("nation")).alias("info"),
        F.lit("supplier").alias("kind"),
    )
    return records.merge_records(left, right, ["id"])


@query
def d7_merge(spark, sf):
    return _merged(spark, sf).select(
        "id", F.col("info.name").alias("name"), F.col("info.balance").alias("balance"),
        F.col("info.nation").alias("nation"), "segment", "kind",
    )


@query
def d8_flatten(spark, sf):
    return records.flatten_records(_merged(spark, sf))


@query
def d9_chunks(spark, sf):
    keys = inputs.table(spark, sf, "orders").select("o_orderkey")
    return records.with_chunks(keys, 1000, "o_orderkey").withColumnRenamed("_chunk", "chunk")


# -- E: cleaning -----------------------------------------------------------------------


@query
def e1_clean(spark, sf):
    done = jobs.type_and_clean(inputs.items(spark, sf).drop("id"), processed_at=STAMP)
    return done.select("title", "price", "rating", "url", "description", F.col(f"{METADATA}.processed_at").alias("processed_at"))


@query
def e2_clean_nested(spark, sf):
    raw = inputs.items(spark, sf)
    nested = raw.select(
        "id",
        F.struct("name", F.struct("description", F.lit("<br>").alias("gone")).alias("more")).alias("info"),
        F.struct(F.lit(" ").alias("blank")).alias("empty"),
        F.col("description").alias("_raw"),
    )
    done = clean.clean_fields(nested)
    return done.select(
        "id", F.col("info.name").alias("name"), F.col("info.more.description").alias("description"),
        F.col("info.more.gone").alias("gone"), F.col("empty").isNull().alias("is_empty"), F.col("_raw").alias("raw"),
    )


@query
def e2_nested_raw(spark, sf):
    """Names that begin with ``_`` keep their values at every depth; maps are cleaned like structs."""
    dirty = F.concat(F.lit("<b>x</b> &amp; "), "name")
    nested = inputs.items(spark, sf).select(
        "id",
        F.struct(dirty.alias("_raw"), dirty.alias("shown")).alias("info"),
        F.array(F.struct(dirty.alias("_raw"), F.lit(" <i> </i>").alias("gone"), dirty.alias("shown"))).alias("parts"),
        F.create_map(F.lit("k"), dirty, F.lit("_raw"), dirty, F.lit("blank"), F.lit(" &nbsp; ")).alias("attributes"),
        F.create_map(F.lit("blank"), F.lit("<br>")).alias("empty"),
    )
    done = clean.clean_fields(nested)
    part = F.get("parts", F.lit(0))
    return done.select(
        "id", F.col("info._raw").alias("raw"), F.col("info.shown").alias("shown"), part["_raw"].alias("part_raw"),
        part["gone"].alias("gone"), part["shown"].alias("part_shown"), F.col("attributes")["k"].alias("k"),
        F.col("attributes")["_raw"].alias("map_raw"), F.size("attributes").cast("bigint").alias("n"), F.col("empty").isNull().alias("is_empty"),
    )


@query
def e3_large_types(spark, sf):
    """Compatibility characters, entities and tags; the same with Arrow's large types on and off."""
    key, out = "spark.sql.execution.arrow.useLargeVarTypes", []
    raw = inputs.table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("<i>a</i> &eacute; \ufb01 \u2460 \uff26\uff11 "), "p_name").alias("text"),
    )
    before = spark.conf.get(key)
    try:
        for large in ("false", "true"):
            spark.conf.set(key, large)
            path = storage.scratch_path(spark, "large")
            done = clean.clean_fields(raw.withColumn("parts", F.array("text"))).withColumn("large", F.lit(large))
            done.write.parquet(path)
            out.append(spark.read.parquet(path).select("p_partkey", "large", "text", F.get("parts", F.lit(0)).alias("part")))
    finally:
        spark.conf.set(key, before)
    return out[0].unionByName(out[1])


@query
def e5_case_variant(spark, sf):
    """A standard name in another case and a variant meet in one column; the later one wins where set."""
    raw = inputs.items(spark, sf).select("id", F.col("name").alias("Title"), F.when(F.col("id") % 3 == 0, F.lit("h")).alias("Heading"))
    return clean.standardise_fields(raw, keep=("id",)).select("id", "title")


@query
def e7_long_text(spark, sf):
    """Title case over whole documents."""
    docs = inputs.table(spark, sf, "documents").select("doc_id", text.title_case(F.replace("text", F.lit("ß"), F.lit("s"))).alias("title"))
    return docs.select("doc_id", F.md5("title").alias("title"))


@query
def e3_clean_string(spark, sf):
    """Every page's whole markup: entities, tags, whitespace."""
    return pages(spark, sf).select("page_id", text.clean_string(F.col("html")).alias("shown"))


@query
def e3_clean_documents(spark, sf):
    docs = inputs.spread(inputs.table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", text.clean_string(F.col("text")).alias("text"))


@query
def e4_clean_list(spark, sf):
    lists = inputs.items(spark, sf).select("id", F.array("name", F.lit("<i> </i>"), "description").alias("parts"))
    return clean.clean_fields(lists).select(
        "id", F.array_join("parts", "|").alias("parts"), F.size("parts").cast("bigint").alias("n")
    )


@query
def e5_standardise(spark, sf):
    raw = inputs.items(spark, sf).select(
        "id", "name", F.when(F.col("id") % 4 == 0, F.lit("H")).alias("Heading"), F.col("price").alias("cost"), "rating", F.col("rating").alias("stars"),
    )
    return clean.standardise_fields(raw)


@query
def e6_remove_empty(spark, sf):
    raw = inputs.items(spark, sf).select(
        F.when(F.col("id") % 3 == 0, F.lit(" \t")).when(F.col("id") % 3 == 1, F.col("name")).alias("name"),
        F.when(F.col("id") % 2 == 0, F.col("price")).alias("price"),
        F.lit("  ").alias("never"),
    )
    return clean.remove_empty_fields(raw, drop_columns=True)


@query
def e7_title_case(spark, sf):
    mixed = F.concat(F.col("p_name"), F.lit(" OF the "), F.col("p_type"), F.lit(" LONGWORD "), F.col("p_name"))
    raw = inputs.table(spark, sf, "part").select("p_partkey", mixed.alias("title"))
    return clean.normalise_case(raw)


@query
def e8_clean_prices(spark, sf):
    raw = inputs.items(spark, sf).select("id", "price", (F.col("id") / 8.0).alias("cost"))
    return clean.clean_prices(raw)


@query
def e9_clean_urls(spark, sf):
    return clean.clean_urls(inputs.items(spark, sf).select("id", "link"))


@query
def e10_clean_html(spark, sf):
    return clean.clean_html_fields(inputs.items(spark, sf).select("id", "description"))


# -- F: URLs ---------------------------------------------------------------------------


@query
def f1_sanitise(spark, sf):
    return inputs.links(spark, sf).select("page_id", urls.sanitise_url(F.col("url")).alias("url"))


@query
def f2_query_params(spark, sf):
    params = urls.query_params(urls.query_string(F.col("url")))
    rows = inputs.links(spark, sf).select("page_id", F.inline(params))
    return rows.select("page_id", "key", F.posexplode("values").alias("nth", "value")).withColumn("nth", F.col("nth").cast("bigint"))


@query
def f3_build_query(spark, sf):
    params = F.array(
        F.struct(F.lit("q w").alias("key"), F.array("p_name", "p_type").alias("values")),
        F.struct(F.lit("b").alias("key"), F.array("p_brand").alias("values")),
    )
    return inputs.table(spark, sf, "part").select("p_partkey", urls.build_query(params).alias("query"))


@query
def f4_append_param(spark, sf):
    value = F.concat(F.lit("n "), F.col("page_id").cast("string"))
    return inputs.links(spark, sf).select("page_id", urls.append_param(F.col("url"), F.lit("page"), value).alias("url"))


@query
def f5_base_url(spark, sf):
    return pages(spark, sf).select("page_id", urls.base_url(F.col("url")).alias("base"))


@query
def f6_domain(spark, sf):
    """Pages and records per host; partial counts shrink a hot host before the shuffle."""
    return pages(spark, sf).groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


@query
def f7_join_url(spark, sf):
    rel = F.when(F.col("page_id") % 4 == 0, F.lit("/top")).when(F.col("page_id") % 4 == 1, F.lit("../up/./x")).when(
        F.col("page_id") % 4 == 2, F.lit("http://else.example.com/")).otherwise(F.lit("a//b?c=d"))
    base = F.regexp_replace("url", "[?#].*$", "")
    return pages(spark, sf).select("page_id", urls.join_url(base, rel).alias("url"))


@query
def f8_bare_domain(spark, sf):
    return pages(spark, sf).select("page_id", urls.bare_domain(F.col("url")).alias("domain"))


@query
def f9_is_url(spark, sf):
    found = pages(spark, sf).select("url").union(inputs.items(spark, sf).select("link"))
    return found.select("url", urls.is_url(F.col("url")).alias("is_url"))


@query
def f10_split_domain(spark, sf):
    return inputs.items(spark, sf).select("id", urls.split_domain(F.col("link")).alias("domain"))


# -- G: scalars ------------------------------------------------------------------------


@query
def g1_task_id(spark, sf):
    return inputs.table(spark, sf, "documents").select(
        "doc_id", text_hash(F.col("text")).alias("hash"), values.task_id(F.col("source"), F.col("text")).alias("task_id")
    )


def text_hash(column):
    return values.md5_hex(column)


@query
def g2_safe_id(spark, sf):
    return pages(spark, sf).select("page_id", text.safe_id(F.col("url")).alias("safe"))


@query
def g3_file_name(spark, sf):
    return inputs.table(spark, sf, "documents").select(
        "doc_id", text.safe_file_name(F.concat(F.lit(" ."), F.col("text"), F.lit(".txt"))).alias("file_name")
    )


@query
def g4_truncate(spark, sf):
    return inputs.table(spark, sf, "documents").select("doc_id", text.truncate(F.col("text"), 80).alias("text"))


@query
def g5_format_timestamp(spark, sf):
    return inputs.feedback(spark, sf).select(
        F.col("timestamp"), values.format_epoch(F.col("timestamp")).alias("shown")
    )


@query
def g6_elapsed(spark, sf):
    return inputs.table(spark, sf, "events").select(
        "event_id", values.format_elapsed(F.col("event_id") * F.lit(1.25)).alias("elapsed")
    )


# -- H: feedback -------------------------------------------------------------------------


@query
def h1_store(spark, sf):
    entries = inputs.feedback(spark, sf).withColumn(
        "rating", F.when(F.col("rating") > 8, F.lit("no")).when(F.col("rating") == 8, F.lit("11")).otherwise(F.concat(F.lit(" "), F.col("rating")))
    )
    path = storage.scratch_path(spark, "ratings")
    ratings.append_feedback(entries, path)
    return spark.read.schema(schemas.FEEDBACK).parquet(path)


@query
def h2_for_task(spark, sf):
    return placed(ratings.for_task(inputs.feedback(spark, sf), "01993059f0f2eb1fef51f0bf3749f2e0")).drop("task_id")


@query
def h3_for_domain(spark, sf):
    return placed(ratings.for_domain(inputs.feedback(spark, sf), "ite4.example"))


@query
def h4_average(spark, sf):
    return ratings.average_rating(inputs.feedback(spark, sf))


@query
def h4_average_by_task(spark, sf):
    return ratings.average_by_task(inputs.feedback(spark, sf))


@query
def h4_average_by_domain(spark, sf):
    return ratings.average_by_domain(inputs.feedback(spark, sf))


@query
def h5_recent(spark, sf):
    return ratings.recent(inputs.feedback(spark, sf), 10)


@query
def h6_issues(spark, sf):
    return ratings.common_issues(inputs.feedback(spark, sf))


def low_rated(spark, sf):
    """Feedback on the page tasks: each event rates one of them."""
    tasks = inputs.tasks(spark, sf)
    events = inputs.table(spark, sf, "events")
    rated = events.select(F.col("user_id").alias("page_id"), "event_id", "event_type")
    return tasks.join(rated, "page_id").select(
        "task_id", "url", "data_description", (F.col("event_id") % 10 + 1).cast("int").alias("rating"),
        F.concat(F.lit("saw "), F.col("event_type")).alias("feedback"), F.col("event_id").cast("double").alias("timestamp"),
    )


@query
def h7_to_refine(spark, sf):
    work = ratings.to_refine(low_rated(spark, sf), stored_catalogue(spark, sf))
    return work.select("task_id", "rating", "timestamp", F.col("pagination.selector").alias("next_selector"))


# -- I: catalogue -------------------------------------------------------------------------


@query
def i1_save(spark, sf):
    stored = stored_catalogue(spark, sf)
    newer = F.col("metadata").withField("generated_at", F.col("metadata.generated_at") + 10)
    # A second version of every task on a secure address, and a task of its own per host.
    incoming = stored.where(F.col("metadata.url").startswith("https")).withColumn("metadata", newer)
    fresh = stored.withColumn("task_id", F.md5(urls.domain(F.col("metadata.url"))))
    return flat_catalogue(store.save(stored, incoming.unionByName(fresh)))


@query
def i2_get(spark, sf):
    wanted = inputs.tasks(spark, sf).where(F.col("url").contains("/en/")).select("task_id")
    return flat_catalogue(store.get(stored_catalogue(spark, sf), wanted))


@query
def i3_list(spark, sf):
    return store.listing(stored_catalogue(spark, sf))


@query
def i4_delete(spark, sf):
    gone = inputs.tasks(spark, sf).where(F.col("url").contains("/en/")).select("task_id")
    return flat_catalogue(store.delete(stored_catalogue(spark, sf), gone))


@query
def i5_similar(spark, sf):
    found = store.find_similar(inputs.requests(spark, sf), stored_catalogue(spark, sf))
    return found.select("request_id", "match_task_id", "score")


@query
def i5_hot_host(spark, sf):
    """As many requests as stored tasks on one host, all from one template."""
    made = inputs.hot_stored(spark, sf)
    nothing = F.lit(None)
    kept = made.select(
        "task_id", nothing.cast(schemas.CONFIG["selectors"].dataType).alias("selectors"),
        nothing.cast(schemas.CONFIG["pagination"].dataType).alias("pagination"), F.struct("url", "data_description").alias("metadata"),
    )
    found = store.find_similar(inputs.hot_requests(spark, sf), kept)
    return found.select("request_id", "match_task_id", "score")


@query
def i6_resolve(spark, sf):
    known = stored_catalogue(spark, sf).where(F.col("metadata.url").startswith("https"))
    done = store.resolve(inputs.tasks(spark, sf), known)
    return done.select("task_id", "to_generate", F.get("selectors", F.lit(0))["selector"].alias("selector"))


@query
def i9_loose_flags(spark, sf):
    flag = (
        F.when(F.col("p_partkey") % 5 == 0, F.lit(', "multiple": "true"')).when(F.col("p_partkey") % 5 == 1, F.lit(', "multiple": 1'))
        .when(F.col("p_partkey") % 5 == 2, F.lit(', "multiple": false')).when(F.col("p_partkey") % 5 == 3, F.lit(', "multiple": "false"')).otherwise(F.lit(""))
    )
    body = F.concat(F.lit('{"selectors": [{"name": "a", "selector": "'), F.col("p_name"), F.lit('"'), flag, F.lit("}]}"))
    done = inputs.table(spark, sf, "part").select("p_partkey", store.parse_response(body).alias("c"))
    first = F.get("c.selectors", F.lit(0))
    return done.select("p_partkey", first["selector"].alias("selector"), first["multiple"].alias("multiple"))


@query
def i7_retry(spark, sf):
    """Tasks over every page; those whose pages have no parameter link gave no record."""
    visits = inputs.tasks(spark, sf).select("page_id", "task_id")
    rules = config(rule("href", 'nav a[href*="n"]', "href"))
    found = extract.extract_records(pages(spark, sf), rules, ("page_id",)).join(visits, "page_id")
    return store.to_retry(inputs.tasks(spark, sf), found).select("page_id", "task_id")


@query
def i8_prompts(spark, sf):
    made = store.generate_prompt(inputs.tasks(spark, sf))
    work = ratings.to_refine(low_rated(spark, sf), stored_catalogue(spark, sf))
    again = store.refine_prompt(work.withColumn("page_id", F.lit(None).cast("bigint")))
    return made.select("task_id", "prompt").union(again.select("task_id", "prompt"))


@query
def i9_parse_response(spark, sf):
    body = F.concat(F.lit('{"selectors": [{"name": "a", "selector": "'), F.col("p_name"),
                    F.lit('", "multiple": true}], "pagination": {"selector": "n", "type": "link"}}'))
    answer = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("Sure "), body, F.lit(" ok")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("{"), body))
        .otherwise(F.lit("no idea"))
    )
    done = inputs.table(spark, sf, "part").select("p_partkey", store.parse_response(answer).alias("c"))
    first = F.get("c.selectors", F.lit(0))
    return done.select(
        "p_partkey", F.size("c.selectors").cast("bigint").alias("n"), first["selector"].alias("selector"),
        first["multiple"].alias("multiple"), F.col("c.pagination.selector").alias("next_selector"),
    )


@query
def i10_stamp(spark, sf):
    meta = stored_catalogue(spark, sf).select("task_id", "metadata.*")
    return meta.select("task_id", "generated_at", "url", "data_description", "provider", "refined")


# -- J: sinks ---------------------------------------------------------------------------------


def _read_csv(spark, path, *names):
    """Read back what was written, taking the column order from the header."""
    kind = T.StructType([T.StructField(name, T.StringType()) for name in sorted(names)])
    return spark.read.schema(kind).option("header", True).option("escape", '"').option("enforceSchema", False).csv(path)


@query
def j1_csv(spark, sf):
    path = storage.scratch_path(spark, "csv")
    nested = inputs.items(spark, sf).withColumn("tags", F.array("name", "rating"))
    writers.write_csv(nested, path)
    return _read_csv(spark, path, *nested.columns)


@query
def j2_json(spark, sf):
    path = storage.scratch_path(spark, "json")
    docs = inputs.table(spark, sf, "documents").select("doc_id", "text", "lang")
    writers.write_json(docs, path)
    return spark.read.schema(docs.schema).json(path)


@query
def j3_dispatch(spark, sf):
    path = storage.scratch_path(spark, "dispatch")
    table = inputs.table(spark, sf, "part").select("p_name", "p_partkey")
    writers.export(table, f"{path}/1", "JSON")
    writers.export(table, f"{path}/2", "something")
    a = spark.read.schema(table.schema).json(f"{path}/1")
    return a.select(F.col("p_partkey").cast("string"), "p_name").unionByName(_read_csv(spark, f"{path}/2", "p_name", "p_partkey"))


@query
def j4_formats(spark, sf):
    folder = storage.scratch_path(spark, "formats")
    table = inputs.table(spark, sf, "customer").select("c_custkey", "c_name")
    done = writers.export_formats(table, folder, ["CSV", "json", "unheard-of"])
    a = _read_csv(spark, done["csv"], *table.columns).withColumn("format", F.lit("csv"))
    b = spark.read.schema("c_custkey string, c_name string").json(done["json"]).withColumn("format", F.lit("json"))
    return a.unionByName(b)


@query
def j5_chunks(spark, sf):
    folder = storage.scratch_path(spark, "chunks")
    table = inputs.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    writers.export_chunks(table, folder, "o_orderkey", chunk_size=1000, format_type="json", with_count=True)
    back = spark.read.schema("o_orderkey bigint, o_orderstatus string, chunks bigint, chunk bigint").json(folder)
    return back.withColumn("file", F.col("_metadata.file_path")).groupBy("chunk", "chunks").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"),
        F.count_distinct("file").alias("files"),
    )


@query
def j6_empty(spark, sf):
    """A table filtered down to nothing: the header's names, and how many rows read back from either format."""
    path = storage.scratch_path(spark, "empty")
    nothing = records.filter_records(inputs.items(spark, sf), {"name": "no such name"})
    writers.export(nothing, f"{path}/csv", "csv")
    writers.export(nothing, f"{path}/json", "json")
    header = spark.read.text(f"{path}/csv").select(F.explode(F.split("value", ",")).alias("name"))
    rows = spark.read.option("header", True).schema("description string").csv(f"{path}/csv").agg(F.count(F.lit(1)).alias("n"))
    lines = spark.read.text(f"{path}/json").agg(F.count(F.lit(1)).alias("n"))
    return (
        header.select(F.lit("header").alias("kind"), "name", F.lit(None).cast("bigint").alias("n"))
        .unionByName(rows.select(F.lit("csv").alias("kind"), F.lit(None).cast("string").alias("name"), "n"))
        .unionByName(lines.select(F.lit("json").alias("kind"), F.lit(None).cast("string").alias("name"), "n"))
    )


@query
def j7_json_write(spark, sf):
    path = storage.scratch_path(spark, "configs")
    writers.write_json(stored_catalogue(spark, sf), path)
    return flat_catalogue(spark.read.schema(schemas.CATALOGUE).json(path))


# -- whole jobs ---------------------------------------------------------------------------------


HEADLINES = config(rule("headline", "h1"), rule("page_title", "title"), rule("ad_text", "div.ad"))


@query
def scrape_by_domain(spark, sf):
    """The flagship: pages to typed, cleaned records, counted per host."""
    done = jobs.scrape(pages(spark, sf), HEADLINES, ("url",), STAMP)
    return done.groupBy(urls.domain(F.col("url")).alias("domain")).agg(
        F.count(F.lit(1)).alias("records"),
        F.count("headline").alias("headlines"),
        F.count("ad_text").alias("ads"),
        F.sum(F.length("headline")).alias("headline_chars"),
    )


@query
def scrape_tasks(spark, sf):
    """Stored tasks over stored pages: resolve, walk, extract under each task's own rules."""
    tasks = inputs.tasks(spark, sf).withColumn("pages", F.lit(2))
    found = jobs.scrape_tasks(tasks, pages(spark, sf), stored_catalogue(spark, sf))
    return extract.record_columns(found, {"title": False}).select("task_id", "page_id", "title")


@query
def task_run(spark, sf):
    """The main flow over all pages: two stored pages a task; every third task's rule finds nothing at first,
    and every second of those gets a refined rule that does."""
    stored = pages(spark, sf)
    link = stored.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    anchor = F.concat(F.lit('<a class="next" href="'), F.col("next_url"), F.lit('">next</a>'))
    chained = stored.join(link, "page_id", "left").select(
        "page_id", "url", F.concat(F.coalesce(anchor, F.lit("")), "html").alias("html")
    )
    tasks = inputs.tasks(spark, sf).withColumn("pages", F.lit(2))
    following = F.struct(F.lit("a.next").alias("selector"), F.lit("link").alias("type"), F.lit(None).cast("string").alias("parameter"))

    def configs(rows, selector):
        one = F.struct(*[(selector if n == "selector" else F.lit("title") if n == "name" else F.lit(None)).cast(schemas.SELECTOR[n].dataType).alias(n) for n in schemas.SELECTOR.names])
        return store.stamp(rows.select("task_id", "url", "data_description", F.array(one).alias("selectors"), following.alias("pagination")), F.lit(1.0), "given").select(*schemas.CATALOGUE.names)

    first = configs(tasks, F.when(F.col("page_id") % 3 == 0, F.lit("video")).otherwise(F.lit("h1")))
    refined = configs(tasks.where(F.col("page_id") % 6 == 0), F.lit("h1"))
    done = jobs.run_tasks(tasks, chained, first, {"title": False}, refined, STAMP)
    found = done.records.select("task_id", F.col("page_no").cast("bigint").alias("page_no"), "title")
    left = done.retry.select("task_id", F.lit(None).cast("bigint").alias("page_no"), F.left("prompt", F.lit(11)).alias("title"))
    return found.unionByName(left)


@query
def record_chain(spark, sf):
    """Type, clean, consolidate, dedupe, filter: the library chain on one table."""
    done = jobs.type_and_clean(inputs.items(spark, sf).withColumnRenamed("id", "_ord"), ("_ord",), STAMP)
    merged = records.consolidate_fields(done, keep=("_ord",))
    unique = records.remove_duplicates(merged, "_ord", ["title", "price"])
    kept = records.filter_records(unique, {"price": {"min": 900}, "title": {"regex": "^[a-m]"}})
    return kept.select(F.col("_ord").alias("id"), "title", "price", "rating", "url")


@query
def lineitem_first_per_part(spark, sf):
    """Keep-first over the largest table: one candidate per key and task is shuffled."""
    lines = inputs.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = F.col("l_orderkey") * 1000 + F.col("l_linenumber")
    first = records.remove_duplicates(lines.withColumn("_ord", order), "_ord", ["l_partkey"])
    return first.select("l_partkey", "_ord")


# -- tables that change, records without a schema, SQL ---------------------------------------


@query
def i1_snapshot_versions(spark, sf):
    """Two upserts and a delete on disk; the second and the last version are read."""
    kept = store.catalogue_store(spark, storage.scratch_path(spark, "catalogue"), buckets=16)
    stored = stored_catalogue(spark, sf)
    kept.upsert(stored)
    newer = F.col("metadata").withField("generated_at", F.col("metadata.generated_at") + 10)
    second = kept.upsert(stored.where(F.col("metadata.url").startswith("https")).withColumn("metadata", newer))
    gone = inputs.tasks(spark, sf).where(F.col("url").contains("/en/")).select("task_id")
    store.remove(kept, gone)
    earlier = flat_catalogue(kept.read(second)).withColumn("version", F.lit("second"))
    return earlier.unionByName(flat_catalogue(kept.read()).withColumn("version", F.lit("last")))


@query
def a4_ragged_records(spark, sf):
    """Records whose keys and types differ, read without a schema; absent keys are told from nulls."""
    path = storage.scratch_path(spark, "ragged")
    raw = inputs.table(spark, sf, "part")
    some = F.col("p_partkey") % 3
    line = F.concat(
        F.lit('{"id":'), F.col("p_partkey").cast("string"),
        F.when(some == 0, F.concat(F.lit(',"size":'), F.col("p_size").cast("string"))).when(some == 1, F.lit(',"size":null')).otherwise(F.lit("")),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(',"code":'), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit(',"code":"'), F.col("p_brand"), F.lit('"'))),
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(',"more":{"kind":"'), F.col("p_type"), F.lit('"}'))).otherwise(F.lit("")), F.lit("}"),
    )
    raw.select(line.alias("value")).write.text(path)
    found = ragged.read_ragged(spark, path)
    return ragged.with_fields(found, ragged.observed_schema(found), absent="absent").select(
        "id", "size", "code", F.col("more.kind").alias("kind"), F.array_join("absent", ",").alias("absent")
    )


@query
def d7_merge_maps(spark, sf):
    """Maps on both sides, nested two deep: entries merge one by one."""
    part = inputs.table(spark, sf, "part")
    price = F.col("p_retailprice").cast("double")
    left = part.select("p_partkey", F.create_map(
        F.lit("name"), F.create_map(F.lit("text"), F.col("p_name"), F.lit("brand"), F.col("p_brand")),
        F.lit("kind"), F.create_map(F.lit("text"), F.col("p_type"))).alias("info"), F.create_map(F.lit("a"), price, F.lit("b"), price).alias("sums"))
    even = part.where(F.col("p_partkey") % 2 == 0)
    right = even.select("p_partkey", F.create_map(
        F.lit("name"), F.create_map(F.lit("brand"), F.lit("new"), F.lit("text"), F.lit(None).cast("string")),
        F.lit("extra"), F.create_map(F.lit("text"), F.lit("x"))).alias("info"), F.create_map(F.lit("b"), F.lit(1.0)).alias("sums"))
    merged = records.merge_records(left, right, ["p_partkey"])
    return merged.select(
        "p_partkey", F.col("info.name.text").alias("name"), F.col("info.name.brand").alias("brand"), F.col("info.kind.text").alias("kind"),
        F.col("info.extra.text").alias("extra"), F.col("sums.a").alias("a"), F.col("sums.b").alias("b"),
    )


@query
def j4_formats_agree(spark, sf):
    """Stamped once: both formats hold the same time of processing."""
    folder = storage.scratch_path(spark, "formats")
    stamped = process_records(inputs.items(spark, sf), keep=("id",)).select("id", F.col(f"{METADATA}.processed_at").alias("at"))
    done = writers.export_formats(stamped, folder)
    a = _read_csv(spark, done["csv"], "at", "id").select(F.col("id").cast("bigint").alias("id"), F.col("at").alias("csv_at"))
    b = spark.read.schema("id bigint, at string").json(done["json"])
    return a.join(b, "id").select("id", (F.col("csv_at") == F.col("at")).alias("same"))


@query
def b1_sql_function(spark, sf):
    """The container query in SQL: columns come from the selector list."""
    table_function.register(spark)
    pages(spark, sf).createOrReplaceTempView("stored_pages")
    rules = '[{"name":"title","selector":"h1"},{"name":"links","selector":"nav a","type":"href","multiple":true}]'
    return spark.sql(f"""select p.page_id, e.title, cast(size(e.links) as bigint) as links
        from stored_pages p, lateral extract_items(p.html, '{rules}') e""")


@query
def b8_rules_per_task(spark, sf):
    """Each task has one of three rules, one of them for buttons; a chain over all pages is followed for up to nine pages."""
    stored = pages(spark, sf)
    following = stored.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    marks = F.concat(
        F.lit('<a class="next" href="'), F.col("next_url"), F.lit('">next</a><a rel="more" href="'), F.col("next_url"),
        F.lit("\">more</a><button id=\"go\" onclick=\"location.href='"), F.col("next_url"), F.lit("'\">go</button>"),
    )
    chained = stored.join(following, "page_id", "left").select("page_id", "url", F.concat(F.coalesce(marks, F.lit("")), F.col("html")).alias("html"))
    kind = F.col("page_id") % 3
    rule = F.struct(
        F.when(kind == 0, "a.next").when(kind == 1, "a[rel=more]").otherwise("#go").alias("selector"),
        F.when(kind == 2, "button").otherwise("link").alias("type"), F.lit(None).cast("string").alias("parameter"),
    )
    tasks = stored.select(F.col("page_id").cast("string").alias("task_id"), "url", (F.col("page_id") % 10).cast("int").alias("pages"), rule.alias("pagination"))
    visits = walk.walk_pages(tasks, chained)
    return visits.select(F.col("task_id").cast("bigint").alias("task"), F.col("page_no").cast("bigint").alias("page_no"), "page_id")


@query
def b1_wider_grammar(spark, sf):
    """Selectors as generators write them: negation, counted places, elements that hold others, case put aside."""
    rules = config(
        rule("odd", "nav li:nth-child(2n+1) a", "href", multiple=True), rule("later", "nav li:not(:first-child) > a", "href", multiple=True),
        rule("last", "nav li:nth-last-of-type(1) a", "href"), rule("title", "article:has(> h1) h1:only-of-type, article:is(.none)"),
        rule("charset", 'meta[CHARSET="UTF-8" i]', "attribute", attribute="charset"), rule("none", "nav:has(video) a"),
    )
    found = extract.extract_records(pages(spark, sf), rules, ("page_id",))
    return found.select("page_id", F.array_join("odd", "|").alias("odd"), F.array_join("later", "|").alias("later"), "last", "title", "charset", "none")
