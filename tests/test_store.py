"""Catalogue, feedback, readers, writers and arrivals."""

import json
import logging
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegrain import schemas, storage
from pagegrain.operators import catalogue, feedback
from pagegrain.plans import jobs
from pagegrain.sources import readers, writers
from pagegrain.streaming import arrivals


def entries(spark, data):
    return spark.createDataFrame(data, schemas.FEEDBACK)


RATED = [
    ("t1", "http://a.com/x", "d", 2, "Missing DATA, timeout", 3.0),
    ("t1", "http://a.com/x", "d", 10, "missing data", 5.0),
    ("t-1", "http://b.com/a.com", "d", None, None, 4.0),
    ("t2", "http://b.com", "d", 4, "", None),
]


def test_feedback(spark):
    df = entries(spark, RATED)
    assert [r.timestamp for r in feedback.for_task(df, "t1").collect()] == [5.0, 3.0]
    assert [r.task_id for r in feedback.for_task(df, "t_1").collect()] == ["t-1"]
    assert [r.timestamp for r in feedback.for_domain(df, "a.com").collect()] == [5.0, 4.0, 3.0]
    assert [r.timestamp for r in feedback.recent(df, 2).collect()] == [5.0, 4.0]
    mean = lambda **by: feedback.average_rating(df, **by).first()[0]
    assert (mean(), mean(task_id="t1"), mean(domain="b.com"), mean(task_id="t1", domain="b.com"), mean(task_id="zz")) == (
        16 / 3, 6.0, 4.0, 6.0, 0.0)
    assert {tuple(r) for r in feedback.average_by_task(df).collect()} == {("t1", 6.0, 2), ("t-1", 0.0, 0), ("t2", 4.0, 1)}
    assert {tuple(r) for r in feedback.common_issues(df).collect()} == {("missing data", 2), ("timeout", 1)}


def test_ratings(column):
    given = {"7": 7, " 8 ": 8, "0": None, "11": None, "x": None, "7.5": None, None: None, "10": 10}
    assert column(feedback.valid_rating, list(given)) == list(given.values())
    assert column(feedback.valid_rating, [7.9, 0.5, 10.2, None], "v double") == [7, None, 10, None]


def stored(spark, specs):
    rows = [
        (task, [("f", "h1", "text", "", False, "", None)], ("a", "link", None), (at, url, text, "p", None, None, None))
        for task, url, text, at in specs
    ]
    return spark.createDataFrame(rows, schemas.CATALOGUE)


def test_catalogue(spark):
    base = stored(spark, [("t1", "http://a.com", "x", 1.0), ("t2", "http://a.com", "x", 2.0)])
    newer = stored(spark, [("t1", "http://a.com", "new", 0.5), ("t1", "http://a.com", "newest", 0.7), ("t3", "u", "v", 9.0)])
    saved = catalogue.save(base, newer)
    got = {r.task_id: r.metadata.data_description for r in saved.collect()}
    assert got == {"t1": "newest", "t2": "x", "t3": "v"}
    again = {r.task_id: r.metadata.data_description for r in catalogue.save(saved, newer).collect()}
    assert again == got
    wanted = spark.createDataFrame([("t1",), ("t1",), ("zz",)], "task_id string")
    assert [r.task_id for r in catalogue.get(saved, wanted).collect()] == ["t1"]
    assert {r.task_id for r in catalogue.delete(saved, wanted).collect()} == {"t2", "t3"}
    tasks = spark.createDataFrame([("t1", "u"), ("t9", "u")], "task_id string, url string")
    assert {(r.task_id, r.to_generate) for r in catalogue.resolve(tasks, saved).collect()} == {("t1", False), ("t9", True)}
    assert all(r.to_generate and r.selectors is None for r in catalogue.resolve(tasks, saved, use_saved=False).collect())
    found = spark.createDataFrame([("t1",), ("t1",)], "task_id string")
    assert [r.task_id for r in catalogue.to_retry(tasks, found).collect()] == ["t9"]
    listed = catalogue.listing(saved.unionByName(spark.createDataFrame([("bad", None, None, None)], schemas.CATALOGUE)))
    assert {r.listed_as for r in listed.where("generated_at is null").collect()} == {"unknown"}


def test_refinement(spark):
    base = stored(spark, [("t1", "http://a.com/x", "d", 1.0)])
    work = feedback.to_refine(entries(spark, RATED), base)
    assert [(r.task_id, r.rating) for r in work.collect()] == [("t1", 2)]
    prompt = catalogue.refine_prompt(work).first().prompt
    assert "http://a.com/x" in prompt and '"selector":"h1"' in prompt and "Missing DATA" in prompt
    mine = catalogue.generate_prompt(work, "{url}|{data_description}|{other}").first().prompt
    assert mine == "http://a.com/x|d|{other}"
    stamped = catalogue.stamp(work, F.lit(5.0), "given", F.col("feedback"), F.col("selectors")).first().metadata
    assert stamped.refined and stamped.original_selectors[0].selector == "h1" and stamped.generated_at == 5.0


def test_several_configs_of_a_task_multiply_nothing(spark):
    """An appended catalogue holds old and new configs of a task: the newest readable one is used, once."""
    base = stored(spark, [("t1", "http://a.com/x", "name and price", 1.0), ("t1", "http://a.com/x", "name and price", 3.0), ("t1", "http://a.com/x", "name and price", 2.0)])
    newest = F.when(F.col("metadata.generated_at") == 3.0, "h2").otherwise("h1")
    base = base.withColumn("selectors", F.transform("selectors", lambda rule: rule.withField("selector", newest)))
    base = base.unionByName(spark.createDataFrame([("t1", None, None, None), ("t2", None, None, None), ("t2", None, None, None)], schemas.CATALOGUE))
    tasks = spark.createDataFrame([("t1", "http://a.com/x", 1), ("t2", "http://a.com/x", 1)], "task_id string, url string, pages int")
    resolved = sorted((r.task_id, r.to_generate, r.selectors and r.selectors[0].selector) for r in catalogue.resolve(tasks, base).collect())
    assert resolved == [("t1", False, "h2"), ("t2", True, None)]
    assert [(r.timestamp, r.selectors[0].selector) for r in feedback.to_refine(entries(spark, RATED), base).where("task_id = 't1'").collect()] == [(3.0, "h2")]
    requests = spark.createDataFrame([("http://a.com", "name and price now")], "url string, data_description string")
    assert [(r.match_task_id, r.selectors[0].selector) for r in catalogue.find_similar(requests, base).collect()] == [("t1", "h2")]
    pages = spark.createDataFrame([(1, "http://a.com/x", "<h1>one</h1><h2>two</h2>")], schemas.PAGES)
    found = jobs.scrape_tasks(tasks.unionByName(tasks.where("task_id = 't1'")), pages, base)
    assert [(r.task_id, r.record) for r in found.collect()] == [("t1", {"f": ["two"]})] * 2


def best_by_hand(url, text, rows):
    """Compare with every stored row of the host."""
    host = lambda u: u.split("//")[-1].split("/")[0]
    words = set(text.lower().split())
    best = (0.5, None)
    for task, stored_url, stored_text, _ in sorted(rows):
        theirs = set(stored_text.lower().split())
        if host(stored_url) == host(url) and words and theirs:
            score = len(words & theirs) / max(len(words), len(theirs))
            if score > best[0]:
                best = (score, task)
    return best[1] and (best[1], best[0])


@pytest.mark.parametrize("common", [0, 6, 50])
def test_similar_equals_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(catalogue, "COMMON", common)
    rng = random.Random(7)
    vocabulary = [f"w{at}" for at in range(12)] + ["the", "of", "data"]
    host = lambda: rng.choice(["http://hot.com/x", "http://hot.com/y", "http://b.com", "c.com/z"])
    text = lambda: " ".join(rng.choices(vocabulary, k=rng.randint(0, 7))).title()
    rows = [(f"t{at:03}", host(), text(), 1.0) for at in range(150)] + [(f"u{at}", "http://hot.com", "the data", 1.0) for at in range(60)]
    asked = [(at, host(), text()) for at in range(200)] + [(1000 + at, "http://hot.com", "Data The") for at in range(100)]
    requests = spark.createDataFrame(asked, "id int, url string, data_description string")
    got = {r.id: (r.match_task_id, r.score) for r in catalogue.find_similar(requests, stored(spark, rows)).collect()}
    expected = {at: best_by_hand(url, words, rows) for at, url, words in asked}
    assert got == {at: match for at, match in expected.items() if match}
    assert any(match is None for match in expected.values()) and len(set(got.values())) > 20


def test_threshold_is_strict(spark):
    rows = [("t", "http://a.com", "product titles and prices", 1.0)]
    requests = spark.createDataFrame([("http://a.com", "product titles")], "url string, data_description string")
    assert catalogue.find_similar(requests, stored(spark, rows)).count() == 0


def test_similar_pairs_no_whole_groups(spark):
    rows = stored(spark, [("t", "http://a.com", "a b", 1.0)])
    requests = spark.createDataFrame([("http://a.com", "a b c")], "url string, data_description string")
    plan = catalogue.find_similar(requests, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "CartesianProduct" not in plan


def test_responses(column):
    run = lambda text: column(catalogue.parse_response, [text])[0]
    fenced = run('x\n```json\n{"selectors":[{"name":"a","selector":"b","multiple":true}]}\n```')
    assert fenced.selectors[0].selector == "b" and fenced.pagination is None
    assert run('text {"selectors":[],"pagination":{"selector":"x","type":"link"}} more').pagination.selector == "x"
    for bad in ("nothing", "{", '{"selectors": [}', "```json\n{} trailing\n```", "[1]", "```json\n{} {}\n```"):
        config = run(bad)
        assert config.selectors == [] and (config.pagination.selector, config.pagination.type) == ("", "link"), bad


def test_bad_response_keeps_the_old_config(spark):
    base = stored(spark, [("t1", "http://a.com", "d", 1.0)]).withColumn("answer", F.lit("no json"))
    old = F.struct("selectors", "pagination")
    assert base.select(catalogue.parse_response(F.col("answer"), old).alias("c")).first().c.selectors[0].selector == "h1"


def test_readers(spark, tmp_path):
    folder = tmp_path / "configs"
    folder.mkdir()
    (folder / "t1.json").write_text(json.dumps({"selectors": [{"name": "a", "selector": "b"}], "metadata": {"generated_at": 5}}, indent=2))
    (folder / "t2.json").write_text("{broken")
    found = {r.task_id: r for r in readers.read_catalogue(spark, str(folder)).collect()}
    assert found["t1"].selectors[0].selector == "b" and found["t1"].metadata.generated_at == 5.0
    assert found["t2"].selectors is None and found["t2"].metadata is None
    ratings = tmp_path / "ratings"
    ratings.mkdir()
    (ratings / "a.json").write_text(json.dumps({"task_id": "t", "rating": 3}, indent=1))
    (ratings / "b.json").write_text("not json")
    assert {(r.task_id, r.rating, r[readers.BAD]) for r in readers.read_feedback(spark, str(ratings)).collect()} == {
        ("t", 3, None), (None, None, "not json")}
    kind = T.StructType([T.StructField("a", T.LongType())])
    (tmp_path / "records.json").write_text('[\n {"a": 1},\n {"b": 2}\n]')
    assert [r.a for r in readers.read_records(spark, str(tmp_path / "records.json"), kind).collect()] == [1, None]
    missing = readers.read_records(spark, str(tmp_path / "none.json"), kind)
    assert missing.count() == 0 and missing.columns == ["a"]


def test_csv_text(spark, tmp_path):
    df = spark.createDataFrame([(' "q", é ', None, True, ["x"], ("y", None))], "b string, a string, flag boolean, l array<string>, s struct<u:string,v:string>")
    path = writers.export(df.coalesce(1), str(tmp_path / "out"), "CSV")
    [name] = [n for n in os.listdir(path) if n.endswith(".csv")]
    text = (tmp_path / "out" / name).read_text(encoding="utf-8")
    assert text == 'a,b,flag,l,s\n,"  ""q"", é ",True,"[""x""]","{""u"":""y"",""v"":null}"\n'.replace('"  ""q', '" ""q')


def test_json_text_and_unknown_format(spark, tmp_path):
    df = spark.createDataFrame([("é", None)], "b string, a string").coalesce(1)
    path = writers.write_json(df, str(tmp_path / "j"))
    [name] = [n for n in os.listdir(path) if n.endswith(".json")]
    assert (tmp_path / "j" / name).read_text(encoding="utf-8") == '{"b":"é","a":null}\n'
    writers.export(df, str(tmp_path / "x"), "parquetish")
    assert any(n.endswith(".csv") for n in os.listdir(tmp_path / "x"))


def test_one_failing_format_does_not_stop_the_others(spark, tmp_path, caplog):
    df = spark.range(3).selectExpr("id", "cast(id as string) as t")
    (tmp_path / "csv").mkdir()
    with caplog.at_level(logging.CRITICAL):
        done = writers.export_formats(df, str(tmp_path), ["csv", "excel", "JSON"])
    assert list(done) == ["json"] and spark.read.json(done["json"]).count() == 3


def test_chunks_and_parts(spark, tmp_path):
    df = spark.range(25).selectExpr("id", "id * 2 as v")
    writers.export_chunks(df, str(tmp_path / "c"), "id", chunk_size=10)
    sizes = {}
    for part in sorted(os.listdir(tmp_path / "c")):
        if part.startswith("chunk="):
            [name] = [n for n in os.listdir(tmp_path / "c" / part) if n.endswith(".csv")]
            sizes[part] = (tmp_path / "c" / part / name).read_text().split()
    assert {k: len(v) - 1 for k, v in sizes.items()} == {"chunk=0": 10, "chunk=1": 10, "chunk=2": 5}
    assert sizes["chunk=1"][:2] == ["id,v", "10,20"]
    writers.export_parts(df.coalesce(1), str(tmp_path / "p"), 10, "json")
    assert len([n for n in os.listdir(tmp_path / "p") if n.endswith(".json")]) == 3


def test_empty_output_reads_back(spark, tmp_path):
    df = spark.createDataFrame([], "b string, a int")
    writers.export(df, str(tmp_path / "e"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).columns == ["a", "b"]
    writers.export(df, str(tmp_path / "j"), "json")
    assert spark.read.schema("a int").json(str(tmp_path / "j")).count() == 0


def test_shared_folder_follows_the_session(spark):
    own = storage.shared_folder(spark)
    assert own == spark.conf.get("spark.checkpoint.dir", None) or own == spark.sparkContext.getCheckpointDir()
    assert storage.scratch_path(spark, "x").startswith(own.rstrip("/"))
    assert storage.scratch_path(spark, "x") != storage.scratch_path(spark, "x")


def test_arrivals(spark, tmp_path, sf):
    folder, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    os.mkdir(folder)

    def rate(name, rating):
        with open(f"{folder}/{name}.json", "w") as out:
            json.dump({"url": "u", "data_description": "d", "rating": rating, "feedback": "f", "timestamp": 1.0}, out, indent=1)

    rate("a", "7")
    arrivals.append_new_feedback(spark, folder, table, state).awaitTermination()
    rate("b", "99")
    arrivals.append_new_feedback(spark, folder, table, state).awaitTermination()
    assert sorted(str(r.rating) for r in spark.read.schema(schemas.FEEDBACK).parquet(table).collect()) == ["7", "None"]

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages.write.parquet(str(tmp_path / "pages"))
    config = {"selectors": [{"name": "headline", "selector": "h1"}]}
    arrivals.append_new_records(spark, str(tmp_path / "pages"), config, str(tmp_path / "r"), str(tmp_path / "rs")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "r")).count() == pages.count()

def test_similar_sends_no_sets_through_the_driver(spark, tmp_path):
    """Small files can hold any number of templated texts, so their size must not make Spark broadcast sets."""
    stored(spark, [(f"t{at}", "http://a.com", f"name price size of number {at}", 1.0) for at in range(300)]).write.parquet(f"{tmp_path}/stored")
    asked = [(at, "http://a.com", f"name price size of number r{at}") for at in range(300)]
    spark.createDataFrame(asked, "id int, url string, data_description string").write.parquet(f"{tmp_path}/asked")
    found = catalogue.find_similar(spark.read.parquet(f"{tmp_path}/asked"), spark.read.parquet(f"{tmp_path}/stored"))
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert all("family" in line and "BuildRight" in line for line in plan if "BroadcastHashJoin" in line)  # widths by host only
    assert {r.id: (r.match_task_id, r.score) for r in found.collect()} == {at: ("t0", 5 / 6) for at in range(300)}
