"""A file per row: what the driver lists at once, and that no row or file is lost on the way."""

import json

from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameReader

from checks.queries import QUERIES
from pagegrain import schemas
from pagegrain.sources import readers, writers


def test_no_read_of_the_broken_files_lists_them_all(spark, tmp_path, monkeypatch):
    n, reads = 200, {"text": [], "json": []}
    for kind, seen in reads.items():
        def spied(self, *args, _read=getattr(DataFrameReader, kind), _seen=seen, **more):
            _seen.append(_read(self, *args, **more))
            return _seen[-1]

        monkeypatch.setattr(DataFrameReader, kind, spied)
    monkeypatch.setattr(writers, "SHELF", 10, raising=False)
    monkeypatch.setattr(readers, "SHELVES_AT_ONCE", 7, raising=False)
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("https://a.com/"), "id").alias("url"), F.lit("<h1>x</h1>").alias("html"))
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    rows = QUERIES["a2_broken_files"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == [(False, True, n // 5), (True, False, n - n // 5)]
    for seen in reads.values():
        listed = [len(df.inputFiles()) for df in seen]
        assert sum(listed) == n and max(listed) <= 100


def test_no_page_makes_no_file(spark, tmp_path):
    spark.createDataFrame([], schemas.PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["a2_broken_files"](spark, str(tmp_path)).collect() == []


def test_each_row_is_a_file_with_a_name_of_its_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "SHELF", 7, raising=False)
    monkeypatch.setattr(readers, "SHELVES_AT_ONCE", 3, raising=False)
    texts = spark.range(100).select(F.when(F.col("id") % 9 == 0, "{broken").otherwise(F.to_json(F.struct(F.array(F.struct(F.col("id").cast("string").alias("selector"))).alias("selectors")))))
    path = writers.write_each(texts, f"{tmp_path}/configs")
    files = sorted(tmp_path.glob("configs/shelf=*/part-*"))
    assert len({f.name for f in files}) == len(files) == 100
    found = {r.task_id: r.selectors for r in readers.read_catalogue(spark, path).collect()}
    assert found.keys() == {f.name for f in files}
    for f in files:
        said = f.read_text().strip()
        assert (found[f.name] is None) if said == "{broken" else found[f.name][0].selector == json.loads(said)["selectors"][0]["selector"]


def test_shelves_of_task_files_read_like_one_folder(spark, tmp_path):
    one = {"selectors": [{"name": "a", "selector": "b", "multiple": True}], "pagination": {"selector": "n", "type": "link"}, "metadata": {"generated_at": 5, "original_selectors": [{"name": "o"}]}}
    said = {f"t{n}.json": text for n, text in enumerate([json.dumps(one, indent=2), "{", "", "[]", "null", json.dumps({"selectors": []}), json.dumps([one, one])])}
    for n, (name, text) in enumerate(said.items()):
        for folder in (tmp_path / "flat", tmp_path / "shelves" / f"shelf={n % 3}"):
            folder.mkdir(parents=True, exist_ok=True)
            (folder / name).write_text(text)
    flat, shelves = (readers.read_catalogue(spark, str(tmp_path / kind)) for kind in ("flat", "shelves"))
    assert flat.dtypes == shelves.dtypes and flat.columns == schemas.CATALOGUE.names
    assert sorted(flat.collect(), key=str) == sorted(shelves.collect(), key=str) and flat.count() == 6
