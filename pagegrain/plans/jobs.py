"""The three ways data runs through: a scrape run, a record chain, the feedback loop."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.operators import catalogue as store
from pagegrain.operators import feedback as ratings
from pagegrain.operators.clean import clean_records
from pagegrain.operators.extract import ITEM, extract_by_task, extract_records, record_columns, unusable_rules
from pagegrain.operators.process import process_records
from pagegrain.operators.walk import walk_pages, with_html
from pagegrain.storage import cut_lineage


def scrape(
    pages: DataFrame, config: dict, keep: tuple[str, ...] = ("page_id",), processed_at: str | None = None
) -> DataFrame:
    """Pages to clean typed records under one config: extract, type, clean; no shuffle."""
    kept = (*keep, ITEM)
    records = extract_records(pages, config, keep)
    return clean_records(process_records(records, processed_at, kept), kept)


def scrape_site(
    pages: DataFrame, config: dict, url: str, page_count: int = 1, processed_at: str | None = None
) -> DataFrame:
    """One address, one config: follow its pagination over stored pages, then as ``scrape``."""
    start = pages.sparkSession.range(1).select(
        F.lit(url).alias("task_id"), F.lit(url).alias("url"), F.lit(page_count).alias("pages")
    )
    visits = walk_pages(start, pages, config.get("pagination") or {}, page_count)
    return scrape(with_html(visits, pages), config, ("page_no", "page_id"), processed_at)


def scrape_tasks(tasks: DataFrame, pages: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Walk the pages of every task that has a config and extract its records.

    ``tasks(task_id, url, data_description, pages)``; the result has a ``record`` map
    per row, to be spread with ``extract.record_columns``.
    """
    ready = store.resolve(tasks, catalogue).where(~F.col("to_generate"))
    return extract_by_task(walk_pages(ready, pages), pages, _rules(ready))


def _rules(ready: DataFrame) -> DataFrame:
    """The selectors that resolving chose, once for each task, however often it is asked for or stored."""
    return ready.select("task_id", "selectors").dropDuplicates(["task_id"])


class TaskRun(NamedTuple):
    """What a run over many tasks leaves."""

    records: DataFrame  # typed and clean, with task_id, page_no, page_id and _item
    retry: DataFrame  # tasks with a config but no record, with the prompt to refine it
    to_generate: DataFrame  # tasks without a config, with the prompt to make one
    unusable: DataFrame  # rules that extraction could not use


def run_tasks(
    tasks: DataFrame,
    pages: DataFrame,
    catalogue: DataFrame,
    fields: dict[str, bool],
    refined: DataFrame | None = None,
    processed_at: str | None = None,
) -> TaskRun:
    """The main flow: resolve, walk and extract, retry once, type and clean; export what comes back.

    ``fields`` names the record fields to keep, with whether each is all-of. Tasks that
    gave no record run once more under their config in ``refined``, where there is one;
    those still without a record come back with a prompt to refine their selectors.
    """
    resolved = store.resolve(tasks, catalogue)
    ready = resolved.where(~F.col("to_generate"))
    found = cut_lineage(extract_by_task(walk_pages(ready, pages), pages, _rules(ready)))
    empty = store.to_retry(ready, found)
    unusable = unusable_rules(catalogue)
    if refined is not None:
        again = store.resolve(empty.select(*tasks.columns), refined).where(~F.col("to_generate"))
        more = cut_lineage(extract_by_task(walk_pages(again, pages), pages, _rules(again)))
        found = found.unionByName(more)
        empty = store.to_retry(empty, more)
        unusable = unusable.unionByName(unusable_rules(refined))
    kept = ("task_id", "page_no", "page_id", ITEM)
    rows = record_columns(found, fields).select(*kept, *fields)
    failed = empty.withColumn("feedback", F.lit("No records were found with these selectors."))
    return TaskRun(
        type_and_clean(rows, kept, processed_at),
        store.refine_prompt(failed),
        store.generate_prompt(resolved.where("to_generate")),
        unusable,
    )


def type_and_clean(
    records: DataFrame, keep: tuple[str, ...] = (), processed_at: str | None = None
) -> DataFrame:
    """The record chain: typed pass, then cleaning."""
    return clean_records(process_records(records, processed_at, keep), keep)


def refinement_prompts(entries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """New feedback to prompts for the tasks it rates low."""
    return store.refine_prompt(ratings.to_refine(ratings.new_feedback(entries), catalogue))
