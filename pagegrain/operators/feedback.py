"""Feedback: normalise, look up, average, count issues, list what to refine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain import fixed_values as fixed
from pagegrain.functions import text as texts
from pagegrain.functions import urls, values
from pagegrain.operators.catalogue import one_per_task


def valid_rating(rating: Column) -> Column:
    """Whole-number rating inside the range, else null; a fraction of a number is cut off."""
    number = rating.try_cast("int")
    return F.when(number.between(*fixed.RATING_RANGE), number)


def new_feedback(entries: DataFrame) -> DataFrame:
    """Entries as given (``url, data_description, rating, feedback, timestamp``) to stored rows."""
    return entries.select(
        values.task_id(F.col("url"), F.col("data_description")).alias("task_id"),
        "url",
        "data_description",
        valid_rating(F.col("rating")).alias("rating"),
        "feedback",
        F.col("timestamp").cast("double").alias("timestamp"),
    )


def append_feedback(entries: DataFrame, path: str) -> None:
    new_feedback(entries).write.mode("append").parquet(path)


def _newest_first(feedback: DataFrame) -> DataFrame:
    return feedback.orderBy(
        F.coalesce("timestamp", F.lit(0.0)).desc(), "task_id", "url", "data_description", "feedback", "rating"
    )


def for_task(feedback: DataFrame, task_id: str) -> DataFrame:
    """Feedback of one task, newest first."""
    mine = texts.safe_id(F.col("task_id")) == texts.safe_id(F.lit(task_id))
    return _newest_first(feedback.where(mine))


def for_domain(feedback: DataFrame, domain: str) -> DataFrame:
    """Feedback whose URL holds ``domain`` anywhere, newest first."""
    return _newest_first(feedback.where(F.col("url").contains(domain)))


def recent(feedback: DataFrame, limit: int = 10) -> DataFrame:
    """The newest entries; each task hands on at most ``limit`` rows."""
    return _newest_first(feedback).limit(limit)


def _mean() -> Column:
    return F.coalesce(F.avg("rating"), F.lit(0.0)).alias("average_rating")


def average_rating(feedback: DataFrame, task_id: str | None = None, domain: str | None = None) -> DataFrame:
    """One row: mean of the ratings given, by task if named, else by domain, else all; 0 if none."""
    if task_id:
        feedback = feedback.where(texts.safe_id(F.col("task_id")) == texts.safe_id(F.lit(task_id)))
    elif domain:
        feedback = feedback.where(F.col("url").contains(domain))
    return feedback.agg(_mean())


def average_by_task(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("task_id").agg(_mean(), F.count("rating").alias("ratings"))


def average_by_domain(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy(urls.split_domain(F.col("url")).alias("domain")).agg(
        _mean(), F.count("rating").alias("ratings")
    )


def common_issues(feedback: DataFrame) -> DataFrame:
    """Entries per issue keyword, each entry once per keyword; unseen keywords are absent.

    One aggregate with a counter per keyword: rows are not multiplied, and each
    task sends a single row.
    """
    low = F.lower("feedback")
    counters = [
        F.count(F.when(low.contains(word), 1)).alias(f"c{at}")
        for at, word in enumerate(fixed.ISSUE_KEYWORDS)
    ]
    pairs = F.array(
        *[
            F.struct(F.lit(word).alias("issue"), F.col(f"c{at}").alias("entries"))
            for at, word in enumerate(fixed.ISSUE_KEYWORDS)
        ]
    )
    return feedback.agg(*counters).select(F.inline(pairs)).where("entries > 0")


def to_refine(feedback: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Low-rated entries, once each, with the stored selectors of their task, matched by safe id like every lookup."""
    low = feedback.where(F.col("rating") < fixed.REFINE_BELOW).select(
        "task_id", "url", "data_description", "rating", "feedback", "timestamp"
    )
    stored = one_per_task(catalogue).select("_safe", "selectors", "pagination")
    return low.join(stored, texts.safe_id(F.col("task_id")) == F.col("_safe")).drop("_safe")
