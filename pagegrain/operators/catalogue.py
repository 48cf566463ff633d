"""Selector catalogue: upsert, look up, similar tasks, prompts and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegrain import fixed_values as fixed
from pagegrain import schemas
from pagegrain.functions import text as texts
from pagegrain.functions import urls, values
from pagegrain.operators.records import first_per_key
from pagegrain.operators.set_join import best_overlaps
from pagegrain.sources.snapshots import Snapshots
from pagegrain.storage import cut_lineage


def _safe(name: str = "task_id") -> Column:
    return texts.safe_id(F.col(name))


def _newest(catalogue: DataFrame) -> list[Column]:
    """Order of several configs of a task."""
    timed = "generated_at" in catalogue.schema["metadata"].dataType.names
    at = [F.col("metadata.generated_at").desc_nulls_last()] if timed else []
    return [*at, F.xxhash64(F.to_json(F.struct("selectors", "pagination")))]


def _there() -> Column:
    """Whether a config has any part; an unreadable file leaves none."""
    return F.col("selectors").isNotNull() | F.col("pagination").isNotNull() | F.col("metadata").isNotNull()


def one_per_task(catalogue: DataFrame) -> DataFrame:
    """A task's one config, with its safe id in ``_safe``: of several, as appended tables hold them, the newest readable one, as ``save`` keeps it."""
    known = catalogue.withColumn("_safe", _safe())
    return first_per_key(known, [F.col("_safe")], [_there().desc(), *_newest(catalogue)])


def save(catalogue: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by task; of several incoming rows of a task the newest wins.

    One pass over both tables instead of an anti join and a union: any incoming
    row comes before the stored one, and each task thins its rows before the shuffle.
    """
    stored = catalogue.withColumn("_new", F.lit(0))
    fresh = incoming.select(*catalogue.columns).withColumn("_new", F.lit(1))
    return first_per_key(stored.unionByName(fresh), [_safe()], [F.col("_new").desc(), *_newest(catalogue)]).drop("_new")


def get(catalogue: DataFrame, task_ids: DataFrame) -> DataFrame:
    """Stored configs of a batch of tasks."""
    wanted = task_ids.select(_safe().alias("_safe")).distinct()
    return catalogue.join(wanted, _safe() == F.col("_safe"), "left_semi")


def listing(catalogue: DataFrame) -> DataFrame:
    """Task and time of generation, ``unknown`` where there is none."""
    seconds = F.col("metadata.generated_at")
    return catalogue.select(
        "task_id",
        seconds.alias("generated_at"),
        F.coalesce(seconds.cast("decimal(20,6)").cast("string"), F.lit("unknown")).alias("listed_as"),
    )


def delete(catalogue: DataFrame, task_ids: DataFrame) -> DataFrame:
    gone = task_ids.select(_safe().alias("_safe")).distinct()
    return catalogue.join(gone, _safe() == F.col("_safe"), "left_anti")


def catalogue_store(spark: SparkSession, folder: str, buckets: int = 64) -> Snapshots:
    """The catalogue on disk: ``upsert`` saves configs, ``read`` gives any version; see ``remove``."""
    return Snapshots(spark, folder, schemas.CATALOGUE, _safe(), save, buckets)


def remove(store: Snapshots, task_ids: DataFrame) -> int:
    return store.delete(task_ids, delete)


# -- similar tasks ----------------------------------------------------------------


def word_set(text: Column) -> Column:
    """Sorted distinct lower-case words."""
    words = F.filter(F.split(texts.collapse(F.lower(text)), " "), lambda word: word != "")
    return F.array_sort(F.array_distinct(words))


def similarity(a: Column, b: Column) -> Column:
    """Shared words over the size of the larger set."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))


#: A word that more stored sets of a host hold than this is common there.
COMMON = 50


def _parts(sets: DataFrame, counts: DataFrame, *carried: str) -> DataFrame:
    """Each set with its common words, rarest first, and its other words; ``counts`` has the common ones only."""
    known = sets.select("domain", "words", *carried, F.explode("words").alias("word")).join(
        counts, ["domain", "word"], "left"
    )
    ranked = F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "word"))))
    return known.groupBy("domain", "words", *carried).agg(
        F.transform(ranked, lambda pair: pair["word"]).alias("common"),
        F.collect_list(F.when(F.col("n").isNull(), F.col("word"))).alias("rare"),
    )


def _fit(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can share over half of the larger one."""
    return (a * 2 > b) & (b * 2 > a)


def _by_rare_words(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """Scored pairs that share a word which at most ``COMMON`` stored sets of the host hold.

    A pair is scored at its first such word only.
    """
    a = asked.select("domain", "words", F.col("rare").alias("a_rare"), F.explode("rare").alias("word"))
    b = stored.select("domain", F.col("words").alias("b_words"), "task_id", F.col("rare").alias("b_rare"), F.explode("rare").alias("word"))
    first = F.col("word") == F.array_min(F.array_intersect("a_rare", "b_rare"))
    pairs = a.join(b.hint("merge"), ["domain", "word"]).where(_fit(F.size("words"), F.size("b_words")) & first)
    return pairs.select("domain", "words", "task_id", similarity(F.col("words"), F.col("b_words")).alias("score"))


def _by_common_words(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """Scored pairs by their common words alone, once per distinct (common words, size).

    Sets made from one template differ in rare words only, so they are one class on
    either side.
    """
    own = asked.select("domain", "words", "common", F.size("words").alias("size"))
    classes = own.select("domain", "common", "size").distinct()
    kept = stored.groupBy("domain", "common", F.size("words").alias("size")).agg(F.min("task_id").alias("task_id"))
    best = best_overlaps(classes, kept, fixed.SIMILARITY_THRESHOLD)
    return own.join(best.hint("merge"), ["domain", "common", "size"]).select("domain", "words", "task_id", "score")


def find_similar(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Best stored config of the same host whose description shares over half its words.

    ``requests(url, data_description, ...)`` in, the requests that have a match out,
    with ``match_task_id``, ``score``, ``selectors`` and ``pagination``. Ties go to the
    smallest task id, and of several configs of a task the newest is given.

    Both sides first shrink to distinct (host, word set) pairs, so a description
    that fills a third of the rows is compared once. Equal sets meet in a plain
    equi-join. Other pairs either share a word that few stored sets of the host hold,
    and meet there, or share common words alone; then their score depends on these
    and the sizes only, and whole classes of sets are compared at once. The better of
    the two is the exact best match, and no full host group is paired with another.

    Texts that follow a template fill a hundred times their size on disk, so Spark would take
    tables of any number of sets for small and send them through the driver: joins of sets merge.
    """
    asked = requests.withColumns(
        {
            "_domain": urls.split_domain(F.col("url")),
            "_words": word_set(F.col("data_description")),
        }
    )
    stored = (
        catalogue.select(
            urls.split_domain(F.coalesce("metadata.url", F.lit(""))).alias("domain"),
            word_set(F.coalesce("metadata.data_description", F.lit(""))).alias("words"),
            "task_id",
        )
        .where(F.size("words") > 0)
        .groupBy("domain", "words")
        .agg(F.min("task_id").alias("task_id"))
    )
    # Both small forms are used several times below; compute each once.
    stored = cut_lineage(stored)
    sets = asked.select(F.col("_domain").alias("domain"), F.col("_words").alias("words"))
    sets = cut_lineage(sets.where(F.size("words") > 0).distinct())

    equal = sets.join(stored.hint("merge"), ["domain", "words"]).select(
        "domain", "words", F.lit(1.0).alias("score"), "task_id"
    )
    rest = sets.join(stored.hint("merge"), ["domain", "words"], "left_anti")
    counts = stored.select("domain", F.explode("words").alias("word")).groupBy("domain", "word").agg(
        F.count(F.lit(1)).alias("n")
    ).where(F.col("n") > COMMON)
    asked_parts, stored_parts = cut_lineage(_parts(rest, counts)), cut_lineage(_parts(stored, counts, "task_id"))
    scored = _by_rare_words(asked_parts, stored_parts).unionByName(_by_common_words(asked_parts, stored_parts))
    scored = scored.where(F.col("score") > fixed.SIMILARITY_THRESHOLD)
    near = (
        scored.groupBy("domain", "words")
        .agg(F.min(F.struct((-F.col("score")).alias("minus"), "task_id")).alias("best"))
        .select("domain", "words", (-F.col("best.minus")).alias("score"), "best.task_id")
    )
    best = equal.unionByName(near).select(
        F.col("domain").alias("_domain"), F.col("words").alias("_words"), "score",
        F.col("task_id").alias("match_task_id"),
    )
    newest = first_per_key(catalogue, [F.col("task_id")], [_there().desc(), *_newest(catalogue)])
    configs = newest.select(F.col("task_id").alias("match_task_id"), "selectors", "pagination")
    return (
        asked.join(best.hint("merge"), ["_domain", "_words"])
        .drop("_domain", "_words")
        .join(configs.hint("merge"), "match_task_id")
    )


# -- life of a task ------------------------------------------------------------------


def with_task_id(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("task_id", values.task_id(F.col("url"), F.col("data_description")))


def resolve(tasks: DataFrame, catalogue: DataFrame, use_saved: bool = True) -> DataFrame:
    """Tasks with their stored config, ``to_generate`` where there is none to use.

    A stored config without any part, as an unreadable file leaves it, counts as
    none; one with an empty list of selectors is a config. A task has one row here for
    each it has in ``tasks``, however many configs are stored for it (see ``one_per_task``).
    """
    known = one_per_task(catalogue).select("_safe", "selectors", "pagination", (F.lit(use_saved) & _there()).alias("_saved"))
    joined = tasks.join(known, _safe() == F.col("_safe"), "left")
    missing = ~F.coalesce("_saved", F.lit(False))
    return joined.select(
        *tasks.columns,
        F.when(~missing, F.col("selectors")).alias("selectors"),
        F.when(~missing, F.col("pagination")).alias("pagination"),
        missing.alias("to_generate"),
    )


def to_retry(tasks: DataFrame, records: DataFrame) -> DataFrame:
    """Tasks whose extraction gave no record."""
    return tasks.join(records.select("task_id").distinct(), "task_id", "left_anti")


# -- prompts and responses ---------------------------------------------------------------

GENERATE = (
    "Write CSS selectors for the page {url} that extract: {data_description}\n"
    "Name every field, give its selector, its type and any clean-up it needs.\n"
    "Answer with JSON alone, in this shape:\n{shape}"
)
REFINE = (
    "Improve the CSS selectors used on the page {url} to extract: {data_description}\n"
    "Current selectors:\n{selectors}\nCurrent pagination:\n{pagination}\n"
    "What went wrong:\n{feedback}\n"
    "Answer with JSON alone, in this shape:\n{shape}"
)


def _fill(template: str, parts: dict[str, Column]) -> Column:
    """Column text from a template with ``{name}`` places."""
    pieces: list[Column] = []
    rest = template
    while rest:
        hits = [(rest.find("{" + name + "}"), name) for name in parts if "{" + name + "}" in rest]
        at, name = min(hits, default=(len(rest), ""))
        if at:
            pieces.append(F.lit(rest[:at]))
        if name:
            pieces.append(parts[name])
        rest = rest[at + len(name) + 2 :] if name else ""
    return F.concat(*pieces)


def generate_prompt(tasks: DataFrame, template: str = GENERATE) -> DataFrame:
    """Add ``prompt`` for tasks that need selectors; the wording is a parameter."""
    parts = {
        "url": F.col("url"),
        "data_description": F.col("data_description"),
        "shape": F.lit(fixed.RESPONSE_SHAPE),
    }
    return tasks.withColumn("prompt", _fill(template, parts))


def refine_prompt(work: DataFrame, template: str = REFINE) -> DataFrame:
    """Add ``prompt`` for tasks whose selectors need work (see ``feedback.to_refine``)."""
    parts = {
        "url": F.col("url"),
        "data_description": F.col("data_description"),
        "selectors": F.coalesce(F.to_json("selectors"), F.lit("[]")),
        "pagination": F.coalesce(F.to_json("pagination"), F.lit("{}")),
        "feedback": F.coalesce("feedback", F.lit("None")),
        "shape": F.lit(fixed.RESPONSE_SHAPE),
    }
    return work.withColumn("prompt", _fill(template, parts))


def response_json(response: Column) -> Column:
    """The JSON part of a model response: a fenced block, else the widest braces, else all."""
    fenced = response.rlike(fixed.RESPONSE_FENCE)
    braced = response.rlike(fixed.RESPONSE_OBJECT)
    return (
        F.when(fenced, F.regexp_extract(response, fixed.RESPONSE_FENCE, 1))
        .when(braced, F.regexp_extract(response, fixed.RESPONSE_OBJECT, 1))
        .otherwise(response)
    )


def parse_response(response: Column, fallback: Column | None = None) -> Column:
    """Config struct of a response; on bad JSON the ``fallback`` config or an empty one.

    Flags may come as ``true``, ``"true"`` or ``1``: they are read as text and
    turned into booleans by what they say.
    """
    loose = T.StructType(
        [T.StructField(f.name, T.StringType()) for f in schemas.SELECTOR]  # flags among them
    )
    config_type = T.StructType(
        [T.StructField("selectors", T.ArrayType(loose)), T.StructField("pagination", schemas.PAGINATION)]
    )
    text = response_json(response)
    parsed = F.from_json(text, config_type, {"mode": "PERMISSIVE"})
    empty = F.struct(
        F.array().cast(schemas.CONFIG["selectors"].dataType).alias("selectors"),
        F.struct(
            F.lit("").alias("selector"), F.lit("link").alias("type"), F.lit(None).cast("string").alias("parameter")
        ).alias("pagination"),
    )

    def flag(value: Column) -> Column:
        said = F.lower(F.trim(value))
        return F.when(said.isNotNull(), ~said.isin("", "false", "0", "0.0", "no", "none", "null", "[]", "{}"))

    def typed(rule: Column) -> Column:
        flags = {f.name for f in schemas.SELECTOR if isinstance(f.dataType, T.BooleanType)}
        return F.struct(*[(flag(rule[n]) if n in flags else rule[n]).alias(n) for n in schemas.SELECTOR.names])

    # One JSON object and nothing behind it.
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    strict = F.try_parse_json(text).isNotNull() & F.json_object_keys(text).isNotNull()
    good = F.coalesce(strict & alone, F.lit(False))
    rules = F.filter(parsed["selectors"], lambda rule: rule.isNotNull())
    config = F.struct(F.transform(rules, typed).alias("selectors"), parsed["pagination"].alias("pagination"))
    return F.when(good, config).otherwise(empty if fallback is None else fallback)


def stamp(
    configs: DataFrame,
    generated_at: Column,
    provider: str,
    feedback: Column | None = None,
    original: Column | None = None,
) -> DataFrame:
    """Add ``metadata`` to configs; with ``feedback`` they are marked as refined."""
    refined = feedback is not None
    nothing = F.lit(None)
    kind = schemas.METADATA
    return configs.withColumn(
        "metadata",
        F.struct(
            generated_at.cast("double").alias("generated_at"),
            F.col("url").alias("url"),
            F.col("data_description").alias("data_description"),
            F.lit(provider).alias("provider"),
            (F.lit(True) if refined else nothing.cast("boolean")).alias("refined"),
            (feedback if refined else nothing.cast("string")).alias("feedback"),
            (nothing if original is None else original)
            .cast(kind["original_selectors"].dataType)
            .alias("original_selectors"),
        ),
    )
