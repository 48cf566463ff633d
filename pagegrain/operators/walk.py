"""Pagination walk over stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import urls
from pagegrain.operators.extract import page_items, page_items_by_row, pagination_rule, raw_rule
from pagegrain.storage import broadcast_if_small, cut_lineage, text_bytes

#: Rules of one host that a scan tries on all its pages; with more, pages are read for the rules that reach them.
MOST_RULES = 64


def page_addresses(pages: DataFrame, at: Column | None = None) -> DataFrame:
    """``_at, page_id``: the stored page found under each sanitised address.

    Of several pages with one address the smallest id stays. Only addresses and
    ids are shuffled, and each task sends one row per address.
    """
    at = urls.sanitise_url(F.col("url")) if at is None else at
    return pages.groupBy(at.alias("_at")).agg(F.min("page_id").alias("page_id"))


def _raw_links(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, _rule, _raw``: the attribute a rule needs, for each wanted page and rule."""
    work = pages.select("page_id", "html").join(wanted, "page_id")
    rule = raw_rule(F.col("_rule.selector"), F.col("_rule.type"))
    raw = F.get(F.get(page_items_by_row(F.col("html"), rule), F.lit(0))["raw"], F.lit(0))
    return work.select("page_id", "_rule", raw.alias("_raw"))


def _all_links(pages: DataFrame, pagination: dict) -> DataFrame:
    """``page_id, _raw`` of every page that has the attribute one rule needs: one scan, a narrow table."""
    raw = F.get(page_items(F.col("html"), pagination_rule(pagination)), F.lit(0))["raw"]
    return cut_lineage(pages.select("page_id", raw.alias("_raw")).where(F.col("_raw").isNotNull()))


def _host_rules(tasks: DataFrame) -> DataFrame:
    """``_host, _rules``: the rules of tasks that start on a host, where they are few."""
    rules = tasks.where(F.col("_rule.selector") != "").groupBy(urls.domain(F.col("url")).alias("_host")).agg(F.collect_set("_rule").alias("_rules"))
    return rules.where(F.size("_rules") <= MOST_RULES)


def _host_links(host_rules: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, _rule, _raw`` of every page under all rules of its host: one scan, each page read once."""
    work = pages.select("page_id", "html", urls.domain(F.col("url")).alias("_host")).join(broadcast_if_small(host_rules), "_host")
    named = F.transform("_rules", lambda rule, at: F.struct(
        F.concat(F.lit("r"), at.cast("string")).alias("name"), rule["selector"].alias("selector"), F.lit("attribute").alias("type"),
        F.when(rule["type"] == "button", F.lit("onclick")).otherwise(F.lit("href")).alias("attribute")))
    item = F.get(page_items_by_row(F.col("html"), F.to_json(named)), F.lit(0))
    found = work.select("page_id", "_rules", item.alias("_item")).where(F.col("_item").isNotNull())
    each = found.select("page_id", "_item", F.posexplode("_rules").alias("_at", "_rule"))
    raw = F.get(F.col("_item")[F.concat(F.lit("r"), F.col("_at").cast("string"))], F.lit(0))
    return cut_lineage(each.select("page_id", "_rule", raw.alias("_raw")).where(F.col("_raw").isNotNull()))


class _Steps:
    """Where a rule leads from an address: ``_rule, url, page_id, _next``, for addresses of stored pages."""

    def __init__(self, pages: DataFrame, tasks: DataFrame, pagination: dict | None):
        self.pages, self.fixed = pages, pagination
        # Long expressions, so each is built once.
        self.address = urls.sanitise_url(F.col("url"))
        kind = F.col("_rule.type") if pagination is None else pagination.get("type") or "link"
        self.following = urls.next_page(kind, F.col("url"), F.col("_raw"), F.col("_rule.parameter"))
        self.addresses = cut_lineage(page_addresses(pages, self.address))
        if pagination is not None:
            self.links, self.scanned = _all_links(pages, pagination), None
        else:
            self.scanned = cut_lineage(_host_rules(tasks))
            self.links = _host_links(self.scanned, pages)
        self.on = ["page_id"] if pagination is not None else ["page_id", "_rule"]

    def starts(self, tasks: DataFrame) -> DataFrame:
        """Addresses to begin with: those of tasks, and of every page a rule leads on from."""
        asked = tasks.select("_rule", "url")
        linked = self.links.select(*self.on).join(self.pages.select("page_id", "url"), "page_id")
        if self.fixed is not None:
            linked = linked.select(_rule_column(self.fixed).alias("_rule"), "url")
        return asked.unionByName(linked.select("_rule", "url")).distinct()

    def here(self, states: DataFrame) -> DataFrame:
        """States whose page is stored."""
        return states.withColumn("_at", self.address).join(self.addresses, "_at").drop("_at")

    def of(self, here: DataFrame) -> DataFrame:
        links = self.links
        if self.fixed is None:
            # Pages of other hosts, and of hosts with many rules, are read for the rules that reach them.
            hosts = self.pages.select("page_id", urls.domain(F.col("url")).alias("_host"))
            done = self.scanned.select("_host", F.explode("_rules").alias("_rule"))
            wanted = here.where(F.col("_rule.selector") != "").select("page_id", "_rule").distinct()
            missing = wanted.join(hosts, "page_id").join(done, ["_host", "_rule"], "left_anti").select("page_id", "_rule")
            if not missing.isEmpty():
                missing = cut_lineage(missing)
                size = text_bytes(missing)
                links = links.unionByName(_raw_links(broadcast_if_small(missing, size=size), self.pages))
        linked = here.join(links, self.on, "left").withColumn("_next", F.when(F.col("_raw").isNotNull() & (F.col("_rule.selector") != ""), self.following))
        return linked.select("_rule", "url", "page_id", F.when(F.col("_next") != F.col("url"), F.col("_next")).alias("_next"))

    def table(self, tasks: DataFrame) -> DataFrame:
        """Steps of all addresses that can be met. Those written in another way than their page's are added until there are none."""
        table = fresh = cut_lineage(self.of(self.here(self.starts(tasks))))
        while True:
            target = fresh.where("_next is not null").select("_rule", F.col("_next").alias("url")).distinct()
            new = self.here(target.join(table, ["_rule", "url"], "left_anti"))
            if new.isEmpty():
                return table
            fresh = cut_lineage(self.of(cut_lineage(new)))
            table = table.unionByName(fresh)


def walk_pages(
    tasks: DataFrame,
    pages: DataFrame,
    pagination: dict | None = None,
    max_pages: int | None = None,
) -> DataFrame:
    """Pages each task visits: ``task_id, page_no, url, page_id``.

    ``tasks(task_id, url, pages, pagination)`` start at ``url`` and follow the next-page
    rule up to their ``pages`` (1 if null); with ``pagination`` one rule serves all
    and the column may be missing. A walk ends at a page that is not stored, without
    a next link, or with a link to the same address. Longer loops run to the limit.

    One scan of the pages, for all rules of their host, gives a table of steps: where a
    rule leads from an address. Rounds then double the length of steps and of walks
    alike: two steps of n pages make one of 2n, and it takes the first n pages of a
    walk to the next n. So their number is the logarithm of the longest walk, and they
    join narrow tables of numbers, each checkpointed.
    """
    if pagination is not None and not pagination.get("selector"):
        max_pages = 1
    limit = F.coalesce("pages", F.lit(1)).cast("long")
    limit = limit if max_pages is None else F.least(limit, F.lit(max_pages))
    asked = tasks.select("task_id", limit.alias("_pages"), _rule_column(pagination).alias("_rule"), "url").where("_pages > 0")
    longest = asked.agg(F.max("_pages")).first()[0] or 0
    if longest < 2:
        here = asked.withColumn("_at", urls.sanitise_url(F.col("url"))).join(page_addresses(pages), "_at")
        return here.select("task_id", F.lit(1).alias("page_no"), "url", "page_id")
    # The table is checkpointed, so its rows have the same numbers wherever it is read.
    table = _Steps(pages, asked, pagination).table(asked).withColumn("_from", F.monotonically_increasing_id())
    names = table.select("_rule", "url", "_from")
    to = names.select("_rule", F.col("url").alias("_next"), F.col("_from").alias("_to"))
    jump = cut_lineage(table.where("_next is not null").join(to, ["_rule", "_next"]).select("_from", "_to"))
    visits = asked.join(names, ["_rule", "url"]).select("task_id", "_pages", F.lit(0).cast("long").alias("_no"), F.col("_from").alias("_state"))
    length = 1
    while length < longest:
        visits = cut_lineage(visits)
        further = visits.where(F.col("_no") + length < F.col("_pages")).join(jump, F.col("_state") == F.col("_from"))
        visits = visits.unionByName(further.select("task_id", "_pages", (F.col("_no") + length).alias("_no"), F.col("_to").alias("_state")))
        length *= 2
        if length < longest:
            second = jump.select(F.col("_from").alias("_to"), F.col("_to").alias("_then"))
            jump = jump.join(second, "_to").select("_from", F.col("_then").alias("_to"))
            jump = cut_lineage(jump) if 2 * length < longest else jump
    places = table.select(F.col("_from").alias("_state"), "url", "page_id")
    return visits.join(places, "_state").select("task_id", (F.col("_no") + 1).cast("int").alias("page_no"), "url", "page_id")


def _rule_column(pagination: dict | None) -> Column:
    if pagination is None:
        given = F.col("pagination")
        selector, kind, name = given["selector"], given["type"], given["parameter"]
    else:
        selector, kind, name = (
            F.lit(pagination.get(key)).cast("string") for key in ("selector", "type", "parameter")
        )
    return F.struct(
        F.coalesce(selector, F.lit("")).alias("selector"),
        F.coalesce(kind, F.lit("link")).alias("type"),
        F.coalesce(name, F.lit("page")).alias("parameter"),
    )


def with_html(visits: DataFrame, pages: DataFrame) -> DataFrame:
    """Visits with the markup of their page."""
    return pages.select("page_id", "html").join(broadcast_if_small(visits), "page_id")
