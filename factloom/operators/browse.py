"""Looking at the catalogue: pages of items, one item, and the values a fact takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.registry import Registry
from ..functions.spec import FactSpec, FactType
from .facts import leaf_count

SORTS = {
    "title": lambda: F.lower("sort_title"),
    "year": lambda: F.col("year"),
    "added": lambda: F.col("added_at"),
    "size": lambda: F.col("file_size"),
}
PATH_STATUSES = ("mapped", "unmapped", "missing", "unknown")
ITEM_TYPES = ("movie", "show", "season", "episode")


def _filtered(items, q, path_status, item_type):
    for value, known in ((path_status, PATH_STATUSES), (item_type, ITEM_TYPES)):
        if value and value not in known:
            raise ValueError(f"{value!r} is none of {', '.join(known)}")
    live = items.filter(F.col("deleted_at").isNull())
    if q:
        live = live.filter(F.lower("title").contains(q.lower()))
    if path_status:
        live = live.filter(F.col("path_status") == path_status)
    if item_type:
        live = live.filter(F.col("item_type") == item_type)
    return live


def items(catalogue: DataFrame, registry: Registry, q: str = "", path_status: str = "",
          item_type: str = "", sort: str = "title", descending: bool = False,
          limit: int | None = None, offset: int = 0, columns=None, after=None,
          with_cursor: bool = False) -> DataFrame:
    """Live items with the number of facts each has; ``limit`` and ``offset`` make it a page.

    An offset sorts all rows before the page. For deep pages ``with_cursor`` adds a column
    ``cursor``, the (sort value, item id) of each row; handed in as ``after``, the last one of
    a page is a filter for what follows it, so every page costs the same. Rows that came in
    before the cursor meanwhile are not shown, and none is shown twice.
    """
    if after is not None and offset:
        raise ValueError("a page starts at an offset or after a cursor, not both")
    value = SORTS.get(sort, SORTS["title"])()
    live = _filtered(catalogue, q, path_status, item_type)
    if after is not None:
        live = live.filter(_beyond(value, descending, *after))
    page = live.orderBy(value.desc() if descending else value.asc(), "item_id")
    page = page.offset(offset) if offset else page
    page = page.limit(limit) if limit else page
    shown = [F.col(c) for c in columns or page.columns] + [
        leaf_count(registry, catalogue).alias("fact_count")]
    if with_cursor:
        shown.append(F.struct(value.alias("value"), F.col("item_id")).alias("cursor"))
    return page.select(*shown)


def _beyond(value: Column, descending: bool, last, last_id) -> Column:
    """Rows behind (last, last_id); NULL is the smallest value, ids rise in both directions."""
    later_id = F.col("item_id") > F.lit(last_id)
    if last is None:
        same = value.isNull() & later_id
        return same if descending else same | value.isNotNull()
    bound = F.lit(last)
    further = (value < bound) | value.isNull() if descending else value > bound
    return further | ((value == bound) & later_id)


def total(catalogue: DataFrame, q: str = "", path_status: str = "",
          item_type: str = "") -> DataFrame:
    return _filtered(catalogue, q, path_status, item_type).agg(
        F.count(F.lit(1)).alias("total"))


def detail(catalogue: DataFrame, provenance: DataFrame, item_id) -> DataFrame:
    """An item with one row per provider, each with its ``stale`` flag, by provider."""
    item = catalogue.filter(F.col("item_id") == F.lit(item_id))
    return with_stale(item.join(provenance, "item_id", "left")).orderBy("provider")


def with_stale(joined: DataFrame) -> DataFrame:
    """``stale``: the facts describe another version of the file than the present one."""
    return joined.withColumn("stale", F.coalesce(
        (F.col("input_fp") != "") & (F.col("file_fp") != "")
        & (F.col("input_fp") != F.col("file_fp")), F.lit(False)))


def values(catalogue: DataFrame, spec: FactSpec, needle: str = "", limit: int | None = None,
           vocabulary: DataFrame | None = None) -> DataFrame:
    """(value, n): the values a fact takes in live items, most frequent first.

    The needle is a plain substring. ``vocabulary`` (value) adds values that were not
    observed, with n = 0, behind the observed ones and up to the limit.
    """
    live = catalogue.filter(F.col("deleted_at").isNull())
    raw = F.explode(spec.key) if spec.type is FactType.LIST else F.col(spec.key)
    observed = live.select(raw.alias("_raw")).filter(F.col("_raw").isNotNull())
    text = _as_text(spec)
    counted = observed.filter(_has(text, needle)).groupBy("_raw").agg(
        F.count(F.lit(1)).alias("n"))
    top = counted.orderBy(F.desc("n"), "_raw")
    top = (top.limit(limit) if limit else top).select(text.alias("value"), "n")
    if vocabulary is None:
        return top
    folded = F.lower("value").alias("_folded")
    extra = (
        vocabulary.filter(_has(F.col("value"), needle))
        .groupBy(folded).agg(F.min("value").alias("value"))
        .join(top.select(folded), "_folded", "left_anti")
        .select("value", F.lit(0).cast("bigint").alias("n"))
    )
    both = top.unionByName(extra).orderBy(F.desc("n"), "value")
    return both.limit(limit) if limit else both


def _as_text(spec: FactSpec) -> Column:
    """A value as it is shown and searched: whole numbers without a fraction, flags as 1 and 0."""
    raw = F.col("_raw")
    if spec.type is FactType.NUMBER:
        whole = raw.try_cast("bigint")
        return F.when(whole == raw, whole.cast("string")).otherwise(raw.cast("string"))
    if spec.type is FactType.BOOL:
        return raw.cast("int").cast("string")
    return raw.cast("string")


def _has(value: Column, needle: str) -> Column:
    return F.lower(value).contains(needle.lower()) if needle else F.lit(True)
