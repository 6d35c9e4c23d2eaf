"""Facts of a parent (show) rolled up from its children (episodes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ...functions.joins import left_lookup
from ...functions.lookup import constant, in_order
from ...functions.scalars import emitted, or_empty, truthy
from ...functions.spec import enum, flag, measure, words
from ..store import Store
from .base import Provider

# Worst first; the share from which a show counts as finished.
WORST_FIRST = ("sd", "720p", "1080p", "4k", "other")
FINISHED_PERCENT = 90

# Sets of texts per parent, and the facts of its children that they are of.
SETS = {"resolutions": "derived.resolution_class", "hdr": "video.hdr_format", "aspects": "video.aspect_bucket"}
LANGUAGES = "audio.languages"
# A set of up to so many values is added up as the bits of a number.
BITS = 63
# So many touched parents are sent to every task, where the others' children are left out.
FEW_PARENTS = 100_000

TOTALS_SCHEMA = (
    "parent_key string, episodes bigint, size bigint, seconds double, min_rate double, "
    "max_rate double, mean_rate double, resolutions array<string>, hdr array<string>, "
    "aspects array<string>, languages array<string>, version bigint"
)


def children_by_parent(items: DataFrame) -> DataFrame:
    """One row per parent over its live episodes.

    Everything is an aggregate with a partial step, the sets too: what is shuffled per
    parent and task is one row, however many children a parent has. Languages are counted
    apart, one by one, since the distinct lists could be many; both results are already
    partitioned by parent when they meet.
    """
    episodes = _episodes(items)
    scalars = episodes.groupBy("parent_key").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.sum(F.coalesce("file_size", F.lit(0))).alias("size"),
        *_rates("file.duration_s", "file.bitrate_kbps"),
        *[_set(fact).alias(name) for name, fact in SETS.items()],
    )
    languages = union_of_lists(episodes, "parent_key", LANGUAGES, "languages")
    return scalars.join(languages, "parent_key", "left")


def _episodes(items: DataFrame) -> DataFrame:
    return items.filter(
        F.col("deleted_at").isNull() & (F.col("item_type") == "episode")
        & F.col("parent_key").isNotNull())


def _rates(duration: str, rate: str) -> list[Column]:
    return [F.sum(duration).alias("seconds"), F.min(rate).alias("min_rate"),
            F.max(rate).alias("max_rate"), F.avg(rate).alias("mean_rate")]


def union_of_lists(items: DataFrame, parent: str, key: str, out: str) -> DataFrame:
    """Per parent the sorted set of the elements of a list fact; empty texts are dropped."""
    elements = items.select(parent, F.explode(key).alias("_e"))
    return elements.groupBy(parent).agg(_set("_e").alias(out))


def _set(name: str) -> Column:
    value = F.col(name)
    return F.array_sort(F.collect_set(F.when(value != "", value)))


def totals_store(spark: SparkSession, path: str, buckets: int | None = None) -> Store:
    """Totals of parents on disk, bucketed by parent; see ``keep_up``."""
    return Store.open(spark, path, TOTALS_SCHEMA, ("parent_key",), "version", buckets)


def touched_parents(*changed: DataFrame) -> DataFrame:
    """``parent_key`` of changed children, once each.

    Give the children as they were and as they are: one that moved touches both parents.
    """
    keys = [rows.select("parent_key") for rows in changed]
    every = keys[0]
    for more in keys[1:]:
        every = every.unionByName(more)
    return every.filter(F.col("parent_key").isNotNull()).distinct()


def keep_up(store: Store, items: DataFrame, touched: DataFrame, version: int) -> None:
    """Write the totals of the touched parents anew, from the children they have now.

    Totals like a minimum or a set cannot be taken back child by child, so a touched parent
    is aggregated over all its children. The others' children are left out first if few parents
    are touched; if many are, each task adds up what it holds of a parent before it knows. A
    parent that has no live child any more gets a row without episodes. ``version`` counts the
    updates from 1; a repeated one replaces itself.
    """
    touched = touched.select("parent_key").persist()
    try:
        episodes = _episodes(items)
        if touched.count() <= FEW_PARENTS:
            episodes = episodes.join(F.broadcast(touched), "parent_key", "left_semi")
        totals = _totals_of(episodes, touched, _coded(episodes))
        store.put(totals.withColumn("version", F.lit(version)), version)
    finally:
        touched.unpersist()


def _totals_of(episodes: DataFrame, touched: DataFrame, coded: dict[str, list[str]]) -> DataFrame:
    """Totals of the touched parents in one aggregation, which their keys are rows of, too.

    Sets with a list of values in ``coded`` are numbers until the end; others are collected.
    """
    children = episodes.select(
        "parent_key", F.lit(1).alias("_child"), F.coalesce("file_size", F.lit(0)).alias("size"),
        F.col("file.duration_s").alias("duration_s"), F.col("file.bitrate_kbps").alias("bitrate_kbps"),
        *[_bits(name, values).alias(name) for name, values in coded.items()],
        *[F.col(fact).alias(name) for name, fact in SETS.items() if name not in coded])
    rows = children.unionByName(touched.withColumn("_touched", F.lit(True)), allowMissingColumns=True)
    count = F.count("_child")
    totals = rows.groupBy("parent_key").agg(
        F.when(count > 0, count).alias("episodes"), F.sum("size").alias("size"),
        *_rates("duration_s", "bitrate_kbps"),
        *[F.bit_or(name).alias(name) for name in coded],
        *[F.when(count > 0, _set(name)).alias(name) for name in SETS if name not in coded],
        F.max("_touched").alias("_touched"),
    ).filter("_touched").drop("_touched").withColumns(
        {name: _of_bits(F.col(name), values) for name, values in coded.items()})
    if "languages" in coded:
        return totals
    return totals.join(union_of_lists(episodes, "parent_key", LANGUAGES, "languages"), "parent_key", "left")


def _coded(episodes: DataFrame) -> dict[str, list[str]]:
    """Sorted values of the sets that have at most ``BITS``."""
    def value(name: str, of: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), of.alias("value"))
    # first each combination once, of which there are few where values are few
    each = episodes.select(*[F.col(fact).alias(name) for name, fact in SETS.items()],
                           F.col(LANGUAGES).alias("languages")).distinct()
    listed = F.transform(F.coalesce("languages", F.array().cast("array<string>")), lambda v: value("languages", v))
    values = each.select(F.explode(F.concat(F.array(*[value(name, F.col(name)) for name in SETS]), listed)).alias("_v"))
    values = values.select("_v.*").filter("value <> ''").distinct()
    nth = F.row_number().over(Window.partitionBy("name").orderBy("value"))
    found: dict[str, list[str]] = {name: [] for name in (*SETS, "languages")}
    for row in values.withColumn("_nth", nth).filter(F.col("_nth") <= BITS + 1).collect():
        found[row["name"]].append(row["value"])
    return {name: in_order(own, True) for name, own in found.items() if len(own) <= BITS}


def _bits(name: str, values: list[str]) -> Column:
    """A child's values as a number: 0 is none; NULL, of languages, a list without elements."""
    known = constant(values, "array<string>")

    def bit(value: Column) -> Column:
        at = F.coalesce(F.array_position(known, value), F.lit(0)).cast("int")
        return F.when(at > 0, F.call_function("shiftleft", F.lit(1).cast("long"), at - 1)).otherwise(F.lit(0).cast("long"))
    if name in SETS:
        return bit(F.col(SETS[name]))
    return F.when(F.size(LANGUAGES) > 0, F.aggregate(
        LANGUAGES, F.lit(0).cast("long"), lambda bits, value: bits.bitwiseOR(bit(value))))


def _of_bits(bits: Column, values: list[str]) -> Column:
    one = F.lit(1).cast("long")
    return F.when(bits.isNotNull(), F.filter(
        constant(values, "array<string>"),
        lambda _, at: bits.bitwiseAND(F.call_function("shiftleft", one, at)) != 0))


def kept_totals(store: Store) -> DataFrame:
    """Totals of all parents, as ``children_by_parent`` gives them; stored rows are not moved."""
    return store.merged().filter(F.col("episodes").isNotNull()).drop("version")


def worst_of(present: Column) -> Column:
    return F.coalesce(
        F.get(F.filter(F.array(*[F.lit(r) for r in WORST_FIRST]),
                       lambda r: F.array_contains(present, r)), F.lit(0)),
        F.lit("other"))


def percent_watched(viewed: Column, leaves: Column) -> Column:
    return F.round(F.try_divide(viewed, leaves) * 100, 1)


class Rollup(Provider):
    id = "show_rollup"
    depends_on = ("plex", "ffprobe", "derived")
    max_age_s = 0      # always due
    applies_to = ("show",)
    # Keys, types, enum values.
    facts = (
        measure("show.episode_count"),
        flag("show.mixed_resolutions"),
        enum("show.worst_resolution", *WORST_FIRST, folded=True),
        flag("show.all_4k"),
        flag("show.any_4k"),
        flag("show.mixed_hdr"),
        flag("show.any_dolby_vision"),
        words("show.hdr_formats"),
        measure("show.total_size_bytes", unit="B"),
        measure("show.size_per_episode_mb", unit="MB"),
        measure("show.total_runtime_min", unit="min"),
        measure("show.max_bitrate_kbps", unit="kbps"),
        measure("show.min_bitrate_kbps", unit="kbps"),
        measure("show.mean_bitrate_kbps", unit="kbps"),
        words("show.audio_languages"),
        words("show.aspect_buckets"),
        measure("show.leaf_count"),
        measure("show.watched_count"),
        measure("show.percent_watched", unit="%"),
        flag("show.unwatched"),
        flag("show.abandoned"),
    )

    def compute(self, items, sources):
        """``children``: the catalogue with the episodes' facts."""
        return self.from_totals(items, children_by_parent(sources["children"]))

    def from_totals(self, items: DataFrame, totals: DataFrame) -> DataFrame:
        """Facts from totals per parent, computed now or kept up (``kept_totals``)."""
        found = left_lookup(
            items, totals.withColumnRenamed("parent_key", "rating_key"), ["rating_key"], "item_id")
        get = F.col
        leaves = F.coalesce(get("leaf_count"), F.lit(0))
        viewed = F.coalesce(get("viewed_leaf_count"), F.lit(0))
        tracked, rolled = leaves != 0, get("episodes").isNotNull()
        percent = percent_watched(viewed, leaves)
        some_resolution = F.size("resolutions") > 0
        some_hdr = F.size("hdr") > 0

        made = {
            "show.leaf_count": emitted(tracked, leaves),
            "show.watched_count": emitted(tracked, viewed),
            "show.percent_watched": emitted(tracked, percent),
            "show.unwatched": emitted(tracked, viewed == 0),
            "show.abandoned": emitted(tracked, (percent > 0) & (percent < FINISHED_PERCENT)),
            "show.episode_count": get("episodes"),
            "show.aspect_buckets": emitted(rolled, or_empty(get("aspects"))),
            "show.audio_languages": emitted(rolled, or_empty(get("languages"))),
            "show.total_size_bytes": emitted(truthy(get("size")), get("size")),
            "show.size_per_episode_mb": emitted(
                truthy(get("size")),
                F.round(F.try_divide(get("size") / 1_000_000, get("episodes")), 1)),
            "show.total_runtime_min": emitted(
                truthy(get("seconds")), F.round(get("seconds") / 60, 1)),
            "show.min_bitrate_kbps": F.round("min_rate", 1),
            "show.max_bitrate_kbps": F.round("max_rate", 1),
            "show.mean_bitrate_kbps": F.round("mean_rate", 1),
            "show.mixed_resolutions": emitted(some_resolution, F.size("resolutions") > 1),
            "show.all_4k": emitted(some_resolution, get("resolutions") == F.array(F.lit("4k"))),
            "show.any_4k": emitted(some_resolution, F.array_contains("resolutions", "4k")),
            "show.worst_resolution": emitted(some_resolution, worst_of(get("resolutions"))),
            "show.hdr_formats": emitted(some_hdr, get("hdr")),
            "show.mixed_hdr": emitted(some_hdr, F.size("hdr") > 1),
            "show.any_dolby_vision": emitted(
                some_hdr, F.exists("hdr", lambda h: h.startswith("dv"))),
        }
        return self.results(
            found, made, F.when(tracked | rolled, "ok").otherwise("skipped"),
            F.lit("no episodes indexed"))
