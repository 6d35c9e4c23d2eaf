"""Publish what rules match: difference to what is there, safety gates, membership.

Sets are frames of (rule_id, item_key). ``current`` carries the rule's label now, ``ours``
is what earlier runs put there, ``pinned`` and ``vetoed`` are a person's choice and are
never written. Only what is ours is ever removed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.scalars import yes

SETS = ("matched", "current", "ours", "pinned", "vetoed")
PAIR = ["rule_id", "item_key"]


@dataclass(frozen=True)
class Limits:
    """The defaults of the safety gates."""

    refuse_empty_result: bool = True
    max_stale_fraction: float = 0.10
    min_removal_alarm: int = 20
    max_removal_fraction: float = 0.25
    max_changes: int = 2000


def diff(matched: DataFrame, current: DataFrame, ours: DataFrame, pinned: DataFrame,
         vetoed: DataFrame) -> DataFrame:
    """One row per (rule_id, item_key) of any set, with its memberships and the verdicts.

    One union and one aggregation serve all rules: a pair has at most a handful of rows,
    so a rule that holds most of the items is spread like any other.
    """
    tagged = reduce(DataFrame.unionByName, [
        frame.select(*PAIR, *[F.lit(other == name).alias(other) for other in SETS])
        for name, frame in zip(SETS, (matched, current, ours, pinned, vetoed))
    ])
    flags = tagged.groupBy(*PAIR).agg(*[F.bool_or(s).alias(s) for s in SETS])
    target = F.col("matched") & ~F.col("vetoed")
    return flags.withColumns({
        "target": target,
        "add": target & ~F.col("current"),
        "remove": F.col("current") & F.col("ours") & ~target,
        "kept": target & F.col("current"),
        "drifted": F.col("current") & ~F.col("ours"),
        "published": target | F.col("pinned"),
    })


COUNTED = ("matched", "current", "target", "add", "remove", "kept", "drifted", "pinned",
           "vetoed", "published")


def counts(changes: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Counts per rule. With ``rules`` (rule_id) a rule without any row gets zeros."""
    made = changes.groupBy("rule_id").agg(
        *[F.count_if(name).alias(f"n_{name}") for name in COUNTED])
    if rules is None:
        return made
    return rules.select("rule_id").join(made, "rule_id", "left").fillna(
        0, [f"n_{name}" for name in COUNTED])


def gates(diff_counts: DataFrame, limits: Limits = Limits(), force: bool = False) -> DataFrame:
    """Adds ``gate``, the first gate that refuses (NULL = publish).

    ``diff_counts`` also has ``stale`` and ``in_scope`` per rule. Each rule is judged on
    its own; a refused one does not stop the others.
    """
    if force:
        return diff_counts.withColumn("gate", F.lit(None).cast("string"))
    n = {name: F.col(f"n_{name}") for name in COUNTED}
    return diff_counts.withColumn(
        "gate",
        F.when((n["matched"] == 0) & F.lit(limits.refuse_empty_result), "empty_result")
        .when(yes(F.try_divide("stale", "in_scope") > limits.max_stale_fraction), "stale_facts")
        .when(
            (n["current"] > 0) & (n["remove"] > limits.min_removal_alarm)
            & yes(F.try_divide(n["remove"], n["current"]) > limits.max_removal_fraction),
            "mass_removal")
        .when(n["add"] + n["remove"] > limits.max_changes, "too_many_changes"))


def change_list(changes: DataFrame, items: DataFrame, which: str,
                key: str = "rating_key") -> DataFrame:
    """The rows to ``add`` or ``remove``, by key, with title and year."""
    titles = items.select(F.col(key).alias("item_key"), "title", "year")
    return changes.filter(which).select(*PAIR).join(
        titles, "item_key", "left"
    ).select("rule_id", "item_key", "title", "year").orderBy("rule_id", "item_key")


def unpublish(current: DataFrame, ours: DataFrame, strip_all: bool = False
              ) -> tuple[DataFrame, DataFrame]:
    """(pairs to strip, counts per rule): what is ours, or everything with ``strip_all``."""
    both = current.select(*PAIR, F.lit(True).alias("c"), F.lit(False).alias("o")).unionByName(
        ours.select(*PAIR, F.lit(False).alias("c"), F.lit(True).alias("o"))
    ).groupBy(*PAIR).agg(F.bool_or("c").alias("current"), F.bool_or("o").alias("ours"))
    strip = F.lit(True) if strip_all else F.col("ours")
    removed = F.col("current") & strip
    totals = both.groupBy("rule_id").agg(
        F.count_if(removed).alias("removed"),
        F.count_if(F.col("current") & ~removed).alias("still_labelled"),
    )
    return both.filter(removed).select(*PAIR), totals


# ── membership table ──────────────────────────────────────────────────────────
# Parquet, partitioned by rule. Writing replaces the partitions of the rules at hand and
# no others. A rule that became empty gets one row with a NULL key: a partition without
# any row would leave the former one in place.


def target_of(changes: DataFrame) -> DataFrame:
    """The new membership: every target, hand-labelled ones that match included."""
    return changes.filter("target").select(*PAIR)


def collection_of(changes: DataFrame) -> DataFrame:
    """What a reader of the collection sees: targets and pins."""
    return changes.filter("published").select(*PAIR)


def write_membership(members: DataFrame, rule_ids: Sequence, path: str, added_at: int) -> None:
    """Replace the membership of every rule in ``rule_ids`` by its part of ``members``."""
    ids = list(rule_ids)
    kind = members.schema["rule_id"].dataType
    tombs = members.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(i).cast(kind) for i in ids])).alias("rule_id"),
        F.lit(None).cast("string").alias("item_key"))
    rows = members.filter(F.col("rule_id").isin(*ids)).select(
        "rule_id", F.col("item_key").cast("string")
    ).unionByName(tombs).withColumn("added_at", F.lit(int(added_at)).cast("bigint"))
    (
        # Rebalancing packs small rules into few files and splits a large one.
        rows.hint("rebalance", "rule_id").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("rule_id").parquet(path)
    )


def read_membership(spark: SparkSession, path: str, rule_type: str = "bigint") -> DataFrame:
    schema = f"item_key string, added_at bigint, rule_id {rule_type}"
    try:
        table = spark.read.schema(schema).parquet(path)
    except AnalysisException:
        table = spark.createDataFrame([], schema)
    return table.filter(F.col("item_key").isNotNull()).select("rule_id", "item_key", "added_at")


def add_membership(current: DataFrame, members: DataFrame, path: str, added_at: int) -> None:
    """Append pairs that are not recorded yet."""
    new = members.select(*PAIR).distinct().join(current, PAIR, "left_anti")
    new.select("rule_id", F.col("item_key").cast("string")).withColumn(
        "added_at", F.lit(int(added_at)).cast("bigint")
    ).write.mode("append").partitionBy("rule_id").parquet(path)


def drop_membership(current: DataFrame, gone: DataFrame) -> DataFrame:
    """The membership without some pairs, to be given to ``write_membership``."""
    return current.join(gone.select(*PAIR), PAIR, "left_anti").select(*PAIR)


def history_rows(judged: DataFrame, started_at: int, trigger: str = "manual",
                 dry_run: bool = False) -> DataFrame:
    """One log row per rule; a refused one is logged as ``guarded``."""
    return judged.select(
        "rule_id", F.lit(int(started_at)).cast("bigint").alias("started_at"),
        F.lit(trigger).alias("trigger"), F.lit(dry_run).alias("dry_run"),
        F.col("n_matched").alias("matched_count"), F.col("n_add").alias("added_count"),
        F.col("n_remove").alias("removed_count"), F.col("n_kept").alias("kept_count"),
        F.col("n_pinned").alias("pinned_count"), F.col("n_vetoed").alias("vetoed_count"),
        F.col("n_drifted").alias("drifted_count"),
        F.when(F.col("gate").isNull(), "ok").otherwise("guarded").alias("status"),
        F.col("gate").alias("error"),
    )


def append_history(judged: DataFrame, path: str, started_at: int, **options) -> None:
    history_rows(judged, started_at, **options).write.mode("append").parquet(path)


def allowed(changes: DataFrame, judged: DataFrame) -> DataFrame:
    """The changes of the rules no gate refused.

    ``judged`` has one row per rule, so AQE makes the join a broadcast once it has seen it.
    """
    return changes.join(
        judged.filter(F.col("gate").isNull()).select("rule_id"), "rule_id", "left_semi")
