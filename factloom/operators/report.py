"""Counts about the catalogue, the providers and the runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def coverage(items: DataFrame, provenance: DataFrame, providers) -> DataFrame:
    """known / errors / skipped / stale against what each provider applies to.

    One row per provider (item_type NULL) and one per (provider, item_type). Provenance of
    other providers is left out. Staleness is only told for providers whose fingerprint is
    that of the file; the others' never equals it.
    """
    spark = items.sparkSession
    live = items.filter(F.col("deleted_at").isNull())
    per_type = live.groupBy("item_type").agg(F.count(F.lit(1)).alias("total"))
    ids = [p.id for p in providers]
    # The providers are a short list, so they are literals and not a table to join.
    targets = per_type.select("item_type", "total", F.explode(F.array_compact(F.array(*[
        F.when(F.col("item_type").isin(*p.applies_to) if p.applies_to else F.lit(True), p.id)
        for p in providers
    ]))).alias("provider"))
    ok = F.col("status") == "ok"
    by_file = F.col("provider").isin(*[p.id for p in providers if p.file_fingerprinted])
    outdated = ok & by_file & F.coalesce(F.col("input_fp") != F.col("file_fp"), F.lit(False))
    seen = (
        provenance.filter(F.col("provider").isin(*ids))
        .select("item_id", "provider", "status", "input_fp")
        .join(live.select("item_id", "item_type", "file_fp"), "item_id")
    )
    done = seen.groupBy("provider", "item_type").agg(
        F.count_if(ok).alias("known"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(~F.col("status").isin("ok", "error")).alias("skipped"),
        F.count_if(outdated).alias("stale"),
    )
    sums = ["known", "errors", "skipped", "stale"]
    zero = F.lit(0).cast("bigint")
    every = ["total", *sums]
    rows = (
        spark.range(1).select(
            F.explode(F.array(*[F.lit(i) for i in ids])).alias("provider"),
            F.lit(None).cast("string").alias("item_type"), *[zero.alias(c) for c in every])
        .unionByName(targets.select(
            "provider", "item_type", "total", *[zero.alias(c) for c in sums]))
        .unionByName(done.select("provider", "item_type", zero.alias("total"), *sums))
    )
    per_provider = F.col("_level") == 1
    return (
        rows.groupingSets([["provider", "item_type"], ["provider"]], "provider", "item_type")
        .agg(F.grouping_id().alias("_level"), *[F.sum(c).alias(c) for c in every])
        .filter(per_provider | (F.col("total") > 0))
        .select("provider", "item_type", *every)
    )


def stats(items: DataFrame, has_facts=None) -> DataFrame:
    """(path_status, total, with_facts, deleted) per status; deleted rows of the status apart.

    ``has_facts`` is a condition; without it a row counts when any struct column is set.
    """
    if has_facts is None:
        structs = [n for n, kind in items.dtypes if kind.startswith("struct")]
        has_facts = F.lit(False)
        for name in structs:
            has_facts = has_facts | F.col(name).isNotNull()
    live = F.col("deleted_at").isNull()
    return items.groupBy("path_status").agg(
        F.count_if(live).alias("total"),
        F.count_if(live & has_facts).alias("with_facts"),
        F.count_if(~live).alias("deleted"),
    )


def run_outcome(results: DataFrame) -> DataFrame:
    """Per provider: eligible, ok, errors, skipped and the reason of the first skip by id."""
    skipped = F.col("status") == "skipped"
    return results.groupBy("provider").agg(
        F.count_if(~skipped).alias("eligible"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(skipped).alias("skipped"),
        F.min_by(F.when(skipped, F.col("reason")),
                 F.when(skipped, F.col("item_id"))).alias("skip_reason"),
    )


def published_counts(rules: DataFrame, members: DataFrame) -> DataFrame:
    """How many items each rule has published; 0 for none."""
    counted = members.groupBy("rule_id").agg(F.count(F.lit(1)).alias("published"))
    return rules.join(counted, "rule_id", "left").fillna(0, ["published"])


def recent(log: DataFrame, k: int, rule_id=None, at: str = "started_at",
           tie: str | None = None) -> DataFrame:
    """The newest k entries of a run or publish log, of one rule if given."""
    entries = log if rule_id is None else log.filter(F.col("rule_id") == F.lit(rule_id))
    return entries.orderBy(F.desc(at), *([F.desc(tie)] if tie else [])).limit(k)
