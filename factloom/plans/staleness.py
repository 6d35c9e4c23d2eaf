"""Which items a provider has to work on, and which it cannot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import digest, yes


def stale(items: DataFrame, provenance: DataFrame, provider, now: float,
          force: bool = False) -> DataFrame:
    """Live items of the provider's types and selector that are due.

    Due: never computed, another schema version, an error or a skip last time, changed
    inputs, or too old. Items carry ``input_fp``, the fingerprint to be stored.
    """
    candidates = items.filter(
        F.col("deleted_at").isNull() & provider.selector()
    ).withColumn("input_fp", provider.fingerprint().cast("string"))
    if provider.applies_to:
        candidates = candidates.filter(F.col("item_type").isin(*provider.applies_to))
    if force:
        return candidates
    last = provenance.filter(F.col("provider") == provider.id).select(
        "item_id",
        F.struct("schema_version", F.col("input_fp").alias("fp"), "computed_at", "status")
        .alias("_last"))
    joined = candidates.join(last, "item_id", "left")
    return joined.filter(is_due(
        F.col("_last"), F.col("input_fp"), provider.schema_version, provider.max_age_s, now
    )).drop("_last")


def is_due(last: Column, fingerprint: Column, version: int, max_age_s: int | None,
           now: float) -> Column:
    due = (
        last.isNull()
        | yes(last["schema_version"] != version)
        | yes(last["status"].isin("error", "skipped"))
        | (fingerprint.isNotNull() & ~fingerprint.eqNullSafe(last["fp"]))
    )
    if max_age_s is not None:
        due = due | yes(F.lit(now) - last["computed_at"] >= max_age_s)
    return due


def split_eligible(due: DataFrame, provider) -> tuple[DataFrame, DataFrame]:
    """(eligible items, skip results with the reason)."""
    reasoned = due.withColumn("reason", provider.ineligible())
    eligible = reasoned.filter(F.col("reason").isNull()).drop("reason")
    skipped = reasoned.filter(F.col("reason").isNotNull()).select(
        "item_id", F.lit("skipped").alias("status"), "reason", "input_fp")
    return eligible, skipped


def input_fingerprint(*inputs: Column) -> Column:
    return digest(*inputs)


def provenance_rows(results: DataFrame, provider, now: int) -> DataFrame:
    """What ``merge_provenance`` takes, from the provider's results."""
    return results.select(
        "item_id", F.lit(provider.id).alias("provider"),
        F.lit(provider.schema_version).alias("schema_version"), "input_fp",
        F.lit(int(now)).cast("bigint").alias("computed_at"), "status", "reason")


def run(items: DataFrame, provenance: DataFrame, provider, sources: dict, now: float,
        force: bool = False, hold: Callable[[DataFrame], DataFrame] = lambda due: due) -> DataFrame:
    """Results of one provider over what is due: (item_id, status, reason, input_fp, structs).

    ``hold`` stores what is due and gives the table back, so that the join that tells is made
    once, and not for the eligible and for the skipped items.
    """
    due = hold(stale(items, provenance, provider, now, force))
    eligible, skipped = split_eligible(due, provider)
    done = provider.compute(eligible, sources)
    return done.unionByName(skipped, allowMissingColumns=True)


def in_order(providers) -> list:
    """Providers after those they depend on, else as given; a dependency not given is no hindrance."""
    left, done = list(providers), []
    ids = {p.id for p in left}
    while left:
        ready = next((p for p in left if not set(p.depends_on) & ids - {d.id for d in done}), None)
        if ready is None:
            raise ValueError(f"providers depend on each other: {', '.join(p.id for p in left)}")
        left.remove(ready)
        done.append(ready)
    return done


def run_all(items: DataFrame, provenance: DataFrame, providers, sources: dict, now: float,
            keep, force: bool = False, hold: Callable[[DataFrame], DataFrame] = lambda frame: frame
            ) -> tuple[DataFrame, DataFrame]:
    """Every provider over what is due for it, in the order of their dependencies.

    A provider sees the facts of those before it. ``keep(provider, results)`` stores the
    results of one provider as a table and gives that table back, so that nothing is computed
    twice; ``hold(frame)`` does so for what is due and for the provenance between providers.
    Returns the items with the new facts laid over, and the merged provenance.
    """
    from ..operators.facts import lay_over, merge_provenance

    for provider in in_order(providers):
        results = keep(provider, run(items, provenance, provider, sources, now, force, hold))
        spaces = sorted({spec.namespace for spec in provider.facts} & set(results.columns))
        items = lay_over(items, results.filter(F.col("status") == "ok"), spaces)
        provenance = hold(merge_provenance(provenance, provenance_rows(results, provider, int(now))))
    return items, provenance
