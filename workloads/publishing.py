"""Difference to what is published, gates, membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import publish

from . import tables as t
from .base import ORACLES, query, scratch

# The sets of each rule (a part type), over parts.
SETS = {
    "matched": "p_size >= 20 AND p_type <> 'MEDIUM'",
    "current": "p_brand < 'Brand#2'",
    "ours": "p_brand < 'Brand#18'",
    "pinned": "p_name LIKE 'hot%'",
    "vetoed": "p_name LIKE '%anvil'",
}
FLAGS_SQL = "(SELECT p_type AS rule_id, p_partkey AS item_key, " + ", ".join(
    f"{where} AS {name}" for name, where in SETS.items()) + " FROM part)"
DIFF_SQL = f"""(
    SELECT *, matched AND NOT vetoed AS target, matched AND NOT vetoed AND NOT current AS "add",
           current AND ours AND NOT (matched AND NOT vetoed) AS remove,
           matched AND NOT vetoed AND current AS kept, current AND NOT ours AS drifted,
           (matched AND NOT vetoed) OR pinned AS published
    FROM {FLAGS_SQL} WHERE matched OR current OR ours OR pinned OR vetoed)"""


def sets(spark, sf):
    part = t.table(spark, sf, "part")
    return [
        part.filter(where).select(F.col("p_type").alias("rule_id"),
                                  F.col("p_partkey").alias("item_key"))
        for where in SETS.values()
    ]


def changes(spark, sf):
    return publish.diff(*sets(spark, sf))


@query("publish_diff", f"""
    SELECT rule_id, item_key, target, "add", remove, kept, drifted, published FROM {DIFF_SQL}""")
def publish_diff(spark, sf):
    return changes(spark, sf).select(
        "rule_id", "item_key", "target", "add", "remove", "kept", "drifted", "published")


COUNTS_SQL = "SELECT rule_id, " + ", ".join(
    f'count(*) FILTER (WHERE "{name}") AS n_{name}' for name in publish.COUNTED
) + f" FROM {DIFF_SQL} GROUP BY rule_id"


@query("publish_counts", COUNTS_SQL)
def publish_counts(spark, sf):
    return publish.counts(changes(spark, sf))


@query("change_list", f"""
    SELECT rule_id, item_key, p_name AS title, p_size AS year
    FROM {DIFF_SQL} JOIN part ON p_partkey = item_key WHERE remove""")
def change_list(spark, sf):
    titles = t.table(spark, sf, "part").select(
        F.col("p_partkey").alias("rating_key"), F.col("p_name").alias("title"),
        F.col("p_size").alias("year"))
    return publish.change_list(changes(spark, sf), titles, "remove")


@query("title_lookup", f"""
    SELECT rule_id, item_key, p_name AS title, p_size AS year
    FROM {DIFF_SQL} JOIN part ON p_partkey = item_key WHERE "add" """)
def title_lookup(spark, sf):
    titles = t.table(spark, sf, "part").select(
        F.col("p_partkey").alias("rating_key"), F.col("p_name").alias("title"),
        F.col("p_size").alias("year"))
    return publish.change_list(changes(spark, sf), titles, "add")


@query("published_collection", f"SELECT rule_id, item_key FROM {DIFF_SQL} WHERE published")
def published_collection(spark, sf):
    return publish.collection_of(changes(spark, sf))


@query("unpublish", f"""
    SELECT rule_id, item_key FROM {FLAGS_SQL} WHERE current AND ours""")
def unpublish(spark, sf):
    _, current, ours, _, _ = sets(spark, sf)
    return publish.unpublish(current, ours)[0]


@query("unpublish_counts", f"""
    SELECT rule_id, count(*) FILTER (WHERE current AND ours) AS removed,
           count(*) FILTER (WHERE current AND NOT ours) AS still_labelled
    FROM {FLAGS_SQL} WHERE current OR ours GROUP BY rule_id""")
def unpublish_counts(spark, sf):
    _, current, ours, _, _ = sets(spark, sf)
    return publish.unpublish(current, ours)[1]


@query("unpublish_all", f"SELECT rule_id, item_key FROM {FLAGS_SQL} WHERE current")
def unpublish_all(spark, sf):
    _, current, ours, _, _ = sets(spark, sf)
    return publish.unpublish(current, ours, strip_all=True)[0]


# ── gates: several settings over the same counts ─────────────────────────────────

SETTINGS = {
    "default": publish.Limits(),
    "wary": publish.Limits(min_removal_alarm=1, max_removal_fraction=0.05),
    "small": publish.Limits(max_changes=40, max_removal_fraction=1.0),
    "lenient": publish.Limits(max_removal_fraction=1.0, max_changes=10**12),
    "fresh": publish.Limits(max_stale_fraction=0.0, refuse_empty_result=False),
}
JUDGED_SQL = f"""(
    SELECT c.*, stale, in_scope FROM ({COUNTS_SQL}) c JOIN (
        SELECT p_type AS rule_id, count(*) FILTER (WHERE p_retailprice < 905) AS stale,
               count(*) AS in_scope FROM part GROUP BY 1) USING (rule_id))"""


def judged(spark, sf):
    scope = t.table(spark, sf, "part").groupBy(F.col("p_type").alias("rule_id")).agg(
        F.count_if(F.col("p_retailprice") < 905).alias("stale"),
        F.count(F.lit(1)).alias("in_scope"))
    return publish.counts(changes(spark, sf)).join(scope, "rule_id")


def _gate_sql(name, limits):
    return f"""
    SELECT '{name}' AS setting, rule_id, CASE
        WHEN n_matched = 0 AND {str(limits.refuse_empty_result).lower()} THEN 'empty_result'
        WHEN in_scope > 0 AND stale / in_scope > {limits.max_stale_fraction} THEN 'stale_facts'
        WHEN n_current > 0 AND n_remove > {limits.min_removal_alarm}
             AND n_remove / n_current > {limits.max_removal_fraction} THEN 'mass_removal'
        WHEN n_add + n_remove > {limits.max_changes} THEN 'too_many_changes' END AS gate
    FROM {JUDGED_SQL}"""


@query("gates", " UNION ALL ".join(_gate_sql(*s) for s in SETTINGS.items()))
def gates(spark, sf):
    counted = judged(spark, sf)
    parts = [
        publish.gates(counted, limits).select(F.lit(name).alias("setting"), "rule_id", "gate")
        for name, limits in SETTINGS.items()
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@query("gates_forced", f"SELECT rule_id, CAST(NULL AS VARCHAR) AS gate FROM {JUDGED_SQL}")
def gates_forced(spark, sf):
    return publish.gates(judged(spark, sf), force=True).select("rule_id", "gate")


@query("publish_history", f"""
    SELECT rule_id, n_matched AS matched_count, n_add AS added_count, n_remove AS removed_count,
           n_kept AS kept_count, n_drifted AS drifted_count,
           CASE WHEN gate IS NULL THEN 'ok' ELSE 'guarded' END AS status, gate AS error
    FROM {JUDGED_SQL} JOIN ({_gate_sql('small', SETTINGS['small'])}) USING (rule_id)""")
def publish_history(spark, sf):
    log = publish.history_rows(
        publish.gates(judged(spark, sf), SETTINGS["small"]), t.EVENTS_NOW)
    return log.select("rule_id", "matched_count", "added_count", "removed_count", "kept_count",
                      "drifted_count", "status", "error")


@query("history_appended", f"""
    WITH log AS ({ORACLES["publish_history"]})
    SELECT *, CAST({t.EVENTS_NOW} AS BIGINT) AS started_at, 'manual' AS trigger, false AS dry_run FROM log
    UNION ALL SELECT *, CAST({t.EVENTS_NOW + 60} AS BIGINT), 'schedule', true FROM log""")
def history_appended(spark, sf):
    """Two runs appended to the log on disk."""
    path = scratch(spark, "history")
    gated = publish.gates(judged(spark, sf), SETTINGS["small"])
    publish.append_history(gated, path, t.EVENTS_NOW)
    publish.append_history(gated, path, t.EVENTS_NOW + 60, trigger="schedule", dry_run=True)
    return spark.read.parquet(path).select(
        "rule_id", "matched_count", "added_count", "removed_count", "kept_count", "drifted_count", "status",
        "error", "started_at", "trigger", "dry_run")


@query("membership_table", f"""
    SELECT rule_id, CAST(item_key AS VARCHAR) AS item_key, CAST(2 AS BIGINT) AS added_at FROM {DIFF_SQL}
    WHERE target AND rule_id NOT IN ('PROMO', 'SMALL') UNION ALL
    SELECT rule_id, CAST(item_key AS VARCHAR), 1 FROM {DIFF_SQL}
    WHERE target AND rule_id = 'SMALL'""")
def membership_table(spark, sf):
    """Published twice: all rules, then all but SMALL, with PROMO having become empty."""
    path = scratch(spark, "members")
    members = publish.target_of(changes(spark, sf))
    types = ["STANDARD", "PROMO", "LARGE", "SMALL", "ECONOMY", "MEDIUM"]
    publish.write_membership(members, types, path, 1)
    publish.write_membership(members.filter("rule_id <> 'PROMO'"),
                             [n for n in types if n != "SMALL"], path, 2)
    return publish.read_membership(spark, path, "string")
