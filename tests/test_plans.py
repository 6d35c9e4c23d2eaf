"""Physical plans: what must not be in any, and what must be in some."""

import os
import re

import pytest

import __spark_entry__ as contract

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plan_of(spark, name):
    frame = contract.workloads.QUERIES[name](spark, SF)
    return frame._jdf.queryExecution().executedPlan().toString()


WRITES = {"membership_table", "refresh_equals_batch", "fact_table", "scope_partitioned",
          "fact_store_merge", "prov_table", "stale_stored", "reconcile_stored", "reconcile_observed", "file_manifest",
          "scan_run", "scan_all", "history_appended", "rollup_kept_up", "running_totals"}


@pytest.mark.parametrize("name", sorted(set(contract.workloads.QUERIES) - WRITES))
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas",
                "FlatMapGroups"):
        assert bad not in plan, (name, bad)
    # A window over everything, or a sort or join that needs one task.
    assert not re.search(r"Window \[.*\], \[\w+#\d+ (ASC|DESC)", plan) or "many" in name
    exchanges = re.findall(r"Exchange SinglePartition", plan)
    # paths ask, twice and in both branches, whether there is any mapping: a sum of counts
    assert len(exchanges) <= (4 if name.startswith("path_") else 1), (name, exchanges)


@pytest.mark.parametrize("name,pushed", [
    ("match", "GreaterThanOrEqual(p_size,20)"), ("match", "GreaterThanOrEqual(p_retailprice,"),
    ("num_in", "In(p_size"), ("agg_pct90", "GreaterThanOrEqual(l_extendedprice,"),
    ("publish_diff", "StringStartsWith(p_name,hot)"),
])
def test_filters_reach_the_scan(spark, name, pushed):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    assert pushed in plan_of(spark, name)


def test_only_needed_columns_are_read(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    assert "ReadSchema: struct<doc_id:bigint>" in plan_of(spark, "num_is_null")
    plan = plan_of(spark, "preview_counts")
    assert "text:string" not in plan and "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan


def above_stored_scans(plan):
    """For each bucketed scan, the operators between it and the top that move rows."""
    lines, out = plan.splitlines(), []
    depth = lambda line: len(re.match(r"[ :|+\-*]*", line).group())
    for at, line in enumerate(lines):
        if "Bucketed: true" in line:
            level, moved = depth(line), []
            for upper in reversed(lines[:at]):
                if depth(upper) < level:
                    level = depth(upper)
                    moved += [upper.strip()] if "Exchange" in upper else []
            out.append(moved)
    return out


@pytest.mark.parametrize("name", ["fact_table", "fact_store_merge", "prov_table", "stale_stored", "rollup_kept_up",
                                  "running_totals"])
def test_stored_rows_stay_in_their_buckets(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = above_stored_scans(plan_of(spark, name))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved and not any(moved), moved


def test_scope_prunes_folders(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(spark, "scope_partitioned")
    [pruning] = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)
    assert "library_key" in pruning and "item_type" in pruning


def test_ranking_is_cut_before_the_shuffle(spark):
    plan = plan_of(spark, "many_top_n")
    assert plan.count("WindowGroupLimit") >= 4 and "Partial" in plan


def test_thresholds_run_in_parallel(spark):
    """No pass of a rank search sorts or windows the data."""
    from factloom.functions.thresholds import _RankSearch
    frame = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS v0", "0.5 AS u")
    search = _RankSearch("v0", 0.5)
    plan = frame.agg(search.probe())._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and not re.search(r"^\W*Sort ", plan, re.M)


def test_later_passes_filter_at_the_scan(spark):
    from factloom.functions.thresholds import _RankSearch, _with_chance
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    values = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_extendedprice AS v0")
    search = _RankSearch("v0", 0.5)
    search.low, search.high = 5000.0, 6000.0
    plan = _with_chance(values.filter(search.window())).agg(
        search.probe())._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_extendedprice,5000.0)" in plan
    assert "ReadSchema: struct<l_extendedprice:double>" in plan


def test_facts_nobody_asks_for_are_not_computed(spark):
    """Progress facts need no sets of the children."""
    frame = contract.queries()["progress"](spark, SF)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan


def partitioned(spark, tmp_path):
    from pyspark.sql import functions as F
    path = str(tmp_path / "catalogue")
    spark.range(400).select(
        F.col("id").cast("string").alias("item_id"), F.col("id").cast("string").alias("sort_title"),
        (F.col("id") % 4).cast("string").alias("library_key"), F.lit("movie").alias("item_type"),
        F.lit(None).cast("bigint").alias("deleted_at"),
        F.struct(F.col("id").cast("double").alias("bitrate_kbps")).alias("file"),
    ).write.partitionBy("library_key", "item_type").parquet(path)
    return spark.read.schema(
        "item_id string, sort_title string, deleted_at bigint, file struct<bitrate_kbps: double>, "
        "library_key string, item_type string").parquet(path)


def test_scopes_prune_many_rules_and_thresholds(spark, tmp_path, registry):
    from factloom import Rule
    from factloom.functions import thresholds
    from factloom.plans import rules
    items = partitioned(spark, tmp_path)
    made = [Rule(i, {"root": {"type": "cmp", "key": "file.bitrate_kbps", "op": "gte", "value": 9}},
                 libraries=("2",), limit=limit) for i, limit in ((1, None), (2, 3))]
    plan = rules.evaluate_all(items, made, registry)._jdf.queryExecution().executedPlan().toString()
    for pruning in re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan):
        assert "library_key" in pruning
    seen = []
    agg = type(items).agg

    def watched(frame, *columns):
        seen.append(frame._jdf.queryExecution().executedPlan().toString())
        return agg(frame, *columns)
    spec = registry.require("file.bitrate_kbps")
    request = thresholds.Request(made[0].scope_key, spec, "percentile", 90)
    type(items).agg = watched
    try:
        found = thresholds.compute(items, [request], {made[0].scope_key: made[0].scope})
    finally:
        type(items).agg = agg
    assert found == {request: 358.0} and seen
    for plan in seen:
        [pruning] = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)
        assert "library_key" in pruning
