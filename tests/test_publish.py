"""Publishing: dry runs, repeats, drift, people's labels, gates, taking back."""

import pytest
from conftest import agg, cmp, group
from pyspark.sql import functions as F

from factloom import Rule
from factloom.operators import publish, report
from factloom.plans import rules

PAIR = "rule_id bigint, item_key string"
ITEM = ("item_id string, library_key string, rating_key string, item_type string, title string, "
        "sort_title string, year int, deleted_at bigint, video struct<dar:double>")


class World:
    """Labels outside, membership and history tables inside."""

    def __init__(self, spark, registry, folder, unscanned=0):
        self.spark, self.registry = spark, registry
        self.members, self.history = f"{folder}/members", f"{folder}/history"
        rows = [(key, "4", key, "movie", f"Reel {key}", f"Reel {key}", 1960 + n, None, (1.2 + n / 5,))
                for n, key in enumerate(KEYS)]
        rows += [(f"dark{i}", "4", f"dark{i}", "movie", f"Dark {i}", "", 1950, None, None)
                 for i in range(unscanned)]
        self.items = spark.createDataFrame(rows, ITEM)
        self.prov = self.items.filter("video is not null").select(
            "item_id", F.lit("ffprobe").alias("provider"), F.lit("ok").alias("status"))
        self.labels = {"main": set(), "pin": set(), "veto": set()}

    def pairs(self, keys, rule_id):
        return self.spark.createDataFrame([(rule_id, k) for k in keys], PAIR)

    def sync(self, rule, limits=publish.Limits(), force=False, dry_run=False, at=1):
        spark = self.spark
        ids = spark.createDataFrame([(rule.rule_id,)], "rule_id bigint")
        matched = rules.evaluate_all(self.items, [rule], self.registry, key="rating_key").select(
            F.col("rule_id").cast("bigint"), F.col("rating_key").alias("item_key"))
        recorded = publish.read_membership(spark, self.members)
        ours = recorded.filter(F.col("rule_id") == rule.rule_id).select("rule_id", "item_key")
        changes = publish.diff(
            matched, *[frame for frame in (
                self.pairs(self.labels["main"], rule.rule_id), ours,
                self.pairs(self.labels["pin"], rule.rule_id),
                self.pairs(self.labels["veto"], rule.rule_id))])
        changes = spark.createDataFrame(changes.collect(), changes.schema)
        counts, _ = rules.preview(self.items, self.prov, rule, self.registry)
        judged = publish.gates(
            publish.counts(changes, ids).join(
                counts.select("stale", "in_scope").withColumn(
                    "rule_id", F.lit(rule.rule_id).cast("bigint")), "rule_id"),
            limits, force)
        publish.append_history(judged, self.history, at, dry_run=dry_run)
        verdict = judged.first()
        if not dry_run and verdict.gate is None:
            for r in changes.collect():
                if r.add:
                    self.labels["main"].add(r.item_key)
                if r.remove:
                    self.labels["main"].discard(r.item_key)
            publish.write_membership(
                publish.target_of(changes), [rule.rule_id], self.members, at)
        return verdict, changes

    def recorded(self, rule_id=1):
        return {r.item_key for r in publish.read_membership(self.spark, self.members)
                .filter(F.col("rule_id") == rule_id).collect()}


KEYS = "abcdefghi"  # of rising aspect, 1.2 to 2.8
WIDE = Rule(1, {"root": cmp("video.dar", "gt", 1.9)}, libraries=("4",))
FIVE = set("efghi")


@pytest.fixture
def world(spark, registry, tmp_path):
    return World(spark, registry, str(tmp_path))


@pytest.fixture
def published(world):
    world.sync(WIDE)
    return world


def test_a_dry_run_only_leaves_a_log(spark, world):
    verdict, changes = world.sync(WIDE, dry_run=True)
    assert (verdict.n_matched, verdict.n_add, verdict.gate) == (5, 5, None)
    assert changes.filter("`add`").count() == 5 and not world.labels["main"] and not world.recorded()
    assert [r.dry_run for r in spark.read.parquet(world.history).collect()] == [True]


def test_publishing_twice_changes_nothing_more(published):
    assert published.labels["main"] == published.recorded() == FIVE
    verdict, changes = published.sync(WIDE)
    assert (verdict.n_kept, changes.filter("`add` or `remove`").count()) == (5, 0)


def test_a_label_set_by_others_is_left_alone(published):
    published.labels["main"].add("a")
    verdict, _ = published.sync(WIDE)
    assert verdict.n_drifted == 1 and "a" in published.labels["main"] and published.recorded() == FIVE


def test_people_force_items_out_and_in(published):
    published.labels["veto"].add("h")
    published.labels["pin"].add("b")
    verdict, changes = published.sync(WIDE)
    assert (verdict.n_vetoed, verdict.n_pinned) == (1, 1)
    assert published.labels["main"] == published.recorded() == FIVE - {"h"}
    shown = {r.item_key for r in publish.collection_of(changes).collect()}
    assert shown == FIVE - {"h"} | {"b"} and verdict.n_published == len(shown)


@pytest.mark.parametrize("tree,limits,gate", [
    (cmp("video.dar", "gt", 50), {}, "empty_result"),
    (cmp("video.dar", "gt", 2.7), {"min_removal_alarm": 2}, "mass_removal"),
    (cmp("video.dar", "gt", 2.7), {"max_changes": 3}, "too_many_changes"),
])
def test_gates_hold_a_publish_until_forced(spark, published, tree, limits, gate):
    changed = Rule(1, {"root": tree}, libraries=("4",))
    assert published.sync(changed, publish.Limits(**limits))[0].gate == gate
    assert published.recorded() == FIVE == published.labels["main"]
    assert spark.read.parquet(published.history).filter("status = 'guarded'").count() == 1
    assert published.sync(changed, publish.Limits(**limits), force=True)[0].gate is None
    assert published.recorded() < FIVE


def test_unpublish_takes_back_what_is_ours(published):
    published.labels["main"].add("c")
    current, ours = published.pairs(published.labels["main"], 1), published.pairs(published.recorded(), 1)
    strip, totals = publish.unpublish(current, ours)
    assert {r.item_key for r in strip.collect()} == FIVE
    assert totals.first().asDict() == {"rule_id": 1, "removed": 5, "still_labelled": 1}
    strip, totals = publish.unpublish(current, ours, strip_all=True)
    assert {r.item_key for r in strip.collect()} == FIVE | {"c"} and totals.first().still_labelled == 0


def test_missing_facts_stop_a_publish(spark, registry, tmp_path):
    w = World(spark, registry, str(tmp_path), unscanned=9)
    verdict, _ = w.sync(WIDE)
    assert verdict.gate == "stale_facts" and (verdict.stale, verdict.in_scope) == (9, 18)
    assert w.recorded() == set()


@pytest.mark.parametrize("current,removals,refused", [(80, 20, None), (84, 21, None),
                                                      (83, 21, "mass_removal")])
def test_mass_removal_limits_are_strict(spark, current, removals, refused):
    frame = spark.createDataFrame(
        [tuple([1, 5, current, 5, 0, removals] + [0] * 5 + [1, 10])],
        "rule_id int, " + ", ".join(f"n_{c} bigint" for c in publish.COUNTED)
        + ", stale bigint, in_scope bigint")
    assert publish.gates(frame).first().gate == refused
    assert publish.gates(frame.withColumn("stale", F.lit(2))).first().gate == "stale_facts"


def test_membership_table(spark, tmp_path):
    path = str(tmp_path / "m")
    pairs = lambda *p: spark.createDataFrame(list(p), PAIR)
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "rule_id bigint")
    assert publish.read_membership(spark, path).count() == 0
    publish.write_membership(pairs((1, "a"), (1, "b"), (2, "a"), (3, "z")), [1, 2], path, 5)

    def stored():
        return {(r.rule_id, r.item_key, r.added_at)
                for r in publish.read_membership(spark, path).collect()}

    assert stored() == {(1, "a", 5), (1, "b", 5), (2, "a", 5)}
    publish.write_membership(pairs(), [2], path, 6)
    assert stored() == {(1, "a", 5), (1, "b", 5)}
    now = publish.read_membership(spark, path)
    publish.add_membership(now, pairs((1, "b"), (1, "c"), (2, "q")), path, 7)
    assert stored() == {(1, "a", 5), (1, "b", 5), (1, "c", 7), (2, "q", 7)}
    left = publish.drop_membership(publish.read_membership(spark, path), pairs((1, "a")))
    publish.write_membership(left.filter("rule_id = 1"), [1], path, 8)
    assert stored() == {(1, "b", 8), (1, "c", 8), (2, "q", 7)}
    counted = report.published_counts(ids(1, 2, 3), publish.read_membership(spark, path))
    assert {(r.rule_id, r.published) for r in counted.collect()} == {(1, 2), (2, 1), (3, 0)}


def test_all_rules_at_once_and_one_refusal(spark, registry, tmp_path):
    w = World(spark, registry, str(tmp_path))
    made = [WIDE, Rule(2, {"root": group("or")}),
            Rule(3, {"root": agg("video.dar", "lte", "percentile", 25)})]
    matched = rules.evaluate_all(w.items, made, registry, key="rating_key").select(
        F.col("rule_id").cast("bigint"), F.col("rating_key").alias("item_key"))
    none = w.pairs([], 1)
    changes = publish.diff(matched, none, none, none, w.pairs(["b"], 3))
    ids = spark.createDataFrame([(1,), (2,), (3,)], "rule_id bigint")
    judged = publish.gates(publish.counts(changes, ids).withColumns(
        {"stale": F.lit(0), "in_scope": F.lit(9)}))
    assert {r.rule_id: r.gate for r in judged.collect()} == {
        1: None, 2: "empty_result", 3: None}
    go = publish.allowed(changes, judged)
    assert {(r.rule_id, r.item_key) for r in publish.target_of(go).collect()} == {
        (1, k) for k in FIVE} | {(3, "a"), (3, "c")}
    listed = publish.change_list(go, w.items, "add").collect()
    assert [(r.rule_id, r.item_key) for r in listed] == sorted(
        (r.rule_id, r.item_key) for r in listed)
    assert listed[0].title == "Reel e" and listed[0].year == 1964
    log = publish.history_rows(judged, 9)
    assert report.recent(log, 1, rule_id=2).first().status == "guarded"
    assert report.recent(log, 2, tie="rule_id").count() == 2
