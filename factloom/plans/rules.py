"""Boolean rules over facts: checking, evaluation, previews, many rules in one pass.

A rule tree is nested dicts, as saved by a client::

    {"root": {"type": "and", "children": [
        {"type": "cmp", "key": "video.dar", "op": "gte", "value": 2.3},
        {"type": "agg_cmp", "key": "file.bitrate_kbps", "op": "gt", "agg": "median"}]}}

It becomes one boolean Column; Catalyst does the rest.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import thresholds
from ..functions.predicates import (
    AGG_COMPARISONS, AGGREGATES, check_operand, comparable, emit, emit_threshold,
)
from ..functions.registry import Registry
from ..functions.spec import FactType, RuleError
from ..operators.catalogue import in_scope

# How large a rule may be.
MAX_DEPTH = 8
MAX_NODES = 200

# Sort keys that are catalogue columns. Title sorts without regard to case.
COLUMN_SORTS = {
    "title": lambda: F.lower("sort_title"),
    "year": lambda: F.col("year"),
    "added_at": lambda: F.col("added_at"),
    "size": lambda: F.col("file_size"),
}
RANDOM_SORT = "random"

RESULT_COLUMNS = ("item_id", "rating_key", "title", "year", "sort_title")


@dataclass(frozen=True)
class Rule:
    rule_id: object
    tree: dict = field(hash=False)
    libraries: tuple[str, ...] = ()
    types: tuple[str, ...] = ("movie",)
    order_by: str | None = None
    descending: bool = True
    limit: int | None = None
    name: str | None = None
    enabled: bool = True

    @classmethod
    def from_row(cls, row: dict) -> Rule:
        """A saved rule: trees and lists may be JSON text."""
        def load(name, default):
            value = row.get(name)
            return json.loads(value) if isinstance(value, str) else (value or default)

        return cls(
            rule_id=row["id"],
            tree=load("rule_json", row.get("rule") or {"root": {"type": "and"}}),
            libraries=tuple(load("library_keys", [])),
            types=tuple(load("item_types", []) or ["movie"]),
            order_by=row.get("order_by_key"),
            descending=str(row.get("order_dir") or "desc").lower() == "desc",
            limit=row.get("limit_n"),
            name=row.get("name"),
            enabled=bool(row.get("enabled", True)),
        )

    @property
    def scope_key(self) -> str:
        return json.dumps([sorted(self.libraries), sorted(self.types)])

    @property
    def scope(self) -> Column:
        return in_scope(self.libraries, self.types)


# ── checking ──────────────────────────────────────────────────────────────────


def check(tree, registry: Registry, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> dict:
    """The tree with only the fields that count; RuleError names the faulty node by its path.

    A node type is an entry of ``SHAPES``: what it keeps of the node, and the nodes below with
    their place. Nothing is cut: a tree that is too deep or too large is an error.
    """
    root = tree.get("root") if isinstance(tree, dict) else None
    if root is None:
        raise RuleError("a rule is an object with a 'root' node")
    size = 0

    def clean(node, path: str, depth: int) -> dict:
        nonlocal size
        size += 1
        shape = SHAPES.get(node.get("type")) if isinstance(node, dict) else None
        try:
            if size > max_nodes or depth > max_depth:
                raise RuleError(f"a rule has {max_nodes} nodes and {max_depth} levels at most")
            if shape is None:
                raise RuleError(f"a node has a type out of {', '.join(SHAPES)}")
            kept, below = shape(node, registry)
        except RuleError as error:
            raise RuleError(f"{path}: {error}") from None
        slots = {name: [clean(child, path + place, depth + 1) for place, child in children]
                 for name, children in below.items()}
        one = {name: nodes[0] for name, nodes in slots.items() if name == "child"}
        return {"type": node["type"], **kept, **slots, **one}

    return {"version": int(tree.get("version", 1)), "root": clean(root, "root", 0)}


def _branch(node, registry):
    children = node.get("children") or []
    if not isinstance(children, list):
        raise RuleError("'children' is a list")
    return {}, {"children": [(f".{node['type']}[{i}]", child) for i, child in enumerate(children)]}


def _inverse(node, registry):
    if node.get("child") is None:
        raise RuleError("'not' needs a 'child'")
    return {}, {"child": [(".not", node["child"])]}


def _constant(node, registry):
    return {"value": bool(node.get("value"))}, {}


def _fact_of(node, registry):
    key = node.get("key")
    if not isinstance(key, str) or not key:
        raise RuleError("a condition needs the 'key' of a fact")
    return registry.require(key)


def _one_of(what, allowed):
    if what not in allowed:
        raise RuleError(f"{what!r} is none of {', '.join(allowed)}")
    return what


def _test(node, registry):
    spec = _fact_of(node, registry)
    check_operand(spec, node.get("op"), node.get("value"))
    return {"key": spec.key, "op": node["op"], "value": node.get("value")}, {}


def _library_test(node, registry):
    spec = _fact_of(node, registry)
    if not spec.aggregatable:
        raise RuleError(f"{spec.key} cannot be compared with the library")
    kept = {"key": spec.key, "op": _one_of(node.get("op"), AGG_COMPARISONS),
            "agg": _one_of(node.get("agg"), AGGREGATES), "agg_arg": node.get("agg_arg")}
    if kept["agg"] == "percentile":
        kept["agg_arg"] = _share(kept["agg_arg"])
    return kept, {}


def _share(value) -> float:
    try:
        share = float(value)
    except (TypeError, ValueError):
        share = -1.0
    if not 0 <= share <= 100:
        raise RuleError(f"a percentile is a number from 0 to 100, not {value!r}")
    return share


SHAPES = {"and": _branch, "or": _branch, "not": _inverse, "cmp": _test,
          "agg_cmp": _library_test, "const": _constant}


def check_order(key: str | None, registry: Registry) -> str | None:
    if not key:
        return None
    if key in COLUMN_SORTS or key == RANDOM_SORT:
        return key
    if registry.require(key).type is FactType.LIST:
        raise RuleError(f"{key} is a list and cannot be sorted by")
    return key


def keys_of(node: dict) -> set[str]:
    """Every fact the tree reads."""
    own = {node["key"]} if "key" in node else set()
    below = list(node.get("children") or []) + ([node["child"]] if node.get("child") else [])
    return own.union(*map(keys_of, below))


def providers_of(rule: Rule, registry: Registry) -> set[str]:
    return {registry.require(k).provider for k in keys_of(rule.tree["root"])}


# ── conditions ────────────────────────────────────────────────────────────────


def requests_of(node: dict, registry: Registry, scope_key: str) -> list[thresholds.Request]:
    if node["type"] == "agg_cmp":
        return [_request(node, registry, scope_key)]
    below = list(node.get("children") or []) + ([node["child"]] if node.get("child") else [])
    return [r for child in below for r in requests_of(child, registry, scope_key)]


def _request(node, registry, scope_key):
    arg = node.get("agg_arg") if node["agg"] == "percentile" else None
    return thresholds.Request(scope_key, registry.require(node["key"]), node["agg"], arg)


def condition(tree: dict, registry: Registry, found=None, now: float | None = None,
              unknown: str = "parity", scope_key: str = "") -> Column:
    """The tree as one boolean Column. ``found`` holds the thresholds it needs."""

    def build(node):
        kind = node["type"]
        if kind in ("and", "or"):
            join = Column.__and__ if kind == "and" else Column.__or__
            parts = [build(child) for child in node["children"]]
            return reduce(join, parts) if parts else F.lit(kind == "and")
        if kind == "not":
            return ~build(node["child"])
        if kind == "const":
            return F.lit(node["value"])
        spec = registry.require(node["key"])
        if kind == "cmp":
            return emit(spec, node["op"], node.get("value"), now, unknown)
        bound = (found or {})[_request(node, registry, scope_key)]
        return emit_threshold(spec, node["op"], bound, unknown)

    return build(check(tree, registry)["root"])


def conditions(items: DataFrame, rules: Iterable[Rule], registry: Registry,
               now: float | None = None, unknown: str = "parity") -> list[Column]:
    """One Column per rule, scope included; all thresholds of all rules share their passes.

    Every pass reads ``items``, so rules with thresholds want a stored wide table and not a
    frame that is joined together anew each time.
    """
    rules = list(rules)
    trees = [check(r.tree, registry) for r in rules]
    requests = [q for r, t in zip(rules, trees)
                for q in requests_of(t["root"], registry, r.scope_key)]
    found = thresholds.compute(items, requests, {r.scope_key: r.scope for r in rules})
    return [
        r.scope & condition(t, registry, found, now, unknown, r.scope_key)
        for r, t in zip(rules, trees)
    ]


# ── evaluation ────────────────────────────────────────────────────────────────


def order_columns(registry: Registry, order_by: str | None = None, descending: bool = True,
                  seed: int | None = None, item_id: str = "item_id") -> list[Column]:
    """Sort columns, with the item id as the last one so that ties are settled."""
    if not order_by:
        return [F.lower("sort_title").asc(), F.col(item_id)]
    if check_order(order_by, registry) == RANDOM_SORT:
        return [F.rand(seed) if seed is not None else F.rand(), F.col(item_id)]
    if order_by in COLUMN_SORTS:
        value = COLUMN_SORTS[order_by]()
        return [value.desc() if descending else value.asc(), F.col(item_id)]
    value = comparable(registry.require(order_by))
    return [value.desc_nulls_last() if descending else value.asc_nulls_last(), F.col(item_id)]


def evaluate(items: DataFrame, rule: Rule, registry: Registry, *, limit: int | None = None,
             now: float | None = None, unknown: str = "parity", columns=RESULT_COLUMNS,
             ordered: bool = True, seed: int | None = None) -> DataFrame:
    """The matched items, in the rule's order; ``limit`` (or the rule's own) makes it a top-N."""
    [test] = conditions(items, [rule], registry, now, unknown)
    matched = items.filter(test)
    cap = limit or rule.limit
    if ordered or cap:
        matched = matched.orderBy(
            *order_columns(registry, rule.order_by, rule.descending, seed))
    return (matched.limit(int(cap)) if cap else matched).select(*columns)


def count(items: DataFrame, rule: Rule, registry: Registry, *, now: float | None = None,
          unknown: str = "parity") -> DataFrame:
    [test] = conditions(items, [rule], registry, now, unknown)
    return items.filter(test).agg(F.count(F.lit(1)).alias("matched"))


def matches(items: DataFrame, rule: Rule, registry: Registry, limit: int | None = None,
            **options) -> DataFrame:
    """A saved rule's matches; its own limit goes before the given one (none: all)."""
    return evaluate(items, rule, registry, limit=rule.limit or limit, **options)


def without_facts(items: DataFrame, provenance: DataFrame, rule: Rule,
                  registry: Registry) -> DataFrame:
    """Items in scope that no provider of the rule has computed successfully."""
    in_scope_items = items.filter(rule.scope)
    providers = providers_of(rule, registry)
    if not providers:
        return in_scope_items.limit(0)
    return in_scope_items.join(_computed(provenance, providers), "item_id", "left_anti")


def _computed(provenance, providers):
    return provenance.filter(
        F.col("provider").isin(*sorted(providers)) & (F.col("status") == "ok")
    ).select("item_id")


def preview(items: DataFrame, provenance: DataFrame, rule: Rule, registry: Registry, *,
            sample_size: int | None = None, now: float | None = None, unknown: str = "parity",
            columns=RESULT_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(one row of counts, ordered sample) for an unsaved rule.

    Counts: matched, collection_size, in_scope, stale. The sample's size is its own and
    not the rule's limit; without one the sample is all matches.
    """
    [test] = conditions(items, [rule], registry, now, unknown)
    frame = items.filter(rule.scope)
    providers = providers_of(rule, registry)
    narrow = frame.select("item_id", F.coalesce(test, F.lit(False)).alias("_hit"))
    if providers:
        done = _computed(provenance, providers).distinct().withColumn("_done", F.lit(True))
        narrow = narrow.join(done, "item_id", "left")
        stale = F.count_if(F.col("_done").isNull())
    else:
        stale = F.lit(0).cast("bigint")
    counts = narrow.agg(
        F.count_if("_hit").alias("matched"),
        F.count(F.lit(1)).alias("in_scope"),
        stale.alias("stale"),
    )
    size = F.least(F.col("matched"), F.lit(rule.limit)) if rule.limit else F.col("matched")
    counts = counts.withColumn("collection_size", size.cast("bigint"))
    sample = frame.filter(test).orderBy(*order_columns(registry, rule.order_by, rule.descending))
    if sample_size is not None:
        sample = sample.limit(sample_size)
    return counts, sample.select(*columns)


def evaluate_all(items: DataFrame, rules: Iterable[Rule], registry: Registry, *,
                 now: float | None = None, unknown: str = "parity",
                 key: str = "item_id") -> DataFrame:
    """(rule_id, item) for every enabled rule.

    Rules without a limit share one pass over the items: each row lists the rules it
    meets. Rules with a limit share a pass per type and direction of the sort key; one that
    is alone in its kind is a top-N of its own. Every rule is part of the plan's expressions,
    which suits some hundreds of rules.
    """
    rules = [r for r in rules if r.enabled]
    if not rules:
        raise RuleError("no enabled rule to evaluate")
    tests = conditions(items, rules, registry, now, unknown)
    # rows outside all scopes meet no rule: this filter is one the scan can prune by
    items = items.filter(reduce(Column.__or__, [r.scope for r in rules]))
    parts = []
    open_ended = [(r, t) for r, t in zip(rules, tests) if not r.limit]
    if open_ended:
        met = F.array_compact(F.array(*[F.when(t, F.lit(r.rule_id)) for r, t in open_ended]))
        parts.append(items.select(F.explode(met).alias("rule_id"), F.col(key)))
    kinds: dict[tuple, list] = {}
    for rule, test in zip(rules, tests):
        if rule.limit:
            kinds.setdefault(_sort_kind(items, rule, registry), []).append((rule, test))
    for kind, members in kinds.items():
        if len(members) > 1:
            parts.append(_top_of_each(items, members, registry, kind, key))
            continue
        [(rule, test)] = members
        parts.append(
            items.filter(test)
            .orderBy(*order_columns(registry, rule.order_by, rule.descending))
            .limit(int(rule.limit))
            .select(F.lit(rule.rule_id).alias("rule_id"), F.col(key)))
    return reduce(DataFrame.unionByName, parts)


def _sort_value(rule: Rule, registry: Registry) -> Column:
    if rule.order_by == RANDOM_SORT:
        return F.rand()
    fact = registry.get(rule.order_by) if rule.order_by else None
    return comparable(fact) if fact is not None else COLUMN_SORTS[rule.order_by or "title"]()


def _sort_kind(items: DataFrame, rule: Rule, registry: Registry) -> tuple[str, bool]:
    """Rules whose sort keys can stand in one column: those of one data type and direction."""
    [(_, kind)] = items.select(_sort_value(rule, registry).alias("value")).dtypes
    falling = bool(rule.order_by) and rule.order_by != RANDOM_SORT and rule.descending
    return kind, falling


def _top_of_each(items: DataFrame, members: list, registry: Registry, kind: tuple[str, bool],
                 key: str) -> DataFrame:
    """The top-N of several rules in one pass; every task keeps at most N rows per rule.

    Values are ranked as they are, in the order that ``order_columns`` gives. Spark prunes
    the ranking inside each task for limits up to spark.sql.optimizer.windowGroupLimitThreshold;
    a rule's candidates then meet in one task, as its top-N must.
    """
    falling = kind[1]
    entries = []
    for rule, test in members:
        value = _sort_value(rule, registry)
        is_fact = bool(rule.order_by) and registry.get(rule.order_by) is not None
        # Unknown facts come last; unknown columns come first, or last when falling.
        unknown_rank = 1 if is_fact or falling else -1
        entries.append(F.when(test, F.struct(
            F.lit(rule.rule_id).alias("rule_id"), F.lit(int(rule.limit)).alias("_limit"),
            F.when(value.isNull(), unknown_rank).otherwise(0).alias("_unknown"),
            value.alias("_value"))))
    rows = items.select(
        F.inline(F.array_compact(F.array(*entries))), F.col("item_id").alias("_tie"),
        F.col(key).alias("_key"))
    value = F.col("_value").desc() if falling else F.col("_value").asc()
    rank = F.row_number().over(
        Window.partitionBy("rule_id").orderBy("_unknown", value, "_tie"))
    most = max(int(rule.limit) for rule, _ in members)
    return (
        rows.withColumn("_rank", rank)
        .filter((F.col("_rank") <= most) & (F.col("_rank") <= F.col("_limit")))
        .select("rule_id", F.col("_key").alias(key))
    )
