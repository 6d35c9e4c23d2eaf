"""Random rule trees, as Columns and as SQL on another engine."""

import random

import duckdb
import pytest

from factloom.functions.spec import RuleError, date, enum, flag, measure, text, words
from factloom.functions.registry import Registry
from factloom.operators.providers import Provider
from factloom.plans import rule_index, rules

ROWS = 400


class Toy(Provider):
    id = "toy"
    facts = (measure("t.n"), text("t.s"), enum("t.e", "red", "green", "blue"), flag("t.b"),
             words("t.l"))


def table(rng):
    def maybe(value):
        return None if rng.random() < 0.25 else value

    return [
        (i, maybe(float(rng.randint(0, 9))), maybe(rng.choice(["Abc", "xy%", "a_b", "", "ABC"])),
         maybe(rng.choice(["red", "green", "blue"])), maybe(rng.random() < 0.5),
         maybe([rng.choice(["a", "B", "c"]) for _ in range(rng.randint(0, 3))]))
        for i in range(ROWS)
    ]


def leaf(rng):
    """(tree node, SQL)"""
    n, s, e = rng.randint(0, 9), rng.choice(["abc", "XY%", "_", "a"]), rng.choice(
        ["red", "green"])
    item = rng.choice(["A", "b", "z"])
    guard = lambda key, test: f"(({key} IS NOT NULL) AND ({test}))"
    lists = lambda test: f"(CASE WHEN l IS NOT NULL THEN ({test}) END)"
    low = "list_transform(l, lambda x: lower(x))"
    q = s.lower().replace("'", "''")
    return rng.choice([
        (("t.n", "eq", n), f"(n = {n})"), (("t.n", "ne", n), guard("n", f"n <> {n}")),
        (("t.n", "gte", n), f"(n >= {n})"), (("t.n", "lt", n), f"(n < {n})"),
        (("t.n", "between", [n, 5]), f"(n BETWEEN {min(n, 5)} AND {max(n, 5)})"),
        (("t.n", "not_in", [n, 1]), guard("n", f"n NOT IN ({n}, 1)")),
        (("t.n", "is_null", None), "(n IS NULL)"),
        (("t.s", "eq", s), f"(lower(s) = '{q}')"),
        (("t.s", "contains", s), f"contains(lower(s), '{q}')"),
        (("t.s", "not_contains", s), guard("s", f"NOT contains(lower(s), '{q}')")),
        (("t.s", "starts_with", s), f"starts_with(lower(s), '{q}')"),
        (("t.s", "in", [s, "abc"]), f"(lower(s) IN ('{q}', 'abc'))"),
        (("t.s", "not_in", []), "true"), (("t.s", "in", []), "false"),
        (("t.e", "ne", e), guard("e", f"e <> '{e}'")), (("t.e", "in", [e]), f"(e IN ('{e}'))"),
        (("t.b", "is_true", None), "b"), (("t.b", "is_false", None), guard("b", "NOT b")),
        (("t.l", "contains", item), lists(f"list_contains({low}, '{item.lower()}')")),
        (("t.l", "not_contains", item), lists(f"NOT list_contains({low}, '{item.lower()}')")),
        (("t.l", "contains_any", [item, "c"]),
         lists(f"list_has_any({low}, ['{item.lower()}', 'c'])")),
        (("t.l", "contains_all", [item, "c"]),
         lists(f"list_has_all({low}, ['{item.lower()}', 'c'])")),
        (("t.l", "length_gte", 2), lists("len(l) >= 2")), (("t.l", "is_empty", None),
                                                           lists("len(l) = 0")),
        (("agg", "gt", "median"), guard("n", "n > (SELECT v FROM med)")),
        (("agg", "lte", "mean"), guard("n", "n <= (SELECT avg(n) FROM toy)")),
    ])


def tree(rng, depth=0):
    pick = rng.random()
    if depth == 4 or pick < 0.35:
        (key, op, value), sql = leaf(rng)
        if key == "agg":
            return {"type": "agg_cmp", "key": "t.n", "op": op, "agg": value}, sql
        return {"type": "cmp", "key": key, "op": op, "value": value}, sql
    if pick < 0.55:
        node, sql = tree(rng, depth + 1)
        return {"type": "not", "child": node}, f"(NOT {sql})"
    kind = "and" if pick < 0.78 else "or"
    parts = [tree(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    sql = f" {kind.upper()} ".join(p[1] for p in parts) or ("true" if kind == "and" else "false")
    return {"type": kind, "children": [p[0] for p in parts]}, f"({sql})"


@pytest.mark.parametrize("seed", range(3))
def test_agree(spark, seed):
    rng = random.Random(seed)
    rows = table(rng)
    registry = Registry([Toy()])
    frame = spark.createDataFrame(
        [(i, "movie", None, "1", (n, s, e, b, lst)) for i, n, s, e, b, lst in rows],
        "item_id int, item_type string, deleted_at bigint, library_key string, "
        "t struct<n:double,s:string,e:string,b:boolean,l:array<string>>").cache()
    db = duckdb.connect()
    db.execute("CREATE TABLE toy (id INT, n DOUBLE, s VARCHAR, e VARCHAR, b BOOLEAN, l VARCHAR[])")
    db.executemany("INSERT INTO toy VALUES (?,?,?,?,?,?)", rows)
    db.execute(
        "CREATE TABLE med AS SELECT n AS v FROM (SELECT n, row_number() OVER (ORDER BY n) - 1 r, "
        "count(*) OVER () c FROM toy WHERE n IS NOT NULL) WHERE r = floor((c - 1) * 0.5 + 0.5)")
    pairs = [tree(rng) for _ in range(40)]
    made = [rules.Rule(i, {"root": node}) for i, (node, _) in enumerate(pairs)]
    got, indexed = {}, {}
    for row in rules.evaluate_all(frame, made, registry).collect():
        got.setdefault(row.rule_id, set()).add(row.item_id)
    found = rule_index.evaluate_many(frame, made, registry).collect()
    for row in found:
        indexed.setdefault(row.rule_id, set()).add(row.item_id)
    assert indexed == got and len(found) == sum(map(len, got.values()))
    for i, (node, sql) in enumerate(pairs):
        expected = {r[0] for r in db.execute(f"SELECT id FROM toy WHERE {sql}").fetchall()}
        assert got.get(i, set()) == expected, (node, sql)


@pytest.mark.parametrize("unknown", ["parity", "null"])
def test_index_agrees_on_dates_limits_and_scopes(spark, unknown):
    rng = random.Random(7)
    registry = Registry([Toy(), Dated()])
    some = lambda value: None if rng.random() < 0.2 else value
    rows = [(i, rng.choice(["movie", "show"]), some(1) if i % 9 == 0 else None, rng.choice(["1", "2"]),
             rng.choice(["Zed", "abc", "É"]), some(rng.randint(1990, 2000)), some(rng.randint(1, 9)),
             (some(float(rng.randint(-3, 3))), some(rng.choice(["Ab", "bA", "a\U0010ffff", "aé"]))), (some(rng.randint(0, 20) * 43200),))
            for i in range(300)]
    frame = spark.createDataFrame(
        rows, "item_id int, item_type string, deleted_at bigint, library_key string, sort_title string, year int, "
        "file_size bigint, t struct<n:double,s:string>, d struct<at:bigint>").cache()
    cmp = lambda key, op, value=None: {"type": "cmp", "key": key, "op": op, "value": value}
    leaves = [cmp("d.at", "in_last_days", 3), cmp("d.at", "not_in_last_days", 2), cmp("d.at", "before", "1970-01-05"),
              cmp("t.s", "ends_with", "A"), cmp("t.s", "starts_with", "a\U0010ffff"), cmp("t.s", "ends_with", ""),
              cmp("t.n", "between", [1, -1]), cmp("t.n", "eq", -0.0), cmp("t.s", "contains", ""), cmp("d.at", "is_not_null")]
    made = []
    for i in range(60):
        part = rng.choice(leaves)
        node = rng.choice([part, {"type": "not", "child": part}, {"type": "or", "children": rng.sample(leaves, 3)},
                           {"type": "not", "child": {"type": "and", "children": rng.sample(leaves, 2)}}])
        made.append(rules.Rule(f"r{i}", {"root": node}, libraries=rng.choice([(), ("2",), ("1", "2")]),
                               types=rng.choice([("movie",), ("movie", "show"), ()]), limit=rng.choice([None, 1, 7]),
                               order_by=rng.choice([None, "title", "year", "size", "t.n", "t.s"]),
                               descending=rng.random() < 0.5, enabled=i % 10 > 0))
    rows_of = lambda f: sorted((r.rule_id, r.item_id) for r in f.collect())
    options = {"now": 600_000.0, "unknown": unknown}
    assert rows_of(rule_index.evaluate_many(frame, made, registry, **options)) == rows_of(
        rules.evaluate_all(frame, made, registry, **options))


class Dated(Provider):
    id = "dated"
    facts = (date("d.at"),)


def test_index_refuses_what_it_cannot_tell_apart(spark):
    frame = spark.createDataFrame([], "item_id int, item_type string, deleted_at bigint, library_key string, "
                                      "t struct<n:double>, d struct<at:bigint>")
    registry, node = Registry([Toy(), Dated()]), {"type": "cmp", "key": "t.n", "op": "gt", "value": 1}
    twice = [rules.Rule(1, {"root": node})] * 2
    for made in (twice, [], [rules.Rule(1, {"root": node}, enabled=False)],
                 [rules.Rule(1, {"root": {"type": "cmp", "key": "d.at", "op": "in_last_days", "value": 1}})]):
        with pytest.raises(RuleError):
            rule_index.evaluate_many(frame, made, registry)
    assert rule_index.evaluate_many(frame, twice[:1], registry).collect() == []
    never = rules.Rule(1, {"root": {"type": "const", "value": False}})
    assert rule_index.evaluate_many(frame, [never], registry).collect() == []


@pytest.mark.parametrize("seed", [3, 4])
def test_agree_by_two_facts(spark, monkeypatch, seed):
    monkeypatch.setattr(rule_index, "SHARED", 0)  # however few rules share a shape
    test_agree(spark, seed)


@pytest.mark.parametrize("unknown", ["parity", "null"])
def test_two_facts_agree_on_dates_limits_and_scopes(spark, monkeypatch, unknown):
    monkeypatch.setattr(rule_index, "SHARED", 0)
    test_index_agrees_on_dates_limits_and_scopes(spark, unknown)


def test_two_lists_texts_and_negated_bands_by_two_facts(spark, monkeypatch):
    """Items of several elements in one range, boxes that overlap, NULLs, repeated items."""
    monkeypatch.setattr(rule_index, "SHARED", 0)
    registry = Registry([Toy()])
    cmp = lambda key, op, value=None: {"type": "cmp", "key": key, "op": op, "value": value}
    node = lambda kind, *children: {"type": kind, "children": list(children)}
    rows = [(n, s, "e", True, lst) for n in (None, 1.0, 2.0, 5.0, 9.0) for s in (None, "ab", "b")
            for lst in (None, [], ["a"], ["a", "b", "b"], ["c", "b", "a"])]
    frame = spark.createDataFrame(
        [(i // 2, "movie", None, "1", row) for i, row in enumerate(rows + rows[:9])],
        "item_id int, item_type string, deleted_at bigint, library_key string, "
        "t struct<n:double,s:string,e:string,b:boolean,l:array<string>>").cache()
    outside = node("or", cmp("t.n", "lt", 2), cmp("t.n", "gt", 5), cmp("t.s", "ne", "ab"))
    trees = [
        {"type": "not", "child": outside}, node("and", {"type": "not", "child": outside}, cmp("t.l", "contains", "b")),
        node("and", cmp("t.l", "contains_any", ["a", "b"]), cmp("t.n", "between", [1, 5])),
        node("and", cmp("t.l", "contains_all", ["a", "b"]), cmp("t.s", "in", ["ab", "b"])),
        node("or", node("and", cmp("t.n", "in", [1, 2]), cmp("t.s", "eq", "b")),
             node("and", cmp("t.n", "between", [1, 5]), cmp("t.s", "starts_with", "b")), cmp("t.n", "eq", 9)),
        node("and", cmp("t.n", "gte", 5), cmp("t.n", "lt", 2)),
        node("and", cmp("t.s", "eq", "ab"), cmp("t.n", "between", [1, 5]),
             node("or", cmp("t.l", "is_empty"), node("and", cmp("t.n", "gt", 1), cmp("t.l", "contains", "c")))),
    ]
    made = [rules.Rule(i, {"root": tree}, limit=4 if i % 2 else None, order_by="t.n") for i, tree in enumerate(trees * 2)]
    rows_of = lambda f: sorted((r.rule_id, r.item_id) for r in f.collect())
    found = rows_of(rule_index.evaluate_many(frame, made, registry))
    assert found == rows_of(rules.evaluate_all(frame, made, registry)) and len({r for r, _ in found}) == 12


def test_rules_are_entered_by_what_is_narrow():
    """A negated OR is a band and a point, not all items of the rule's type."""
    from workloads import rule_queries, tables
    index = rule_index.Index(tables.REGISTRY, {}, None, "parity", True)
    made = [i for i in range(4000) if i % 7]
    nodes = [index.scoped(rule_queries.numbered_rule(i)) for i in made]
    for view in index.views.values():
        view.settle()
    for i, node in zip(made, nodes):
        cost, boxes, met = index.picked(index.conjuncts(node), lambda _: True)
        assert boxes and all(len(box) == 2 for box in boxes) and cost <= 100, (i, boxes)


def test_only_items_are_dealt_out(spark):
    """Rules and entries go to every task, so no value of a fact is one task's."""
    registry, node = Registry([Toy()]), {"type": "cmp", "key": "t.n", "op": "gt", "value": 1}
    frame = spark.createDataFrame([], "item_id int, item_type string, deleted_at bigint, library_key string, "
                                      "t struct<n:double,s:string,e:string,b:boolean,l:array<string>>")
    found = rule_index.evaluate_many(frame, [rules.Rule(1, {"root": node})], registry)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    assert "RoundRobinPartitioning" in plan and "hashpartitioning" not in plan


def test_dyadic_intervals_cover_each_rank_once():
    for low, high in ((0, 0), (1, 1), (3, 17), (0, 31), (5, 100)):
        covered = sorted(r for level, at in rule_index.dyadic(low, high) for r in range(at << level, (at + 1) << level))
        assert covered == list(range(low, high + 1))
