"""Thousands of rules in one plan: rules as rows, found by look-ups, judged by a small program.

``rules.evaluate_all`` makes every rule an expression of the plan; here the plan depends on the
facts that rules use, not on the rules.

1. All operands of a fact, in order, cut its values into ranks: odd ranks lie between two
   operands, even ones are operands, 0 is unknown. One binary search gives an item's rank, and
   every condition on a plain fact, its negation too, is a few ranges of ranks.
2. An item need not meet most rules at all. Each rule is entered under boxes of which a match
   must meet one: a box is a range of ranks of one fact or of two, of AND the two best parts, of
   OR all parts. Ranges are entered as dyadic intervals, so items find rules by an equality join
   on (shape, interval, interval), where a shape names facts and levels. A rule is judged at the
   first of its boxes that the item meets, so no pair comes twice.
3. What a rule asks beyond its box, with NOT pushed down to the conditions, is judged on an
   item's ranks by one expression, the same for all rules: clauses (one of several conditions)
   up to the first that fails, and a postfix program for what is nested deeper.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import thresholds
from ..functions.lookup import constant, in_order, ranker
from ..functions.predicates import SECONDS_PER_DAY, comparable, operator_of
from ..functions.registry import Registry
from ..functions.spec import FactSpec, FactType, RuleError
from . import rules as plain
from .rules import RANDOM_SORT, Rule, check

UNKNOWN = 0
SOME, NONE, HOLDS, HOLDS_NOT, AND, OR = range(6)
# How many items a condition lets through, roughly: the entry with the least is taken. A point
# of a view is one of many values, of few (an enumeration), or of hardly any (flags, scopes).
MANY, FEW, HARDLY = 1, 30, 900
SPAN, BLANK, HALF, REST = 100, 300, 1000, 3000
# A rule has at most so many entries by two facts; two facts share so many rules per shape at
# least, or their rules are entered by one: every item is looked up in every shape.
PAIRS, SHARED = 64, 16


@dataclass
class View:
    """One way a fact is looked at: its ranks come from the operands of all rules."""

    value: Column
    texts: bool
    many: bool = False
    point: int = MANY
    needled: bool = False
    bounds: set = field(default_factory=set)
    order: list = field(default_factory=list)
    at: dict = field(default_factory=dict)

    def settle(self) -> None:
        self.order = in_order(self.bounds, self.texts)
        self.at = {b: 2 * i + 2 for i, b in enumerate(self.order)}

    @property
    def last(self) -> int:
        return 2 * len(self.order) + 1


@dataclass(frozen=True)
class Span:
    """Values from ``low`` to ``high``; None is no end, and an end counts unless it is open."""

    low: object = None
    high: object = None
    low_open: bool = False
    high_open: bool = False

    def ranks(self, view: View) -> tuple[int, int]:
        low = 1 if self.low is None else view.at[self.low] + self.low_open
        high = view.last if self.high is None else view.at[self.high] - self.high_open
        return low, high


@dataclass(frozen=True)
class Atom:
    """A condition on one view: some value in the spans (``rest``: known, but in none of them).

    ``unknown``: unknown items meet it, too. ``needle``: a text to be contained instead.
    """

    view: object
    spans: tuple[Span, ...] = ()
    rest: bool = False
    unknown: bool = False
    needle: str | None = None


@dataclass(frozen=True)
class Ranked:
    """Conditions on one view of one value, met together: a rank in one of the ranges."""

    view: object
    ranges: tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Joint:
    """AND (``all``) or OR of parts; without parts true or false."""

    all: bool
    parts: tuple


TRUE, FALSE = Joint(True, ()), Joint(False, ())


def after_prefix(prefix: str) -> str | None:
    """The least text after all that begin with ``prefix``; None if there is none."""
    for at in range(len(prefix) - 1, -1, -1):
        code = ord(prefix[at]) + 1
        if code <= 0x10FFFF:
            return prefix[:at] + chr(0xE000 if 0xD800 <= code <= 0xDFFF else code)
    return None


class Index:
    """Views and programs of a set of rules."""

    def __init__(self, registry: Registry, found: dict, now: float | None, unknown: str, one_scope: bool = False):
        self.registry, self.found, self.now, self.one_scope = registry, found, now, one_scope
        self.parity = unknown == "parity"
        self.views: dict[object, View] = {}
        self.places: dict[object, int] = {}

    # ── conditions ────────────────────────────────────────────────────────────

    def view(self, key, value: Callable[[], Column], texts: bool, many: bool = False, point: int = MANY) -> object:
        if key not in self.views:
            self.views[key] = View(value(), texts, many, point)
        return key

    def _span(self, view, *ends, **opened) -> Span:
        span = Span(*ends, **opened)
        self.views[view].bounds.update(e for e in (span.low, span.high) if e is not None)
        return span

    def _point(self, view, value) -> Span:
        return self._span(view, value, value)

    def of_fact(self, spec: FactSpec) -> object:
        if spec.type is FactType.BOOL:
            return self.view(spec.key, lambda: F.col(spec.key).cast("double"), False, point=HARDLY)
        if spec.type is FactType.LIST:
            return self.view(spec.key, lambda: F.col(spec.key) if spec.folded else F.transform(F.col(spec.key), F.lower),
                             True, many=True)
        return self.view(spec.key, lambda: comparable(spec), spec.type in (FactType.STRING, FactType.ENUM),
                         point=FEW if spec.type is FactType.ENUM else MANY)

    def tested(self, spec: FactSpec, op: str, raw, wanted: bool) -> Atom | Joint:
        """When ``spec op raw`` is true (``wanted``) or false, as conditions with two values."""
        operand = operator_of(spec, op).operand(spec, raw)
        if spec.type is FactType.LIST:
            return self._list(spec, op, operand, wanted)
        view = self.of_fact(spec)
        negative = op in ("ne", "not_in", "is_false", "not_contains")
        guarded = negative or op in ("in_last_days", "not_in_last_days")
        if op in ("is_null", "is_not_null"):
            known = (op == "is_not_null") == wanted
            return Atom(view, rest=True) if known else Atom(view, unknown=True)
        if op in ("in", "not_in") and not operand:
            return TRUE if (op == "not_in") == wanted else FALSE
        rest = negative == wanted
        unknown = guarded and not wanted and self.parity
        if op in ("contains", "not_contains"):
            self.views[view].needled = True
            return Atom(view, rest=rest, unknown=unknown, needle=operand)
        if op == "ends_with":
            view = self.view((spec.key, "end"), lambda: F.reverse(comparable(spec)), True)
        return Atom(view, self._spans(view, op, operand), rest, unknown)

    def _spans(self, view, op: str, x) -> tuple[Span, ...]:
        match op:
            case "eq" | "ne":
                return (self._point(view, x),)
            case "in" | "not_in":
                return tuple(self._point(view, v) for v in x)
            case "is_true" | "is_false":
                return (self._point(view, 1.0),)
            case "gt" | "after":
                return (self._span(view, x, low_open=True),)
            case "gte":
                return (self._span(view, x),)
            case "lt" | "before":
                return (self._span(view, None, x, high_open=True),)
            case "lte":
                return (self._span(view, None, x),)
            case "between":
                return (self._span(view, *x),)
            case "in_last_days":
                return (self._span(view, self._clock() - x),)
            case "not_in_last_days":
                return (self._span(view, None, self._clock() - x, high_open=True),)
            case "starts_with" | "ends_with":
                prefix = x if op == "starts_with" else x[::-1]
                return (self._span(view, prefix, after_prefix(prefix), high_open=True),) if prefix else (Span(),)
        raise RuleError(f"{op!r} is not known here")

    def _clock(self) -> float:
        if self.now is None:
            raise RuleError("relative dates among many rules need a fixed 'now'")
        return float(self.now)

    def _list(self, spec, op, x, wanted) -> Atom | Joint:
        view = self.of_fact(spec)
        if op in ("is_empty", "is_not_empty", "length_gte", "length_lte"):
            size = self.view((spec.key, "size"), lambda: F.when(
                F.col(spec.key).isNotNull(), F.size(spec.key)).cast("double"), False)
            how, bound = {"is_empty": ("lte", 0), "is_not_empty": ("gt", 0), "length_gte": ("gte", x),
                          "length_lte": ("lte", x)}[op]
            return Atom(size, self._spans(size, how, float(bound)), rest=not wanted)
        if op in ("contains_any", "contains_all") and not x:
            return TRUE if (op == "contains_all") == wanted else FALSE
        if op == "contains_all":
            each = tuple(Atom(view, (self._point(view, v),), rest=not wanted) for v in x)
            return Joint(wanted, each)
        points = tuple(self._point(view, v) for v in (x if op == "contains_any" else [x]))
        return Atom(view, points, rest=(op == "not_contains") == wanted)

    def compared(self, spec: FactSpec, op: str, bound: float | None, wanted: bool) -> Atom | Joint:
        """A comparison with a library threshold; without a threshold it is true nowhere."""
        view, unknown = self.of_fact(spec), not wanted and self.parity
        if bound is None:
            return Atom(view, unknown=True) if unknown else FALSE
        return Atom(view, self._spans(view, op, float(bound)), not wanted, unknown)

    def built(self, node: dict, rule: Rule, wanted: bool = True) -> Atom | Joint:
        kind = node["type"]
        if kind in ("and", "or"):
            return Joint((kind == "and") == wanted, tuple(self.built(c, rule, wanted) for c in node["children"]))
        if kind == "not":
            return self.built(node["child"], rule, not wanted)
        if kind == "const":
            return TRUE if node["value"] == wanted else FALSE
        spec = self.registry.require(node["key"])
        if kind == "cmp":
            return self.tested(spec, node["op"], node.get("value"), wanted)
        return self.compared(spec, node["op"], self.found[plain._request(node, self.registry, rule.scope_key)], wanted)

    def scoped(self, rule: Rule) -> Joint:
        """The rule and its scope: live, and of its libraries and types.

        If all rules have one scope, only items of it are looked at and need not be asked.
        """
        parts = [self.built(check(rule.tree, self.registry)["root"], rule)]
        live = Atom(self.everywhere()[0], unknown=True)
        if self.one_scope:
            return Joint(True, tuple(parts))
        parts.append(live)
        for column, allowed in (("library_key", rule.libraries), ("item_type", rule.types)):
            if allowed:
                view = self.view(("column", column), partial(F.col, column), True, point=HARDLY)
                parts.append(Atom(view, tuple(self._point(view, v) for v in allowed)))
        return Joint(True, tuple(parts))

    # ── rows ──────────────────────────────────────────────────────────────────

    def ranges(self, atom: Atom) -> tuple[int, list[tuple[int, int]]]:
        """SOME or NONE, and the ranges of ranks."""
        view = self.views[atom.view]
        spans = [r for s in atom.spans if (r := s.ranks(view))[0] <= r[1]]
        if atom.rest and not view.many:  # one value: the ranges that the spans leave
            spans = _left_over(spans, view.last)
        if atom.rest and view.many:
            return NONE, [*spans, (UNKNOWN, UNKNOWN)]
        return SOME, [*spans, *([(UNKNOWN, UNKNOWN)] if atom.unknown else [])]

    def conjuncts(self, node) -> list:
        """What must hold together; conditions on the same view of one value as one."""
        if isinstance(node, Joint) and node.all:
            flat = [c for p in node.parts for c in self.conjuncts(p)]
        elif isinstance(node, Atom) and node.needle is None and not self.views[node.view].many:
            flat = [Ranked(node.view, tuple(_merged(self.ranges(node)[1])))]
        else:
            flat = [node]
        ranked: dict[object, Ranked] = {}
        for part in flat:
            if isinstance(part, Ranked):
                other = ranked.get(part.view, part)
                ranked[part.view] = Ranked(part.view, tuple(
                    (max(a, c), min(b, d)) for a, b in part.ranges for c, d in other.ranges if max(a, c) <= min(b, d)))
        return [*ranked.values(), *[p for p in flat if not isinstance(p, Ranked)]]

    def _step(self, node: Atom | Ranked, numbers: dict) -> dict:
        needle = None
        if isinstance(node, Ranked):
            how, spans = SOME, node.ranges
        elif node.needle is not None:
            how, needle = HOLDS_NOT if node.rest else HOLDS, node.needle
            spans = [(UNKNOWN, UNKNOWN)] if node.unknown else []
        else:
            how, spans = self.ranges(node)
        return _step(how, numbers[node.view], spans, needle)

    def program(self, node: Atom | Joint | Ranked, numbers: dict) -> list[dict]:
        """Postfix steps; an empty AND or OR is a condition that any, or no, item meets."""
        if not isinstance(node, Joint):
            return [self._step(node, numbers)]
        if not node.parts:
            return [_step(NONE if node.all else SOME)]
        steps = [self.program(p, numbers) for p in node.parts]
        return reduce(lambda a, b: a + b + [_step(AND if node.all else OR)], steps)

    def judgement(self, parts: list, numbers: dict) -> tuple[list[list[dict]], list[dict]]:
        """Clauses and a program, which together hold if all parts do."""
        clauses, nested = [], []
        for part in parts:
            either = _alternatives(part)
            if any(isinstance(p, Joint) for p in either):
                nested.append(part)
            else:
                clauses.append([self._step(p, numbers) for p in either])
        return clauses, self.program(Joint(True, tuple(nested)), numbers) if nested else []

    def cost(self, name, ranges: Iterable[tuple[int, int]]) -> int:
        view = self.views[name]
        if name == self.everywhere()[0]:
            return REST

        def one(low: int, high: int) -> int:
            if low == high:
                return BLANK if low == UNKNOWN else view.point
            return (SPAN, HALF, REST)[(low <= 1) + (high == view.last)]
        return sum(one(*r) for r in ranges)

    def entries(self, node, paired: Callable[[tuple], bool]) -> tuple[int, list[tuple], bool]:
        """Cost, boxes of which a match meets one, and whether who meets one is a match.

        A box is one range ``(view, low, high)`` or two, of views that ``paired`` allows.
        """
        parts = self.conjuncts(node)
        if len(parts) != 1:
            cost, boxes, met = self.picked(parts, paired)
            return cost, boxes, len(met) == len(parts)
        [node] = parts
        if isinstance(node, Joint):
            each = [self.entries(p, paired) for p in node.parts]
            return sum(e[0] for e in each), list(dict.fromkeys(b for e in each for b in e[1])), all(e[2] for e in each)
        view, exact = self.views[node.view], True
        if isinstance(node, Ranked):
            spans = node.ranges
        else:
            how, spans = self.ranges(node)
            if how == NONE and node.needle is None:
                return 10 * REST, [(self.everywhere(),)], False
            if node.needle is not None:
                exact, spans = False, [(1, view.last), *([(UNKNOWN, UNKNOWN)] if node.unknown else [])]
        return self.cost(node.view, spans), [((node.view, *s),) for s in spans], exact

    def picked(self, parts: list, paired: Callable[[tuple], bool]) -> tuple[int, list[tuple], list]:
        """Cost and boxes of all parts together, and the parts that hold in every box."""
        if not parts:
            return 10 * REST, [(self.everywhere(),)], []
        rated = sorted(((*self.entries(p, paired), p) for p in parts), key=lambda r: r[0])
        cost, boxes, exact, part = rated[0]
        met = [part] if exact else []
        for more, others, exact, part in rated[1:]:
            if more >= HARDLY:
                break
            crossed = [tuple(sorted(a + b, key=self._nth)) for a in boxes for b in others]
            if all(self._pairable(box) and paired(box) for box in crossed) and sum(
                    len(_intervals(box)) for box in crossed) <= PAIRS:
                return cost * more // REST, crossed, met + ([part] if exact else [])
        return cost, boxes, met

    def _nth(self, place: tuple) -> tuple:
        return (self.places.setdefault(place[0], len(self.places)), *place[1:])

    def _pairable(self, box: tuple) -> bool:
        """Two views, not both lists: of those all pairs of elements would be looked up."""
        return len(box) == 2 and not all(self.views[p[0]].many for p in box)

    def apart(self, one: tuple, other: tuple) -> bool:
        """Whether no item meets both boxes."""
        return any(a[0] == b[0] and not self.views[a[0]].many and (a[2] < b[1] or b[2] < a[1])
                   for a in one for b in other)

    def everywhere(self) -> tuple[object, int, int]:
        view = self.view(("column", "deleted_at"), lambda: F.col("deleted_at").cast("double"), False)
        return view, UNKNOWN, UNKNOWN  # deleted rows meet no rule


def _left_over(spans: Sequence[tuple[int, int]], last: int) -> list[tuple[int, int]]:
    out, at = [], 1
    for low, high in sorted(spans):
        if at < low:
            out.append((at, low - 1))
        at = max(at, high + 1)
    return [*out, (at, last)] if at <= last else out


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same ranks in ranges that lie apart."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return out


def _alternatives(node) -> list:
    """The parts of an OR, those of ORs in it too; anything else is its only part."""
    if isinstance(node, Joint) and not node.all:
        return [a for p in node.parts for a in _alternatives(p)]
    return [node]


def _step(op: int, view: int = 0, ranges: Iterable[tuple[int, int]] = (), needle: str | None = None) -> dict:
    return {"op": op, "view": view, "ranges": [{"low": a, "high": b} for a, b in ranges], "needle": needle}


def _intervals(box: tuple) -> list[tuple[tuple[int, int], ...]]:
    """For each part of a box, ``(level, interval)`` of each of its ranges."""
    return list(product(*(dyadic(low, high) for _, low, high in box)))


def dyadic(low: int, high: int) -> list[tuple[int, int]]:
    """``(level, interval)``: the fewest aligned intervals of ``2 ** level`` ranks that make the range."""
    out, level, high = [], 0, high + 1
    while low < high:
        if low & 1:
            out.append((level, low))
            low += 1
        if high & 1:
            high -= 1
            out.append((level, high))
        low, high, level = low >> 1, high >> 1, level + 1
    return out


STEP = pa.struct([("op", pa.int8()), ("view", pa.int32()), ("needle", pa.string()),
                  ("ranges", pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))])
PLACE = pa.struct([("view", pa.int32()), ("low", pa.int32()), ("high", pa.int32())])
BOX = pa.list_(PLACE)


def _within(ranks: Column, ranges: Column) -> Column:
    return F.exists(ranges, lambda r: F.exists(ranks, lambda k: (k >= r["low"]) & (k <= r["high"])))


def _holds(step: Column, ranks: Column, texts: Column) -> Column:
    """Whether an item meets one condition."""
    inside = _within(F.get(ranks, step["view"]), step["ranges"])
    held = F.coalesce(F.get(texts, step["view"]).contains(step["needle"]), F.lit(False))
    known = F.get(texts, step["view"]).isNotNull()
    op = step["op"]
    return (F.when(op == SOME, inside).when(op == NONE, ~inside)
            .when(op == HOLDS, held | inside).otherwise((known & ~held) | inside))


def _judged(program: Column, ranks: Column, texts: Column) -> Column:
    """Whether an item meets a program: a stack of bits in a long."""
    def run(stack, step):
        top, below = stack % 2 == 1, F.shiftright(stack, 1) % 2 == 1
        joined = F.when(step["op"] == AND, top & below).otherwise(top | below)
        return F.when(step["op"] >= AND, F.shiftleft(F.shiftright(stack, 2), 1) + joined.cast("long")).otherwise(
            F.shiftleft(stack, 1) + _holds(step, ranks, texts).cast("long"))
    return (F.size(program) == 0) | (F.aggregate(program, F.lit(0).cast("long"), run) % 2 == 1)


def evaluate_many(items: DataFrame, rules: Iterable[Rule], registry: Registry, *, now: float | None = None,
                  unknown: str = "parity", key: str = "item_id") -> DataFrame:
    """(rule_id, item) for every enabled rule, as ``rules.evaluate_all`` gives it.

    The plan's size depends on the facts that are used. Rules, operands and entries are small
    tables, sent to every task: only items are dealt out, evenly. Items are read once for the rules without a limit and once for those with one, after
    the passes for library thresholds. Rule ids are unique and of one type. Relative dates need
    ``now``.
    """
    rules = [r for r in rules if r.enabled]
    if not rules:
        raise RuleError("no enabled rule to evaluate")
    if len({r.rule_id for r in rules}) < len(rules):
        raise RuleError("rule ids are not unique")
    trees = [check(r.tree, registry) for r in rules]
    requests = [q for r, t in zip(rules, trees) for q in plain.requests_of(t["root"], registry, r.scope_key)]
    scopes = {key: r.scope for key, r in {r.scope_key: r for r in rules}.items()}
    found = thresholds.compute(items, requests, scopes)
    # rows outside all scopes meet no rule: this filter is one the scan can prune by
    items = items.filter(reduce(Column.__or__, scopes.values()))
    index = Index(registry, found, now, unknown, len(scopes) == 1)
    built = [(r, index.scoped(r)) for r in rules]
    for view in index.views.values():
        view.settle()
    numbers = {name: i for i, name in enumerate(index.views)}
    sorts = sorted({plain.check_order(r.order_by, registry) or "title" for r in rules if r.limit})
    parts = []
    if every := [b for b in built if not b[0].limit]:
        entries = _entries(items.sparkSession, index, every, numbers, sorts)
        parts.append(_matches(items, index, entries, numbers, key, F.lit(None).cast("int")).select("rule_id", key))
    if first := [b for b in built if b[0].limit]:
        entries = _entries(items.sparkSession, index, first, numbers, sorts)
        values = F.struct(*[plain._sort_value(Rule(0, {}, order_by=k), registry).alias(f"s{i}") for i, k in enumerate(sorts)])
        found = _matches(items, index, entries, numbers, key, values)
        parts.append(_first_of_each(found, sorts, registry, max(int(r.limit) for r, _ in first)).select("rule_id", key))
    return reduce(DataFrame.unionByName, parts)


def _entries(spark, index: Index, built, numbers, sorts) -> tuple[DataFrame, DataFrame, list[tuple]]:
    """Entries, a row for each box and pair of intervals; rules, with what is judged; shapes.

    A shape is ``(view, level, view, level)``, of one view ``(view, level, -1, 0)``: nothing else
    is looked up.
    """
    parts = [index.conjuncts(node) for _, node in built]
    rules_of, shapes_of = Counter(), defaultdict(set)
    for own in parts:
        boxes = [b for b in index.picked(own, lambda _: True)[1] if len(b) == 2]
        rules_of.update({_views(b) for b in boxes})
        for box in boxes:
            shapes_of[_views(box)].update(tuple(level for level, _ in pair) for pair in _intervals(box))
    shared = {views for views, own in shapes_of.items() if len(own) * SHARED <= rules_of[views]}
    shapes: dict[tuple, int] = {}
    entries = {n: [] for n in ("shape", "a", "b", "nth", "box", "earlier")}
    rows = {n: [] for n in ("nth", "rule_id", "clauses", "program", "limit", "by", "falling")}
    for nth, ((rule, _), own) in enumerate(zip(built, parts)):
        _, boxes, met = index.picked(own, lambda box: _views(box) in shared)
        clauses, program = index.judgement([p for p in own if p not in met], numbers)
        by = sorts.index(rule.order_by or "title") if rule.limit else None
        _add(rows, nth, rule.rule_id, clauses, program, rule.limit and int(rule.limit), by,
             bool(rule.order_by) and rule.descending)
        for at, box in enumerate(boxes):
            earlier = [_placed(b, numbers) for b in boxes[:at] if not index.apart(b, box)]
            for (level, a), *second in _intervals(box):
                other, other_level, b = (numbers[box[1][0]], *second[0]) if second else (-1, 0, UNKNOWN)
                shape = (numbers[box[0][0]], level, other, other_level)
                _add(entries, shapes.setdefault(shape, len(shapes)), a, b, nth, _placed(box, numbers), earlier)
    kinds = {"clauses": pa.list_(pa.list_(STEP)), "program": pa.list_(STEP), "limit": pa.int64(),
             "falling": pa.bool_(), "rule_id": None, "box": BOX, "earlier": pa.list_(BOX)}

    def frame(columns):
        return spark.createDataFrame(pa.table({n: pa.array(v, kinds.get(n, pa.int32())) for n, v in columns.items()}))
    return frame(entries), frame(rows), list(shapes)


def _views(box: tuple) -> tuple:
    return tuple(place[0] for place in box)


def _placed(box: tuple, numbers: dict) -> list[dict]:
    return [{"view": numbers[name], "low": low, "high": high} for name, low, high in box]


def _add(columns: dict[str, list], *row) -> None:
    for column, value in zip(columns.values(), row, strict=True):
        column.append(value)


def _matches(items: DataFrame, index: Index, entries: tuple[DataFrame, DataFrame, list[tuple]], numbers, key: str,
             sort_values: Column) -> DataFrame:
    """``rule_id``, the item's key, and what rules with a limit sort by."""
    ranks, held = [], []
    for view in index.views.values():
        one = ranker(view.order, "string" if view.texts else "double")
        known = F.array_distinct(F.transform(F.array_compact(view.value), one)) if view.many else F.array(one(view.value))
        ranks.append(F.when(view.value.isNull(), F.array(F.lit(UNKNOWN))).otherwise(known))
        held.append(view.value if view.needled else F.lit(None).cast("string"))
    ranked = items.select(F.col(key).alias("_key"), F.array(*ranks).alias("_ranks"), F.array(*held).alias("_held"),
                          sort_values.alias("_sort"), F.col("item_id").alias("_tie"))
    # an item costs far more than its bytes tell: files or small partitions would be too few tasks
    ranked = ranked.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    entries, rows, shapes = entries
    first_view, first_level, other_view, other_level = (
        constant([s[i] for s in shapes], "array<int>") for i in range(4))
    shift = partial(F.call_function, "shiftright")

    def looked_up(shape):
        others = F.when(F.get(other_view, shape) < 0, F.array(F.lit(UNKNOWN))).otherwise(
            F.get("_ranks", F.get(other_view, shape)))
        return F.flatten(F.transform(F.get("_ranks", F.get(first_view, shape)), lambda one: F.transform(
            others, lambda other: F.struct(
                shape.alias("shape"), shift(one, F.get(first_level, shape)).alias("a"),
                shift(other, F.get(other_level, shape)).alias("b"), F.array(one, other).alias("own")))))
    probes = F.flatten(F.transform(constant(list(range(len(shapes))), "array<int>"), looked_up))
    probed = ranked.withColumn("_probe", F.explode(probes)).select(*ranked.columns, "_probe.*")
    both = probed.join(F.broadcast(entries), ["shape", "a", "b"])

    def least(place) -> Column:
        """The least of the item's ranks in a range of ranks."""
        return F.array_min(F.filter(F.get("_ranks", place["view"]), lambda k: (k >= place["low"]) & (k <= place["high"])))
    first = ~F.exists("earlier", lambda box: F.forall(box, lambda place: least(place).isNotNull()))
    if any(view.many for view in index.views.values()):
        for i in range(2):
            place = F.get("box", F.lit(i))
            first &= place.isNull() | (least(place) == F.get("own", F.lit(i)))
    met = F.forall("clauses", lambda clause: F.exists(clause, lambda step: _holds(step, F.col("_ranks"), F.col("_held"))))
    return both.filter(first).join(F.broadcast(rows), "nth").filter(
        met & _judged(F.col("program"), F.col("_ranks"), F.col("_held"))).select(
        "rule_id", F.col("_key").alias(key), "limit", "by", "falling", "_sort", "_tie")


def _first_of_each(found: DataFrame, sorts: Sequence[str], registry: Registry, most: int) -> DataFrame:
    """The first ``limit`` items of each rule, in one ranking for all sort keys.

    A rule's value stands in the column of its type and direction; the others are NULL for all
    of its items and settle nothing.
    """
    kinds: dict[str, list[tuple[int, Column]]] = {}
    random, unknown = F.lit(None).cast("double"), F.lit(0)
    for i, name in enumerate(sorts):
        if name == RANDOM_SORT:
            random = F.when(F.col("by") == i, F.rand())
            continue
        value = F.col(f"_sort.s{i}")
        kinds.setdefault(found.schema["_sort"].dataType[f"s{i}"].dataType.simpleString(), []).append((i, value))
        first = F.lit(1) if registry.get(name) is not None else F.when(F.col("falling"), 1).otherwise(-1)
        unknown = F.when((F.col("by") == i) & value.isNull(), first).otherwise(unknown)
    order = [unknown, random]
    for values in kinds.values():
        own = F.coalesce(*[F.when(F.col("by") == i, value) for i, value in values])
        order += [F.when(F.col("falling"), own).desc(), F.when(~F.col("falling"), own).asc()]
    rank = F.row_number().over(Window.partitionBy("rule_id").orderBy(*order, "_tie"))
    return found.withColumn("_nth", rank).filter((F.col("_nth") <= most) & (F.col("_nth") <= F.col("limit")))
