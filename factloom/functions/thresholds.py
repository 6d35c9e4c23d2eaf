"""Numbers taken from the whole library: mean, min, max, median, percentile.

Median and percentile are nearest-rank: the value at 0-based position
``floor((n - 1) * q + 0.5)`` of the sorted known values. They are found exactly without
sorting the data and without bringing it into one task: each pass narrows an interval
that holds the wanted rank, with a quantile sketch as the guess and exact counts as the
proof. A pass is one aggregation that serves every pending request of every rule at once.
Its result meets in one task, so what a task sends is kept small: a coarse sketch of a few
kilobytes in the first pass, then sketches over a sample of bounded size. How good a guess
is decides the number of passes (about six for 10^12 values), never the result.

Thresholds come back as plain numbers, so a rule's filter is a comparison with a literal:
it reaches the Parquet scan and needs no join.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .predicates import comparable
from .spec import FactSpec

# With at most about this many distinct candidates left, one exact histogram finishes the
# search: what a task sends then is some tens of kilobytes.
EXACT_DISTINCT = 2_000
# Rows that the later sketches are made of, over all tasks.
SAMPLE = 1_000_000


@dataclass(frozen=True)
class Sketch:
    """How closely a pass looks: quantiles asked for, steps kept around the guess, accuracy."""

    grid: int
    pad: int
    accuracy: int


COARSE = Sketch(grid=100, pad=2, accuracy=100)
FINE = Sketch(grid=500, pad=2, accuracy=2_000)


@dataclass(frozen=True)
class Request:
    """One threshold: ``agg`` (``arg``) of ``spec`` over the rows of scope ``scope_key``."""

    scope_key: str
    spec: FactSpec
    agg: str
    arg: float | None = None

    @property
    def quantile(self) -> float | None:
        if self.agg == "median":
            return 0.5
        return float(self.arg) / 100.0 if self.agg == "percentile" else None


def rank_of(n: int, quantile: float) -> int:
    return max(0, math.floor((n - 1) * quantile + 0.5))


def compute(items: DataFrame, requests: Iterable[Request],
            scopes: dict[str, Column] | None = None) -> dict[Request, float | None]:
    """All thresholds over ``items``; equal requests are computed once.

    ``scopes`` maps a scope key to its row condition; a key that is not in it means
    "all of ``items``".
    """
    wanted = list(dict.fromkeys(requests))
    if not wanted:
        return {}
    names = {}
    for r in wanted:
        names.setdefault((r.scope_key, r.spec.key), (f"v{len(names)}", r))
    needed = {r.scope_key for r in wanted}
    if scopes and needed <= scopes.keys():
        # rows outside all scopes count for nothing: this filter is one the scan can prune by
        items = items.filter(reduce(Column.__or__, [scopes[k] for k in sorted(needed)]))
    values = items.select(*[
        _within(scopes, r.scope_key, comparable(r.spec)).alias(name)
        for name, r in names.values()
    ])

    simple, searches = {}, {}
    for r in wanted:
        name = names[r.scope_key, r.spec.key][0]
        if r.quantile is None:
            simple[r] = {"mean": F.avg, "min": F.min, "max": F.max}[r.agg](name)
        else:
            searches[r] = _RankSearch(name, r.quantile)

    found: dict[Request, float | None] = {}
    first = True
    while first or searches:
        todo = {**(simple if first else {}), **{r: s.probe() for r, s in searches.items()}}
        frame = values if first else values.filter(
            reduce(Column.__or__, [s.window() for s in searches.values()]))
        row = _with_chance(frame).agg(*[c.alias(f"a{i}") for i, c in enumerate(todo.values())]).first()
        for i, r in enumerate(todo):
            if r in searches:
                if searches[r].advance(row[i]):
                    found[r] = searches.pop(r).answer
            else:
                found[r] = row[i]
        first = False
    return found


def nearest_rank(df: DataFrame, column: str, quantile: float) -> float | None:
    """The nearest-rank quantile of one numeric column."""
    values = df.select(F.col(column).cast("double").alias("v0"))
    search = _RankSearch("v0", quantile)
    while True:
        frame = _with_chance(values.filter(search.window()))
        if search.advance(frame.agg(search.probe()).first()[0]):
            return search.answer


def _with_chance(values: DataFrame) -> DataFrame:
    """Adds ``u``, after the filter: below a random column it would not reach the scan."""
    return values.withColumn("u", F.rand(1))


def _within(scopes, key, value):
    scope = (scopes or {}).get(key)
    return value if scope is None else F.when(scope, value)


class _RankSearch:
    """Finds the value of a given rank in column ``v``; ``u`` is uniform on [0, 1).

    ``low`` < answer < ``high`` always holds (None is unbounded) once ``rank`` is known,
    and ``rank`` counts from the first value above ``low``. ``guess`` is the closed
    interval that the next pass counts.
    """

    def __init__(self, column: str, quantile: float):
        self.v = column
        self.quantile = quantile
        self.rank: int | None = None
        self.low = self.high = None
        self.guess = (None, None)
        self.sketch, self.share = COARSE, 1.0
        self.rows = None          # set for the last, exact step
        self.answer = None

    def window(self) -> Column:
        return F.expr(self._between(self.low, self.high))

    def probe(self) -> Column:
        if self.rows is not None:
            at = (self.rank + 0.5) / self.rows
            picked = f"CASE WHEN {self._between(self.low, self.high)} THEN {self.v} END"
            return F.expr(f"percentile_disc({_sql(at)}) WITHIN GROUP (ORDER BY {picked})")
        a, b = self.guess
        inner = self._between(a, b)
        grid = ", ".join(_sql(i / self.sketch.grid) for i in range(self.sketch.grid + 1))
        picked = f"CASE WHEN {inner} THEN {self.v} END"
        sampled = f"CASE WHEN {inner} AND u < {_sql(self.share)} THEN {self.v} END"
        return F.expr(
            f"struct("
            f" count_if({self._between(self.low, a)}) AS below,"
            f" count_if({self._equals(a)}) AS at_a,"
            f" count_if({inner}) AS inside,"
            f" count_if({self._equals(b)}) AS at_b,"
            f" approx_count_distinct({picked}) AS kinds,"
            f" approx_percentile({sampled}, array({grid}), {self.sketch.accuracy}) AS grid)"
        )

    def advance(self, seen) -> bool:
        """Take the result of ``probe``; True when the answer is known."""
        if self.rows is not None:
            self.answer = seen
            return True
        a, b = self.guess
        below = 0 if a is None or a == self.low else seen.below
        at_a = 0 if a is None or a == self.low else seen.at_a
        at_b = 0 if b is None or b == self.high or b == a else seen.at_b
        if self.rank is None:
            if not seen.inside:
                return True
            self.rank = rank_of(seen.inside, self.quantile)

        position = self.rank - below
        if position < 0:
            self._narrow(self.low, a, self.rank)
        elif position < at_a:
            self.answer = a
            return True
        elif position < at_a + seen.inside:
            self._narrow(a, b, position - at_a)
            if min(seen.kinds, seen.inside) <= EXACT_DISTINCT:
                self.rows = seen.inside
            else:
                self._guess_from(seen.grid, seen.inside)
        elif position < at_a + seen.inside + at_b:
            self.answer = b
            return True
        else:
            self._narrow(b, self.high, position - at_a - seen.inside - at_b)
        return False

    def _narrow(self, low, high, rank):
        self.low, self.high, self.rank = low, high, rank
        self.guess = (low, high)

    def _guess_from(self, grid, inside):
        """Aim the next pass at the part of the grid around the rank, and sample that part."""
        steps, pad = self.sketch.grid, self.sketch.pad
        step = self.rank * steps // inside
        first, last = max(step - pad, 0), min(step + pad + 1, steps)
        if grid:
            self.guess = (grid[first], grid[last])
        expected = inside * (last - first) / steps
        self.sketch, self.share = FINE, min(1.0, SAMPLE / max(expected, 1.0))

    def _between(self, low, high) -> str:
        tests = [f"{self.v} IS NOT NULL"]
        if low is not None:
            tests.append(f"{self.v} > {_sql(low)}")
        if high is not None:
            tests.append(f"{self.v} < {_sql(high)}")
        return "(" + " AND ".join(tests) + ")"

    def _equals(self, bound) -> str:
        return "false" if bound is None else f"{self.v} = {_sql(bound)}"


def _sql(number: float) -> str:
    return f"double('{float(number)!r}')"
