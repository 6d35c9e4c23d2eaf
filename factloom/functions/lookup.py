"""Look-ups in sorted lists that the driver knows: constants of the plan, searched by halving."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F


def in_order(values, texts: bool) -> list:
    """Distinct values as Spark orders them: texts by their UTF-8 bytes, NaN after all numbers."""
    key = (lambda x: x.encode("utf-8", "surrogatepass")) if texts else (lambda x: (math.isnan(x), x))
    return sorted(set(values), key=key)


def constant(values: list, kind: str) -> Column:
    """An array as one literal of the plan: Spark cuts the text once, when it folds constants."""
    if not values:
        return F.array().cast(kind)
    texts = [v if isinstance(v, str) else repr(v) for v in values]
    used = set().union(*texts)
    mark = next(c for c in map(chr, range(1, 0x110000)) if c not in used)
    return F.split(F.lit(mark.join(texts)), rf"\x{{{ord(mark):x}}}", -1).cast(kind)


def ranker(bounds: list, kind: str) -> Callable[[Column], Column]:
    """Makes the rank of a known value among sorted ``bounds``.

    Rank ``2 * i + 2`` is the value of bound ``i``, ``2 * i + 1`` lies right below it; so half the
    rank, rounded down, is the number of bounds up to the value.
    """
    held, count = constant(bounds, f"array<{kind}>"), len(bounds)
    start = F.struct(F.lit(0).alias("low"), F.lit(count).alias("high"))
    steps = F.sequence(F.lit(1), F.lit(count.bit_length() + 1))

    def rank(value: Column) -> Column:
        def halve(s, _):
            middle = ((s["low"] + s["high"]) / 2).cast("int")
            open_ = s["low"] < s["high"]
            less = open_ & F.coalesce(F.get(held, middle) < value, F.lit(False))
            return F.struct(F.when(less, middle + 1).otherwise(s["low"]).alias("low"),
                            F.when(open_ & ~less, middle).otherwise(s["high"]).alias("high"))
        at = F.aggregate(steps, start, halve, lambda s: s["low"])
        return 2 * at + F.when(F.get(held, at).eqNullSafe(value), 2).otherwise(1)
    return rank
