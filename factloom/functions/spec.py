"""What a fact is: its key, its type and the operations its type allows."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import types as T


class RuleError(ValueError):
    """A rule, operand or sort key that cannot be used; the message says where."""


class FactType(Enum):
    NUMBER = "number"
    STRING = "string"
    ENUM = "enum"
    BOOL = "bool"
    DATE = "date"
    LIST = "list"


# Dates are epoch seconds, so that a relative window is plain arithmetic.
STORAGE = {
    FactType.NUMBER: T.DoubleType(),
    FactType.STRING: T.StringType(),
    FactType.ENUM: T.StringType(),
    FactType.BOOL: T.BooleanType(),
    FactType.DATE: T.LongType(),
    FactType.LIST: T.ArrayType(T.StringType()),
}

# Fixed value: the shape of a legal key.
KEY_PATTERN = re.compile(r"^[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)+$")


@dataclass(frozen=True)
class FactSpec:
    """One typed attribute.

    ``folded`` promises that stored text is already lower case. Predicates then
    compare the bare column, which Parquet can filter on, instead of ``lower(col)``.
    """

    key: str
    type: FactType
    values: tuple[str, ...] = ()
    element: FactType | None = None
    aggregatable: bool = False
    unit: str | None = None
    folded: bool = False
    applies_to: tuple[str, ...] = ()
    provider: str = ""

    def __post_init__(self):
        problem = None
        if not KEY_PATTERN.match(self.key):
            problem = "keys are dotted lower-case words"
        elif self.type is FactType.ENUM and not self.values:
            problem = "an enum has to list its values"
        elif self.type is FactType.LIST and self.element is None:
            problem = "a list has to name its element type"
        elif self.aggregatable and self.type not in (FactType.NUMBER, FactType.DATE):
            problem = "only numbers and dates can be aggregated"
        if problem:
            raise ValueError(f"fact {self.key!r}: {problem}")

    @property
    def namespace(self) -> str:
        return self.key.partition(".")[0]

    def owned_by(self, provider: str, applies_to: tuple[str, ...]) -> FactSpec:
        return replace(self, provider=provider, applies_to=self.applies_to or applies_to)


def number(key, **options):
    return FactSpec(key, FactType.NUMBER, **options)


def measure(key, **options):
    """A number that rules may compare with the whole library."""
    return FactSpec(key, FactType.NUMBER, aggregatable=True, **options)


def text(key, **options):
    return FactSpec(key, FactType.STRING, **options)


def enum(key, *values, **options):
    return FactSpec(key, FactType.ENUM, values=values, **options)


def flag(key, **options):
    return FactSpec(key, FactType.BOOL, **options)


def date(key, **options):
    return FactSpec(key, FactType.DATE, aggregatable=True, **options)


def words(key, **options):
    return FactSpec(key, FactType.LIST, element=FactType.STRING, **options)
