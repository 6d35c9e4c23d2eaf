"""Rules over sparse facts, on Spark.

Facts are typed attributes of catalogue items, computed by independent providers. Rules
are boolean trees over facts; they become DataFrame conditions, and what they match is
published as sets.
"""

from .functions.registry import Registry
from .functions.spec import FactSpec, FactType, RuleError
from .plans.rules import Rule

__all__ = ["FactSpec", "FactType", "Registry", "Rule", "RuleError"]
