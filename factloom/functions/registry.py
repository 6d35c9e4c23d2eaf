"""All known facts, by key. Driver-side metadata only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from .predicates import AGGREGATES, operators_for
from .spec import STORAGE, FactSpec, RuleError


class Registry:
    def __init__(self, providers=()):
        self._specs: dict[str, FactSpec] = {}
        for provider in providers:
            self.register(provider)

    def register(self, provider) -> None:
        """Add every fact of ``provider`` (``id``, ``facts``, ``applies_to``)."""
        for spec in provider.facts:
            other = self._specs.get(spec.key)
            if other is not None:
                raise ValueError(
                    f"fact {spec.key!r} belongs to {other.provider!r}; "
                    f"{provider.id!r} cannot declare it too"
                )
            self._specs[spec.key] = spec.owned_by(provider.id, tuple(provider.applies_to))

    def get(self, key: str) -> FactSpec | None:
        return self._specs.get(key)

    def require(self, key: str) -> FactSpec:
        try:
            return self._specs[key]
        except KeyError:
            raise RuleError(f"unknown fact {key!r}") from None

    def specs(self) -> list[FactSpec]:
        return [self._specs[k] for k in sorted(self._specs)]

    def for_provider(self, provider_id: str) -> list[FactSpec]:
        return [s for s in self.specs() if s.provider == provider_id]

    def namespaces(self) -> list[str]:
        return sorted({s.namespace for s in self._specs.values()})

    def schema(self) -> T.StructType:
        """One struct column per namespace, so that ``col("video.dar")`` resolves."""
        tree: dict = {}
        for spec in self.specs():
            *parents, leaf = spec.key.split(".")
            level = tree
            for name in parents:
                level = level.setdefault(name, {})
            level[leaf] = STORAGE[spec.type]
        return _struct(tree)

    def describe_df(self, spark: SparkSession) -> DataFrame:
        """Each fact with the operators and aggregates a rule may use on it."""
        rows = [
            (
                s.key, s.type.value, s.namespace, s.provider, s.unit, list(s.values),
                s.aggregatable, list(s.applies_to),
                [o["op"] for o in operators_for(s)],
                list(AGGREGATES) if s.aggregatable else [],
            )
            for s in self.specs()
        ]
        return spark.createDataFrame(
            rows,
            "key string, type string, namespace string, provider string, unit string, "
            "allowed_values array<string>, aggregatable boolean, applies_to array<string>, "
            "operators array<string>, aggregates array<string>",
        )


def _struct(tree: dict) -> T.StructType:
    return T.StructType([
        T.StructField(name, _struct(kind) if isinstance(kind, dict) else kind)
        for name, kind in tree.items()
    ])
