"""The sparse fact store: long rows with tombstones, and the wide frame made of them.

Long rows: (item_id, key, value STRING, provider, seq, is_delete). The row with the
highest ``seq`` counts. A key that a later run does not emit keeps its value; an explicit
delete removes it; a list replaces the former list as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.registry import Registry
from ..functions.spec import STORAGE, FactSpec, FactType
from .store import Store

LONG_SCHEMA = (
    "item_id string, key string, value string, provider string, seq bigint, is_delete boolean"
)


def to_long(results: DataFrame, specs: list[FactSpec], seq: Column | int) -> DataFrame:
    """The emitted (non-null) facts of provider results as long rows."""
    entries = [
        F.struct(
            F.lit(s.key).alias("key"),
            (F.to_json(F.col(s.key)) if s.type is FactType.LIST
             else F.col(s.key).cast("string")).alias("value"),
            F.lit(s.provider).alias("provider"),
        )
        for s in specs
    ]
    emitted = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    return results.select(
        "item_id", F.inline(emitted),
    ).withColumns({
        "seq": F.lit(seq).cast("bigint") if isinstance(seq, int) else seq.cast("bigint"),
        "is_delete": F.lit(False),
    })


def merge(stored: DataFrame, results: DataFrame) -> DataFrame:
    """Stored long rows with newer ones laid over them; deleted keys disappear.

    For frames at hand; ``fact_store`` merges stored rows without moving them.
    """
    columns = ["value", "provider", "seq", "is_delete"]
    latest = (
        stored.unionByName(results)
        .groupBy("item_id", "key")
        .agg(F.max_by(F.struct(*columns), F.col("seq")).alias("last"))
    )
    return latest.filter(~F.col("last.is_delete")).select(
        "item_id", "key", *[f"last.{c}" for c in columns])


# ── the tables on disk ────────────────────────────────────────────────────────
# One folder per run, bucketed by item (see ``store``). Writing a run's facts adds no more than
# that run's rows, and a run that is repeated replaces its own. Readers merge bucket by bucket;
# ``compact`` rewrites.

PROVENANCE_SCHEMA = (
    "item_id string, provider string, schema_version int, input_fp string, computed_at bigint, "
    "status string, reason string"
)


def fact_store(spark: SparkSession, path: str, buckets: int | None = None) -> Store:
    return Store.open(spark, path, LONG_SCHEMA, ("item_id", "key"), "seq", buckets)


def provenance_store(spark: SparkSession, path: str, schema: str = PROVENANCE_SCHEMA,
                     buckets: int | None = None) -> Store:
    return Store.open(spark, path, schema, ("item_id", "provider"), "computed_at", buckets)


def write_patch(results: DataFrame, path: str, run_id: int, buckets: int | None = None) -> None:
    fact_store(results.sparkSession, path, buckets).put(results, run_id)


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    return fact_store(spark, path).rows()


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each (item, key) that is not a tombstone; no stored row is shuffled."""
    return fact_store(spark, path).merged().filter(~F.col("is_delete"))


def compact(spark: SparkSession, path: str, new_path: str, run_id: int) -> None:
    """The merged facts as one run of a new table; deleted keys are gone for good."""
    write_patch(read_merged(spark, path), new_path, run_id, fact_store(spark, path).buckets)


def merge_provenance(stored: DataFrame | Store, results: DataFrame) -> DataFrame:
    """One row per (item, provider): the newest, as a whole.

    Of a store only the results are moved, to the buckets the stored rows are in.
    """
    if isinstance(stored, Store):
        return stored.merged(results)
    rest = [c for c in stored.columns if c not in ("item_id", "provider")]
    return (
        stored.unionByName(results)
        .groupBy("item_id", "provider")
        .agg(F.max_by(F.struct(*rest), F.col("computed_at")).alias("last"))
        .select("item_id", "provider", *[f"last.{c}" for c in rest])
    )


def widen(facts: DataFrame, registry: Registry) -> DataFrame:
    """One row per item with one struct column per namespace.

    An item has at most one row per registered key, so its map is bounded by the registry.
    """
    known = [s.key for s in registry.specs()]
    by_key = (
        facts.filter(F.col("key").isin(*known))
        .groupBy("item_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("f"))
    )
    return by_key.select("item_id", *_namespaces(registry.schema(), registry, "", F.col("f")))


def _namespaces(schema: T.StructType, registry, prefix, values) -> list[Column]:
    columns = []
    for item in schema.fields:
        path = prefix + item.name
        if isinstance(item.dataType, T.StructType):
            made = F.struct(*_namespaces(item.dataType, registry, path + ".", values))
        else:
            made = _typed(registry.require(path), F.try_element_at(values, F.lit(path)))
        columns.append(made.alias(item.name))
    return columns


def _typed(spec: FactSpec, raw: Column) -> Column:
    if spec.type is FactType.LIST:
        return F.from_json(raw, STORAGE[spec.type])
    return raw.try_cast(STORAGE[spec.type])


def lay_over(items: DataFrame, results: DataFrame, namespaces: list[str]) -> DataFrame:
    """The wide form of ``merge`` for results without deletes: new values go first.

    Both sides hold ``namespaces`` as structs; fields keep the order of ``items``, and a
    namespace the items do not have yet is taken as it is.
    """
    have = {f.name: f.dataType for f in items.schema.fields}
    new = {f.name: f.dataType for f in results.schema.fields}
    joined = items.join(
        results.select("item_id", *[F.col(n).alias(f"_new_{n}") for n in namespaces]),
        "item_id", "left")
    made = {}
    for name in namespaces:
        if name not in have:
            made[name] = F.col(f"_new_{name}")
            continue
        fields = list(dict.fromkeys([*have[name].names, *new[name].names]))
        made[name] = F.struct(*[
            F.coalesce(*[
                F.col(f"{side}.{f}") for side, kind in
                ((f"_new_{name}", new[name]), (name, have[name])) if f in kind.names
            ]).alias(f)
            for f in fields
        ])
    return joined.withColumns(made).drop(*[f"_new_{n}" for n in namespaces])


def leaf_count(registry: Registry, items: DataFrame) -> Column:
    """How many facts an item has; a list counts once."""
    structs = {f.name: f.dataType for f in items.schema.fields
               if isinstance(f.dataType, T.StructType)}
    known = [
        F.col(s.key).isNotNull().cast("int") for s in registry.specs()
        if s.namespace in structs and s.key.split(".")[1] in structs[s.namespace].names
    ]
    return sum(known, F.lit(0))
