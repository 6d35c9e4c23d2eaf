"""Look-ups that stay even when many rows share a key, or have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SPREAD = 1024


def left_lookup(left: DataFrame, right: DataFrame, on: list[str], spread_by: str) -> DataFrame:
    """``left`` LEFT JOIN ``right`` (unique on ``on``), with NULL keys spread out.

    Rows without a key match nothing, yet a plain join would hash them all to one task.
    They are hashed on a stand-in made from ``spread_by`` instead; the join condition still
    asks for the real key, so a stand-in never matches. Rows with a key keep it, and AQE
    splits a key that is hot on the left side.
    """
    kinds = dict(left.dtypes)
    names = {name: f"_r_{name}" for name in on}
    other = right.withColumnsRenamed(names)
    spot = F.pmod(F.xxhash64(spread_by), F.lit(SPREAD))
    condition = F.lit(True)
    for name, renamed in names.items():
        stand_in = -1 - spot
        if kinds[name] == "string":
            stand_in = F.concat(F.lit("\x00"), spot.cast("string"))
        condition = condition & F.col(name).isNotNull() & (
            F.coalesce(F.col(name), stand_in.cast(kinds[name])) == F.col(renamed))
    return left.join(other, condition, "left").drop(*names.values())


def names_by_id(vocabulary: DataFrame) -> DataFrame:
    """The vocabulary ``(id, name)`` with one row per id: the smallest name that is not empty."""
    return vocabulary.filter(F.col("id").isNotNull() & (F.col("name") != "")).groupBy(
        F.col("id").cast("long").alias("_id")).agg(F.min("name").alias("_name"))


def resolve_names(df: DataFrame, row_id: str, ids: str, out: str,
                  vocabulary: DataFrame) -> DataFrame:
    """Replace an array of ids by the sorted names; unknown ids are dropped.

    An id with several names has the smallest. Spark broadcasts the vocabulary when it is
    small enough and shuffles the (row, id) pairs when it is not; the result is the same.
    """
    pairs = df.select(row_id, F.explode(F.col(ids).cast("array<bigint>")).alias("_id"))
    resolved = pairs.join(names_by_id(vocabulary), "_id").groupBy(row_id).agg(
        F.array_sort(F.collect_list("_name")).alias(out))
    return df.join(resolved, row_id, "left").withColumn(
        out, F.coalesce(out, F.array().cast("array<string>")))


def resolve_name(df: DataFrame, row_id: str, ref: str, out: str,
                 vocabulary: DataFrame) -> DataFrame:
    """Replace one id by its name, the smallest it has; NULL when unknown."""
    known = names_by_id(vocabulary).select(
        F.col("_id").alias(ref), F.col("_name").alias(out))
    return left_lookup(df.withColumn(ref, F.col(ref).cast("long")), known, [ref], row_id)
