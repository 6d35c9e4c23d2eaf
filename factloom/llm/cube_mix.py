"""Mixing sources to target weights by balanced sampling (the cube method).

A source whose target is ``r`` times its size takes every document ``floor(r)`` times; what
is left of ``r`` is each document's inclusion probability for one more copy. The flight
phase moves these probabilities along directions that change neither the expected number
of documents nor of tokens of the source, until a document's probability is 0 or 1. It runs
on parts of a source that hash buckets deal out, so a source that holds a third of all rows
is many tasks; at most three undecided documents of each bucket go on to the next, smaller
round. In the last bucket of a source some ten documents of graded sizes do not fly; they and
the two that flights leave undecided are the landing problem, solved by trying all choices
for the one nearest to the totals.

Documents enter a flight from long to short, so that those still undecided are short ones.
Everything depends on ids and sizes alone: reruns and other partitionings agree.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE_WORD, scratch, written

EDGE = 1e-9


def size_of(text: Column) -> Column:
    """Number of words between white space; NULL is 0."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
            most: float = 2.0) -> DataFrame:
    """Target of each source: ``source, n_docs, source_size, target, ratio``.

    ``sizes`` has ``source`` and ``size``. Sources in code point order, NULL last, take the
    ``weights`` in turn and share ``share`` times all sizes. None gets more than ``most``
    times its size: the water level ``l`` is found at which the targets ``min(most * size,
    l * weight)`` sum to the amount, by running sums over the sources in the order in which
    they reach their cap. There is one row per source from the first step on; the two
    windows over all sources see nothing larger. Sources without words get 0.
    """
    if not 0 <= share <= most:
        raise ValueError("share must lie between 0 and most")
    by_source = sizes.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    given = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    weighted = by_source.withColumn("weight", given.cast("double")).withColumn(
        "cap", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    levelled = weighted.withColumn("amount", F.lit(float(share)) * F.sum("source_size").over(everything)) \
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), zero)) \
        .withColumn("open", F.sum("weight").over(everything)
                    - F.coalesce(F.sum("weight").over(before), zero))
    # the first source that stays under its cap when it and all later ones share the rest
    level = (F.col("amount") - F.col("capped")) / F.col("open")
    stays = F.col("cap") > level * F.col("weight")
    levelled = levelled.withColumn("level", F.min(F.when(stays, F.struct(
        (F.col("cap") / F.col("weight")).alias("at"), level.alias("level")))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(
        F.least("cap", F.col("level.level") * F.col("weight")))
    return levelled.withColumn("target", target).select(
        "source", "n_docs", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(
            zero).alias("ratio"))


def flight(chance: list[float], size: list[float], draw: list[float]) -> list[float]:
    """Move probabilities until at most two are undecided (three equal sizes: at most one).

    The direction over three undecided documents is the cross product of the constraint rows
    (1, 1, 1) and their sizes, so both totals stay. ``draw`` says which way to go, such that
    the expected move is zero. Documents of one size keep only the number constraint.
    """
    chance = list(chance)
    open_: list[int] = []
    for i in range(len(chance)):
        if chance[i] < EDGE or chance[i] > 1 - EDGE:
            chance[i] = 0.0 if chance[i] < 0.5 else 1.0
            continue
        open_.append(i)
        while True:
            if len(open_) >= 2 and size[open_[-1]] == size[open_[-2]]:
                at, way = open_[-2:], (1.0, -1.0)
            elif len(open_) == 3:
                a, b, c = (size[k] for k in open_)
                at, way = open_, (c - b, a - c, b - a)
            else:
                break
            up = down = math.inf
            for k, w in zip(at, way):
                if w > 0:
                    up, down = min(up, (1 - chance[k]) / w), min(down, chance[k] / w)
                elif w < 0:
                    up, down = min(up, chance[k] / -w), min(down, (1 - chance[k]) / -w)
            step = up if draw[i] * (up + down) < down else -down
            left = []
            for k, w in zip(at, way):
                chance[k] += step * w
                if chance[k] < EDGE or chance[k] > 1 - EDGE:
                    chance[k] = 0.0 if chance[k] < 0.5 else 1.0
                else:
                    left.append(k)
            if len(left) == len(at):  # rounding left the nearest one just inside
                k = min(at, key=lambda k: min(chance[k], 1 - chance[k]))
                chance[k] = float(round(chance[k]))
                left.remove(k)
            open_ = [k for k in open_ if k not in at] + left
    return chance


def ladder(size: list[float], steps: int = 10) -> list[int]:
    """Documents kept for the landing: nearest to the largest size halved again and again."""
    order = sorted(range(len(size)), key=lambda k: (-size[k], k))
    chosen, goal, at = [], size[order[0]] if order else 0.0, 0
    while at < len(order) and len(chosen) < steps:
        if size[order[at]] <= goal or at == len(order) - 1:
            chosen.append(order[at])
            goal = min(goal, size[order[at]]) / 2
        at += 1
    return chosen


def landing(chance: list[float], size: list[float]) -> list[float]:
    """Decide the undecided documents, by all their choices: nearest token and document totals.

    A document too many or too few weighs as much as a twentieth of the mean size in tokens.
    """
    open_ = [k for k, p in enumerate(chance) if 0 < p < 1]
    if not open_:
        return list(chance)
    picks = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    sizes, chances = np.array([size[k] for k in open_]), np.array([chance[k] for k in open_])
    cost = abs(picks @ sizes - chances @ sizes) + abs(
        picks.sum(axis=1) - chances.sum()) * sizes.mean() / 20
    done = list(chance)
    for k, pick in zip(open_, picks[int(cost.argmin())]):
        done[k] = float(pick)
    return done


def repaired(chance: list[float], size: list[float], gap: float) -> list[float]:
    """Turn decisions, from long documents to short, while that brings the tokens nearer.

    ``gap`` is what the decided documents lack in tokens. Needed where one document is so long
    that it stays undecided through all flights; else the gap is under a mean size at once.
    """
    done = list(chance)
    for k in sorted(range(len(size)), key=lambda k: (-size[k], k)) if size else ():
        if abs(gap) <= sum(size) / len(size):
            break
        if size[k] <= abs(gap) and done[k] == (0.0 if gap > 0 else 1.0):
            done[k] = 1.0 - done[k]
            gap += size[k] if gap < 0 else -size[k]
    return done


def _flying(land: bool):
    """Flight of one bucket, with the landing where it is the source's only one."""
    def fly(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "hash", "key"], ascending=[False, True, True], kind="stable")
        size = rows["size"].astype(float).tolist()
        draws = ((rows["hash"].to_numpy().astype("uint64") >> 11) / float(1 << 53)).tolist()
        chance = rows["chance"].tolist()
        waiting = set(ladder(size)) if land else set()
        flying = [k for k in range(len(size)) if k not in waiting]
        moved = flight([chance[k] for k in flying], [size[k] for k in flying], [draws[k] for k in flying])
        for k, p in zip(flying, moved):
            chance[k] = p
        if land:
            expected = math.fsum(p * s for p, s in zip(rows["chance"], size))
            chance = landing(chance, size)
            chance = repaired(chance, size, expected - math.fsum(p * s for p, s in zip(chance, size)))
        return rows[["key", "hash", "source", "size"]].assign(chance=chance, buckets=group[1])
    return fly


def balanced(units: DataFrame, counts: DataFrame, bucket_rows: int = 4000) -> DataFrame:
    """Balanced sample: ``key, taken_once`` for ``units(key, source, size, chance)``.

    ``counts(source, n_docs)`` bounds the rows of each source, which sets its number of
    buckets. A round shrinks a source by ``bucket_rows / 2`` at least, so three rounds do for
    10^10 documents. Each round is a written table.
    """
    spark = units.sparkSession
    schema = "key string, hash long, source string, size long, chance double"
    largest = counts.agg(F.max("n_docs")).first()[0] or 0
    most_buckets = max(1, math.ceil(largest / bucket_rows))
    current = units.join(
        counts.select(F.col("source").alias("_s"),
                      F.ceil(F.col("n_docs") / F.lit(bucket_rows)).alias("buckets")),
        F.col("source").eqNullSafe(F.col("_s"))).select(
        "key", F.xxhash64("key").alias("hash"), "source", "size", "chance", "buckets")
    decided = []
    per_round = max(2, bucket_rows // 3)
    while True:
        land = most_buckets == 1
        spread = F.pmod(F.xxhash64("hash", F.lit(len(decided))), F.col("buckets"))
        out = current.groupBy(F.col("source"), F.col("buckets"), spread.alias("bucket")).applyInPandas(
            _flying(land), schema + ", buckets long")
        out = written(out, scratch(spark, f"cube-round-{len(decided)}"))
        settled = F.col("chance").isin(0.0, 1.0)
        decided.append(out.filter(settled).select("key", F.col("chance").cast("int").alias("taken_once")))
        if land:
            break
        # at most two of each bucket go on
        most_buckets = math.ceil(most_buckets / per_round)
        current = out.filter(~settled).withColumn(
            "buckets", F.ceil(F.col("buckets") / F.lit(per_round)))
    result = decided[0]
    for more in decided[1:]:
        result = result.unionByName(more)
    return result


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
        most: float = 2.0, bucket_rows: int = 4000, doc_id: str = "doc_id", text: str = "text",
        source: str = "source") -> DataFrame:
    """``id, rev, source, nth, size, source_size, target, copies``: how often the mix takes each document.

    NULL sources are one source, the last; NULL texts have no words and are never taken.
    Repeated rows of one id and text are units of their own, told apart by ``nth``, and get the same or different copies as any two documents would: they
    come out as separate rows. Empty tables give no rows. ``rev`` is a hash of the text.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("rev"),
        F.col(source).alias("source"), size_of(F.col(text)).alias("size"))
    # one row per document that differs, with the number of its repetitions
    same = sized.groupBy("id", "rev", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    repeated = same.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(
        "id", "rev", "source", "size", "nth",
        F.concat_ws("|", F.col("id").cast("string"), "rev", F.coalesce(F.col("source"), F.lit("\0")),
                    F.col("nth").cast("string")).alias("key"))
    repeated = written(repeated, scratch(spark, "cube-units"))
    goals = written(targets(repeated, weights, share, most), scratch(spark, "cube-targets"))
    whole = F.floor(F.col("ratio") + EDGE)
    planned = repeated.join(goals.withColumnRenamed("source", "_s"),
                            F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "key", "id", "rev", "source", "nth", "size", "source_size", "target", whole.alias("whole"),
        F.greatest(F.col("ratio") - whole, F.lit(0.0)).alias("chance"))
    units = planned.filter((F.col("chance") > EDGE) & (F.col("size") > 0)).select(
        "key", "source", "size", "chance")
    chosen = balanced(units, goals, bucket_rows)
    return planned.join(chosen, "key", "left").select(
        "id", "rev", "source", "nth", "size", "source_size", "target",
        F.when(F.col("size") > 0, F.col("whole") + F.coalesce("taken_once", F.lit(0))).otherwise(
            F.lit(0)).cast("long").alias("copies"))
