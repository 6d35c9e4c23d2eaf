"""Keep watch facts up to date as history files arrive.

Each micro-batch is reduced to (item, user) pairs and written as one partition of the
state table, named by the batch id. A batch that runs again after a failure overwrites its
own partition, so every history row counts once. Readers add the partitions up; distinct
users stay exact since the user is part of the pair. ``compact`` folds old partitions into
one.

``RunningTotals`` keeps the totals per item themselves: each batch adds one row per item it
touches, in which only pairs that no batch had before count as users, and readers add up
these rows without looking at pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.providers.history import merge_pairs, per_item, plays_by_user
from ..operators.store import RUN, Store

HISTORY_SCHEMA = (
    "rating_key string, date bigint, stopped bigint, user string, watched_status double"
)
STATE_SCHEMA = (
    "rating_key string, user string, plays bigint, last bigint, completed bigint, "
    "generation string, batch bigint"
)


def start(history: DataFrame, state_path: str, checkpoint: str,
          generation: str = "g0") -> StreamingQuery:
    """Process all history that has arrived and stop.

    ``history`` is a streaming frame with the columns of ``HISTORY_SCHEMA``. Run it again
    with the same paths to take in what came since.
    """

    def record(batch: DataFrame, batch_id: int) -> None:
        (
            plays_by_user(batch)
            .withColumns({"generation": F.lit(generation), "batch": F.lit(batch_id)})
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("generation", "batch").parquet(state_path)
        )

    return (
        history.writeStream.foreachBatch(record)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


@dataclass(frozen=True)
class RunningTotals:
    """Totals per item on disk: the (item, user) pairs seen, and each batch's changes per item.

    Pairs are bucketed by a hash of item and user, so that an item with most of the history
    is spread over all buckets; changes are bucketed by item. A batch is a run of both stores
    and looks only at earlier runs, so one that is repeated writes the same again. Batches
    come one after the other, under numbers that rise; a folder belongs to one checkpoint.
    """

    folder: str
    pairs: Store
    changes: Store

    @classmethod
    def open(cls, spark: SparkSession, folder: str, buckets: int | None = None) -> RunningTotals:
        """The totals in ``folder``, empty ones if there are none."""
        return cls(
            folder,
            Store.open(spark, f"{folder}/pairs",
                       "pair bigint, rating_key string, user string, plays bigint, last bigint, "
                       "completed bigint", ("pair", "rating_key", "user"), "last", buckets),
            Store.open(spark, f"{folder}/changes",
                       "rating_key string, plays bigint, last bigint, users bigint, "
                       "completed bigint", ("rating_key",), "last", buckets))

    def take(self, history: DataFrame, batch: int) -> None:
        """Add a batch of history rows (columns of ``HISTORY_SCHEMA``), numbered from 0."""
        run = batch + 1  # run 0 of a store is the empty one it is made with
        met = self._met(history, run)
        # stored once, in place of the batch before: both stores are written from it
        path = f"{self.folder}/batch"
        met.write.mode("overwrite").parquet(path)
        met = self.pairs.spark.read.schema(met.schema).parquet(path)
        self.changes.put(
            met.groupBy("rating_key").agg(
                F.sum("plays").alias("plays"), F.max("last").alias("last"),
                F.count(F.when(F.col("fresh"), F.col("user"))).alias("users"),
                F.sum("completed").alias("completed")), run)
        self.pairs.put(met.filter("fresh"), run)

    def _met(self, history: DataFrame, run: int) -> DataFrame:
        """The batch's pairs; ``fresh``: no earlier run has the pair.

        Stored pairs stay in place: under a union Spark knows buckets only of the bare table,
        so what is stored has the columns of what came, and the run tells them apart.
        """
        came = self.pairs.dealt(plays_by_user(history).withColumn(
            "pair", F.xxhash64("rating_key", "user"))).withColumn(RUN, F.lit(None).cast("bigint"))
        now = F.col(RUN).isNull()
        known = self.pairs.rows().filter(F.col(RUN) < run)
        return known.unionByName(came).groupBy("pair", "rating_key", "user").agg(
            F.max(F.when(now, F.col("plays"))).alias("plays"),
            F.max(F.when(now, F.col("last"))).alias("last"),
            F.max(F.when(now, F.col("completed"))).alias("completed"),
            F.bool_and(now).alias("fresh"),
        ).filter(F.col("plays").isNotNull())

    def totals(self) -> DataFrame:
        """History totals per item, as ``History.from_totals`` takes them."""
        return self.changes.rows().groupBy("rating_key").agg(
            F.sum("plays").alias("plays"), F.max("last").alias("last"),
            F.sum("users").alias("users"), F.sum("completed").alias("completed"))

    def touched(self, since_batch: int) -> DataFrame:
        """``rating_key`` of the items that batches from ``since_batch`` on have changed."""
        return self.changes.rows().filter(F.col(RUN) > since_batch).select("rating_key").distinct()


def start_running(history: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Take all history that has arrived into the running totals in ``folder`` and stop."""
    def take(batch: DataFrame, batch_id: int) -> None:
        RunningTotals.open(batch.sparkSession, folder).take(batch, batch_id)

    return (
        history.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_history(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    return spark.readStream.schema(HISTORY_SCHEMA).format(kind).load(path)


def pairs(spark: SparkSession, state_path: str) -> DataFrame:
    return spark.read.schema(STATE_SCHEMA).parquet(state_path)


def totals(spark: SparkSession, state_path: str) -> DataFrame:
    """History totals per item, as ``History.from_totals`` takes them."""
    return per_item(pairs(spark, state_path))


def touched(spark: SparkSession, state_path: str, since_batch: int) -> DataFrame:
    """Totals of the items that batches from ``since_batch`` on have changed."""
    state = pairs(spark, state_path)
    keys = state.filter(F.col("batch") >= since_batch).select("rating_key")
    return per_item(state.join(keys, "rating_key", "left_semi"))


def compact(spark: SparkSession, state_path: str, new_path: str, up_to_batch: int) -> None:
    """Write a state table with all batches up to ``up_to_batch`` folded into one."""
    state = pairs(spark, state_path)
    folded = merge_pairs(state.filter(F.col("batch") <= up_to_batch)).withColumns({
        "generation": F.lit("compacted"), "batch": F.lit(up_to_batch).cast("bigint")})
    rest = state.filter(F.col("batch") > up_to_batch)
    folded.unionByName(rest).write.mode("overwrite").partitionBy(
        "generation", "batch").parquet(new_path)
