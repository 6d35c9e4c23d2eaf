"""Facts from watch history: who played an item, how often, and to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ...functions.joins import left_lookup
from ...functions.scalars import emitted, filled, truthy, yes
from ...functions.spec import date, flag, measure
from .base import Provider

FINISHED = 1.0


def plays_by_user(history: DataFrame) -> DataFrame:
    """History rows reduced to (rating_key, user): plays, last, completed.

    The pair is the unit that batches are merged on: counts add up, and distinct users are
    the pairs with a user.
    """
    stopped = F.coalesce(
        F.when(F.col("date") != 0, F.col("date")), F.when(F.col("stopped") != 0, F.col("stopped")))
    return history.filter(filled(F.col("rating_key")).isNotNull()).groupBy(
        "rating_key", filled(F.col("user")).alias("user")
    ).agg(
        F.count(F.lit(1)).alias("plays"),
        F.max(stopped).alias("last"),
        F.count_if(yes(F.col("watched_status") >= FINISHED)).alias("completed"),
    )


def per_item(pairs: DataFrame) -> DataFrame:
    """Totals per item from (possibly several rows per) pair."""
    return merge_pairs(pairs).groupBy("rating_key").agg(
        F.sum("plays").alias("plays"),
        F.max("last").alias("last"),
        F.count("user").alias("users"),
        F.sum("completed").alias("completed"),
    )


def merge_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("rating_key", "user").agg(
        F.sum("plays").alias("plays"), F.max("last").alias("last"),
        F.sum("completed").alias("completed"))


def aggregate(history: DataFrame) -> DataFrame:
    """History totals per item. An item with most of the history is spread by user first."""
    return plays_by_user(history).groupBy("rating_key").agg(
        F.sum("plays").alias("plays"),
        F.max("last").alias("last"),
        F.count("user").alias("users"),
        F.sum("completed").alias("completed"),
    )


class History(Provider):
    id = "tautulli"
    max_age_s = 6 * 3600
    applies_to = ("movie", "episode")
    # Keys and types.
    facts = (
        measure("watch.play_count"),
        date("watch.last_played"),
        flag("watch.never_played"),
        measure("watch.unique_users"),
        measure("watch.completed_count"),
        flag("watch.abandoned"),
    )

    def compute(self, items, sources):
        """``history``: (rating_key, date, stopped, user, watched_status)."""
        return self.from_totals(items, aggregate(sources["history"]))

    def from_totals(self, items: DataFrame, totals: DataFrame) -> DataFrame:
        found = left_lookup(items, totals, ["rating_key"], "item_id")
        played = F.col("plays").isNotNull()

        def count(name):
            return F.coalesce(name, F.lit(0))

        return self.results(found, {
            "watch.play_count": count("plays"),
            "watch.last_played": emitted(truthy(F.col("last")), F.col("last")),
            "watch.never_played": ~played,
            "watch.unique_users": count("users"),
            "watch.completed_count": count("completed"),
            "watch.abandoned": played & (count("completed") == 0),
        })
