"""Reconcile the catalogue with a new snapshot of the source.

An incoming item is matched by (library, key), soft-deleted rows included, so an item that
returns is resurrected. One that is not matched takes over a row of the same library and
guid whose own key is gone from the snapshot: its key was rotated, its id and facts stay.
Anything else is new. Live rows of the scanned libraries that the snapshot lacks are
marked deleted and keep their facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

KEY = ["library_key", "rating_key"]


def apply(items: DataFrame, snapshot: DataFrame, libraries: list[str], run_at: int,
          run_id: int, new_id: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(new catalogue, one row of change counts).

    ``snapshot`` has unique (library_key, rating_key); its columns overwrite those of the
    catalogue. ``new_id`` makes the id of a new row from snapshot columns; by default a
    digest of library, key and run, which no other row can have.

    When several incoming rows share the guid of one candidate, the greatest key takes the
    row and the others become new rows; when several candidates share a guid, the greatest
    id is taken. Groups are reduced before they are joined, so a guid shared by many rows
    never meets in one task.

    The two frames are computed apart; ``store`` writes the one and counts along.
    """
    both, columns, counts = _matched(items, snapshot, libraries, run_at, run_id, new_id)
    return both.select(*columns), both.agg(*counts)


def store(items: DataFrame, snapshot: DataFrame, libraries: list[str], run_at: int, run_id: int, path: str,
          new_id: Column | None = None, **options) -> tuple[DataFrame, dict[str, int]]:
    """The new catalogue written to ``path`` and read back, and its change counts, in one execution.

    The counts are observed on the rows that are written. ``options`` are those of
    ``catalogue.write``; the written rows do not depend on the catalogue at another path.
    """
    from . import catalogue

    both, columns, counts = _matched(items, snapshot, libraries, run_at, run_id, new_id)
    seen = Observation("reconcile")
    catalogue.write(both.observe(seen, *counts).select(*columns), path, **options)
    return catalogue.read(items.sparkSession, path), seen.get


def _matched(items, snapshot, libraries, run_at, run_id, new_id) -> tuple[DataFrame, list[Column], list[Column]]:
    """Old and new rows side by side, the columns of the new catalogue, and the counts."""
    incoming = snapshot.filter(F.col("library_key").isin(*libraries))
    assigned = _assign(items, incoming)

    updates = [c for c in incoming.columns if c not in KEY]
    keeps = [c for c in items.columns if c not in (*KEY, *updates, "item_id")]
    fresh = new_id if new_id is not None else F.sha1(
        F.concat_ws("|", "library_key", "rating_key", F.lit(str(run_id))))
    incoming_rows = assigned.select(
        F.coalesce(F.col("prev_id"), fresh).alias("item_id"),
        F.struct(*KEY, *updates).alias("new"),
        F.when(F.col("prev_id").isNull(), "added")
        .when(F.col("rotated"), "rotated").otherwise("updated").alias("change"),
    )
    previous = items.select(
        "item_id", F.struct(*[c for c in items.columns if c != "item_id"]).alias("old"))
    both = previous.join(incoming_rows, "item_id", "full")

    seen = F.col("change").isNotNull()
    added = F.col("change") == "added"
    gone = ~seen & F.col("old.deleted_at").isNull() & F.col("old.library_key").isin(*libraries)
    stamped = {
        "first_seen": F.when(added, F.lit(run_at)).otherwise(F.col("old.first_seen")),
        "last_seen": F.when(seen, F.lit(run_at)).otherwise(F.col("old.last_seen")),
        "seen_run": F.when(seen, F.lit(run_id)).otherwise(F.col("old.seen_run")),
        "deleted_at": F.when(gone, F.lit(run_at)).when(~seen, F.col("old.deleted_at")),
    }
    kinds = dict(items.dtypes)

    def column(name):
        if name == "item_id":
            return F.col("item_id")
        if name in stamped:
            return stamped[name].cast(kinds[name]).alias(name)
        if name in (*KEY, *updates):
            return F.when(seen, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)
        return F.col(f"old.{name}").alias(name)

    assert set(keeps) <= set(items.columns)
    changed = F.lit(False)
    if "file_fp" in updates:
        changed = seen & ~added & F.col("new.file_fp").isNotNull() & ~F.col(
            "new.file_fp").eqNullSafe(F.col("old.file_fp"))
    counts = [
        F.count_if(seen).alias("seen"),
        F.count_if(added).alias("added"),
        F.count_if(F.col("change") == "updated").alias("updated"),
        F.count_if(F.col("change") == "rotated").alias("rotated"),
        F.count_if(gone).alias("removed"),
        F.count_if(seen & F.col("old.deleted_at").isNotNull()).alias("resurrected"),
        F.count_if(changed).alias("changed_files"),
    ]
    return both, [column(c) for c in items.columns], counts


def _assign(items: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows with ``prev_id`` (NULL = new) and ``rotated``."""
    previous = items.select(*KEY, F.col("item_id").alias("prev_id"), F.col("guid").alias("_guid"))
    slim = incoming.select(*KEY, "guid", F.lit(True).alias("_in"))
    sides = previous.join(slim, KEY, "full")

    unmatched_old = F.col("_in").isNull()
    unmatched_new = F.col("prev_id").isNull()
    pairs = sides.filter(unmatched_old | unmatched_new).select(
        "library_key",
        F.when(unmatched_old, F.col("_guid")).otherwise(F.col("guid")).alias("guid"),
        F.when(unmatched_old, F.col("prev_id")).alias("old_id"),
        F.when(unmatched_new, F.col("rating_key")).alias("new_key"),
    ).filter(F.col("guid") != "").groupBy("library_key", "guid").agg(
        F.max("old_id").alias("prev_id"), F.max("new_key").alias("rating_key"),
    ).filter(F.col("prev_id").isNotNull() & F.col("rating_key").isNotNull())

    targets = previous.select(*KEY, "prev_id", F.lit(False).alias("rotated")).unionByName(
        pairs.select(*KEY, "prev_id", F.lit(True).alias("rotated")))
    # A key may be both an old row's and, through its guid, a rotated one's: the row whose
    # own key it is goes first, and such a key is never unmatched, so the sets are disjoint.
    return incoming.join(targets, KEY, "left")
