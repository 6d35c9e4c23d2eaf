"""Facts that are catalogue columns already."""

from pyspark.sql import functions as F

from ...functions.scalars import emitted, truthy
from ...functions.spec import date, flag, measure, text
from .base import Provider


class Identity(Provider):
    id = "plex"
    applies_to = ("movie", "show", "episode")
    # Keys and types.
    facts = (
        text("plex.title"),
        measure("plex.year"),
        date("plex.added_at"),
        date("plex.updated_at"),
        measure("plex.duration_min", unit="min"),
        flag("plex.has_tmdb_id"),
    )

    def fingerprint(self):
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("None"))
                 for c in ("updated_at", "title", "year", "duration_ms")]
        return F.concat_ws("|", *parts)

    def compute(self, items, sources):
        return self.results(items, {
            "plex.title": F.col("title"),
            "plex.year": F.col("year"),
            "plex.added_at": emitted(truthy(F.col("added_at")), F.col("added_at")),
            "plex.updated_at": emitted(truthy(F.col("updated_at")), F.col("updated_at")),
            "plex.duration_min": emitted(
                truthy(F.col("duration_ms")), F.round(F.col("duration_ms") / 60000, 2)),
            "plex.has_tmdb_id": F.col("tmdb_id").isNotNull(),
        })
