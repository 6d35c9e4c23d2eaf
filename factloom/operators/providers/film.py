"""Facts from film metadata records."""

from pyspark.sql import functions as F

from ...functions.joins import left_lookup
from ...functions.scalars import emitted, epoch, filled, non_null, or_empty, sorted_set, truthy, yes
from ...functions.spec import date, flag, measure, text, words
from ...sources.payloads import FILM_SCHEMA, parse
from .base import Provider


class Film(Provider):
    id = "tmdb"
    max_age_s = 30 * 24 * 3600
    # Keys and types.
    facts = (
        words("tmdb.keywords", folded=True),
        text("tmdb.collection"),
        measure("tmdb.runtime", unit="min"),
        measure("tmdb.budget", unit="USD"),
        measure("tmdb.revenue", unit="USD"),
        measure("tmdb.roi"),
        measure("tmdb.vote_average"),
        measure("tmdb.vote_count"),
        text("tmdb.original_language"),
        words("tmdb.genres"),
        words("tmdb.countries"),
        date("tmdb.release_date"),
        flag("tmdb.adult"),
        text("tmdb.tagline"),
    )

    def selector(self):
        return F.col("tmdb_id").isNotNull()

    def ineligible(self):
        return F.when(~yes(truthy(F.col("tmdb_id"))), "no film id")

    def fingerprint(self):
        return F.concat(F.lit("tmdb:"), F.col("tmdb_id").cast("string"))

    def compute(self, items, sources):
        """``sources["films"]``: (tmdb_id, payload), one row per id."""
        films = parse(sources["films"], FILM_SCHEMA).select("tmdb_id", "doc", "payload")
        found = left_lookup(items, films, ["tmdb_id"], "item_id")
        doc = F.col("doc")
        budget = F.coalesce(doc["budget"], F.lit(0))
        revenue = F.coalesce(doc["revenue"], F.lit(0))

        def names(entries, field):
            return or_empty(non_null(F.transform(entries, lambda e: e[field])))

        made = {
            "tmdb.keywords": sorted_set(F.transform(
                names(doc["keywords"]["keywords"], "name"), F.lower)),
            "tmdb.collection": filled(doc["belongs_to_collection"]["name"]),
            "tmdb.runtime": emitted(truthy(doc["runtime"]), doc["runtime"]),
            "tmdb.budget": budget,
            "tmdb.revenue": revenue,
            "tmdb.roi": emitted((budget > 0) & (revenue > 0),
                                F.round(F.try_divide(revenue, budget), 3)),
            "tmdb.vote_average": F.round(doc["vote_average"], 2),
            "tmdb.vote_count": doc["vote_count"],
            "tmdb.original_language": filled(doc["original_language"]),
            "tmdb.genres": names(doc["genres"], "name"),
            "tmdb.countries": names(doc["production_countries"], "iso_3166_1"),
            "tmdb.release_date": epoch(doc["release_date"]),
            "tmdb.adult": F.coalesce(doc["adult"], F.lit(False)),
            "tmdb.tagline": filled(doc["tagline"]),
        }
        present = F.col("payload").isNotNull() & ~F.trim("payload").isin("", "{}", "null")
        return self.results(
            found, made, F.when(present, "ok").otherwise("error"),
            F.concat(F.lit("no record of film "), F.col("tmdb_id").cast("string")))
