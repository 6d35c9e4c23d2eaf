"""Column helpers shared by the providers and operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def epoch(value: Column) -> Column:
    """Epoch seconds of an ISO-8601 text; NULL when it is none. No offset means UTC."""
    trimmed = F.trim(value)
    zoned = trimmed.rlike(r"[Tt ].*([Zz]|[+-]\d{2}:?\d{2})$")
    bare_date = trimmed.rlike(r"^\d{4}-\d{2}-\d{2}$")
    iso = (
        F.when(zoned, trimmed)
        .when(bare_date, F.concat(trimmed, F.lit("T00:00:00Z")))
        .otherwise(F.concat(trimmed, F.lit("Z")))
    )
    return F.unix_timestamp(iso.try_cast("timestamp"))


def seconds(df: DataFrame, name: str) -> Column:
    """Epoch seconds of a date-time column; one without a zone is read as UTC."""
    kind = dict(df.dtypes)[name]
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    if kind == "timestamp":
        return F.unix_timestamp(name)
    return F.col(name).cast("long")


def truthy(value: Column) -> Column:
    """A number that is known and not zero; NULL when unknown, which WHEN takes as no."""
    return value != 0


def filled(value: Column) -> Column:
    """A text, or NULL when it is empty."""
    return F.nullif(value, F.lit(""))


def yes(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def emitted(test: Column, value: Column) -> Column:
    """A fact that is only there when ``test`` holds."""
    return F.when(test, value)


def sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def or_empty(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def non_null(values: Column) -> Column:
    return F.filter(values, lambda e: e.isNotNull() & (e != ""))


def digest(*parts: Column) -> Column:
    """sha1 over the parts, joined with a bar; an unknown part reads 'None'."""
    texts = [F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    return F.sha1(F.concat_ws("|", *texts))
