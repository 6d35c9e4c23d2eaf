"""Paths as the source reports them, translated to paths this cluster can read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.joins import left_lookup
from ..functions.lookup import constant, in_order, ranker
from ..functions.scalars import filled

MAPPED, MISSING, UNMAPPED, UNKNOWN = "mapped", "missing", "unmapped", "unknown"


def is_windows(path: Column) -> Column:
    return path.contains("\\") | (F.substring(path, 2, 1) == ":")


def _under(local: Column, rest: Column) -> Column:
    """``local`` plus the rest of a path, with one slash between all components."""
    tail = F.regexp_replace(F.regexp_replace(rest, r"^[\\/]+", ""), r"\\", "/")
    joined = F.concat(local, F.lit("/"), tail)
    tidy = F.regexp_replace(F.regexp_replace(joined, "/(\\./)+", "/"), "/+", "/")
    tidy = F.regexp_replace(tidy, "(/\\.)?/?$", "")
    return F.when(tail == "", local).otherwise(F.when(tidy == "", F.lit("/")).otherwise(tidy))


def mapping_table(spark: SparkSession, mappings: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """The mappings as ``(source, local)``; pairs go through Arrow, so that Spark knows the size."""
    if isinstance(mappings, DataFrame):
        return mappings.select("source", "local")
    return spark.createDataFrame(pa.table({
        "source": pa.array([m[0] for m in mappings], pa.string()),
        "local": pa.array([m[1] for m in mappings], pa.string())}))


@dataclass(frozen=True)
class Prefixes:
    """Mappings by prefix; ``few`` has them as rows where they are few, else it is None.

    A mapping that lacks one of its sides is none.
    """

    table: DataFrame
    few: tuple | None
    world: Column

    @classmethod
    def of(cls, spark: SparkSession, mappings, most: int = 10_000) -> Prefixes:
        """``most``: how many mappings the driver takes; more are joined."""
        if isinstance(mappings, Prefixes):
            return mappings
        given = mapping_table(spark, mappings).filter("source IS NOT NULL AND local IS NOT NULL")
        source = F.col("source")
        windows = is_windows(source)
        prefix = F.regexp_replace(source, r"[\\/]+$", "")
        table = given.select(
            F.when(windows, F.lower(prefix)).otherwise(prefix).alias("_prefix"), windows.alias("_windows"),
            F.struct(F.length(source).alias("size"), F.length(prefix).alias("cut"),
                     F.col("local").alias("local")).alias("_map"))
        rows = table.limit(most + 1).collect()
        best = table.groupBy("_prefix", "_windows").agg(F.max("_map").alias("_map"))
        if len(rows) > most:
            return cls(best, None, F.lit(False))
        return cls(best, tuple(rows), F.lit(not rows))


def _ranges(prefixes: dict[str, int], sep: str) -> tuple[list[str], list[int]]:
    """Nested prefixes as disjoint ranges: where each begins, and its longest prefix (-1: none).

    A prefix holds itself and all that goes on with a separator.
    """
    after = chr(ord(sep) + 1)
    starts = in_order((start for p in prefixes for start in (p, p + "\0", p + sep, p + after)), texts=True)

    def longest(text: str) -> int:
        at = len(text)
        while at >= 0:
            if (found := prefixes.get(text[:at])) is not None:
                return found
            at = text.rfind(sep, 0, at)
        return -1
    return starts, [longest(s) for s in starts]


def _placed(few: tuple, whole: Column) -> Column:
    """``(size, cut, local)`` of the mapping with the longest prefix of a path, by two searches."""
    found = []
    for windows, text, sep in ((False, whole, "/"), (True, F.lower(whole), "\\")):
        best: dict[str, tuple] = {}
        for row in few:
            if row["_windows"] == windows:
                best[row["_prefix"]] = max(best.get(row["_prefix"], (-1,)), tuple(row["_map"]))
        if not best:
            continue
        starts, owner = _ranges({p: i for i, p in enumerate(best)}, sep)
        at = F.shiftright(ranker(starts, "string")(text), 1) - 1
        number = F.when(at >= 0, F.get(constant(owner, "array<int>"), at)).otherwise(-1)
        sizes, cuts, locals_ = (list(v) for v in zip(*best.values()))
        found.append(F.when(number >= 0, F.struct(
            F.get(constant(sizes, "array<int>"), number).alias("size"),
            F.get(constant(cuts, "array<int>"), number).alias("cut"),
            F.get(constant(locals_, "array<string>"), number).alias("local"))))
    none = F.lit(None).cast("struct<size: int, cut: int, local: string>")
    return F.greatest(*found) if len(found) == 2 else found[0] if found else none


def translate(items: DataFrame, mappings: Sequence[tuple[str, str]] | DataFrame | Prefixes,
              path: str = "source_path", out: str = "local_path",
              item_id: str = "item_id") -> DataFrame:
    """Longest matching prefix wins; without any mapping a path stands for itself.

    ``mappings`` are (source prefix, local prefix) pairs, or a frame with the columns
    ``source`` and ``local``; both, and an empty one, are treated alike. Of several mappings
    of one prefix the greatest local prefix is taken. Up to 10,000 mappings become disjoint
    ranges of texts, among which each path is searched where it lies. More are joined: each path
    is looked up under every prefix of itself that ends before a separator.
    """
    known = Prefixes.of(items.sparkSession, mappings)
    whole = F.col(path)
    if known.few is not None:
        placed = items.withColumn("_map", F.when(filled(whole).isNotNull(), _placed(known.few, whole)))
    else:
        placed = _joined(items, known.table, path, item_id)
    return placed.withColumn(
        out, F.when(known.world, filled(whole)).when(F.col("_map").isNotNull(), _under(
            F.col("_map.local"),
            F.substring(whole, F.col("_map.cut") + 1, F.length(whole))))
    ).drop("_map")


def _joined(items: DataFrame, table: DataFrame, path: str, item_id: str) -> DataFrame:
    def ancestors(text, sep, windows):
        pieces = F.split(text, "\\\\" if sep == "\\" else sep)
        return F.transform(
            F.sequence(F.lit(1), F.size(pieces)),
            lambda n: F.struct(
                F.array_join(F.slice(pieces, 1, n), sep).alias("_prefix"),
                F.lit(windows).alias("_windows")))

    whole = F.col(path)
    probes = items.filter(filled(whole).isNotNull()).select(
        item_id, F.inline(F.array_distinct(F.concat(
            ancestors(whole, "/", False), ancestors(F.lower(whole), "\\", True)))))
    best = probes.join(table, ["_prefix", "_windows"]).groupBy(item_id).agg(
        F.max("_map").alias("_map"))
    return items.join(best, item_id, "left")


def resolve(items: DataFrame, mappings, manifest: DataFrame, path: str = "source_path",
            item_id: str = "item_id") -> DataFrame:
    """Adds local_path, path_status, file_size, file_mtime (and file_fp when the manifest has it).

    A path that is absent while there is no mapping at all counts as unmapped: what is
    missing there is the mapping, not the file.
    """
    known = Prefixes.of(items.sparkSession, mappings)
    translated = translate(items, known, path, "local_path", item_id)
    extra = [c for c in manifest.columns if c not in ("path", "size", "mtime")]
    found = manifest.select(
        F.col("path").alias("local_path"), F.col("size").alias("file_size"),
        F.col("mtime").alias("file_mtime"), *extra, F.lit(True).alias("_there"))
    absent = F.when(known.world, UNMAPPED).otherwise(MISSING)
    status = (
        F.when(filled(F.col(path)).isNull(), UNKNOWN)
        .when(F.col("local_path").isNull(), UNMAPPED)
        .when(F.col("_there"), MAPPED)
        .otherwise(absent)
    )
    kept = translated.drop("file_size", "file_mtime", "path_status", *extra)
    return left_lookup(kept, found, ["local_path"], item_id).withColumn(
        "path_status", status).drop("_there")


def health(items: DataFrame) -> DataFrame:
    """Live items per path status, statuses without items included."""
    live = items.filter(F.col("deleted_at").isNull())
    known = [MAPPED, UNMAPPED, MISSING, UNKNOWN]
    counts = live.groupBy("path_status").agg(F.count(F.lit(1)).alias("n"))
    zeros = items.sparkSession.createDataFrame(
        [(s, 0) for s in known], "path_status string, n bigint")
    return counts.unionByName(zeros).groupBy("path_status").agg(F.sum("n").alias("n"))


def missing_sample(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Items whose file is missing, by id; ``limit`` makes it a sample."""
    missing = items.filter(
        F.col("deleted_at").isNull() & (F.col("path_status") == MISSING)).orderBy("item_id")
    return (missing.limit(limit) if limit else missing).select(
        "item_id", "rating_key", "title", "local_path")


def unmapped_prefixes(items: DataFrame, path: str = "source_path") -> DataFrame:
    """(prefix, n, sample) that would cover the unmapped live paths, per path family.

    The prefix is the longest directory all of a family's paths share, found from the
    smallest and the largest component array alone. A family whose paths share nothing
    gets one row per first component.
    """
    whole = F.col(path)
    windows = is_windows(whole)

    def directories(text, sep, pattern):
        folder = F.when(text.contains(sep), F.substring(
            text, F.lit(1), F.length(text) - F.length(F.substring_index(text, sep, -1)) - 1)
        ).otherwise(text)
        return F.filter(F.split(folder, pattern), lambda c: c != "")

    paths = items.filter(
        F.col("deleted_at").isNull() & (F.col("path_status") == UNMAPPED) & whole.isNotNull()
    ).select(
        windows.alias("windows"), whole.alias("path"),
        F.when(windows, directories(whole, "\\", "\\\\"))
        .otherwise(directories(whole, "/", "/")).alias("parts"),
    ).select(
        "*",
        F.when(F.col("windows"), F.transform("parts", F.lower)).otherwise(F.col("parts"))
        .alias("folded"),
    )
    heads = paths.groupBy(
        "windows", F.coalesce(F.get("parts", F.lit(0)), F.lit("")).alias("head")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.min("folded").alias("low"), F.max("folded").alias("high"),
        F.min("path").alias("sample"), F.min("parts").alias("shown"),
    )
    families = heads.groupBy("windows").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("sample").alias("sample"), F.min("shown").alias("shown"))
    width = F.least(F.size("low"), F.size("high"))
    shared = F.aggregate(
        F.sequence(F.lit(1), F.greatest(width, F.lit(1))), F.lit(0),
        lambda n, i: F.when(
            (n == i - 1) & (i <= width) & (F.get("low", i - 1) == F.get("high", i - 1)), i
        ).otherwise(n))
    families = families.withColumn("shared", shared)
    sep = F.when(F.col("windows"), "\\").otherwise("/")

    def prefix(body):
        return F.concat(F.when(F.col("sample").startswith(sep), sep).otherwise(""), body)

    joined = F.when(
        F.col("windows"), F.array_join(F.slice("shown", 1, F.col("shared")), "\\")
    ).otherwise(F.array_join(F.slice("shown", 1, F.col("shared")), "/"))
    common = families.filter("shared > 0").select(prefix(joined).alias("prefix"), "n", "sample")
    apart = heads.join(
        families.filter("shared = 0").select("windows"), "windows", "left_semi"
    ).select(prefix(F.col("head")).alias("prefix"), "n", "sample")
    return common.unionByName(apart).orderBy(F.desc("n"), "prefix")
