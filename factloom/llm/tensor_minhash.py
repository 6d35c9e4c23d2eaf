"""MinHash near-duplicates with tensored banding.

Two collections of ``halves`` half keys each, every half key made of ``rows`` minhashes, give
``halves ** 2`` table keys: each half key of the one collection combined with each of the
other. So 64 tables take 32 minhashes instead of 256. Two documents of similarity ``s`` meet
in no table with probability ``1 - (1 - (1 - s**rows)**halves)**2``: 0.3 % at 0.75 and under
0.01 % from 0.85 on, for the defaults.

Documents with equal sets are one class, represented by its smallest id, before anything
else. In each table the members of a bucket are first compared with the bucket's smallest
member only. What that links is made components, and then every pair of a bucket that is
still in two components is compared as well, so no candidate pair is lost, while a bucket of
thousands of copies costs one comparison each. Two members whose exact distances from the
bucket's smallest member differ by more than 0.25 cannot be that similar (the triangle
inequality), which is used to join only bands of like distance; a pair that meets in several
tables is listed in one. Before that second step shingles are
counted over the documents left: shingles that no other of them has cannot be shared, and
those that at most ``rare`` have are shared only by pairs that a join on them lists. This
bounds, exactly, what a pair can have in common, and rules out nearly all pairs that a
passage or a much edited original has brought together.
Comparisons are made on the full shingle sets
of the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import scratch, written

SIGNED = "id long, n_shingles long, s1 long, s2 long, a array<long>, b array<long>"
PART = 4096
M64 = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words are one shingle.

    Words stand between ASCII white space, with A-Z lower-cased (bytes methods do just that).
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(width, len(words))
    total = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        total = _mixed(total + hashed[k:len(words) - size + 1 + k])
    return np.unique(total)


class Hashes:
    """The ``2 * halves * rows`` minhash functions, from a seed."""

    def __init__(self, halves: int, rows: int, seed: int):
        draw = np.random.default_rng(seed)
        self.halves, self.rows = halves, rows
        n = 2 * halves * rows
        self.times = draw.integers(0, M64, n, dtype=np.uint64, endpoint=True)[:, None] | np.uint64(1)
        self.plus = draw.integers(0, M64, n, dtype=np.uint64, endpoint=True)[:, None]

    def half_keys(self, found: np.ndarray) -> np.ndarray:
        """Both collections: ``2 x halves`` keys, each told apart by its place."""
        least = np.full(len(self.times), M64, dtype=np.uint64)
        for at in range(0, len(found), PART):
            values = found[None, at:at + PART] * self.times
            values += self.plus
            np.minimum(least, values.min(axis=1), out=least)
        keys = np.arange(2 * self.halves, dtype=np.uint64)
        for row in least.reshape(2 * self.halves, self.rows).T:
            keys = _mixed(keys ^ _mixed(row))
        return keys.view(np.int64).reshape(2, self.halves)


def signed(docs: DataFrame, width: int, halves: int, rows: int, seed: int, doc_id: str, text: str) -> DataFrame:
    """Set size, a 128-bit fingerprint of the set and the half keys of every row with an id."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(halves, rows, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                out: list[list] = [[], [], [], [], []]
                for content in part.column("text").to_pylist():
                    found = shingles(content, width)
                    both = xxhash.xxh3_128_digest(found.tobytes())
                    first, second = np.frombuffer(both, dtype=np.int64).tolist()
                    keys = hashes.half_keys(found).tolist() if len(found) else ([], [])
                    for column, value in zip(out, (len(found), first, second, *keys)):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array(c, k) for c, k in zip(out, kinds))],
                    names=["id", "n_shingles", "s1", "s2", "a", "b"])
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(sign, SIGNED)


def table_keys(reps: DataFrame) -> DataFrame:
    """``key, id, n``: one row for each pair of half keys."""
    pairs = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))
    return reps.select(F.explode_outer(pairs).alias("key"), "id", F.col("n_shingles").alias("n"))


def verified(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs ``(u, v)`` with their exact Jaccard distance ``apart``; ``linked`` if they have the similarity."""
    left = texts.select(F.col("id").alias("u"), F.col("text").alias("u_text"))
    right = texts.select(F.col("id").alias("v"), F.col("text").alias("v_text"))
    both = pairs.join(right, "v").join(left, "u").select("u", "v", "u_text", "v_text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                apart, linked = [], []
                for u_text, v_text in zip(part.column("u_text").to_pylist(), part.column("v_text").to_pylist()):
                    if hub is None or u_text != last:  # rows come sorted by u: a hub is hashed once
                        last, hub = u_text, shingles(u_text, width)
                    other = shingles(v_text, width)
                    common = len(np.intersect1d(hub, other, assume_unique=True))
                    union = len(hub) + len(other) - common
                    apart.append(1 - common / max(union, 1))
                    linked.append(100 * common >= percent * union)
                yield pa.RecordBatch.from_arrays(
                    [part.column("u"), part.column("v"), pa.array(apart, pa.float64()), pa.array(linked, pa.bool_())],
                    names=["u", "v", "apart", "linked"])
    return both.mapInArrow(check, "u long, v long, apart double, linked boolean")


def near_hub(distance: Column, percent: int) -> tuple[Column, Column]:
    """Bands of a distance from the hub: its own, and all that can hold something similar to it.

    The Jaccard distance is a metric, so two members whose distances from the hub differ by more
    than the similarity allows are no pair. Bands are as wide as that, so such members are at
    most one band apart. A distance that is not known is in all bands.
    """
    width = max(100 - percent, 1)
    last = 100 // width
    band = F.floor(100 * distance / width).cast("int")
    every = F.sequence(F.lit(0), F.lit(last))
    return (F.when(distance.isNull(), every).otherwise(F.array(band)),
            F.when(distance.isNull(), every).otherwise(F.sequence(band - 1, band + 1)))


def shingle_rows(texts: DataFrame, width: int) -> DataFrame:
    """``id, h``: the shingles of each row of ``texts``."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, content in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                found = shingles(content, width).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), one)), pa.array(found)], names=["id", "h"])
    return texts.select("id", "text").mapInArrow(each, "id long, h long")


def of_one_text(counts: DataFrame, texts: DataFrame) -> DataFrame:
    """``counts`` without the ids that have several texts: no bound is taken from those."""
    several = texts.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("id")
    return counts.join(several, "id", "left_anti")


def lone_shingles(texts: DataFrame, width: int) -> DataFrame:
    """``id, lone``: how many shingles of a document no other document of ``texts`` has.

    They bound what it can have in common with any of them.
    """
    holders = shingle_rows(texts, width).groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    return of_one_text(holders.filter("id = last").groupBy("id").agg(F.count(F.lit(1)).alias("lone")), texts)


def bounds_of(able: DataFrame, texts: DataFrame, width: int, rare: int) -> tuple[DataFrame, DataFrame]:
    """Exact bounds of what the documents of ``able`` can have in common.

    ``id, low, common``: the (smallest) set size and how many shingles more than ``rare`` of
    these documents have. ``u, v, times``: pairs of different components that share rare
    shingles, and how many. Two documents have at most the smaller ``common`` plus ``times``
    (0 for pairs not listed) in common. A shingle gives under ``rare ** 2`` pair rows.
    """
    spark = able.sparkSession
    ids = able.groupBy("id").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("component").alias("component"))
    ids = written(ids, scratch(spark, "minhash-able-ids"))
    own = texts.join(ids.select("id"), "id", "left_semi")
    tokens = written(shingle_rows(own, width).distinct(), scratch(spark, "minhash-tokens"))
    held = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("holders")).filter(F.col("holders") <= rare)
    seldom = written(tokens.join(written(held, scratch(spark, "minhash-held")), "h"), scratch(spark, "minhash-seldom"))
    uncommon = of_one_text(seldom.groupBy("id").agg(F.count(F.lit(1)).alias("uncommon")), own)
    common = ids.join(uncommon, "id", "left").select(
        "id", "low", (F.col("high") - F.coalesce("uncommon", F.lit(0))).alias("common"))
    side = seldom.filter("holders > 1").join(ids.select("id", "component"), "id")
    shared = side.select("h", F.col("id").alias("u"), F.col("component").alias("u_component")).join(
        side.select("h", F.col("id").alias("v"), F.col("component").alias("v_component")), "h").filter(
        "u < v and u_component <> v_component").groupBy("u", "v").agg(F.count(F.lit(1)).alias("times"))
    return written(common, scratch(spark, "minhash-common")), shared


def duplicates(docs: DataFrame, percent: int = 75, width: int = 5, halves: int = 8, rows: int = 2,
               rare: int = 8, seed: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_shingles, component_id, kept`` for each row of ``docs``.

    Documents are linked when ``100 * intersection >= percent * union`` of their shingle
    sets; ``component_id`` is the smallest id reachable. NULL and empty texts, and white space
    alone, have no shingles and no links. An id is one document: rows that repeat it belong
    together, whatever their texts. Rows without an id are linked with nothing, have no
    component and are kept. Other columns are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    signs = written(signed(docs, width, halves, rows, seed, doc_id, text), scratch(spark, "minhash-signed"))
    nodes = signs.filter(F.col("id").isNotNull())
    full = nodes.filter("n_shingles > 0")

    # equal sets: a class and its smallest id
    classes = full.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
    classes = written(classes, scratch(spark, "minhash-classes"))
    same = full.join(classes.filter("size > 1"), ["s1", "s2"]).filter("id <> rep").select(
        F.col("id").alias("u"), F.col("rep").alias("v"))
    reps = full.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")

    keys = table_keys(reps)
    # written: a join with a table has two plain exchanges, so a hot bucket can be split
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter(
        "hub <> last").select("key", "hub")
    hubs = written(hubs, scratch(spark, "minhash-hubs"))
    members = written(keys.join(hubs, "key"), scratch(spark, "minhash-buckets"))

    star = members.filter("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct()
    star = written(star, scratch(spark, "minhash-star"))
    involved = members.select("id").distinct()
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(
        involved, "id", "left_semi")
    texts = written(texts, scratch(spark, "minhash-texts"))
    compared = written(verified(star, texts, percent, width), scratch(spark, "minhash-compared"))
    linked = compared.filter("linked").select("u", "v").distinct()
    found = components(linked.unionByName(same), "minhash-components")

    # pairs of a bucket that are still apart
    of = found.select(F.col("node").alias("id"), "component")
    placed = members.join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = placed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.min(F.when(F.col("id") == F.col("hub"), F.col("component"))).alias("main")).filter("low <> high")
    apart = written(apart.select("key", "main"), scratch(spark, "minhash-apart"))
    mixed = written(placed.join(apart, "key"), scratch(spark, "minhash-mixed"))
    lone = written(lone_shingles(texts.join(mixed.select("id").distinct(), "id", "left_semi"), width),
                   scratch(spark, "minhash-lone"))
    able = mixed.join(lone, "id", "left").withColumn("shared", F.col("n") - F.coalesce("lone", F.lit(0))).filter(
        100 * F.col("shared") >= percent * F.col("n"))
    # an id with several texts has no one distance, and no one place in the tables
    distances = compared.groupBy(F.col("u").alias("hub"), F.col("v").alias("id")).agg(
        F.when(F.count(F.lit(1)) == 1, F.min("apart")).alias("apart"))
    halves_of = reps.join(able.select("id").distinct(), "id", "left_semi").groupBy("id").agg(
        F.when(F.count(F.lit(1)) == 1, F.first("a")).alias("a"), F.when(F.count(F.lit(1)) == 1, F.first("b")).alias("b"))
    able = able.join(distances, ["hub", "id"], "left").join(halves_of, "id").withColumn(
        "apart", F.when(F.col("id") == F.col("hub"), 0.0).otherwise(F.col("apart")))
    able = written(able.select("key", "id", "n", "component", "main", "apart", "a", "b"), scratch(spark, "minhash-able"))
    common, shared = bounds_of(able, texts, width, rare)
    own, others = near_hub(F.col("apart"), percent)
    bound = able.join(common, "id").drop("n")
    few = bound.filter("component <> main").select(
        "key", F.col("id").alias("f_id"), F.col("low").alias("f_low"), F.col("component").alias("f_component"), "main",
        F.col("common").alias("f_common"), F.col("apart").alias("f_apart"), F.col("a").alias("f_a"), F.col("b").alias("f_b"),
        F.explode(others).alias("band"))

    def may_link(both: Column) -> Column:
        """Whether ``both`` shingles in common could be enough."""
        return (100 + percent) * both >= percent * (F.col("low") + F.col("f_low"))
    # of all tables that two documents meet in, the first pair of half keys lists them
    first = F.xxhash64(*[F.get(F.array_intersect(f"f_{c}", c), F.lit(0)) for c in ("a", "b")])
    once = F.when(F.col("a").isNull() | F.col("f_a").isNull(), True).otherwise(F.col("key") == first)
    reach = 1 - percent / 100 + 1e-9
    across = few.join(bound.drop("main").withColumn("band", F.explode(own)), ["key", "band"]).filter(
        (F.col("component") != F.col("f_component"))
        & ((F.col("component") == F.col("main")) | (F.col("id") < F.col("f_id")))
        & may_link(F.least("common", "f_common"))
        & F.coalesce(F.abs(F.col("apart") - F.col("f_apart")) <= reach, F.lit(True)) & once).select(
        F.least("id", "f_id").alias("u"), F.greatest("id", "f_id").alias("v"))
    rarely = shared.join(common.select(F.col("id").alias("u"), "low", "common"), "u").join(common.select(
        F.col("id").alias("v"), F.col("low").alias("f_low"), F.col("common").alias("f_common")), "v").filter(
        may_link(F.least("common", "f_common") + F.col("times"))).select("u", "v")
    across = across.unionByName(rarely).distinct()
    rest = written(across.join(star, ["u", "v"], "left_anti"), scratch(spark, "minhash-rest"))
    more = verified(rest, texts, percent, width).filter("linked").select("u", "v")
    more = written(more, scratch(spark, "minhash-more"))
    if more.limit(1).count():
        found = components(more.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v"))),
                           "minhash-all")
    ends = found.select(F.col("node").alias("id"), "component")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return signs.select("id", "n_shingles").join(ends, "id", "left").select(
        "id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
