"""Benchmark decontamination: SimHash of item-sized windows, verified exactly.

1. Items and documents become word shingles (five words; a shorter item is one shingle). A
   window that is as similar to an item as asked shares shingles with it. A shingle that no item
   has weighs most, so a window that begins with one can move on and loses nothing: the best
   window begins with a shingle of some item, though not always of its own. So windows are
   opened where a document has a shingle of any item, in the sizes of all items that have a
   shingle inside the window.
2. Equal windows are one. Each gets a 64-bit SimHash of its shingles, each shingle with the
   square root of its share in the similarity of step 4 (times x weight).
3. Fingerprints within ``radius`` of an item's are found by a multi-index: the 64 bits are
   split in ``blocks``, and of two fingerprints within the radius at least one block differs
   by at most ``radius // blocks`` bits. Items are entered under all such neighbours of each
   block, windows look up their own blocks; none within the radius is missed.
4. The pairs get their exact weighted similarity: shingles count as often as they occur
   (minimum over maximum), with integer weights that fall with the number of items that
   share them.

The distance of two SimHashes is about 64 times the angle of their shingle vectors over pi.
With square roots the cosine is at least common / sqrt(weight of one x weight of the other),
so at similarity 0.75 at least 6/7, whatever the weights are: at most 11 bits, with a
deviation of 3. The radius of 19 is 2.6 deviations off. (With the weights themselves many
light shingles in common would count for nothing beside a few heavy ones.)
Only built-in functions are used. What is broadcast is counted before.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import scratch, written

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BITS = 64


def words_of(text: Column) -> Column:
    """Lower-case words: runs of digits, letters and characters past ASCII."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def shingles_of(words: Column, width: int) -> Column:
    """Hash of each run of ``width`` words; empty where there are fewer words."""
    count = F.size(words) - F.lit(width - 1)
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(
        F.lit(width), *(F.get(words, i + F.lit(k)) for k in range(width))))


def simhash(shingles: Column, pulls: Column | None = None) -> Column:
    """64-bit SimHash of an array; ``pulls`` is an array of the longs they count for, else 1.

    Counters are longs. Ties set the bit.
    """
    pulls = F.transform(shingles, lambda _: F.lit(1).cast("long")) if pulls is None else pulls
    pairs = F.zip_with(shingles, pulls, lambda h, pull: F.struct(h.alias("h"), pull.alias("pull")))
    counters = F.aggregate(pairs, F.array(*[F.lit(0).cast("long")] * BITS), lambda counters, s: F.transform(
        counters, lambda c, k: c + _pulled(s["h"], s["pull"], k)))
    bits = F.transform(counters, lambda c, k: F.when(
        c >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _pulled(shingle: Column, pull: Column, k: Column) -> Column:
    """What a shingle adds to the counter of bit k."""
    return F.when(F.getbit(shingle, k) == 1, pull).otherwise(-pull)


def pull_of(times: Column, weight: Column) -> Column:
    """What a shingle counts for in a SimHash, in hundredths: whole, so that sums have no order."""
    return F.round(100 * F.sqrt(times * weight)).cast("long")


def window_prints(distinct: DataFrame, lighter: DataFrame, rare: int) -> DataFrame:
    """``w1, w2, length, print, window_weight`` of windows; ``lighter`` are weights other than ``rare``."""
    keys = ["w1", "w2", "length"]
    # dealt by window before the shingles are listed: both counts then stay inside the task
    bags = distinct.repartition(*keys).select(*keys, F.explode("window").alias("h")).groupBy(*keys, "h").agg(
        F.count(F.lit(1)).alias("times"))
    weighed = bags.join(lighter, "h", "left").withColumn(
        "weight", F.coalesce("weight", F.lit(rare).cast("long"))).withColumn(
        "pull", pull_of(F.col("times"), F.col("weight")))
    sums = weighed.groupBy(*keys).agg(
        F.sum(F.col("times") * F.col("weight")).alias("window_weight"),
        *[F.sum(_pulled(F.col("h"), F.col("pull"), F.lit(k))).alias(f"c{k}") for k in range(BITS)])
    bits = [F.when(F.col(f"c{k}") >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(k))).otherwise(
        F.lit(0).cast("long")) for k in range(BITS)]
    return sums.select(*keys, reduce(Column.bitwiseOR, bits).alias("print"), "window_weight")


def block_ranges(blocks: int) -> list[tuple[int, int]]:
    """First bit and width of each block."""
    return [(BITS * k // blocks, BITS * (k + 1) // blocks - BITS * k // blocks) for k in range(blocks)]


def block_values(fingerprint: Column, blocks: int) -> Column:
    """Array of (block, value)."""
    return F.array(*[F.struct(
        F.lit(k).alias("block"),
        F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")).alias("value"))
        for k, (at, width) in enumerate(block_ranges(blocks))])


def neighbours(blocks: int, radius: int) -> Column:
    """Array of (block, mask): every change of a block within its share of the radius."""
    share = radius // blocks
    return F.array(*[F.struct(F.lit(k).alias("block"), F.array(*[
        F.lit(sum(1 << bit for bit in some)).cast("long")
        for n in range(share + 1) for some in combinations(range(width), n)]).alias("masks"))
        for k, (_, width) in enumerate(block_ranges(blocks))])


def entered(items: DataFrame, blocks: int, radius: int) -> DataFrame:
    """``item, length, print, block, value``: items under all their neighbours."""
    masks = F.explode(neighbours(blocks, radius)).alias("near")
    per_block = items.select("item", "length", "print", masks, block_values(F.col("print"), blocks).alias("own"))
    value = F.element_at("own", F.col("near.block") + 1)["value"]
    return per_block.select("item", "length", "print", F.col("near.block").alias("block"),
                            F.explode(F.transform("near.masks", lambda m: value.bitwiseXOR(m))).alias("value"))


def _windows(texts: DataFrame, vocabulary: DataFrame, size: int, width: int, longest: int, small: bool) -> DataFrame:
    """``id, rev, start, length, window``: shingles from each place of an item's shingle on.

    Opened are the sizes of all items that have a shingle inside. With a small vocabulary one
    pass over the texts does: a place takes along what follows it, as far as the longest item
    reaches. Else the places are found by a shuffled join, and the documents that have any are
    joined to them.
    """
    # the words are a column of their own: inside the lambda they would be made for each shingle
    shingled = texts.select("id", "rev", words_of(F.col("text")).alias("words")).select(
        "id", "rev", shingles_of(F.col("words"), size).alias("shingles"))

    def found(places: DataFrame, known: DataFrame) -> DataFrame:
        of_size = F.filter("lengths", lambda n: F.least(n, F.lit(width)) == size)
        return places.join(known.withColumn("lengths", of_size).filter(F.size("lengths") > 0), "h")

    def opened(places: DataFrame, *along: str) -> DataFrame:
        """A row for each place and each length of an item that has a shingle in that window."""
        reach = Window.partitionBy("id", "rev").orderBy("start").rangeBetween(0, longest - size)
        inside = F.flatten(F.transform("inside", lambda p: F.filter(
            p["lengths"], lambda n: p["start"] + size <= F.col("start") + n)))
        return places.withColumn("inside", F.collect_list(F.struct("start", "lengths")).over(reach)).select(
            "id", "rev", "start", *along, F.explode(F.array_distinct(inside)).alias("length"))

    def cut(shingles: str, start: Column, length: Column) -> Column:
        return F.slice(shingles, start + 1, length - F.lit(size - 1))
    if small:
        places = shingled.select("id", "rev", "shingles", F.posexplode_outer("shingles").alias("start", "h"))
        places = found(places, F.broadcast(vocabulary)).select(
            "id", "rev", "start", "lengths", cut("shingles", F.col("start"), F.lit(longest)).alias("ahead"))
        return opened(places, "ahead").select(
            "id", "rev", "start", "length", cut("ahead", F.lit(0), F.col("length")).alias("window"))
    places = shingled.select("id", "rev", F.posexplode_outer("shingles").alias("start", "h"))
    by_row = opened(found(places, vocabulary).select("id", "rev", "start", "lengths").distinct()).groupBy("id", "rev").agg(
        F.collect_set(F.struct("start", "length")).alias("places"))
    by_row = written(by_row, scratch(texts.sparkSession, f"decontam-places-{size}"))
    return by_row.join(shingled, ["id", "rev"]).select(
        "id", "rev", "shingles", F.explode("places").alias("place")).select(
        "id", "rev", "place.start", "place.length", cut("shingles", F.col("place.start"), F.col("place.length")).alias("window"))


def contamination(docs: DataFrame, benchmark: DataFrame, percent: int = 75, width: int = 5,
                  radius: int = 19, blocks: int = 5, broadcast_rows: int = 1_000_000,
                  doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """``id, item, start, common, total``: each document and item that a window of it resembles.

    One row per document id and item, for the most similar window (of equal ones the first):
    its first word from 0, and the similarity as integer weights ``common / total``, which
    is at least ``percent`` / 100. Documents without such a window have no row. NULL and
    empty texts have no words; items without words match nothing; rows without an id are
    left out. Rows repeated under an id, documents or items, count as one. Other columns are
    not read. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    raw = benchmark.select(F.col(item_id).alias("item"), words_of(F.col(item_text)).alias("words")).filter(
        F.col("item").isNotNull() & (F.size("words") > 0)).distinct()
    short = F.lit(None)
    for k in range(1, width + 1):
        fits = F.size("words") == k if k < width else F.size("words") >= width
        short = F.when(fits, shingles_of(F.col("words"), k)).otherwise(short)
    # equal words under an id are one row; texts of an id that differ are told apart by their shingles
    items = written(raw.select("item", F.size("words").alias("length"), short.alias("shingles")).withColumn(
        "text", F.xxhash64("shingles")), scratch(spark, "decontam-items"))

    counted = items.select("item", "length", "text", F.explode("shingles").alias("h")).groupBy(
        "item", "length", "text", "h").agg(F.count(F.lit(1)).alias("times"))
    n_items = items.select("item").distinct().count()
    spread_of = counted.groupBy("h").agg(
        F.countDistinct("item").alias("items"), F.array_sort(F.collect_set("length")).alias("lengths"))
    weighing = F.round(1000 * F.log(1 + F.lit(float(n_items)) / F.col("items"))).cast("long")
    vocabulary = written(spread_of.select("h", "lengths", weighing.alias("weight")),
                         scratch(spark, "decontam-vocabulary"))
    rare = round(1000 * math.log(1 + n_items))  # of a shingle that no item has: as of one item's
    small = vocabulary.count() <= broadcast_rows
    weights = vocabulary.select("h", "weight")
    lighter = weights.filter(F.col("weight") != rare)  # of shingles that several items share
    lighter = F.broadcast(lighter) if lighter.count() <= broadcast_rows else lighter
    bags = counted.join(weights, "h").groupBy("item", "length", "text").agg(
        F.collect_list(F.struct("h", "times", "weight", pull_of(F.col("times"), F.col("weight")).alias("pull"))).alias("bag"),
        F.sum(F.col("times") * F.col("weight")).alias("item_weight"))
    bags = written(bags.withColumn("print", simhash(F.col("bag.h"), F.col("bag.pull"))), scratch(spark, "decontam-bags"))

    texts = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("rev"), F.col(text).alias("text")).filter(
        F.col("id").isNotNull() & F.col("text").isNotNull())
    reached = items.groupBy(F.least("length", F.lit(width)).alias("size")).agg(F.max("length").alias("longest")).collect()
    sizes = {r["size"]: r["longest"] for r in reached}
    looked_up = vocabulary.select("h", "lengths")
    windows = None
    for size, longest in sorted(sizes.items()) or [(width, width)]:
        shown = _windows(texts, looked_up, size, width, longest, small)
        windows = shown if windows is None else windows.unionByName(shown)
    windows = written(windows.withColumns({
        "w1": F.xxhash64("window"), "w2": F.xxhash64(F.lit(1), "window")}), scratch(spark, "decontam-windows"))
    distinct = windows.groupBy("w1", "w2", "length").agg(F.first("window").alias("window"))
    distinct = written(distinct, scratch(spark, "decontam-distinct"))
    prints = written(window_prints(distinct, lighter, rare), scratch(spark, "decontam-prints"))

    index = written(entered(bags, blocks, radius), scratch(spark, "decontam-index"))
    probes = prints.select("w1", "w2", "length", F.col("print").alias("own"),
                             F.explode(block_values(F.col("print"), blocks)).alias("b")).select(
        "w1", "w2", "length", "own", "b.block", "b.value")
    near = probes.join(index, ["length", "block", "value"]).filter(
        F.bit_count(F.col("own").bitwiseXOR(F.col("print"))) <= radius).select(
        "w1", "w2", "length", "item", "print").distinct()

    # exact weighted similarity of the near pairs: arrays of one window against one item
    near = written(near, scratch(spark, "decontam-near"))
    met = written(distinct.select("w1", "w2", "length", "window").join(
        near.select("w1", "w2", "length").distinct(), ["w1", "w2", "length"]), scratch(spark, "decontam-met"))
    window_weight = prints.select("w1", "w2", "length", "window_weight")
    held = F.aggregate("bag", F.lit(0).cast("long"), lambda total, s: total + s["weight"] * F.least(
        s["times"], F.size(F.filter("window", lambda h: h == s["h"]))))
    similar = near.join(met, ["w1", "w2", "length"]).join(bags, ["item", "length", "print"]).select(
        "w1", "w2", "length", "item", "item_weight", held.alias("common")).join(
        window_weight, ["w1", "w2", "length"]).withColumn(
        "total", F.col("window_weight") + F.col("item_weight") - F.col("common")).filter(
        100 * F.col("common") >= percent * F.col("total"))
    similar = written(similar.select("w1", "w2", "length", "item", "common", "total"),
                      scratch(spark, "decontam-similar"))
    placed = windows.select("id", "start", "length", "w1", "w2").join(similar, ["w1", "w2", "length"])
    # a fraction is carried as a double to rank by, the first start settles ties
    best = placed.groupBy("id", "item").agg(F.max(F.struct(
        (F.col("common") / F.col("total")).alias("similarity"), (-F.col("start")).alias("at"),
        "common", "total")).alias("best"))
    return best.select("id", "item", (-F.col("best.at")).cast("long").alias("start"),
                       F.col("best.common").alias("common"), F.col("best.total").alias("total"))
