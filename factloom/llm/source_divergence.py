"""Source divergence audit: how far the word rates of two sources of a language are apart.

1. Tasks count words per (language, source) in bounded tables and hand over partial counts, so
   a source or word with a third of all occurrences is a few rows a task.
2. Words in enough documents of a language are its terms, each with a number. Numbers are dealt
   in blocks, so a block holds at most ``BLOCK`` counts of all sources together.
3. A source's counts in a block are one sorted (term number, count) array. Sources of a language
   are put in tiles; the arrays of two tiles are co-grouped, and for each unordered pair of
   sources a galloping intersection of the two arrays prices the terms that both have, those
   that only one has and, by their number, those that none has, both ways.
4. Block sums are added up per pair. Everything is integer arithmetic.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import scratch, written

UNIT = 1_000_000_000
BLOCK_BITS = 18
ENTRIES = 500_000  # counters a task holds before it hands them over
LETTERS = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))
PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
VECTOR = "array<struct<term: bigint, n: bigint>>"


def words(text: str | None) -> list[bytes]:
    """Runs of letters and characters past ASCII, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split(b" ") if text else []


def partial_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents, in parts to be added up."""
    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in (
        (lang, "lang"), (source, "source"), (text, "text"))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, dict[bytes, int]] = {}
        held = 0
        for batch in batches:
            for language, origin, content in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
                counts = groups.setdefault((language.as_py(), origin.as_py()), {})
                found = Counter(words(content.as_py()))
                found.pop(b"", None)
                held -= len(counts)
                for term, n in found.items():
                    counts[term] = counts.get(term, 0) + (n << 32) + 1  # occurrences, and documents below
                held += len(counts)
                if held > ENTRIES:
                    yield from handed_over(groups)
                    groups, held = {}, 0
        yield from handed_over(groups)
    return read.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def handed_over(groups: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), counts in groups.items():
        columns = [[lang] * len(counts), [source] * len(counts), [t.decode() for t in counts],
                   [c >> 32 for c in counts.values()], [c & 0xFFFFFFFF for c in counts.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PARTIAL)], schema=PARTIAL)


def gallop(few: np.ndarray, many: np.ndarray, stride: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Places in two sorted arrays of what both hold, by leaps through the longer one.

    For each stretch of the shorter array the leaps double until they cover it, and only what
    they cover is searched.
    """
    at, ours, theirs = 0, [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for start in range(0, len(few), stride):
        stretch = few[start:start + stride]
        at += _leap(many, at, stretch[0])
        end = at + _leap(many, at, stretch[-1] + 1)
        near = many[at:end]
        places = np.searchsorted(near, stretch)
        hit = places < len(near)
        hit[hit] = near[places[hit]] == stretch[hit]
        ours.append(np.flatnonzero(hit) + start)
        theirs.append(places[hit] + at)
        at = end
    return np.concatenate(ours), np.concatenate(theirs)


def _leap(many: np.ndarray, at: int, value: int) -> int:
    """How far from ``at`` the first element is that is not under ``value``."""
    low, step = at, 1
    while low + step < len(many) and many[low + step] < value:
        low, step = low + step, 2 * step
    return low - at + int(np.searchsorted(many[low:low + step + 1], value))


def rates(counts: np.ndarray, base: int) -> np.ndarray:
    """``1 + floor(UNIT * (count + 1) / base)`` exactly; Python's integers where 64 bits are too few."""
    if len(counts) and int(counts.max()) >= (1 << 63) // UNIT - 1:
        return np.array([1 + UNIT * (c + 1) // base for c in counts.tolist()], dtype=np.int64)
    return 1 + UNIT * (counts + 1) // base


def priced(p: np.ndarray, q: np.ndarray) -> int:
    """Sum of ``floor((p - q) ** 2 / q)``. Rates are at most ``UNIT + 1``, and all rates of a group
    at most ``UNIT`` and one a term together, so 64 bits hold the squares and their sum."""
    return int(((p - q) * (p - q) // q).sum())


def divergences(a: tuple, b: tuple) -> tuple[int, int, int]:
    """``(a from b, b from a, terms that either has)`` over one block; sides are ``(terms, counts, base)``.

    What neither has is priced by the caller.
    """
    (a_terms, a_counts, a_base), (b_terms, b_counts, b_base) = a, b
    flip = len(a_terms) > len(b_terms)
    x, y = gallop(*((b_terms, a_terms) if flip else (a_terms, b_terms)))
    in_a, in_b = (y, x) if flip else (x, y)
    a_rates, b_rates = rates(a_counts, a_base), rates(b_counts, b_base)
    zero = np.zeros(1, dtype=np.int64)
    a_zero, b_zero = rates(zero, a_base), rates(zero, b_base)
    only_a, only_b = np.delete(a_rates, in_a), np.delete(b_rates, in_b)
    forth = priced(a_rates[in_a], b_rates[in_b]) + priced(only_a, b_zero) + priced(a_zero, only_b)
    back = priced(b_rates[in_b], a_rates[in_a]) + priced(b_zero, only_a) + priced(only_b, a_zero)
    return forth, back, len(a_terms) + len(b_terms) - len(in_a)


def sides(rows: pa.Table) -> list[tuple]:
    """``(source, (terms, counts, base))`` of the arrays in one tile and block, by source."""
    out = []
    for source, base, entries in zip(*(rows.column(c) for c in ("source", "base", "entries"))):
        held = entries.values
        out.append((source.as_py(), (held.field("term").to_numpy(), held.field("n").to_numpy(), base.as_py())))
    return sorted(out, key=lambda side: side[0])


def pair_sums(vectors: DataFrame, tiles: DataFrame) -> DataFrame:
    """``lang, a, b, forth, back, seen`` of each unordered pair of sources, summed over blocks.

    ``vectors`` has ``lang, source, tile, base, block, entries``, a row for every source and
    block of a language; ``tiles`` has the pairs ``lang, first, second`` of tiles.
    """
    left = vectors.join(tiles.withColumn("tile", F.col("first")), ["lang", "tile"])
    right = vectors.join(tiles.filter("first < second").withColumn("tile", F.col("second")), ["lang", "tile"])
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, told apart from the left's
    schema = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("forth", pa.int64()),
                        ("back", pa.int64()), ("seen", pa.int64())])

    def price(key: tuple, ours: pa.Table, theirs: pa.Table) -> pa.Table:
        lang, _, first, second = (k.as_py() for k in key)
        mine, others = sides(ours), sides(theirs)
        pairs = [(x, y) for i, x in enumerate(mine) for y in mine[i + 1:]] if first == second else [
            (x, y) for x in mine for y in others]
        return pa.Table.from_pylist([
            {"lang": lang, "a": a, "b": b} | dict(zip(("forth", "back", "seen"), divergences(one, two)))
            for (a, one), (b, two) in pairs], schema)
    keys = ["lang", "block", "first", "second"]
    each = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        price, "lang string, a string, b string, forth long, back long, seen long")
    return each.groupBy("lang", "a", "b").agg(*[F.sum(c).alias(c) for c in ("forth", "back", "seen")])


def rate(count: Column, base: Column) -> Column:
    """As ``rates``; in decimals, which hold any count. Without terms the base is 0 and the rate of no use."""
    times = F.lit(UNIT).cast("decimal(38,0)") * (count + 1)
    return 1 + F.call_function("div", times, F.greatest(base, F.lit(1)).cast("decimal(38,0)"))


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200, tile: int = 16, text: str = "text",
          lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank`` for each source of each language.

    Part ``pair``: every other source of the language, and how far the source's rates are from
    it: the sum over all terms of ``floor((p - q) ** 2 / q)``, 0 without terms. Part ``term``:
    up to ``top`` terms the source has more often than its language, by the same measure
    against the language's rates. Rates are ``1 + floor(10**9 * (count + 1) / (N + V))``, with N
    the counted words and V the terms. Terms occur in at least ``least_docs`` documents (rows)
    of the language.

    NULL text, language and source count as empty, which is a language or source like others; a
    source without words still has pairs. Repeated rows each count. Ties of value go by the
    item's UTF-8 bytes. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    # dealt once by (language, word): sums by source, then by word, need no other exchange
    dealt = partial_counts(docs, text, lang, source).repartition("lang", "term")
    counted = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    word = Window.partitionBy("lang", "term")
    kept = counted.withColumn("at", F.monotonically_increasing_id()).withColumns({
        "docs": F.sum("docs").over(word), "total": F.sum("n").over(word), "number": F.min("at").over(word)})
    kept = written(kept.filter(F.col("docs") >= least_docs).drop("docs"), scratch(spark, "divergence-terms"))

    langs = kept.groupBy("lang").agg(F.count_if(F.col("at") == F.col("number")).alias("terms"), F.sum("n").alias("words"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_words"))
    occurring = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"),
                            F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    zero = F.lit(0).cast("long")
    groups = occurring.join(own, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("terms", zero).alias("terms"),
        (F.coalesce("own_words", zero) + F.coalesce("terms", zero)).alias("base"),
        (F.coalesce("words", zero) + F.coalesce("terms", zero)).alias("lang_base"),
        F.expr(f"(row_number() OVER (PARTITION BY lang ORDER BY source) - 1) div {tile}").alias("tile"))
    groups = written(groups, scratch(spark, "divergence-groups"))

    blocks = kept.groupBy("lang", "source", F.shiftright("number", BLOCK_BITS).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("number").alias("term"), "n"))).alias("entries"))
    blocks = written(blocks, scratch(spark, "divergence-blocks"))
    members = groups.select("lang", "source", "tile", "base")
    bare = members.join(blocks.select("lang", "block").distinct(), "lang").join(
        blocks.select("lang", "source", "block"), ["lang", "source", "block"], "left_anti")
    full = blocks.join(members, ["lang", "source"]).unionByName(
        bare.withColumn("entries", F.array().cast(VECTOR)))
    full = written(full, scratch(spark, "divergence-vectors"))
    tiles = groups.select("lang", F.col("tile").alias("first")).distinct().join(
        groups.select("lang", F.col("tile").alias("second")).distinct(), "lang").filter("first <= second")
    sums = pair_sums(full, tiles)

    def side(letter: str) -> DataFrame:
        return groups.select("lang", F.col("source").alias(letter), F.col("base").alias(f"{letter}_base"), "terms")
    pairs = side("a").join(side("b").drop("terms"), "lang").filter("a < b").join(sums, ["lang", "a", "b"], "left")
    a_zero, b_zero = rate(zero, F.col("a_base")), rate(zero, F.col("b_base"))
    unseen = F.col("terms") - F.coalesce("seen", zero)
    both = F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item"),
                 (F.coalesce("forth", zero) + unseen * price(a_zero, b_zero)).alias("value")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item"),
                 (F.coalesce("back", zero) + unseen * price(b_zero, a_zero)).alias("value"))))
    best_first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_pair = pairs.select("lang", both.alias("one")).select("lang", "one.*").withColumn(
        "rank", F.row_number().over(best_first))

    p, q = rate(F.col("n"), F.col("base")), rate(F.col("total"), F.col("lang_base"))
    by_term = kept.join(groups.select("lang", "source", "base", "lang_base"), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q").select(
        "lang", "source", "item", price(F.col("p"), F.col("q")).alias("value")).withColumn(
        "rank", F.row_number().over(best_first)).filter(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return by_pair.withColumn("part", F.lit("pair")).select(*columns).unionByName(
        by_term.withColumn("part", F.lit("term")).select(*columns))
