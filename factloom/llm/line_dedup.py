"""Line deduplication by sorted line hashes; the answer is a keep bitmap per document.

Lines become (hash, document, position) rows. They are partitioned by range of (hash,
document) and sorted, which spreads a line that a third of all documents hold over many
tasks. Each task streams its range once: it puts the places of a line in a document together
as bitmap words and marks the first occurrence of each document in the line, with no further
exchange. What is written are these words; the marks are added up per line, and only words of
lines that enough documents hold go on. The result says for each document which positions go,
as 64-bit words of a bitmap in which words without a dropped line are left out. ``bitmaps``
moves no text; ``dedup`` brings texts and bitmaps together by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import UPPER, scratch, written

SPACES = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """The text split at ``\\n``; NULL and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    stripped = F.btrim(line, F.lit(SPACES))
    # the same for ASCII, and much faster there
    ascii_only = F.octet_length(stripped) == F.length(stripped)
    return F.when(ascii_only, F.lower(stripped)).otherwise(F.translate(stripped, UPPER, UPPER.lower()))


def _hashed(docs: DataFrame, least: int) -> DataFrame:
    """``id, rev, pos, h1, h2``: places of the lines whose key is long enough."""
    # outer: else Spark adds a filter on the size, which splits every text once more
    lines = docs.select("id", "rev", F.posexplode_outer("lines").alias("pos", "line"))
    keyed = lines.select("id", "rev", "pos", key_of(F.col("line")).alias("key")).filter(
        F.length("key") >= least)
    # two 64-bit hashes of different seeds: no two keys of any real corpus share both
    return keyed.select("id", "rev", "pos", F.xxhash64("key").alias("h1"),
                        F.xxhash64(F.lit(1), "key").alias("h2"))


def with_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, rev, lines``; ``rev`` tells apart different texts under one id."""
    return docs.select(F.col(doc_id).alias("id"),
                       F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("rev"),
                       lines_of(F.col(text)).alias("lines"))


def bitmaps(docs: DataFrame, least_length: int = 20, least_docs: int = 3,
            doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, rev, n_dropped, dropped``: documents that lose lines, with their bitmaps.

    A key of at least ``least_length`` code points that ``least_docs`` documents hold loses
    all its lines except those of the largest id holding it. ``dropped`` maps a word number
    to 64 bits; bit ``pos % 64`` of word ``pos div 64`` is set where the line goes. Documents
    that lose nothing have no row.

    Documents are told apart by id, so repeated rows of one id count once. NULL is an id of
    its own, smaller than all others. Empty tables give no rows, other columns are not read.
    """
    spark = docs.sparkSession
    places = _hashed(with_lines(docs, doc_id, text), least_length)
    # (h1, h2, id) ranges split a hot line by document, and hold all its places in a document:
    # the words and the window below need no other exchange, and the window sorts each range
    ranged = places.repartitionByRange(F.col("h1"), F.col("h2"), F.col("id"))
    in_doc = ["h1", "h2", "id"]
    of_line = ranged.groupBy(*in_doc, "rev", F.expr("pos div 64").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    nth = F.row_number().over(Window.partitionBy(*in_doc).orderBy("rev", "word"))
    streamed = written(of_line.withColumn("first", nth == 1), scratch(spark, "line-words"))

    repeated = streamed.groupBy("h1", "h2").agg(
        F.count_if("first").alias("n"), F.max("id").alias("keeper")).filter(
        F.col("n") >= least_docs).select("h1", "h2", "keeper")
    # written: a join with a table has two plain exchanges, so a hot line can be split
    repeated = written(repeated, scratch(spark, "line-repeated"))
    goes = streamed.join(repeated, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("keeper")))
    words = goes.groupBy("id", "rev", "word").agg(F.bit_or("bits").alias("bits"))
    return words.groupBy("id", "rev").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "bits")))).alias("dropped"))


def kept_lines(lines: Column, dropped: Column) -> Column:
    """The lines whose bit is not set in the bitmap (NULL: all lines)."""
    def stays(line: Column, pos: Column) -> Column:
        word = F.coalesce(F.try_element_at(dropped, F.floor(pos / 64).cast("int")), F.lit(0).cast("long"))
        return word.bitwiseAND(
            F.call_function("shiftleft", F.lit(1).cast("long"), pos % 64)) == 0
    return F.when(dropped.isNull(), lines).otherwise(F.filter(lines, stays))


def dedup(docs: DataFrame, least_length: int = 20, least_docs: int = 3,
          doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id, lines, n_lines, n_dropped, kept``.

    ``kept`` is the array of the lines that stay, in order.
    """
    maps = bitmaps(docs, least_length, least_docs, doc_id, text)
    own = with_lines(docs, doc_id, text)
    both = own.alias("d").join(
        maps.alias("m"), F.col("d.id").eqNullSafe(F.col("m.id")) & (F.col("d.rev") == F.col("m.rev")),
        "left")
    return both.select(
        F.col("d.id").alias("id"), F.col("d.lines").alias("lines"),
        F.size("d.lines").cast("long").alias("n_lines"),
        F.coalesce("m.n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        kept_lines(F.col("d.lines"), F.col("m.dropped")).alias("kept"))
