"""Exact top-k inner products by vector-approximation files.

Vectors are stored in blocks: ids, cells of one byte per component (the approximation), and
the exact integer components in a column of their own. A cell says between which marks of
its dimension's equal-width grid a component lies, so the cells of a vector bound its inner
product with any query from both sides.

The search deals the blocks into lanes of bounded size, each of which meets every query of its
length once. A query's bar in a lane starts as the k-th best lower bound of the first cells and
then is the k-th exact score so far. Cells are read block by block: a vector whose upper bound
is under the bar is skipped, and of the others exact vectors are read in the order of their
upper bounds (for inner products large is near) until the k-th exact score is above the next
bound. No vector that belongs in the result can be skipped; ties at the k-th score are kept by
id. Of equal vectors a lane keeps the first ids, as many as a result can hold, so that copies
cost nothing; where near copies leave most of a block over the bar, its exact products are
taken as one matrix.

Queries are a stated set, a part of the rows. They too are packed in blocks; what leaves a lane
is k rows a query. Lanes and parts of the queries are cut by their bytes, so that no task grows
with the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import scratch, written

BLOCKS = "block string, dim int, n int, ids binary, cells binary, exact binary"
EXACT_SINGLE = float(1 << 24)
EXACT_FLOAT = float(1 << 53)
LONGS = 2.0 ** 63
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Bytes of vectors in a lane and of queries in a part, and the least vectors that are worth a lane.
LANE_BYTES, PART_BYTES, LANE_ROWS = 48 << 20, 32 << 20, 16384
#: Cells that meet a query block at once.
STRIDE = 1024


def taking_part(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``id, v`` of the rows that have both; components as they are, if they are floats."""
    kind = vectors.schema[vector].dataType
    column = F.col(vector)
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))):
        column = column.cast("array<double>")
    return vectors.select(F.col(vec_id).cast("long").alias("id"), column.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull())


def integers_of(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and ``floor(scale * component)`` of a batch of ``id, v``, by vector length.

    Vectors with a component that is NULL or not finite are left out.
    """
    column = batch.column("v")
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # NULL becomes NaN
    with np.errstate(over="ignore", invalid="ignore"):
        flat = flat * scale
    sizes = np.diff(offsets)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        if len(at) == len(sizes):
            parts = flat[offsets[0]:offsets[-1]].reshape(len(at), dim)
        else:
            parts = flat[offsets[at][:, None] + np.arange(dim)]
        whole = np.isfinite(parts).all(axis=1)
        if not whole.all():
            at, parts = at[whole], parts[whole]
        if len(at):
            parts = np.floor(parts)
            v = np.clip(parts, -LONGS, LONGS - 1024).astype(np.int64)
            v[parts >= LONGS] = MOST
            yield ids[at].astype(np.int64), v


def usable(rows: DataFrame, scale: int) -> DataFrame:
    """``id, v`` of the rows that take part: those with an id and an integer vector."""
    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, v in integers_of(batch, scale):
                offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * v.shape[1], pa.int32())
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(ids), "v": pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))})
    return rows.mapInArrow(converted, "id long, v array<bigint>")


def grid(rows: DataFrame, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Least and largest value of each dimension, by vector length: two numbers per dimension."""
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for _, v in integers_of(batch, scale):
                low, high = v.min(axis=0), v.max(axis=0)
                if (was := found.get(v.shape[1])) is not None:
                    low, high = np.minimum(low, was[0]), np.maximum(high, was[1])
                found[v.shape[1]] = low, high
        for dim, (low, high) in found.items():
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array([dim] * dim, pa.int32()), "at": pa.array(range(dim), pa.int32()),
                "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())})
    each = rows.mapInArrow(ranges, "dim int, at int, low long, high long").groupBy("dim", "at").agg(
        F.min("low").alias("low"), F.max("high").alias("high"))
    marks: dict[int, dict[int, tuple[int, int]]] = {}
    for r in each.collect():
        marks.setdefault(r["dim"], {})[r["at"]] = (r["low"], r["high"])
    return {dim: tuple(np.array([m[i][side] for i in range(dim)], dtype=np.int64) for side in (0, 1))
            for dim, m in marks.items()}


def widths(low: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    """Cell width of each dimension: integers per cell."""
    return (high - low) // (1 << bits) + 1


def packed(values: np.ndarray) -> bytes:
    """Integers in the fewest bytes each that hold them all: 1, 2, 4 or 8."""
    low, high = values.min(initial=0), values.max(initial=0)
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return values.astype(kind).tobytes()


def unpacked(buffer: pa.Buffer, n: int, dim: int) -> np.ndarray:
    """What ``packed`` made of ``n`` vectors."""
    size = len(buffer) // (n * dim) if n * dim else 8
    return np.frombuffer(buffer, dtype=f"i{size}").reshape(n, dim)


def store(rows: DataFrame, marks: dict, path: str, scale: int, bits: int = 8, block_rows: int = 2048) -> DataFrame:
    """The approximation file: vectors packed as they lie, without a shuffle."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(ids: np.ndarray, exact: np.ndarray) -> pa.RecordBatch:
            dim = exact.shape[1]
            low, high = marks.get(dim, (np.zeros(0, np.int64),) * 2)
            cells = ((exact - low) // widths(low, high, bits)).astype(np.uint8)
            return pa.RecordBatch.from_pydict({
                "block": [f"{dim}-{ids[0]}-{ids[-1]}-{len(ids)}"], "dim": pa.array([dim], pa.int32()),
                "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()),
                "cells": pa.array([cells.tobytes()], pa.binary()), "exact": pa.array([packed(exact)], pa.binary())})

        def joined(dim: int) -> tuple[np.ndarray, np.ndarray]:
            return tuple(np.concatenate(x) for x in zip(*waiting.pop(dim)))
        for batch in batches:
            for more in integers_of(batch, scale):
                dim = more[1].shape[1]
                waiting.setdefault(dim, []).append(more)
                if sum(len(ids) for ids, _ in waiting[dim]) >= block_rows:
                    ids, exact = joined(dim)
                    full = len(ids) // block_rows * block_rows
                    for at in range(0, full, block_rows):
                        yield block(ids[at:at + block_rows], exact[at:at + block_rows])
                    if full < len(ids):
                        waiting[dim] = [(ids[full:], exact[full:])]
        for dim in list(waiting):
            yield block(*joined(dim))
    if not 1 <= bits <= 8:
        raise ValueError("a cell has 1 to 8 bits")
    return written(rows.mapInArrow(blocks, BLOCKS), path)


def query_blocks(queries: DataFrame, block_rows: int) -> DataFrame:
    """``dim, number, names, query`` with up to about ``block_rows`` queries each."""
    one = queries.groupBy("id").agg(F.min("v").alias("v"))  # repeated rows ask once
    sized = one.withColumn("dim", F.size("v"))
    parts = sized.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("parts"))
    dealt = sized.join(F.broadcast(parts), "dim").withColumn(
        "number", F.pmod(F.xxhash64("id"), F.col("parts")))
    gathered = dealt.groupBy("dim", "number").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("rows"))

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, query = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                                for c in ("query_ids", "query"))
                yield pa.RecordBatch.from_pydict({
                    "dim": batch.column("dim").slice(i, 1), "number": batch.column("number").slice(i, 1),
                    "names": pa.array([names.tobytes()], pa.binary()), "query": pa.array([packed(query)], pa.binary())})
    return gathered.select("dim", "number", F.col("rows.id").alias("query_ids"), F.flatten("rows.v").alias("query")).mapInArrow(
        bytes_of, "dim int, number long, names binary, query binary")


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer products ``left @ right.T``: in floats while they are exact there."""
    if not left.shape[1]:
        return np.zeros((len(left), len(right)), dtype=np.int64)
    bound = float(abs(left).max(initial=0)) * float(abs(right).max(initial=0)) * left.shape[1]
    if bound < EXACT_FLOAT:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    if bound >= LONGS:
        raise OverflowError("inner products of these vectors do not fit 64 bits")
    return left @ right.T


def edges(query: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the cells and what to add to their products: for the lower and the upper bound.

    A component lies in ``edge`` to ``edge + width - 1``, so what the cells leave open is, for
    each query, the same amount over all vectors.
    """
    slack = width - 1
    base = query @ low
    return query * width, base + np.minimum(query, 0) @ slack, base + np.maximum(query, 0) @ slack


def bounds(query: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all products of a query block with the vectors of a block."""
    weights, floor, ceiling = edges(query, low, width)
    base = _products(weights, cells.astype(np.int64))
    return base + floor[:, None], base + ceiling[:, None]


class Lane(NamedTuple):
    """Vectors of one length by id, without copies that no result can hold."""
    ids: np.ndarray
    cells: np.ndarray
    exact: np.ndarray


def _place(*keys: np.ndarray) -> np.ndarray:
    """Place of each row among its neighbours with equal keys."""
    at = np.arange(len(keys[0]))
    first = at == 0
    for key in keys:
        first[1:] |= key[1:] != key[:-1]
    return at - np.maximum.accumulate(np.where(first, at, 0))


def lane_of(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> Lane:
    """A lane of blocks (ids, cells, exact): of equal vectors the first k + 1 ids, each k times at most.

    One of them may be the query's own, so k others are left where there are as many.
    """
    ids = np.concatenate([b[0] for b in blocks])
    order, dim = np.argsort(ids, kind="stable"), blocks[0][1].shape[1]
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    ids, cells = ids[order], np.empty((len(ids), dim), dtype=np.uint8)
    exact, keys = np.empty((len(ids), dim), dtype=np.result_type(*(b[2].dtype for b in blocks))), np.empty(len(ids), dtype=np.int64)
    factors, at = np.random.default_rng(1).integers(LEAST, MOST, dim) | 1, 0
    for own, some, whole in blocks:
        to = place[at:at + len(own)]
        cells[to], exact[to], keys[to] = some, whole, whole.astype(np.int64) @ factors
        at += len(own)
    grouped = np.argsort(keys, kind="stable")  # equal vectors have equal keys; others seldom
    alike = np.flatnonzero(keys[grouped[1:]] == keys[grouped[:-1]])
    if not len(alike):
        return Lane(ids, cells, exact)
    changes = np.ones(len(ids), dtype=bool)
    for at in range(0, len(alike), STRIDE):
        some = alike[at:at + STRIDE]
        changes[some + 1] = (exact[grouped[some]] != exact[grouped[some + 1]]).any(axis=1)
    repeat = _place(np.cumsum(changes), ids[grouped])
    new = np.cumsum(repeat == 0)  # numbers (vector, id)
    first = np.maximum.accumulate(np.where(changes, new, 0))
    keep = np.zeros(len(ids), dtype=bool)
    keep[grouped[(new - first <= k) & (repeat < k)]] = True
    return Lane(ids[keep], cells[keep], exact[keep])


class Best:
    """The k best exact scores of each query of a block so far, ties to the smaller place.

    ``small``: scores are under 2 ** 24 and places under 2 ** 23, so one number holds the order.
    """

    def __init__(self, queries: int, k: int, small: bool) -> None:
        self.k, self.small = k, small and queries < 1 << 15
        self.query, self.at, self.score = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.bar = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        query, at, score = (np.concatenate(x) for x in ((self.query, query), (self.at, at), (self.score, score)))
        order = np.argsort((query << 48) + (((1 << 24) - score) << 23) + at) if self.small else np.lexsort((at, -score, query))
        place = _place(query[order])
        last = order[place == self.k - 1]
        np.maximum.at(self.bar, query[last], score[last].astype(np.float64))
        order = order[place < self.k]
        self.query, self.at, self.score = query[order], at[order], score[order]


def search_block(names: np.ndarray, query: np.ndarray, lane: Lane, low: np.ndarray, width: np.ndarray,
                 bits: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A lane's part of the result of a query block: query ids, ids and exact scores."""
    sizes, span = abs(query.astype(np.float64)), width * float(1 << bits)
    largest = np.maximum(abs(low.astype(np.float64)), abs(low + span))
    limit = float((sizes @ largest).max(initial=0))
    if limit >= LONGS:
        raise OverflowError("inner products of these vectors do not fit 64 bits")
    kind = np.float32 if limit < EXACT_SINGLE else np.float64 if limit < EXACT_FLOAT else np.int64
    weights, floor, ceiling = (x.astype(np.float64) for x in edges(query, low, width))
    # products with cells are taken in single floats; where these round, bounds give way by as much
    most = float((sizes @ span).max(initial=0))
    give = (0.0 if most < EXACT_SINGLE else most * (len(low) + 4) * 2.0 ** -23) + (
        0.0 if limit < EXACT_FLOAT else limit * 2.0 ** -48)
    weights, asked, n = weights.astype(np.float32), query.astype(kind), len(lane.ids)
    left, right = (np.searchsorted(lane.ids, names, side) for side in ("left", "right"))
    own_query = np.repeat(np.arange(len(names)), right - left)  # a query's own rows are no candidates
    own_at = _place(own_query) + left[own_query]
    best, waiting = Best(len(names), k, kind == np.float32 and n <= 1 << 23), []

    def reach() -> np.ndarray:
        """The least product with cells that lets a vector's upper bound reach the bar."""
        exact = best.bar - ceiling - give
        single = exact.astype(np.float32)
        single = np.where(single > exact, np.nextafter(single, np.float32(-np.inf)), single)
        return np.maximum(single, np.finfo(np.float32).min)  # own rows stay under it

    def scores(queries: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", asked[queries], lane.exact[at].astype(kind)).astype(np.int64)

    def settle() -> None:
        """Exact scores of what waits, in the order of the upper bounds."""
        queries, at, product = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        order = product.view(np.int32)  # bits of floats, in the order of the floats
        order = np.argsort((queries << 32) - (order ^ ((order >> 31) & 0x7FFFFFFF)))
        place = _place(queries[order])
        begin, end = 0, k
        while len(order):
            now = (place >= begin) & (place < end)
            near = product[order] >= reach()[queries[order]]
            one = order[now & near]
            best.add(queries[one], at[one], scores(queries[one], at[one]))
            rest = near & (place >= end)
            order, place = order[rest], place[rest]
            begin, end = end, 2 * end

    def dense(rows: np.ndarray, begin: int, end: int, product: np.ndarray) -> np.ndarray:
        """Where queries have one of their k best exact scores of a block, for those with near copies in it."""
        every = (asked[rows] @ lane.exact[begin:end].astype(kind).T).astype(np.int64)
        every[np.isneginf(product)] = LEAST
        kth = np.partition(every, end - begin - k, axis=1)[:, end - begin - k][:, None]
        tie = every == kth
        hit = (every > kth) | (tie & (np.cumsum(tie, axis=1) <= k))
        return hit & (every > LEAST) & (every >= best.bar[rows][:, None] - give)

    count, least = 0, reach()
    some_cells = np.empty((STRIDE, len(low)), dtype=np.float32)  # memory is used again: new pages cost as much as products
    some_products = np.empty(len(names) * STRIDE, dtype=np.float32)
    for begin in range(0, n, STRIDE):
        end = min(begin + STRIDE, n)
        product, cells = some_products[:len(names) * (end - begin)].reshape(len(names), end - begin), some_cells[:end - begin]
        cells[...] = lane.cells[begin:end]
        np.matmul(weights, cells.T, out=product)
        mine = (own_at >= begin) & (own_at < end) if len(own_at) else np.zeros(0, dtype=bool)
        product[own_query[mine], own_at[mine] - begin] = -np.inf
        if begin == 0 and end > k:
            kth = np.partition(product, end - k, axis=1)[:, end - k].astype(np.float64)
            best.bar = kth + floor - give
            least = reach()
        some = np.flatnonzero(product.max(axis=1) >= least)
        near = product[some]
        hits = near >= least[some][:, None]
        hit = np.flatnonzero(hits)
        if len(hit) > end - begin:
            wide = np.bincount(hit // (end - begin), minlength=len(some)) > max(4 * k, (end - begin) // 16)
            if wide.any():
                hits[wide] = dense(some[wide], begin, end, near[wide])
                hit = np.flatnonzero(hits)
        if len(hit):
            waiting.append((some[hit // (end - begin)], begin + hit % (end - begin), near.ravel()[hit]))
            count += len(hit)
        if count and (begin == 0 or count >= k * len(names)):
            settle()
            count, least = 0, reach()
    if waiting:
        settle()
    return names[best.query], lane.ids[best.at], best.score


def _dealt(table: DataFrame, asked: DataFrame, marks: dict, lanes: int | None) -> tuple[DataFrame, DataFrame]:
    """Blocks with ``lane, part`` and query blocks with the same: each lane meets each part once."""
    spark = table.sparkSession
    rows = {r["dim"]: r["n"] for r in table.groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    names = {r["dim"]: r["n"] for r in asked.groupBy("dim").agg(F.sum(F.length("names")).alias("n")).collect()}
    tasks = 2 * spark.sparkContext.defaultParallelism

    def counts(dim: int) -> tuple[int, int, int]:
        low, high = marks.get(dim, (np.zeros(0, np.int64),) * 2)
        one = len(packed(np.concatenate([low, high]))) // 2  # bytes of an exact vector
        least = -(-rows[dim] * (8 + dim + one) // LANE_BYTES)
        return dim, lanes or max(least, min(tasks, rows[dim] // LANE_ROWS), 1), max(1, -(-names[dim] * (8 + one) // 8 // PART_BYTES))
    each = [counts(dim) for dim in sorted(rows) if dim in names]
    deal = F.broadcast(spark.createDataFrame(pa.table({
        name: pa.array([x[i] for x in each], pa.int32()) for i, name in enumerate(("dim", "lanes", "parts"))})))
    blocks = table.join(deal, "dim").withColumn("lane", F.pmod(F.xxhash64("block"), "lanes").cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    queries = asked.join(deal, "dim").withColumn("part", F.pmod("number", "parts").cast("int")).withColumn(
        "lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
    return (blocks.select("dim", "lane", "part", "n", "ids", "cells", "exact"),
            queries.select("dim", "lane", "part", "number", "names", "query"))


def search(table: DataFrame, queries: DataFrame, marks: dict, k: int = 10, bits: int = 8,
           query_rows: int = 256, lanes: int | None = None) -> DataFrame:
    """``query_id, rank, id, score``: each query's k largest inner products, ties to the smaller id.

    ``queries`` has ``id, v``; a query's own id is no candidate, and it meets only vectors of
    its own length. Fewer than k candidates give fewer rows.
    """
    spark: SparkSession = table.sparkSession
    asked = written(query_blocks(queries, query_rows), scratch(spark, "va-queries"))

    def results(vectors: pa.Table, block: pa.Table) -> pa.Table:
        found = [(np.zeros(0, dtype=np.int64),) * 3]
        if vectors.num_rows and block.num_rows:
            dim, sizes = vectors.column("dim")[0].as_py(), vectors.column("n").to_pylist()
            low, high = marks.get(dim, (np.zeros(0, np.int64),) * 2)
            buffers = {c: [x.as_buffer() for x in vectors.column(c)] for c in ("ids", "cells", "exact")}
            lane = lane_of([
                (np.frombuffer(i, dtype=np.int64), np.frombuffer(c, dtype=np.uint8).reshape(n, dim), unpacked(e, n, dim))
                for i, c, e, n in zip(*(buffers[c] for c in ("ids", "cells", "exact")), sizes)], k)
            for names, query in zip(block.column("names"), block.column("query")):
                names = np.frombuffer(names.as_buffer(), dtype=np.int64)
                query = unpacked(query.as_buffer(), len(names), dim).astype(np.int64)
                found.append(search_block(names, query, lane, low, widths(low, high, bits), bits, k))
        return pa.table(dict(zip(("query_id", "id", "score"), (pa.array(np.concatenate(x)) for x in zip(*found)))))

    keys = "dim", "lane", "part"
    blocks, parts = _dealt(table, asked, marks, lanes)
    found = blocks.groupBy(*keys).cogroup(parts.groupBy(*keys)).applyInArrow(
        results, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, bits: int = 8,
          block_rows: int = 2048, query_rows: int = 256, vec_id: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """Top k of every row that ``is_query`` (a condition on ``id``) names, among all other rows.

    Rows take part that have an id and a vector of finite components. Repeated rows are
    candidates each, under one id; as queries they ask once (of different vectors under one
    id, the smallest asks). Empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = taking_part(vectors, vec_id, vector)
    marks = grid(rows, scale)
    table = store(rows, marks, scratch(spark, "va-file"), scale, bits, block_rows)
    return search(table, usable(rows.filter(is_query), scale), marks, k, bits, query_rows)
