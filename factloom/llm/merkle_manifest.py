"""Merkle manifest of a dataset: one tree per source, and one over the sources' roots.

Trees are cut in aligned subtrees (*blocks*) of ``height`` levels, at most ``fanout ** height``
leaves. A block is one row; its nodes lie in a byte string in the van Emde Boas order: the tree
is split at half its height, the top part comes first, then the bottom parts one after the
other, each laid out the same way. So a path from a leaf to the block's root touches few
stretches of bytes whatever the size of a cache line or page, and a node is found by address
arithmetic alone, without pointers. The blocks' roots are the leaves of the next round.

Building goes up round by round; proofs come down: a block gets the siblings above it as a list
and adds its own. A source that holds a third of all rows is many blocks. Rounds are tables in
the shared folder. Only the largest number of leaves comes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import scratch, written

DIGEST = 32
SIBLINGS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
BLOCKS = ("tree long, block long, n_next long, height int, count int, root string, nodes binary, "
          "ids array<long>, altered array<string>")
PROOFS = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def h(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def node_count(levels: int, fanout: int) -> int:
    return (fanout ** levels - 1) // (fanout - 1)


@lru_cache(maxsize=256)
def addresses(levels: int, depth: int, fanout: int) -> list[int]:
    """Place of every node of a depth (0: the root) in the van Emde Boas order of ``levels`` levels."""
    index = np.arange(fanout ** depth)
    at = np.zeros(len(index), dtype=np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below = fanout ** (depth - top)
        at += node_count(top, fanout) + index // below * node_count(levels - top, fanout)
        index = index % below
        depth, levels = depth - top, levels - top
    return at.tolist()


def levels_above(n: int, fanout: int) -> int:
    """How often runs of ``fanout`` nodes become one until a single node is left."""
    height, reach = 0, 1
    while reach < n:
        height, reach = height + 1, reach * fanout
    return height


def widths(count: int, height: int, fanout: int) -> list[int]:
    """Nodes at each depth of a block with ``count`` leaves."""
    out = [count]
    for _ in range(height):
        out.append(-(-out[-1] // fanout))
    return out[::-1]


def laid_out(leaves: Sequence[str], height: int, fanout: int) -> tuple[str, bytes]:
    """Root, and the nodes in van Emde Boas order; places of nodes that are not there stay zero."""
    nodes = bytearray(DIGEST * node_count(height + 1, fanout))
    level = list(leaves)
    for depth in range(height, -1, -1):
        places = addresses(height + 1, depth, fanout)
        for place, digest in zip(places, level):
            nodes[DIGEST * place:DIGEST * (place + 1)] = bytes.fromhex(digest)
        if depth:
            level = [h(*level[i:i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], bytes(nodes)


def siblings(nodes: bytes, count: int, height: int, fanout: int) -> Iterator[tuple[int, str, list[tuple[str, str]]]]:
    """Of each leaf of a block: its place, digest, and the runs' other nodes (left, right) level by level upward."""
    text, size = nodes.hex(), 2 * DIGEST
    chains: list[list] = [[]]
    level: list[str] = [text[:size]]
    for depth, width in list(enumerate(widths(count, height, fanout)))[1:]:
        places = addresses(height + 1, depth, fanout)
        level = [text[size * p:size * (p + 1)] for p in places[:width]]
        down = []
        for i in range(width):
            first = i - i % fanout
            own = ("".join(level[first:i]), "".join(level[i + 1:first + fanout]))
            down.append([own, *chains[i // fanout]])
        chains = down
    yield from ((i, digest, chain) for i, (digest, chain) in enumerate(zip(level, chains)))


def positions(frame: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``frame`` with ``pos`` (from 0 in the order within its group) and ``n`` (rows of the group).

    By ranges of the order, so a group is no unit of work; only one row for each range and group
    is numbered in a window.
    """
    keys = [*group, *order]
    sorted_rows = frame.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
        "__at", F.monotonically_increasing_id())
    sorted_rows = written(sorted_rows.withColumn("__part", F.shiftright("__at", 33)), scratch(frame.sparkSession, name))
    runs = sorted_rows.groupBy("__part", *group).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    whole = Window.partitionBy(*[F.col(g) for g in group] or [F.lit(0)])
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__part").alias("__run"), "__first",
                       F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"),
                       F.sum("__rows").over(whole).alias("n"))
    same = F.col("__part") == F.col("__run")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return sorted_rows.join(runs, same).select(
        *frame.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("pos"), "n")


def blocks_of(leaves: DataFrame, height: int, fanout: int) -> DataFrame:
    """Rows of ``BLOCKS`` from ``tree, pos, n, digest, id, altered``."""
    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        n, count = rows.column("n")[0].as_py(), rows.num_rows
        own = min(height, levels_above(n, fanout))
        root, nodes = laid_out(rows.column("digest").to_pylist(), own, fanout)
        return pa.Table.from_pydict({
            "tree": [key[0].as_py()], "block": [key[1].as_py()], "n_next": [-(-n // fanout ** height)],
            "height": pa.array([own], pa.int32()), "count": pa.array([count], pa.int32()), "root": [root], "nodes": [nodes],
            "ids": pa.array([rows.column("id").to_pylist()], pa.list_(pa.int64())),
            "altered": pa.array([rows.column("altered").to_pylist()], pa.list_(pa.string()))})
    return leaves.withColumn("block", F.expr(f"pos div {fanout ** height}")).groupBy("tree", "block").applyInArrow(
        build, BLOCKS)


def forest(leaves: DataFrame, height: int, fanout: int, name: str) -> list[DataFrame]:
    """The blocks of every round, from the leaves up; a tree ends where ``n_next`` is 1."""
    most = leaves.agg(F.max("n")).first()[0] or 1
    rounds = []
    while True:
        blocks = written(blocks_of(leaves, height, fanout), scratch(leaves.sparkSession, name))
        rounds.append(blocks)
        most = -(-most // fanout ** height)
        if most == 1:
            return rounds
        leaves = blocks.filter("n_next > 1").select(
            "tree", F.col("block").alias("pos"), F.col("n_next").alias("n"), F.col("root").alias("digest"),
            F.col("block").alias("id"), F.lit(None).cast("string").alias("altered"))


def _ended(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """The trees that end in this round get what is above the whole tree."""
    return blocks.filter("n_next = 1").join(above, "tree").select(
        *blocks.columns, "above", F.coalesce("top", "root").alias("top"), F.coalesce("whole", "root").alias("whole"))


def _each_leaf(batches: Iterator[pa.RecordBatch], fanout: int):
    """``(block row, place, digest, siblings up to the root of all)`` of each leaf."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            over = [(s["left"], s["right"]) for s in row["above"]]
            for i, digest, chain in siblings(row["nodes"], row["count"], row["height"], fanout):
                yield row, i, digest, chain + over


def descend(rounds: list[DataFrame], above: DataFrame, fanout: int, last: str, leaf_rows) -> DataFrame:
    """From the last round down to the first; ``leaf_rows`` makes the first round's result."""
    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(({"tree": row["tree"], "block": row["ids"][i], "above": _structs(chain), "top": row["top"],
                              "whole": row["whole"]} for row, i, _, chain in _each_leaf(batches, fanout)), handed)
    handed = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("above", SIBLINGS), ("top", pa.string()), ("whole", pa.string())])
    kind = "tree long, block long, above array<struct<left string, right string>>, top string, whole string"
    down = None
    for blocks in rounds[::-1]:
        placed = _ended(blocks, above)
        if down is not None:
            placed = placed.unionByName(blocks.join(down, ["tree", "block"]).select(*placed.columns))
        if blocks is rounds[0]:
            return placed.mapInArrow(leaf_rows, last)
        down = written(placed.mapInArrow(between, kind), scratch(blocks.sparkSession, "merkle-above"))


def _structs(chain: list[tuple[str, str]]) -> list[dict]:
    return [{"left": left, "right": right} for left, right in chain]


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def leaf_digest(*fields: Column) -> Column:
    """Hex sha256 of the fields, each ``-`` if NULL, else its UTF-8 bytes' count, ``:`` and the value."""
    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*map(framed, fields)), 256)


def audit(leaves: DataFrame, height: int = 7, fanout: int = 3) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root`` for each row of ``leaves``.

    ``leaves`` has ``source, id, digest`` and ``altered``, the digest of a row that is to be
    verified, or NULL to verify the leaf itself. Within a source leaves ascend by id, NULL
    first, rows of one id by digest; a run of ``fanout`` nodes (the last one may have fewer)
    becomes its hash until one node is left. The roots of the sources, NULL first, then by the
    UTF-8 bytes, become the root the same way. The proof is the hash of all siblings, level by
    level; ``folded_root`` is what the altered leaf gives with them. No rows, no result.
    """
    placed = positions(leaves, ["source"], ["id", "digest"], "merkle-leaves")
    sources = positions(leaves.select("source").distinct(), [], ["source"], "merkle-sources").select(
        F.col("source").alias("__source"), F.col("pos").alias("tree"), F.col("n").alias("n_trees"))
    sources = written(sources, scratch(leaves.sparkSession, "merkle-trees"))
    numbered = placed.join(sources, F.col("source").eqNullSafe(F.col("__source"))).select(
        "tree", "pos", "n", "digest", "id", "altered")
    numbered = written(numbered, scratch(leaves.sparkSession, "merkle-placed"))
    rounds = forest(numbered, height, fanout, "merkle-blocks")

    ended = None
    for blocks in rounds:
        some = blocks.filter("n_next = 1").select(F.col("tree").alias("id"), F.col("root").alias("digest"))
        ended = some if ended is None else ended.unionByName(some)
    counted = sources.select(F.col("tree").alias("id"), F.col("n_trees").alias("n"))
    subroots = written(ended.join(counted, "id").select(
        F.lit(0).cast("long").alias("tree"), F.col("id").alias("pos"), "n", "digest", "id",
        F.lit(None).cast("string").alias("altered")), scratch(leaves.sparkSession, "merkle-subroots"))
    tops = forest(subroots, height, fanout, "merkle-tops")

    text = F.lit(None).cast("string")
    none = F.array().cast("array<struct<left string, right string>>")
    nothing = tops[-1].select("tree").distinct().select("tree", none.alias("above"), text.alias("top"), text.alias("whole"))

    def of_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tree", pa.int64()), ("above", SIBLINGS), ("top", pa.string()), ("whole", pa.string())])
        yield from _batched(({"tree": row["ids"][i], "above": _structs(chain), "top": digest, "whole": row["whole"]}
                             for row, i, digest, chain in _each_leaf(batches, fanout)), schema)
    above = written(descend(tops, nothing, fanout,
                            "tree long, above array<struct<left string, right string>>, top string, whole string", of_trees),
                    scratch(leaves.sparkSession, "merkle-trees-above"))

    def of_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64())] + [(c, pa.string()) for c in (
            "leaf", "subroot", "root", "proof_sha256", "folded_root")])

        def rows() -> Iterator[dict]:
            for row, i, digest, chain in _each_leaf(batches, fanout):
                folded = row["altered"][i] or digest
                for left, right in chain:
                    folded = h(left, folded, right)
                yield {"id": row["ids"][i], "leaf": digest, "subroot": row["top"], "root": row["whole"],
                       "proof_sha256": h(*(s for pair in chain for s in pair)), "folded_root": folded}
        yield from _batched(rows(), schema)
    return descend(rounds, above, fanout, PROOFS, of_leaves)
