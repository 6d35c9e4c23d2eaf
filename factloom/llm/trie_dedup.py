"""Exact deduplication by Patricia tries: the terminal node of a text knows its owner.

1. Every task inserts the whole texts it reads in compressed radix tries, one for each length
   in bytes. What ends in one terminal node is one *piece*: its text, the best id so far, the
   number of rows. A text that a third of all rows hold is one piece a task from there on.
2. Pieces are dealt by length and content hash. The tries of a partition join equal pieces;
   equality is decided by the bytes on the way down, never by a hash.
3. A trie holds a bounded number of bytes. Beyond that its heaviest subtrees are spilled: their
   texts, and all that later arrive there, are rows of the next round, dealt by subtree. So
   each round has strictly less to do, and none is needed while the partitions fit.
4. Rows find their owner by the number of their piece, at most as many rows a piece as one
   task has read, so no key is hot.

Rounds are tables in the shared folder: a lost executor repeats its part of one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch, written

NODE_BYTES = 400  # of Python objects, for each text in a trie
ROWS = 4096
MEMBERS = pa.schema([("id", pa.int64()), ("sha", pa.string()), ("row", pa.int64()), ("piece", pa.int64())])
PIECES = pa.schema([("piece", pa.int64()), ("branch", pa.int64()), ("text", pa.binary()), ("owner", pa.int64()),
                    ("owner_row", pa.int64()), ("rows", pa.int64())])
LOCAL = pa.schema([*MEMBERS, *list(PIECES)[1:]])
ROUND = pa.schema([*PIECES, ("terminal", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


class Node:
    """An edge label and what hangs below it; a terminal has a piece, a spilled node a branch."""

    __slots__ = ("label", "children", "piece", "owner", "rows", "branch")

    def __init__(self, label: bytes, children: dict[bytes, Node] | None = None):
        self.label, self.children = label, children
        self.piece = self.owner = self.branch = None
        self.rows = 0

    def take(self, piece: int, owner: tuple, rows: int, better) -> None:
        if self.piece is None:
            self.piece, self.owner = piece, owner
        elif better(owner, self.owner):
            self.owner = owner
        self.rows += rows


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Compressed radix trie over byte strings."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.root, self.bytes, self.texts = Node(b"", {}), 0, 0

    def find(self, text: bytes) -> Node:
        """The terminal of ``text``, made if there is none, or the spilled node on its way."""
        node, at = self.root, 0
        while node.children is not None:
            first = text[at:at + 1]
            child = node.children.get(first)
            if child is None:
                child = node.children[first] = Node(text[at:])
                self.bytes += len(child.label) + NODE_BYTES
                self.texts += 1
            elif not text.startswith(child.label, at):
                same = shared_prefix(child.label, text[at:at + len(child.label)])
                fork = Node(child.label[:same], {child.label[same:same + 1]: child})
                child.label = child.label[same:]
                child = node.children[first] = fork
            node, at = child, at + len(child.label)
        return node

    def terminals(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, Node]]:
        """Texts and terminals from ``node`` on; spilled nodes have none."""
        stack = [(node or self.root, prefix)]
        while stack:
            node, prefix = stack.pop()
            text = prefix + node.label
            if node.children is not None:
                stack.extend((child, text) for child in node.children.values())
            elif node.branch is None:
                yield text, node

    def heaviest(self) -> tuple[bytes, Node]:
        """Prefix and node of the heaviest subtree where the texts that are here first part."""
        node, prefix = self.root, b""
        while True:
            live = [(weight, child) for child in node.children.values() if (weight := weighed(child))[1]]
            prefix += node.label
            child = max(live, key=lambda w: w[0])[1]
            if len(live) > 1 or child.children is None:
                return prefix, child
            node = child

    def spill(self, node: Node, branch: int) -> None:
        """No text stays below ``node``: what arrives there from now on belongs to ``branch``.

        What was spilled before keeps its own branch, so the way to it stays.
        """
        heavy, texts = weighed(node)
        self.texts -= texts
        self.bytes -= heavy
        below, stack = [], [node]
        while stack:
            one = stack.pop()
            below.append(one)
            stack.extend((one.children or {}).values())
        ways = set()
        for one in reversed(below):  # children before their parents
            if one.branch is not None or any(id(c) in ways for c in (one.children or {}).values()):
                ways.add(id(one))
        stack = [node]
        while stack:
            one = stack.pop()
            if id(one) not in ways:
                one.children, one.branch = None, branch
            elif one.children is not None:
                self.bytes += len(one.label)
                stack.extend(one.children.values())


def weighed(node: Node) -> tuple[int, int]:
    """Bytes and texts from ``node`` on, without what was spilled."""
    total, texts, stack = 0, 0, [node]
    while stack:
        node = stack.pop()
        if node.children is not None:
            total += len(node.label)
            stack.extend(node.children.values())
        elif node.branch is None:
            total += len(node.label) + NODE_BYTES
            texts += 1
    return total, texts


class Forest:
    """Tries by branch (a length, or a subtree that an earlier round spilled), within a budget."""

    def __init__(self, budget: int):
        self.tries: dict[int, Trie] = {}
        self.budget, self.bytes = budget, 0

    def find(self, branch: int, text: bytes) -> Node:
        trie = self.tries.setdefault(branch, Trie())
        before = trie.bytes
        node = trie.find(text)
        self.bytes += trie.bytes - before
        return node

    def over(self) -> Iterator[tuple[int, Trie]]:
        """Past the budget: the heaviest trie, until half is free. A single text stays, however long."""
        while self.bytes > self.budget // 2:
            branch, trie = max(self.tries.items(), key=lambda t: (t[1].texts > 0, t[1].bytes))
            if sum(t.texts for t in self.tries.values()) <= 1:
                return
            self.bytes -= trie.bytes
            yield branch, trie
            self.bytes += trie.bytes

    def full(self) -> bool:
        return self.bytes > self.budget

    def terminals(self) -> Iterator[tuple[int, bytes, Node]]:
        for branch, trie in self.tries.items():
            for text, node in trie.terminals():
                yield branch, text, node


class Batches:
    """Rows gathered into record batches of bounded size."""

    def __init__(self, schema: pa.Schema, most_bytes: int = 8 << 20):
        self.schema, self.most, self.rows, self.bytes = schema, most_bytes, [], 0

    def add(self, **row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += len(row.get("text") or b"")
        if self.bytes >= self.most or len(self.rows) >= ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_pylist(self.rows, self.schema)
            self.rows, self.bytes = [], 0


def better_of(keep: str):
    """Whether owner ``a`` (id, row) goes before ``b``; an id before NULL, of equal ids the first row."""
    sign = {"smallest": -1, "largest": 1}[keep]

    def rank(owner: tuple) -> tuple:
        number, row = owner
        return (number is not None, sign * (number or 0), -row)
    return lambda a, b: rank(a) > rank(b)


def local_pieces(docs: DataFrame, keep: str, budget: int, doc_id: str, text: str) -> DataFrame:
    """Rows of ``MEMBERS`` and of ``PIECES`` in one table; the branch of a piece is its length."""
    content = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(doc_id).cast("long").alias("id"), content.cast("binary").alias("text"),
                       F.sha2(content, 256).alias("sha"))

    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        better, forest, out = better_of(keep), Forest(budget), Batches(LOCAL)
        number = TaskContext.get().partitionId() << 33

        def piece_of(branch: int, content: bytes, node: Node) -> Iterator[pa.RecordBatch]:
            owner, row = node.owner
            yield from out.add(piece=node.piece, branch=branch, text=content, owner=owner, owner_row=row, rows=node.rows)
        for batch in batches:
            for one, content, sha in zip(batch.column("id").to_pylist(), batch.column("text"),
                                         batch.column("sha").to_pylist()):
                content = content.as_py()
                node = forest.find(len(content), content)
                node.take(number, (one, number), 1, better)
                yield from out.add(id=one, sha=sha, row=number, piece=node.piece)
                number += 1
                for branch, trie in forest.over() if forest.full() else ():
                    # a later copy of these texts begins a piece of its own
                    for whole, leaf in trie.terminals():
                        yield from piece_of(branch, whole, leaf)
                    trie.clear()
        for branch, whole, leaf in forest.terminals():
            yield from piece_of(branch, whole, leaf)
        yield from out.flush()
    return read.mapInArrow(insert, _ddl(LOCAL))


def joined(pieces: DataFrame, keep: str, budget: int) -> DataFrame:
    """One round over pieces dealt by branch: rows of ``ROUND`` of three kinds.

    ``piece, terminal``: where a piece ended. ``terminal`` with an owner: a terminal whose rows
    are all in. ``piece`` with a text: a spilled one, for the next round.
    """
    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        better, forest, out = better_of(keep), Forest(budget), Batches(ROUND)
        next_branch = TaskContext.get().partitionId() << 33
        for batch in batches:
            columns = [batch.column(n) for n in ("piece", "branch", "text", "owner", "owner_row", "rows")]
            for values in zip(*columns):
                piece, branch, content, owner, owner_row, rows = (v.as_py() for v in values)
                node = forest.find(branch, content)
                if node.branch is not None:
                    yield from out.add(piece=piece, branch=node.branch, text=content, owner=owner,
                                       owner_row=owner_row, rows=rows)
                    continue
                node.take(piece, (owner, owner_row), rows, better)
                if node.piece != piece:
                    yield from out.add(piece=piece, terminal=node.piece)
                for _, trie in forest.over() if forest.full() else ():
                    prefix, top = trie.heaviest()
                    for whole, leaf in trie.terminals(top, prefix):
                        yield from out.add(piece=leaf.piece, branch=next_branch, text=whole, owner=leaf.owner[0],
                                           owner_row=leaf.owner[1], rows=leaf.rows)
                    trie.spill(top, next_branch)
                    next_branch += 1
        for _, _, leaf in forest.terminals():
            yield from out.add(terminal=leaf.piece, owner=leaf.owner[0], owner_row=leaf.owner[1], rows=leaf.rows)
        yield from out.flush()
    return pieces.select(*PIECES.names).mapInArrow(insert, _ddl(ROUND))


def owners(docs: DataFrame, keep: str = "smallest", budget: int = 64 << 20, doc_id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256`` for each row of ``docs``.

    Texts are equal when all their bytes are; NULL counts as the empty text. Of equal texts the
    row with the smallest (``keep="largest"``: the largest) id stays, exactly one also where
    rows repeat that id. NULL ids come after all others; ``keep_id`` is NULL where a text has
    no other. ``budget`` bounds the bytes of the tries of a task. Other columns are not read.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    local = written(local_pieces(docs, keep, budget, doc_id, text), scratch(spark, "trie-local"))
    # the first deal is by content, later ones by subtree
    pieces, deal, ends = local.filter("text is not null"), [F.col("branch"), F.xxhash64("text")], None
    ended = pieces.select("piece", F.col("piece").alias("terminal"))
    while True:
        table = written(joined(pieces.repartition(*deal), keep, budget), scratch(spark, "trie-round"))
        moved = table.filter("piece is not null and terminal is not null").select(
            F.col("piece").alias("terminal"), F.col("terminal").alias("onward"))
        ended = ended.join(moved, "terminal", "left").select("piece", F.coalesce("onward", "terminal").alias("terminal"))
        done = table.filter("piece is null").select("terminal", "owner", "owner_row", "rows")
        ends = done if ends is None else ends.unionByName(done)
        pieces, deal = table.filter("text is not null"), [F.col("branch")]
        if not pieces.limit(1).count():
            break
        ended = written(ended, scratch(spark, "trie-ended"))
    of_piece = ended.join(ends, "terminal").drop("terminal")
    of_piece = written(of_piece, scratch(spark, "trie-owners"))
    members = local.filter("text is null").select("id", "sha", "row", "piece")
    return members.join(of_piece, "piece").select(
        "id", F.col("owner").alias("keep_id"), F.col("rows").alias("group_size"),
        (F.col("row") == F.col("owner_row")).alias("kept"), F.col("sha").alias("text_sha256"))
