"""Token ids of documents in compressed shards with one shared zstandard dictionary.

Layout of a folder::

    dictionary-<sha256>     the dictionary, trained on id arrays of a bounded sample
    <shard>.tok             one zstandard frame per document, each on its own
    <shard>.idx             Arrow file: doc_id, offset, length, n_ids of each frame; its
                            metadata holds the dictionary's hash and the width of an id

Documents are in ascending id order over all shards, so ``start`` (ids of all documents
before) is a sum within the shard plus a sum over earlier shards. A document is read with
one seek, and reading refuses a dictionary of another hash.

Texts are range-partitioned by id; each task writes its shards under a name of its own
attempt, and only files named in the committed manifest count, so a task can be repeated.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import opened_folder, scratch, spread, written

MANIFEST = "part int, seq int, data string, index string, n_docs long, n_ids long, dictionary string"
CACHE_PIECES = 500_000
CACHE_CHARS = 64  # longer pieces are not remembered
CHUNK = 1024
# Texts are cut where a byte-level pre-tokeniser always cuts: before a run of spaces and line
# feeds, before the last one of a run that a word follows, after a line feed, and between letters,
# ASCII digits and ASCII marks. An apostrophe stays with what follows; a character that is neither
# of these, or is a letter of three bytes, stays with both sides. Only texts whose white space is
# spaces and line feeds are cut.
OTHER, LETTER, DIGIT, MARK, QUOTE, SPACE, LINE = range(7)
KINDS = bytes(OTHER if c > 127 else LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit()
              else {"'": QUOTE, " ": SPACE, "\n": LINE}.get(chr(c), MARK) for c in range(256))
# of the kinds of two neighbours, as 8 * first + second: does the second begin a piece?
BORDERS = bytes(
    a < SPACE <= b or a == LINE and b < SPACE
    or b in {LETTER: (DIGIT, MARK, QUOTE), DIGIT: (LETTER, MARK, QUOTE), MARK: (LETTER, DIGIT)}.get(a, ())
    for a, b in (divmod(pair, 8) for pair in range(256)))
# letters of Unicode 3.2 that still are: all engines agree on them
LETTERS = frozenset(c for c in map(chr, range(0xD800)) if c.isalpha() and unicodedata.ucd_3_2_0.category(c)[0] == "L")
LETTER_BYTES = np.zeros((256, 256), dtype=bool)  # the two bytes of a letter
for _lead, _next in (c.encode() for c in LETTERS if 0x80 <= ord(c) < 0x800):
    LETTER_BYTES[_lead, _next] = True
# all other characters that some engine takes for white space
OTHER_SPACE = tuple("\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u3000\ufeff") + tuple(
    map(chr, range(0x2000, 0x200C)))


class ByteChars(dict):
    """Of each character, those that a byte-level pre-tokeniser writes for its bytes."""

    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = {c: chr(256 + i) for i, c in enumerate(sorted({*range(256)} - plain))}

    def __missing__(self, char: str) -> str:
        self[char] = found = "".join(self.rest.get(c) or chr(c) for c in char.encode())
        return found


BYTE_CHARS = ByteChars()


def simple(piece: str) -> bool:
    """Is the piece one that the pre-tokeniser hands on in one? Letters or digits, perhaps after a space."""
    word = piece[1:] if piece[0] == " " else piece
    if word.isascii():
        return word.isalpha() or word.isdigit()
    return LETTERS.issuperset(word)


class Encoder:
    """Whole texts to id bytes, with the pieces of a text remembered across texts."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.cuts = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space") and not spec.get("normalizer")
            and not spec.get("truncation") and not spec.get("padding"))
        # texts with any of these are encoded whole
        added = [t["content"] for t in spec.get("added_tokens", ())]
        self.whole = [*OTHER_SPACE, *added]
        self.in_words = [t for t in added if all(c in LETTERS or c.isdigit() or c == " " for c in t)]
        self.whole_pattern = re.compile("|".join(map(re.escape, self.whole)))
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.end = self.packed([end])
        self.known: dict[str, bytes] = {}
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of new pieces.

        Simple ones are what the pre-tokeniser would hand on, so they go to the tokenizer's
        model at once. Of the others, one text is encoded and cut at its line feeds.
        """
        found: dict[str, bytes] = {}
        words = []
        merge, chars = self.tokenizer.model.tokenize, BYTE_CHARS.__getitem__
        for p in pieces:
            if self.cuts and simple(p) and not any(t in p for t in self.in_words):
                found[p] = self.packed([t.id for t in merge("".join(map(chars, p)))])
            elif self.cuts and "\n" not in p and not p.isspace() and not self.whole_pattern.search(p):
                words.append(p)
            else:
                found[p] = self.packed(self.tokenizer.encode(p, add_special_tokens=False).ids)
        parts: list[bytes] = []
        if words and self.line is not None:
            [encoding] = self.tokenizer.encode_batch_fast(["\n".join(words)], add_special_tokens=False)
            ids = np.array(encoding.ids, dtype=f"<u{self.width}")
            flat, cuts = ids.tobytes(), (np.flatnonzero(ids == self.line) * self.width).tolist()
            parts = [flat[a:b] for a, b in zip(
                [0, *(c + self.width for c in cuts)], [*cuts, len(flat)])]
        if len(parts) != len(words):
            parts = [self.packed(e.ids) for e in self.tokenizer.encode_batch(
                words, add_special_tokens=False)]
        found.update(zip(words, parts))
        return found

    def _starts(self, texts: pa.Array, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Places in ``data`` where pieces begin; the texts that are not empty begin and end there."""
        begins, ends = bounds[:-1], bounds[1:]
        filled = ends > begins
        start = np.zeros(len(data), dtype=bool)
        if self.cuts:
            kinds = np.frombuffer(bytearray(data.tobytes().translate(KINDS)), dtype=np.uint8)
            lead = np.flatnonzero(data[:-1] >= 0xC2)
            lead = lead[LETTER_BYTES[data[lead], data[lead + 1]]]
            kinds[lead] = kinds[lead + 1] = LETTER
            start[1:] = np.frombuffer(((kinds[:-1] << 3) | kinds[1:]).tobytes().translate(BORDERS), dtype=bool)
            space = kinds >= SPACE
            last = space[1:-1] & space[:-2] & ~space[2:]
            at = ends[filled] - 2
            last[at[(at >= 0) & (at < len(last))]] = False
            start[1:-1] |= last
            for row, text in enumerate(texts.to_pylist()):
                if any(s in text for s in self.whole):
                    start[begins[row]:ends[row]] = False
        start[begins[filled]] = True
        return np.flatnonzero(start)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian ids of each text, with the end id; NULL is the empty text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, content = texts.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(content or b"", dtype=np.uint8)[bounds[0]:bounds[-1]]
        bounds = bounds - bounds[0]
        if not len(data):
            return [self.end] * len(texts)
        starts = self._starts(texts, data, bounds)
        pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [
            None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known
        ids = list(map(known.get, distinct))
        new = self._learn([p for p, i in zip(distinct, ids) if i is None])
        if new:
            ids = [new[p] if i is None else i for p, i in zip(distinct, ids)]
        if len(known) <= CACHE_PIECES:  # when full, common pieces are in it
            known.update((p, i) for p, i in new.items() if len(p) <= CACHE_CHARS)
        # the ids of each piece in place of it
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        flat, codes = np.frombuffer(b"".join(ids), dtype=f"<u{self.width}"), pieces.indices.to_numpy()
        counts = lengths[codes]
        upto = np.append(0, np.cumsum(counts))
        shift = (np.cumsum(lengths) - lengths)[codes] - upto[:-1]
        packed = flat[np.repeat(shift, counts) + np.arange(upto[-1])].tobytes()
        cuts = (upto[np.searchsorted(starts, bounds)] * self.width).tolist()
        return [packed[a:b] + self.end for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def encoder(path: str, end: int) -> Encoder:
    """One per worker process and tokenizer."""
    return Encoder(path, end)


def train_dictionary(docs: DataFrame, tokenizer: str, end: int = 0, sample_rows: int = 1000,
                     size: int = 64 << 10, doc_id: str = "doc_id", text: str = "text") -> bytes:
    """A dictionary from the id arrays of ``sample_rows`` documents, those of the smallest id hashes.

    The bound keeps what the driver gets to some megabytes. Where the sample is too small or
    too uniform to train on, the dictionary is the sample's first bytes (empty for an empty
    table), which zstandard takes as raw content.
    """
    ids = docs.select(F.col(doc_id).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(
        F.broadcast(ids), "id").select("text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                ids = encoder(tokenizer, end).encode(batch.column("text").slice(at, CHUNK))
                yield pa.RecordBatch.from_pydict({"ids": pa.array(ids, pa.binary())})
    arrays = sorted(bytes(r["ids"]) for r in sample.mapInArrow(encoded, "ids binary").limit(sample_rows).collect())
    try:
        return zstandard.train_dictionary(size, arrays, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(arrays)[:size]


def _named(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


def _zstd(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = 0, level: int = 3,
          shard_bytes: int = 256 << 20, sample_rows: int = 1000, dictionary_bytes: int = 64 << 10,
          doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents as shards below ``folder``; gives the manifest, one row per shard.

    Ascending id order, NULL ids first; rows of one id are in the order of their text hash, so
    repeated rows change nothing. NULL texts are empty: their only id is ``end``. Other
    columns are not read. An empty table writes the dictionary and an empty manifest.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer, end, sample_rows, dictionary_bytes, doc_id, text)
    name = _named(dictionary)
    store, path = opened_folder(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/dictionary-{name}") as out:
        out.write(dictionary)

    ordered = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    ordered = ordered.withColumn("rev", F.xxhash64("text")).repartitionByRange("id", "rev") \
        .sortWithinPartitions("id", "rev").select("id", "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(tokenizer, end)
        options = {"dict_data": _zstd(dictionary)} if dictionary else {}
        compress = zstandard.ZstdCompressor(level=level, write_content_size=True, **options).compress
        files, path = opened_folder(folder)
        seq, out, rows = 0, None, []

        def closed() -> pa.RecordBatch:
            nonlocal seq, out, rows
            out.close()
            ids, offsets, lengths, counts = zip(*rows)
            index = pa.table({
                "doc_id": pa.array(ids, pa.int64()), "offset": pa.array(offsets, pa.int64()),
                "length": pa.array(lengths, pa.int64()), "n_ids": pa.array(counts, pa.int64()),
            }).replace_schema_metadata({"dictionary": name, "width": str(encode.width)})
            with files.open_output_stream(f"{stem}.idx") as side, pa.ipc.new_file(side, index.schema) as writer:
                writer.write_table(index)
            done = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "data": [f"{stem}.tok"], "index": [f"{stem}.idx"], "n_docs": [len(rows)],
                "n_ids": [sum(counts)], "dictionary": [name]})
            seq, out, rows = seq + 1, None, []
            return done

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(at, CHUNK)
                encoded = encode.encode(piece.column("text"))
                for one, ids in zip(piece.column("id").to_pylist(), encoded):
                    if out is None:
                        stem, offset = f"{path}/shard-{part:06d}-{seq:04d}-{uuid.uuid4().hex}", 0
                        out = files.open_output_stream(f"{stem}.tok")
                    frame = compress(ids)
                    out.write(frame)
                    rows.append((one, offset, len(frame), len(ids) // encode.width))
                    offset += len(frame)
                    if offset >= shard_bytes:
                        yield closed()
        if out is not None:
            yield closed()
    return written(ordered.mapInArrow(shards, MANIFEST), scratch(spark, "token-manifest"))


@lru_cache(maxsize=4)
def _dictionary(folder: str, name: str) -> bytes:
    files, path = opened_folder(folder)
    with files.open_input_file(f"{path}/dictionary-{name}") as source:
        content = source.read()
    if _named(content) != name:
        raise ValueError(f"the dictionary in {folder} is not the one the shards were written with")
    return content


def _index(files, path: str) -> tuple[pa.Table, str, int]:
    with files.open_input_file(path) as source:
        index = pa.ipc.open_file(source).read_all()
    meta = index.schema.metadata
    return index, meta[b"dictionary"].decode(), int(meta[b"width"])


def read_document(folder: str, data: str, index: str, doc_id: int) -> list[np.ndarray]:
    """Id arrays of a document in one shard (one per repeated row), by its offsets alone."""
    files, _ = opened_folder(folder)
    rows, name, width = _index(files, index)
    expand = zstandard.ZstdDecompressor(**_options(folder, name)).decompress
    found = []
    with files.open_input_file(data) as source:
        for row in rows.filter(pa.compute.equal(rows["doc_id"], doc_id)).to_pylist():
            source.seek(row["offset"])
            found.append(np.frombuffer(expand(source.read(row["length"])), dtype=f"<u{width}"))
    return found


def _options(folder: str, name: str) -> dict:
    content = _dictionary(folder, name)
    return {"dict_data": _zstd(content)} if content else {}


def read(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_ids, ids_crc32`` of every document in the shards, and its ``ids``.

    ``start`` counts the ids of all documents before it. Ids are little-endian 32-bit
    integers; the crc32 is over them, unsigned. The window over the manifest sees one row
    per shard.
    """
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).cast("long"))
    shards = manifest.count()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = opened_folder(folder)
        for batch in batches:
            for shard in batch.to_pylist():
                index, name, width = _index(files, shard["index"])
                expand = zstandard.ZstdDecompressor(**_options(folder, name)).decompress
                start = shard["before"]
                with files.open_input_stream(shard["data"]) as source:
                    for part in index.to_batches(max_chunksize=CHUNK):
                        rows = part.to_pydict()
                        ids, starts, sums = [], [], []
                        for length, count in zip(rows["length"], rows["n_ids"]):
                            content = np.frombuffer(expand(source.read(length)), dtype=f"<u{width}").astype("<u4")
                            if len(content) != count:
                                raise ValueError(f"{shard['data']} does not hold what its index says")
                            sums.append(zlib.crc32(content))
                            starts.append(start)
                            start += count
                            if with_ids:
                                ids.append(content.tobytes())
                        columns = {
                            "doc_id": pa.array(rows["doc_id"], pa.int64()), "start": pa.array(starts, pa.int64()),
                            "n_ids": pa.array(rows["n_ids"], pa.int64()), "ids_crc32": pa.array(sums, pa.int64())}
                        yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(ids, pa.binary())} if with_ids else {}))
    return spread(placed, shards).mapInArrow(
        documents, "doc_id long, start long, n_ids long, ids_crc32 long" + ", ids binary" * with_ids)


def store_folder(spark: SparkSession) -> str:
    return scratch(spark, "token-store")
