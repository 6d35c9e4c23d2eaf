"""WARC archives: writing, normalising monolithic gzip, and reading by an offset index.

A monolithic archive is one gzip stream over all records, so no record can be read without
inflating everything before it. The normaliser inflates such a stream once, in blocks,
writes every record as a gzip member of its own and, beside the archive, an index with one
line per record: offset, length, record id, type, refers-to. Readers then seek. Archives that already
have several members, or a mix, are read as well; a truncated one is an error.

A task writes files under names of its own attempt and returns their names; only what the
committed table of files names is read further, so tasks can be repeated.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import opened_folder, scratch, spread, written

BLOCK = 1 << 20
ARCHIVES = "archive string, n_records long, n_bytes long"
INDEXED = "archive string, index string, n_records long, n_bytes long"
RECORDS = ("record_id string, record_type string, refers_to string, target_uri string, "
           "payload_bytes long, payload_digest string, verified boolean, offset long, archive string")
PAYLOADS = RECORDS + ", payload binary"


class Member:
    """Writes gzip members to a file, with the counts an index needs."""

    def __init__(self, out: BinaryIO, level: int):
        self.out, self.level, self.at, self.written = out, level, 0, 0
        self.begin()

    def begin(self) -> None:
        self.at, self.gzip = self.written, zlib.compressobj(self.level, zlib.DEFLATED, 31)

    def write(self, content: bytes) -> None:
        self._put(self.gzip.compress(content))

    def end(self) -> int:
        """Close the member; its length."""
        self._put(self.gzip.flush())
        return self.written - self.at

    def _put(self, content: bytes) -> None:
        if content:
            self.out.write(content)
            self.written += len(content)


class Inflated:
    """Plain bytes of a gzip file of any number of members, read in blocks."""

    def __init__(self, source: BinaryIO, name: str):
        self.source, self.name, self.ready, self.at = source, name, b"", 0
        self.gzip, self.rest, self.over = None, b"", False

    def _more(self) -> bool:
        """Inflate one more block; False at the end of the file."""
        while not self.over:
            block = self.rest or self.source.read(BLOCK)
            self.rest = b""
            if not block:
                self.over = True
                if self.gzip is not None:
                    raise ValueError(f"{self.name} is truncated")
                return False
            if self.gzip is None:
                self.gzip = zlib.decompressobj(31)
            plain = self.gzip.decompress(block, BLOCK)
            if self.gzip.eof:
                self.rest, self.gzip = self.gzip.unused_data, None
            else:
                self.rest = self.gzip.unconsumed_tail
            if plain:
                self.ready, self.at = self.ready[self.at:] + plain, 0
                return True
        return False

    def until(self, end: bytes) -> bytes | None:
        """Up to and with ``end``; None at the end of the file."""
        looked = self.at
        while (found := self.ready.find(end, looked)) < 0:
            known = len(self.ready) - self.at
            if not self._more():
                if self.ready[self.at:].strip():
                    raise ValueError(f"{self.name} is truncated")
                return None
            looked = max(0, known - len(end))
        start, self.at = self.at, found + len(end)
        return self.ready[start:self.at]

    def blocks(self, size: int) -> Iterator[bytes]:
        while size:
            if self.at == len(self.ready) and not self._more():
                raise ValueError(f"{self.name} is truncated")
            piece = self.ready[self.at:self.at + size]
            self.at += len(piece)
            size -= len(piece)
            yield piece


def _headers(block: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in block.decode("utf-8").split("\r\n")[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def _body_at(head: bytes, kind: str) -> int:
    """Where the payload begins in a record block: after the HTTP headers, if there are any."""
    return head.find(b"\r\n\r\n") + 4 if kind == "application/http" and b"\r\n\r\n" in head else 0


def digest_text(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_head(kind: str, record_id: str, refers_to: str | None, uri: str | None, date: str,
                digest: str, payload: int, body: int) -> bytes:
    """WARC headers, and the HTTP headers with which the block begins."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {payload}\r\n\r\n").encode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date),
              ("WARC-Payload-Digest", f"sha1:{digest}")]
    if uri:
        safe = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)
        fields.append(("WARC-Target-URI", safe))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{refers_to}>"),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + body))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http


def planned(pages: DataFrame, least_bytes: int = 0, page_id: str = "page_id", url: str = "url",
            html: str = "html") -> DataFrame:
    """``id, uri, payload, digest, first``: what record each page becomes.

    ``first`` is the smallest page id among the pages of an equal payload of ``least_bytes``
    at least; a page of another id revisits it. Pages that repeat with the same id are all
    responses; among pages without an id only those whose payload no page with an id has.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("uri"), payload.alias("payload")) \
        .withColumn("digest", F.sha1("payload"))
    shared = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # written first: Spark then knows its size, and need not move the pages when it is small
    shared = written(shared, scratch(pages.sparkSession, "warc-shared"))
    return rows.join(shared, "digest", "left")


def write_monolithic(plan: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z", level: int = 6,
                     archive_bytes: int = 1 << 30) -> DataFrame:
    """Write the planned records, each archive as one gzip stream of about ``archive_bytes`` plain bytes."""
    def name(page: Column) -> Column:
        return F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("")))
    repeats = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    rows = plan.select(
        name(F.col("id")).alias("record_id"), F.when(repeats, name(F.col("first"))).alias("refers_to"),
        F.col("uri").cast("string").alias("uri"), "digest", F.octet_length("payload").alias("size"),
        F.when(~repeats, F.col("payload")).alias("payload"))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = opened_folder(folder)
        files.create_dir(path, recursive=True)
        out, member, plain, records = None, None, 0, 0

        def closed() -> pa.RecordBatch:
            member.end()
            out.close()
            return pa.RecordBatch.from_pydict(
                {"archive": [archive], "n_records": [records], "n_bytes": [member.written]})
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    archive = f"{path}/mono-{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(archive, compression=None)
                    member, plain, records = Member(out, level), 0, 0
                body = row["payload"] or b""
                member.write(record_head(
                    "response" if row["refers_to"] is None else "revisit", row["record_id"], row["refers_to"],
                    row["uri"], date, digest_text(row["digest"]), row["size"], len(body)))
                member.write(body)
                member.write(b"\r\n\r\n")
                plain, records = plain + len(body), records + 1
                if plain >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()
    return written(rows.mapInArrow(archives, ARCHIVES), scratch(plan.sparkSession, "warc-mono"))


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite each archive with one member per record and an index beside it."""
    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = opened_folder(folder)
        files.create_dir(path, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                stem = f"{path}/records-{uuid.uuid4().hex}"
                records = 0
                with files.open_input_stream(row["archive"], compression=None) as source, \
                        files.open_output_stream(f"{stem}.warc.gz", compression=None) as out, \
                        files.open_output_stream(f"{stem}.idx") as index:
                    plain, member = Inflated(source, row["archive"]), Member(out, level)
                    while (head := plain.until(b"\r\n\r\n")) is not None:
                        head = head.lstrip(b"\r\n")
                        fields = _headers(head)
                        member.begin()
                        member.write(head)
                        for block in plain.blocks(int(fields["content-length"])):
                            member.write(block)
                        for _ in plain.blocks(4):
                            pass
                        member.write(b"\r\n\r\n")
                        length = member.end()
                        index.write((json.dumps([
                            member.at, length, fields.get("warc-record-id"), fields.get("warc-type"),
                            fields.get("warc-refers-to")]) + "\n").encode())
                        records += 1
                yield pa.RecordBatch.from_pydict({
                    "archive": [f"{stem}.warc.gz"], "index": [f"{stem}.idx"],
                    "n_records": [records], "n_bytes": [member.written]})
    dealt = spread(archives, archives.count())
    return written(dealt.mapInArrow(rewritten, INDEXED), scratch(archives.sparkSession, "warc-records"))


def _read_member(source, offset: int, length: int, name: str) -> tuple[dict, dict, bytes]:
    """WARC headers, HTTP headers and payload of the record at ``offset``."""
    source.seek(offset)
    plain = zlib.decompress(source.read(length), 31)
    end = plain.index(b"\r\n\r\n") + 4
    fields = _headers(plain[:end])
    block = plain[end:end + int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError(f"{name} has a short record at {offset}")
    body = _body_at(block, fields.get("content-type", "").split(";")[0].strip())
    return fields, _headers(block[:body]) if body else {}, block[body:]


def records(indexed: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record, by the indexes: a seek and one member for each.

    Bytes and digest are those of the full payload: counted for what holds it, as declared
    for a revisit. ``verified`` says whether the content has the declared digest (NULL for a
    revisit). One record at a time is in memory.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = opened_folder(folder)
        names = [c.split()[0] for c in (PAYLOADS if with_payload else RECORDS).split(", ")]
        schema = pa.schema([(n, {"payload_bytes": pa.int64(), "offset": pa.int64(), "verified": pa.bool_(),
                                 "payload": pa.binary()}.get(n, pa.string())) for n in names])
        for batch in batches:
            for row in batch.to_pylist():
                found = []
                with files.open_input_stream(row["index"]) as side:
                    lines = side.read().decode().splitlines()
                with files.open_input_file(row["archive"]) as source:
                    for line in lines:
                        offset, length, *_ = json.loads(line)
                        fields, http, payload = _read_member(source, offset, length, row["archive"])
                        declared = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        whole = fields.get("warc-type") != "revisit"
                        own = base64.b32encode(hashlib.sha1(payload).digest()).decode() if whole else None
                        found.append((
                            fields["warc-record-id"].strip("<>"), fields.get("warc-type"),
                            fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
                            fields.get("warc-target-uri"),
                            len(payload) if whole else int(http.get("content-length", 0)),
                            own if whole else declared,
                            own == declared if whole and declared else None, offset, row["archive"],
                            *([payload] if with_payload else [])))
                        if len(found) >= (64 if with_payload else 4096):
                            yield pa.RecordBatch.from_pylist([dict(zip(names, f)) for f in found], schema)
                            found = []
                if found:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, f)) for f in found], schema)
    return spread(indexed, indexed.count()).mapInArrow(read, PAYLOADS if with_payload else RECORDS)


def page_of(record_id: Column) -> Column:
    """The page id in a record id of ``write_monolithic``; NULL where the page had none."""
    return F.nullif(F.regexp_extract(record_id, "^urn:page:(.*)$", 1), F.lit("")).cast("long")
