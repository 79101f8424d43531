"""Operator 6, WARC archives: write records, normalise monolithic gzip files, read back by sidecar index.

A task writes its records as one gzip stream over the whole file, as many archives in the wild are. The normaliser
inflates such a stream once, front to back, in blocks, finds each record by its header's Content-Length, writes every
record as its own gzip member and an index line (offset, length, record id) to a sidecar. Reading needs the index and
the members alone. Files go to a shared folder under a name of their own and appear there by a rename at the end, so a
task that is run again after a loss leaves no half-written archive, and the manifest names the files that count.

Defined cases: a null payload is empty; equal payloads make one response (the largest id) and revisits to it; rows
that repeat an id are repeated records; a page without an id is a response with its payload; an empty table writes no archive; long
payloads pass through in blocks; columns other than page_id, url and html are left aside.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, slices

BLOCK, CRLF = 1 << 20, b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record: a response with the payload, or a revisit with the response's header block alone."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    body = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').translate({10: '%0A', 13: '%0D'})}", f"WARC-Payload-Digest: sha1:{digest32(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + CRLF + CRLF


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def inflate(source: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in blocks."""
    engine = zlib.decompressobj(31)
    while data := source.read(BLOCK):
        while data:
            if out := engine.decompress(data, BLOCK):
                yield out
            data = engine.unconsumed_tail
            if engine.eof:
                data, engine = engine.unused_data, zlib.decompressobj(31)
    if out := engine.flush():
        yield out


def split_records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream; the header's Content-Length says where each ends."""
    held = bytearray()

    def fill(size: int) -> bool:
        while len(held) < size:
            if (block := next(blocks, None)) is None:
                return False
            held.extend(block)
        return True

    while fill(1):
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                raise ValueError("the archive ends inside a record's header")
        size = end + 4 + int(parse_head(bytes(held[:end]))["content-length"]) + 4
        if not fill(size):
            raise ValueError("the archive ends inside a record")
        yield bytes(held[:size])
        del held[:size]


def member(data: bytes, level: int = 6) -> bytes:
    engine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return engine.compress(data) + engine.flush()


def normalise(source: BinaryIO, archive: BinaryIO, index: BinaryIO, level: int = 6) -> int:
    """Rewrite a gzip file record by record; the number of records. index: a JSON line for each."""
    at = n = 0
    for data in split_records(inflate(source)):
        packed = member(data, level)
        archive.write(packed)
        head = parse_head(data[: data.find(b"\r\n\r\n")])
        index.write(json.dumps({"offset": at, "length": len(packed), "id": head["warc-record-id"]}).encode() + b"\n")
        at += len(packed)
        n += 1
    return n


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def monolith(rows: Iterator[tuple]) -> Iterator[bytes]:
    """One gzip stream over the records of (page_id, url, html, refers_to) rows, in pieces as it is compressed."""
    engine = zlib.compressobj(1, zlib.DEFLATED, 31)
    for page, url, html, refers in rows:
        if piece := engine.compress(record("response" if refers is None else "revisit", page, url, (html or "").encode(), refers)):
            yield piece
    yield engine.flush()


class Stream:
    """Pieces of bytes read like a file, so that a task's stream is never held whole, in memory or in a local file."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held = pieces, b""

    def read(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n and (piece := next(self.pieces, None)) is not None:
            parts.append(piece)
            have += len(piece)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]


def write_archives(pages: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Write page_id, url, html, refers_to (null: a response) as archives under folder; the manifest: archive, index, n_records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p, u, h, r) for b in slices(batches, "html") for p, u, h, r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True))
        first = next(rows, None)
        if first is None:
            return
        store, base = _open_fs(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}"
        whole = Stream(monolith(itertools.chain([first], rows)))
        with store.open_output_stream(f"{name}.part") as archive, store.open_output_stream(f"{name}.idx.part") as index:
            n = normalise(whole, archive, index, level)
        for end in ("", ".idx"):
            store.move(f"{name}{end}.part", f"{name}.warc.gz{end}")
        root = f"{folder}/{name.rsplit('/', 1)[1]}.warc.gz"
        yield pa.RecordBatch.from_arrays([pa.array([root]), pa.array([f"{root}.idx"]), pa.array([n], pa.int64())], names=["archive", "index", "n_records"])

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, index string, n_records long")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the manifest's archives, read member by member by the sidecar: page_id, url, payload (null for
    revisits), payload_bytes and payload_digest (of the full payload), record_type, refers_to."""
    columns: list[tuple[str, pa.DataType]] = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]

    def number(urn: str | None) -> int | None:
        digits = (urn or ":").strip("<>").rsplit(":", 1)[1]
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist(), strict=True):
                store, path = _open_fs(archive)
                with store.open_input_stream(_open_fs(index)[1]) as f:
                    entries = [json.loads(line) for line in f.read().splitlines()]
                with store.open_input_file(path) as f:
                    rows, held = [], 0
                    for entry in entries:
                        f.seek(entry["offset"])
                        data = zlib.decompress(f.read(entry["length"]), 31)
                        head_end = data.find(b"\r\n\r\n")
                        head, body = parse_head(data[:head_end]), data[head_end + 4 : -4]
                        http_end = body.find(b"\r\n\r\n")
                        http, payload = parse_head(body[:http_end]), body[http_end + 4 :]
                        revisit = head["warc-type"] == "revisit"
                        said = head["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and (digest32(payload) != said or len(payload) != int(http["content-length"])):
                            raise ValueError(f"{archive}: the payload at {entry['offset']} is damaged")
                        rows.append((number(head["warc-record-id"]), head["warc-target-uri"], None if revisit else payload, int(http["content-length"]), said, head["warc-type"], number(head.get("warc-refers-to"))))
                        held += len(data)
                        if held > 8 << 20:
                            yield _batch(rows, columns)
                            rows, held = [], 0
                    yield _batch(rows, columns)

    return manifest.select("archive", "index").mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _batch(rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(columns)], names=[n for n, _ in columns])


def with_revisits(pages: DataFrame, min_bytes: int = 0, broadcast_rows: int = 1 << 20) -> DataFrame:
    """page_id, url, html and refers_to: for payloads of at least min_bytes found more than once, the largest page_id.

    Payloads are counted by digest with map-side sums, so a payload that a third of the pages share is one row a task;
    only digests found twice are joined back, broadcast while they are few and else by a shuffle that may split them."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.sha1(payload).alias("sha1"))
    copies = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("sha1"), F.length(payload).alias("size")).filter(F.col("size") >= min_bytes)
    copies = materialize(copies.groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").select("sha1", "keeper"), "copies")
    few = copies.count() <= broadcast_rows
    joined = keyed.join(F.broadcast(copies) if few else copies, "sha1", "left")
    return joined.select("page_id", "url", "html", F.when(F.col("keeper") != F.col("page_id"), F.col("keeper")).alias("refers_to"))

