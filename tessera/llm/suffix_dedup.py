"""Operator 7, suffix-array dedup: later copies of long byte strings go, the first copy stays.

A byte goes if a `length`-byte string that covers it also starts earlier (smaller id, or same row and earlier start).

Windows of `length` bytes are dealt out by content: of the ANCHOR-byte strings inside a window the one with the least
hash (leftmost of equals) is its anchor. Equal windows have equal anchors, so windows need comparing only where anchors
are equal. Neighbouring windows that share one occurrence of an anchor form a segment: the bytes from the first of them
to the end of the last.

1. One pass hashes anchors and whole segments. A segment met twice in a task is a copy as a whole; the rest, one row
   for each distinct segment and task, shuffles by anchor as (anchor, segment hash, id, start, size) in packed blocks.
2. For each anchor: equal segments are copies of the first; if several distinct segments share an anchor, the first
   of each is a variant whose bytes have to be compared. Anchors with one segment are done.
3. The bytes of variants are cut from their texts and dealt by anchor. For each dealt part the suffixes at window starts
   are sorted by their first `length` bytes, ties by place; previous and next smaller positions in this order give the
   longest previous factor of each start, as far as `length`; where it reaches `length` the window is a copy.
4. Copied spans are joined to the texts by id and cut out.

Hot content: copies inside a task end there, so a passage in a third of all rows is one row a task. Segments and
anchors are compared by 64-bit hashes of at least ANCHOR bytes each, together 128 bits.

Defined cases: null is empty; texts under `length` bytes never lose a byte; copies inside one row count; rows that
repeat an id with its text count as one row and lose the same spans; a row without an id stays whole and takes no
part; a long text is cut into segments like any other (places are 32-bit: texts have less than 2 GB, as Arrow's strings
have); only id and text enter the work, so further columns never clash; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, slices

ANCHOR = 40
BASE = np.uint64(0x9E3779B97F4A7C15)
SEGMENT = np.dtype([("anchor", "<u8"), ("hash", "<u8"), ("id", "<i8"), ("start", "<i4"), ("size", "<i2")])
FEW = 1 << 20
PART_BYTES = 32 << 20
SPAN = np.dtype([("start", "<i8"), ("size", "<i8")])
WANTED = np.dtype([("anchor", "<u8"), ("start", "<i8"), ("size", "<i8")])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size`-byte string, by doubling: h(2n at i) = h(n at i) + h(n at i + n) BASE**n."""
    result, done, power = None, 0, _BYTES[data]
    width, factor, rest = 1, int(BASE), size
    mask = (1 << 64) - 1
    while rest:
        if rest & 1:
            if result is None:
                result = power
            else:
                n = len(result) - width
                result = result[:n] + power[done : done + n] * np.uint64(pow(int(BASE), done, 1 << 64))
            done += width
        rest >>= 1
        if rest:
            power = power[:-width] + power[width:] * np.uint64(factor)
            factor = factor * factor & mask
            width *= 2
    return mix(result[: len(data) - size + 1])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value, leftmost of equals, in each run of `width` values."""
    place = np.arange(len(values), dtype=np.int32)
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = place[:-step], place[step:]
        place = np.where(values[right] < values[left], right, left)
        have += step
    return place


def segments(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, segment hash, start, size) of a text's segments; none under `length` bytes."""
    grams = rolling(data, ANCHOR)
    place = window_minima(grams, length - ANCHOR + 1)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    size = last + length - first
    # A segment is the span of two overlapping windows: at most 2 (length) - ANCHOR bytes, so the two cover it.
    whole = rolling(data, length)
    hashes = mix(whole[first] + mix(whole[last] + size.astype(np.uint64) * BASE))
    return grams[place[first]], hashes, first, size


def covered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Disjoint spans, sorted, that cover the same places; touching spans are one."""
    if not len(starts):
        return np.zeros(0, dtype=SPAN)
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate((starts + sizes)[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    heads = np.flatnonzero(new)
    out = np.zeros(len(heads), dtype=SPAN)
    out["start"] = starts[heads]
    out["size"] = ends[np.r_[heads[1:], len(ends)] - 1] - starts[heads]
    return out


def longest_previous(order: np.ndarray, common: np.ndarray, enough: int) -> np.ndarray:
    """Longest previous factors, as far as `enough`, of suffixes sorted in `order` (places by rank) where common[i] is
    what ranks i - 1 and i share. For each rank the previous and the next rank with a smaller place are found by
    pointer jumping, all ranks at once, while what is shared with the rank jumped to stays positive."""
    n = len(order)
    best = np.zeros(n, dtype=np.int64)
    for ranks, shared in ((order, np.r_[0, common[1:]]), (order[::-1], np.r_[0, common[1:][::-1]])):
        at, share = np.arange(n) - 1, np.minimum(shared, enough).astype(np.int64)
        open_ = np.flatnonzero((at >= 0) & (share > 0))
        while len(open_):
            smaller = ranks[at[open_]] < ranks[open_]
            open_ = open_[~smaller]
            # The rank jumped from has a place that is too large; so have all between it and its own target.
            target = at[open_]
            share[open_] = np.minimum(share[open_], share[target])
            at[open_] = at[target]
            dead = (at[open_] < 0) | (share[open_] <= 0)
            share[open_[dead]] = 0
            open_ = open_[~dead]
        best = np.maximum(best, share if ranks is order else share[::-1])
    result = np.zeros(n, dtype=np.int64)
    result[order] = best
    return result


def copied_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, in the order of their places, the window starts (within it) that occur earlier."""
    counts = np.array([max(0, len(p) - length + 1) for p in parts], dtype=np.int64)
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    offsets = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(parts), dtype=np.uint8)
    inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(offsets, counts) + inner
    if not len(starts):
        return [np.zeros(0, dtype=np.int64) for _ in parts]
    # Suffixes at window starts by their first `length` bytes: big-endian words compare as the bytes do.
    words = -(-length // 8)
    padded = np.r_[text, np.zeros(8, np.uint8)]
    eight = np.zeros(len(text), dtype=np.uint64)
    for i in range(8):
        eight = (eight << np.uint64(8)) | padded[i : i + len(text)]
    keys = []
    for w in range(words):
        key = eight[np.minimum(starts + 8 * w, len(text) - 1)]
        if (left := length - 8 * w) < 8:
            key = key & np.uint64((0xFFFFFFFFFFFFFFFF << (8 * (8 - left))) & 0xFFFFFFFFFFFFFFFF)
        keys.append(key)
    order = np.lexsort(keys[::-1])  # stable: equal windows keep the order of their places
    common = np.zeros(len(order), dtype=np.int64)
    alive = np.ones(len(order) - 1, dtype=bool)
    for w, key in enumerate(keys):
        ranked = key[order]
        same = ranked[1:] == ranked[:-1]
        gain = min(8, length - 8 * w)
        common[1:][alive & same] += gain
        broken = alive & ~same
        if broken.any():  # whole bytes before the first that differs
            diff = ranked[1:][broken] ^ ranked[:-1][broken]
            common[1:][broken] += np.minimum(gain, 7 - (np.floor(np.log2(diff.astype(np.float64))).astype(np.int64) >> 3)).clip(0)
        alive &= same
    previous = longest_previous(order, common, length)
    hit = previous >= length
    owner = np.repeat(np.arange(len(parts)), counts)
    cut = np.searchsorted(owner[hit], np.arange(len(parts) + 1))
    found = inner[hit]
    return [found[cut[i] : cut[i + 1]] for i in range(len(parts))]


def squeeze(table: np.ndarray) -> bytes:
    """A SEGMENT table by columns; ids and places, which come in order, are deflated."""
    places = b"".join(np.diff(table[c].astype(np.int64), prepend=0).tobytes() if c == "id" else table[c].tobytes() for c in ("id", "start", "size"))
    return len(table).to_bytes(8, "little") + table["anchor"].tobytes() + table["hash"].tobytes() + zlib.compress(places, 1)


def expand(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    table, places = np.zeros(n, dtype=SEGMENT), zlib.decompress(blob[8 + 16 * n :])
    table["anchor"], table["hash"] = np.frombuffer(blob, "<u8", n, 8), np.frombuffer(blob, "<u8", n, 8 + 8 * n)
    table["id"], table["start"], table["size"] = np.cumsum(np.frombuffer(places, "<i8", n)), np.frombuffer(places, "<i4", n, 8 * n), np.frombuffer(places, "<i2", n, 12 * n)
    return table


def ranked(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the table by anchor, hash and place, each place once; whether a row is the first of its segment)."""
    table = table[np.lexsort((table["start"], table["id"], table["hash"], table["anchor"]))]
    same = (table["anchor"][1:] == table["anchor"][:-1]) & (table["hash"][1:] == table["hash"][:-1])
    table, same = (t[np.r_[True, ~(same & (table["id"][1:] == table["id"][:-1]) & (table["start"][1:] == table["start"][:-1]))]] for t in (table, np.r_[False, same]))
    return table, ~same


class SuffixDedup:
    """The steps over one table."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, length: int, parts: int | None) -> None:
        if length < ANCHOR + 8:
            raise ValueError(f"length is at least {ANCHOR + 8}")
        self.docs = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].cast("string").alias("text"))
        self.length = length
        self.parts = parts or self._parts(docs.sparkSession)

    def _parts(self, spark) -> int:
        """Parts of about PART_BYTES of text, so that a task's part does not grow with the corpus; four times Spark's shuffle
        partitions at least."""
        size = self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // PART_BYTES))

    def hashed(self) -> DataFrame:
        """part, doc, kind, blob: kind 2 has packed SEGMENT rows of the part's anchors, one for each distinct segment
        and task; kind 0 SPANs of doc that copy segments of the same task."""
        length, parts = self.length, self.parts

        def flush(rows: list[np.ndarray]) -> list[tuple[int, int, int, bytes]]:
            table, first = ranked(np.concatenate(rows))
            out = [(doc % parts, doc, 0, blob) for doc, blob in by_id(table[~first])]
            table = table[first]
            bucket = (table["anchor"] % np.uint64(parts)).astype(np.int64)
            table = table[np.lexsort((table["start"], table["id"], bucket))]
            cuts = np.searchsorted(np.sort(bucket), np.arange(parts + 1))
            return out + [(b, 0, 2, squeeze(table[cuts[b] : cuts[b + 1]])) for b in range(parts) if cuts[b + 1] > cuts[b]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, held = [], 0
            for batch in slices(batches, "text"):
                for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
                    if len(data) < length:
                        continue
                    found = segments(data, length)
                    own = np.zeros(len(found[0]), dtype=SEGMENT)
                    own["anchor"], own["hash"], own["start"], own["size"] = found
                    own["id"] = doc
                    rows.append(own)
                    held += len(own)
                if held > 1 << 20:
                    yield pack(flush(rows))
                    rows, held = [], 0
            if rows:
                yield pack(flush(rows))

        return self.docs.filter("doc IS NOT NULL").mapInArrow(run, "part long, doc long, kind long, blob binary")

    def compared(self) -> DataFrame:
        """doc, kind, blob: SPANs of copies (kind 0) and WANTED variants (kind 1) by row."""

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            out = [(d, 0, b) for d, k, b in zip(pdf["doc"], pdf["kind"], pdf["blob"], strict=True) if k == 0]
            if blobs := [b for k, b in zip(pdf["kind"], pdf["blob"], strict=True) if k == 2]:
                table, first = ranked(np.concatenate([expand(b) for b in blobs]))
                heads = table[first]
                group = np.cumsum(np.r_[True, heads["anchor"][1:] != heads["anchor"][:-1]]) - 1
                several = np.bincount(group)[group] > 1
                out += [(d, 0, b) for d, b in by_id(table[~first])] + [(d, 1, b) for d, b in by_id(heads[several], WANTED)]
            return pd.DataFrame(out, columns=["doc", "kind", "blob"]).astype({"doc": "int64", "kind": "int64"})

        return self.hashed().groupBy("part").applyInPandas(run, "doc long, kind long, blob binary")

    def variants(self, wanted: DataFrame) -> DataFrame:
        """doc, blob (SPANs): copied windows among variants, found in suffix order."""
        length, parts = self.length, self.parts

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", 4 << 20):
                anchors, places, pieces = [], [], []
                for doc, text, blobs in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), batch.column("blobs").to_pylist(), strict=True):
                    data, rows = (text or "").encode(), np.frombuffer(b"".join(blobs), dtype=WANTED)
                    anchors.append(rows["anchor"])
                    places.append(np.stack([np.full(len(rows), doc, dtype=np.int64), rows["start"]]))
                    pieces += [data[s : s + n] for s, n in zip(rows["start"].tolist(), rows["size"].tolist(), strict=True)]
                anchor, place = np.concatenate(anchors), np.concatenate(places, axis=1)
                part = (anchor % np.uint64(parts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(part), pa.array(place[0]), pa.array(place[1]), pa.array(pieces, pa.binary())], names=["anchor", "part", "doc", "start", "data"])

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            # Windows of different anchors differ, so a part is cut between anchors; places follow id and start.
            pdf = pdf.drop_duplicates(["anchor", "doc", "start"]).sort_values(["anchor", "doc", "start"], kind="stable")
            anchor = pdf["anchor"].to_numpy()
            heads = np.r_[np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]), len(anchor)]
            cuts = [0]
            for head in heads[1:]:
                if head - cuts[-1] >= 4096 or head == len(anchor):
                    cuts.append(int(head))
            found = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = pdf.iloc[a:b].sort_values(["doc", "start"], kind="stable")
                hits = copied_windows(part["data"].tolist(), length)
                counts = [len(h) for h in hits]
                rows = np.zeros(sum(counts), dtype=[("id", "<i8"), ("start", "<i8"), ("size", "<i8")])
                rows["id"], rows["start"], rows["size"] = np.repeat(part["doc"].to_numpy(), counts), np.repeat(part["start"].to_numpy(), counts) + np.concatenate(hits), length
                found.append(rows)
            out = list(by_id(np.concatenate(found)))
            return pd.DataFrame(out, columns=["doc", "blob"]).astype({"doc": "int64"})

        lists = wanted.groupBy("doc").agg(F.collect_list("blob").alias("blobs"))
        pieces = self.some(wanted.select("doc").distinct()).join(lists, "doc").mapInArrow(cut, "anchor long, part long, doc long, start long, data binary")
        return pieces.groupBy("part").applyInPandas(compare, "doc long, blob binary")

    def some(self, ids: DataFrame, how: str = "left_semi") -> DataFrame:
        """The rows with (or without) the ids; all rows where the ids are too many to broadcast and a join follows."""
        return self.docs.join(F.broadcast(ids), "doc", how) if ids.count() <= FEW else self.docs

    def spans(self) -> DataFrame:
        """doc, blobs: lists of packed SPANs that go. A written table."""
        found = materialize(self.compared(), "spans")
        late = self.variants(found.filter("kind = 1").select("doc", "blob"))
        return materialize(found.filter("kind = 0").select("doc", "blob").unionByName(late).groupBy("doc").agg(F.collect_list("blob").alias("blobs")), "copies")

    def with_spans(self) -> DataFrame:
        """doc, text, blobs of every row: only rows that lose bytes are joined, while their ids are few."""
        spans = self.spans()
        ids = spans.select("doc")
        if ids.count() > FEW:
            return self.docs.join(spans, "doc", "left")
        hit = self.some(ids).join(spans, "doc")
        return hit.unionByName(self.some(ids, "left_anti").withColumn("blobs", F.lit(None).cast("array<binary>")))


def by_id(rows: np.ndarray, kind: np.dtype = SPAN) -> Iterator[tuple[int, bytes]]:
    """(id, packed rows of the kind) for each id; SPANs are merged."""
    if not len(rows):
        return
    rows = rows[np.argsort(rows["id"], kind="stable")]
    heads = np.flatnonzero(np.r_[True, rows["id"][1:] != rows["id"][:-1]]).tolist()
    ids = rows["id"].tolist()
    if kind is SPAN:
        starts, sizes = rows["start"].astype(np.int64), rows["size"].astype(np.int64)
        for a, b in zip(heads, [*heads[1:], len(rows)], strict=True):
            yield ids[a], covered(starts[a:b], sizes[a:b]).tobytes()
        return
    out = np.zeros(len(rows), dtype=kind)
    for name in kind.names:
        out[name] = rows[name]
    for a, b in zip(heads, [*heads[1:], len(rows)], strict=True):
        yield ids[a], out[a:b].tobytes()


def pack(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], pa.array([r[3] for r in rows], pa.binary())], names=["part", "doc", "kind", "blob"])


def remove_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, parts: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary, the remaining bytes) for each row."""
    work = SuffixDedup(docs, id_col, text_col, length, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, removed, spans, kept = [], [], [], []
            for text, blobs in zip(batch.column("text").to_pylist(), batch.column("blobs").to_pylist(), strict=True):
                data = (text or "").encode()
                own = np.frombuffer(b"".join(blobs or ()), dtype=SPAN)
                own = covered(own["start"], own["size"])
                edges = [0, *np.stack([own["start"], own["start"] + own["size"]], axis=1).ravel().tolist(), len(data)]
                sizes.append(len(data))
                removed.append(int(own["size"].sum()))
                spans.append(len(own))
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return work.with_spans().mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
