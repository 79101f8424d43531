"""Operator 5, line dedup: a once-seen and a twice-seen Bloom filter pick the lines that shuffle at all.

1. Every task hashes its lines' keys and hands on the filter positions of keys it met in one row and in several.
   Merging keeps two filters for a segment of the bits: a bit that a second chunk sets goes to the twice-seen filter,
   so a key in two rows has all its bits there. (Two keys may share bits: that only adds suspects.)
2. The filters have BITS_A_LINE bits for each line, counted first, up to MOST_BITS (128 MB), and the twice-seen one is
   broadcast. Only lines whose key passes it shuffle, as 128-bit hash and row id, and are counted exactly; the filter
   decides nothing else. On a corpus that fills MOST_BITS more lines pass, up to all of them, and the result is the same.
3. Confirmed keys go back to the texts: as a broadcast table while there are at most `broadcast_keys` of them, else by
   a join on the key with salted copies, regrouped by row.

Defined cases: a null or empty text is one empty line; a key shorter than `min_chars` never drops; rows that repeat an
id count as one document, and all of them keep the lines if they are the holder; a row without an id counts as no document
and keeps all its lines; a very long text is one row like any other, cut nowhere; an empty table gives an empty result;
further columns stay as they are, but for n_lines and n_dropped, which the result replaces; helper columns take names that
the table does not have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize, slices, spare, tidy

STRIPPED = " \t\n\x0b\x0c\r"
HASHES, SEGMENT_BITS, FLUSH = 2, 23, 1 << 20
BITS_A_LINE, MOST_BITS = 16, 1 << 30


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """For every line its key, or None where the key is too short to be dropped."""
    stripped = [line.strip(STRIPPED) for line in (text or "").split("\n")]
    return [s.encode().lower() if len(s) >= min_chars else None for s in stripped]  # bytes.lower changes A-Z alone


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The filter positions of 64-bit hashes, HASHES for each."""
    mask = np.uint64(bits - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(31)) & mask]).astype(np.int64)


class SegmentPair:
    """Once-seen and twice-seen bits of one segment, as chunks of positions are merged in."""

    def __init__(self) -> None:
        self.once = np.zeros(1 << SEGMENT_BITS, dtype=bool)
        self.twice = np.zeros(1 << SEGMENT_BITS, dtype=bool)

    def add(self, once: np.ndarray, twice: np.ndarray) -> None:
        self.twice[once[self.once[once]]] = True
        self.twice[twice] = True
        self.once[once] = True


def _merge_segments(df: DataFrame, groups: int) -> DataFrame:
    """Rows (segment, chunk, once, twice: positions as bytes) merged to one row for each segment and chunk modulo groups."""

    def dump(key: tuple[int, int], pair: SegmentPair) -> pa.RecordBatch:
        return segment_rows([key], [np.flatnonzero(pair.once)], [np.flatnonzero(pair.twice)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = pair = None
        for batch in batches:
            for segment, chunk, once, twice in zip(*(batch.column(c) for c in ("segment", "chunk", "once", "twice")), strict=True):
                now = (segment.as_py(), chunk.as_py())
                if key != now:
                    if key is not None:
                        yield dump(key, pair)
                    key, pair = now, SegmentPair()
                pair.add(np.frombuffer(once.as_buffer(), np.uint32), np.frombuffer(twice.as_buffer(), np.uint32))
        if key is not None:
            yield dump(key, pair)
        tidy()

    # Sorted, so that a task holds the bits of one segment at a time.
    dealt = df.withColumn("chunk", F.pmod("chunk", F.lit(groups))).repartition("segment", "chunk")
    return dealt.sortWithinPartitions("segment", "chunk").mapInArrow(merge, df.schema)


def segment_rows(keys: list[tuple[int, int]], once: list[np.ndarray], twice: list[np.ndarray]) -> pa.RecordBatch:
    """(segment, chunk, once, twice) rows with positions as bytes."""
    packed = [pa.array([x.astype(np.uint32).tobytes() for x in places], pa.binary()) for places in (once, twice)]
    return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)] + packed, names=["segment", "chunk", "once", "twice"])


def bits_for(docs: DataFrame, text_col: str) -> int:
    """A power of two of at least BITS_A_LINE bits a line, one segment at least and MOST_BITS at most."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    lines = docs.agg(F.sum(F.length(text) - F.length(F.translate(text, "\n", "")) + 1)).first()[0] or 0
    return min(MOST_BITS, max(1 << SEGMENT_BITS, 1 << (BITS_A_LINE * int(lines) - 1).bit_length()))


def twice_seen(docs: DataFrame, text_col: str, min_chars: int, filter_bits: int) -> np.ndarray:
    """The twice-seen filter of all line keys, as packed bytes: filter_bits / 8 of them."""
    segments = max(1, filter_bits >> SEGMENT_BITS)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.array(held, dtype=np.uint64), return_counts=True)
            at, again = positions(keys, filter_bits), positions(keys[counts > 1], filter_bits)
            once, twice = np.unique(at), np.unique(again)
            chunk = int(keys[0] >> np.uint64(33)) if len(keys) else 0
            for s in range(segments):
                pick = [x[(x >> SEGMENT_BITS) == s] & ((1 << SEGMENT_BITS) - 1) for x in (once, twice)]
                if len(pick[0]):
                    yield segment_rows([(s, chunk)], pick[:1], pick[1:])
            held.clear()

        for batch in batches:
            for sliced in slices(iter([batch]), text_col):
                for text in sliced.column(text_col).to_pylist():
                    held.extend({xxhash.xxh3_64_intdigest(k) for k in line_keys(text, min_chars) if k is not None})
                if len(held) >= FLUSH:
                    yield from flush()
        yield from flush()
        tidy()

    chunks = docs.select(text_col).mapInArrow(emit, "segment long, chunk long, once binary, twice binary")
    merged = _merge_segments(_merge_segments(chunks, 64), 1)
    bits = np.zeros(max(filter_bits, 1 << SEGMENT_BITS) // 8, dtype=np.uint8)
    for row in merged.select("segment", "twice").toLocalIterator():
        full = np.zeros(1 << SEGMENT_BITS, dtype=bool)
        full[np.frombuffer(row["twice"], np.uint32)] = True
        at = row["segment"] << (SEGMENT_BITS - 3)
        bits[at : at + (1 << (SEGMENT_BITS - 3))] = np.packbits(full, bitorder="little")
    return bits


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, filter_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(suspects, confirmed): the suspected (k1, k2, doc) occurrences, one for each key and id, and the keys found
    in at least min_docs documents with `holder`, the largest id that has the key. Both are written tables."""
    filter_bits = filter_bits or bits_for(docs, text_col)
    seen = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, text_col, min_chars, filter_bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = seen.value
        for batch in slices(batches, text_col):
            ids, keys = [], []
            for doc, text in zip(batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist(), strict=True):
                own = {k for k in line_keys(text, min_chars) if k is not None}
                ids += [doc] * len(own)
                keys += own
            if not keys:
                continue
            at = positions(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys)), filter_bits)
            hit = np.all((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1, axis=0)
            picked = [keys[i] for i in np.flatnonzero(hit)]
            both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, picked)), dtype=">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([ids[i] for i in np.flatnonzero(hit)], pa.int64())], names=["k1", "k2", "doc"])
        tidy()

    rows = docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col]).filter(F.col(id_col).isNotNull()).mapInArrow(suspects, "k1 long, k2 long, doc long")
    found = materialize(rows, "suspects")
    counted = found.distinct().groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc").alias("holder"))
    return found, materialize(counted.filter(F.col("n") >= min_docs).select("k1", "k2", "holder"), "repeated")


def _apply(text: str | None, doc: int | None, min_chars: int, drop) -> tuple[int, int, str]:
    lines = (text or "").split("\n")
    keys = line_keys(text, min_chars)
    kept = [line for line, key in zip(lines, keys, strict=True) if key is None or not drop(key, doc)]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, filter_bits: int | None = None, broadcast_keys: int = 1 << 20, salts: int = 16) -> DataFrame:
    """All columns of docs with the text deduplicated, and n_lines and n_dropped (long). A null text stays null: its
    one empty line is kept."""
    found, confirmed = repeated_lines(docs, id_col, text_col, min_chars, min_docs, filter_bits)
    fields = [f for f in docs.schema.fields if f.name not in ("n_lines", "n_dropped")]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    names = [f.name for f in fields]
    spark, base = docs.sparkSession, docs.select(*[docs[n] for n in names])

    def rewrite(batch: pa.RecordBatch, drops) -> pa.RecordBatch:
        texts, ids = batch.column(text_col).to_pylist(), batch.column(id_col).to_pylist()
        done = [_apply(t, i, min_chars, d) for t, i, d in zip(texts, ids, drops, strict=True)]
        fresh = pa.array([None if t is None else kept for t, (_, _, kept) in zip(texts, done, strict=True)], batch.schema.field(text_col).type)
        columns = [fresh if n == text_col else batch.column(n) for n in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64())], names=[*names, "n_lines", "n_dropped"])

    if confirmed.count() <= broadcast_keys:
        rows = sorted(((r["k1"], r["k2"]), r["holder"]) for r in confirmed.toLocalIterator())
        table = spark.sparkContext.broadcast((np.array([k for k, _ in rows], dtype=np.int64).reshape(-1, 2), np.array([h for _, h in rows], dtype=np.int64)))

        def by_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, holders = table.value
            holder = dict(zip((k.tobytes() for k in keys.astype(">i8")), holders.tolist(), strict=True))

            def drop(key: bytes, doc: int | None) -> bool:
                return doc is not None and holder.get(xxhash.xxh3_128_digest(key), doc) != doc

            for batch in slices(batches, text_col):
                yield rewrite(batch, [drop] * batch.num_rows)
            del holder
            tidy()

        return base.mapInArrow(by_table, schema)

    # A key in a third of all documents is spread over `salts` tasks; its documents meet only in rows of their own.
    spread = confirmed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    gone = found.distinct().withColumn("salt", F.pmod("doc", F.lit(salts)).cast("int")).join(spread, ["k1", "k2", "salt"]).filter("doc <> holder")
    drop_doc, drop_keys = spare(base, "drop_doc"), spare(base, "drop_keys")
    lists = gone.groupBy(F.col("doc").alias(drop_doc)).agg(F.collect_list(F.struct("k1", "k2")).alias(drop_keys))
    joined = base.join(lists, base[id_col].cast("long") == lists[drop_doc], "left").drop(drop_doc)

    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            drops = []
            for own in batch.column(drop_keys).to_pylist():
                mine = {np.array([k["k1"], k["k2"]], dtype=">i8").tobytes() for k in own or ()}
                drops.append(lambda key, _, mine=mine: bool(mine) and xxhash.xxh3_128_digest(key) in mine)
            yield rewrite(batch, drops)

    return joined.mapInArrow(by_row, schema)
