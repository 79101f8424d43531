"""Retrieval over columns: dense vectors, sparse vectors, sets, and their fusion.

A search of one query is one pass that scores rows in the JVM and a bounded top-k (score, then id), so no ordered or
grouped shuffle of the table is needed; MinHash signatures alone are made in Arrow batches. A search of many queries is a
join on cells or bands with a bounded top-k for each query. Filters run before ranking: a row that they drop never takes
a place among the k.
"""

from __future__ import annotations

import functools
import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.bind import let

MAX_K = 10_000
MASK = (1 << 64) - 1


def _checked(query: list[float]) -> list[float]:
    if not query or not all(math.isfinite(x) for x in query):
        raise ValueError("a query vector has finite entries, one at least")
    return [float(x) for x in query]


def _k(k: int) -> int:
    if not 0 < k <= MAX_K:
        raise ValueError(f"k is between 1 and {MAX_K}")
    return k


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def similarity(vec: Column, query: list[float], metric: str) -> Column:
    """cosine and dot product: larger is nearer; l2: the distance, smaller is nearer."""
    q = F.array(*[F.lit(x) for x in _checked(query)])
    sized = F.when(F.size(vec) == len(query), vec)
    made = F.when(vec.isNotNull() & (F.size(vec) != len(query)), F.raise_error(F.lit(f"the vector's dimension is not {len(query)}")).cast("double"))
    if metric == "cosine":
        norm = math.sqrt(math.fsum(x * x for x in query))
        value = _dot(sized, q) / F.nullif(F.sqrt(_dot(sized, sized)) * F.lit(norm), F.lit(0.0))
    elif metric in ("dot", "dot_product"):
        value = _dot(sized, q)
    elif metric in ("l2", "euclidean"):
        value = F.sqrt(F.aggregate(F.zip_with(sized, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return F.coalesce(made, value)


def top(df: DataFrame, score: Column, k: int, id_col: str, name: str, ascending: bool = False) -> DataFrame:
    """The k best rows with `name` and search_rank from 1; ties by id. The rank is numbered over k rows alone."""
    order = [F.col(name).asc() if ascending else F.col(name).desc(), F.col(id_col).asc()]
    order[0] = F.col(name).asc_nulls_last() if ascending else F.col(name).desc_nulls_last()
    # Rows without a score come last and go after the limit, so the score is evaluated once for a row.
    best = df.withColumn(name, score).orderBy(*order).limit(_k(k)).filter(F.col(name).isNotNull())
    return best.withColumn("search_rank", F.row_number().over(Window.orderBy(*order)))


def vector_search(df: DataFrame, vec_col: str, query: list[float], k: int, id_col: str, metric: str = "cosine") -> DataFrame:
    """Exact nearest rows: ann_cosine_distance for cosine, exact_score for dot and l2."""
    s = similarity(df[vec_col], query, metric)
    if metric == "cosine":
        return top(df, 1 - s, k, id_col, "ann_cosine_distance", ascending=True)
    return top(df, s, k, id_col, "exact_score", ascending=metric in ("l2", "euclidean"))


def sign_bits(vec: Column) -> Column:
    """Bits of 64-entry words, lowest first: 1 where the entry is above 0."""
    words = F.ceil(F.size(vec) / F.lit(64)).cast("int")
    bit = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda s, i: s.bitwiseOR(F.when(F.coalesce(F.get(vec, w * 64 + i), F.lit(0.0)) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))))
    return F.transform(F.sequence(F.lit(0), words - 1), bit)


def hamming_search(df: DataFrame, vec_col: str, query: list[float], k: int, id_col: str) -> DataFrame:
    """Nearest rows by the number of entries whose sign bit differs (ann_distance)."""
    signs = F.array(*[F.lit(x > 0) for x in _checked(query)])
    away = F.size(F.filter(F.zip_with(df[vec_col], signs, lambda x, y: (x > 0) != y), lambda d: d))
    return top(df, F.when(F.size(df[vec_col]) == len(query), away), k, id_col, "ann_distance", ascending=True)


def rerank(candidates: DataFrame, vec_col: str, query: list[float], limit: int, id_col: str, metric: str = "cosine") -> DataFrame:
    """Candidates of another search by exact similarity."""
    kept = candidates.drop("search_rank", "exact_score")
    return top(kept, similarity(kept[vec_col], query, metric), limit, id_col, "exact_score", ascending=metric in ("l2", "euclidean"))


class IvfIndex:
    """Inverted lists: k-means centres from a bounded sample (`sample` rows, documented bound), every row assigned to its
    nearest centre. With a path the table is stored partitioned by cell, and a search reads the files of its cells alone.
    What probes recall costs is measured, not assumed: see `recall`."""

    def __init__(self, df: DataFrame, vec_col: str, id_col: str, cells: int = 32, sample: int = 20_000, seed: int = 3, path: str | None = None) -> None:
        self.vec_col, self.id_col, self.cells = vec_col, id_col, cells
        part = df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed))).limit(sample).select(vec_col).toPandas()[vec_col]
        points = np.array([p for p in part.tolist() if p is not None], dtype=np.float64)
        rnd = np.random.default_rng(seed)
        self.centres = points[rnd.choice(len(points), min(cells, len(points)), replace=False)]
        for _ in range(15):
            own = self._nearest(points, self.centres, 1)[:, 0]
            self.centres = np.array([points[own == i].mean(axis=0) if (own == i).any() else c for i, c in enumerate(self.centres)])
        self.table = df.withColumn("_cell", self._cells(F.col(vec_col), 1)[0])
        if path:
            self.table.write.partitionBy("_cell").parquet(path)
            self.table = df.sparkSession.read.parquet(path)

    @staticmethod
    def _nearest(points: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
        if not len(points):
            return np.zeros((0, probes), dtype=int)
        away = (centres * centres).sum(axis=1)[None] - 2 * points @ centres.T
        return np.argsort(away, axis=1, kind="stable")[:, :probes]

    def _cells(self, vec: Column, probes: int) -> Column:
        centres, nearest = self.centres, self._nearest

        def assign(column: pa.Array) -> pa.Array:
            there = np.flatnonzero(column.is_valid())
            points = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(there), -1) if len(there) else np.zeros((0, 1))
            out: list = [None] * len(column)
            for i, cells in zip(there.tolist(), nearest(points, centres, probes).tolist(), strict=True):
                out[i] = cells
            return pa.array(out, pa.list_(pa.int32()))

        return F.arrow_udf(assign, "array<int>")(vec)

    def search(self, query: list[float], k: int, probes: int = 4, metric: str = "l2") -> DataFrame:
        cells = [int(c) for c in self._nearest(np.array([_checked(query)]), self.centres, probes)[0]]
        return vector_search(self.table.filter(F.col("_cell").isin(cells)), self.vec_col, query, k, self.id_col, metric).drop("_cell")

    def search_all(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """query_id, id, distance, search_rank: the k nearest (l2) among each query's cells. Blocks of queries meet blocks of
        rows cell by cell, and a query's candidates are cut to k in each block before they shuffle."""
        asked = queries.select(F.col(self.id_col).alias("query_id"), F.col(self.vec_col).alias("_q")).withColumn("_probes", self._cells(F.col("_q"), probes))
        return _best(asked, self.table.select(F.col(self.id_col).alias("id"), F.col(self.vec_col).alias("_v"), F.col("_cell").cast("int").alias("_cell")), k)

    def recall(self, queries: DataFrame, k: int, probes: int) -> float:
        """The share of the queries' exact k nearest rows that search_all finds."""
        found = self.search_all(queries, k, probes).select("query_id", "id")
        exact = exact_search_all(self.table, queries, self.vec_col, self.id_col, k).select("query_id", "id")
        hits = exact.join(found, ["query_id", "id"], "left_semi").count()
        return hits / max(1, exact.count())


#: Rows of a block of queries and at most of a block of rows; bytes of queries that are broadcast; cells of a distance matrix.
QUERY_ROWS, BLOCK_ROWS, QUERY_BYTES, MATRIX = 4096, 1 << 16, 64 << 20, 1 << 21


def _packed(df: DataFrame, rows: int, cells: str) -> DataFrame:
    """One row for at most `rows` rows of a partition: ids, their vectors of one dimension end to end, and cells (an int or
    some ints a row). Rows without a vector have no distance and go."""
    id_col, vec_col = df.columns[0], df.columns[1]
    wide = df.schema[cells].dataType.typeName() == "array"
    vec_type = pa.float64() if df.schema[vec_col].dataType.elementType.typeName() != "float" else pa.float32()

    def run(batches):
        held: dict[int, list[pa.RecordBatch]] = {}

        def block(dim: int) -> pa.RecordBatch:
            t = pa.Table.from_batches(held.pop(dim)).combine_chunks()
            vec, cell = (t.column(c).combine_chunks() for c in (vec_col, cells))
            cell = (cell.flatten() if wide else cell).to_numpy(zero_copy_only=False).astype(np.int32)
            ids = t.column(id_col).combine_chunks()
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([vec.flatten().cast(vec_type).to_numpy().tobytes()], pa.binary()), pa.array([cell.tobytes()], pa.binary())], names=["dim", "ids", "vecs", "cells"])

        for batch in batches:
            # An entry that is null leaves no distance, as does a null vector.
            vec = batch.column(vec_col)
            whole = np.diff(np.r_[0, np.cumsum(vec.flatten().is_valid().to_numpy(zero_copy_only=False))][np.r_[0, np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(vec), 0).to_numpy())]])
            size = pa.compute.fill_null(pa.compute.list_value_length(vec), -1).to_numpy()
            for dim in np.unique(size[(whole == size)]).tolist():
                part = batch.filter(pa.array((size == dim) & (whole == size)))
                for at in range(0, part.num_rows, rows):
                    piece = part.slice(at, rows)
                    if dim in held and sum(b.num_rows for b in held[dim]) + piece.num_rows > rows:
                        yield block(dim)
                    held.setdefault(dim, []).append(piece)
        for dim in list(held):
            yield block(dim)

    id_type = df.schema[id_col].dataType.simpleString()
    return df.mapInArrow(run, f"dim int, ids array<{id_type}>, vecs binary, cells binary")


def _near(q: np.ndarray, v: np.ndarray, v2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) places that hold each query's k nearest rows, and some more: by products, with room for their rounding."""
    q2 = (q * q).sum(axis=1)
    if len(v) <= k or not (np.isfinite(q2).all() and np.isfinite(v2).all()):
        return np.repeat(np.arange(len(q)), len(v)), np.tile(np.arange(len(v)), len(q))
    away = q @ v.T
    away *= -2
    away += v2
    # The k-th least of the groups' least is no less than the k-th least of all.
    groups = min(len(v), max(64, 4 * k))
    least = np.minimum.reduceat(away, np.arange(groups) * len(v) // groups, axis=1)
    edge = np.partition(least, k - 1, axis=1)[:, k - 1] + 1e-10 * (q2 + v2.max())
    return np.nonzero(away <= edge[:, None])


def _block_best(q: np.ndarray, probes: np.ndarray, v: np.ndarray, cell: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of each query's k nearest rows in its cells, ties by id."""
    found_q, found_v, found_d = [], [], []
    for c in np.unique(cell).tolist():
        asking, rows = np.flatnonzero((probes == c).any(axis=1)), np.flatnonzero(cell == c)
        own = v[rows]
        own2 = (own * own).sum(axis=1)
        step = max(1, MATRIX // max(1, len(rows)))
        for at in range(0, len(asking), step):
            some = asking[at : at + step]
            i, j = _near(q[some], own, own2, k)
            d = np.zeros(len(i))
            for x in range(q.shape[1]):  # added in the order of the entries, as a fold over the vector does
                d += (q[some[i], x] - own[j, x]) ** 2
            order = np.lexsort((ids[rows[j]], d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.searchsorted(i, i)
            kept = np.arange(len(i)) - first < k
            found_q.append(some[i[kept]])
            found_v.append(rows[j[kept]])
            found_d.append(d[kept])
    if not found_q:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    i, j, d = (np.concatenate(x) for x in (found_q, found_v, found_d))
    order = np.lexsort((ids[j], d, i))
    i, j, d = i[order], j[order], np.sqrt(d[order])
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept], d[kept]


def _best(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, id, distance, search_rank of the k nearest rows (id, _v, _cell) of every query (query_id, _q, _probes). Blocks
    of queries meet blocks of rows; from a pair of blocks come at most k rows a query. A task holds two blocks."""
    _k(k)
    spark = rows.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    blocks = _packed(rows.repartition(tasks, "id"), BLOCK_ROWS, "_cell")
    n = asked.count()
    # Queries are packed in few partitions, so that their blocks are full.
    own = _packed(asked.repartition(max(1, -(-n // (8 * QUERY_ROWS))), "query_id"), QUERY_ROWS, "_probes")
    own = own.select(F.col("dim").alias("qdim"), F.col("ids").alias("qids"), F.col("vecs").alias("qvecs"), F.col("cells").alias("probes"))
    width = asked.select(F.max(F.size("_q"))).first()[0] or 1
    if n * width * 8 <= QUERY_BYTES:
        own = F.broadcast(own)
    kind = lambda t: np.float32 if t == "float" else np.float64
    q_type, v_type = kind(asked.schema["_q"].dataType.elementType.typeName()), kind(rows.schema["_v"].dataType.elementType.typeName())

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at] for c in batch.schema.names}
                dim, ids, qids = row["dim"].as_py(), row["ids"].values, row["qids"].values
                # frombuffer of no entries fails; vectors without entries are all at distance 0.
                vec = lambda c, t, m, dim=dim, row=row: np.frombuffer(row[c].as_buffer(), t).astype(np.float64).reshape(m, dim) if dim else np.zeros((m, 0))
                q, v = vec("qvecs", q_type, len(qids)), vec("vecs", v_type, len(ids))
                probes, cell = np.frombuffer(row["probes"].as_buffer(), np.int32).reshape(len(qids), -1), np.frombuffer(row["cells"].as_buffer(), np.int32)
                i, j, d = _block_best(q, probes, v, cell, ids.to_numpy(zero_copy_only=False), k)
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(d)], names=["query_id", "id", "distance"])

    types = [d.schema[c].dataType.simpleString() for d, c in ((asked, "query_id"), (rows, "id"))]
    away = blocks.join(own, F.col("dim") == F.col("qdim")).drop("qdim").mapInArrow(run, f"query_id {types[0]}, id {types[1]}, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return away.withColumn("search_rank", F.row_number().over(w)).filter(F.col("search_rank") <= k)


def exact_search_all(df: DataFrame, queries: DataFrame, vec_col: str, id_col: str, k: int) -> DataFrame:
    """query_id, id, distance, search_rank of the k nearest rows (l2) of every query, without an index: a stated query set
    against all rows, block by block, as one cell that every query probes."""
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("_q"), F.array(F.lit(0)).alias("_probes"))
    return _best(asked, df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("_v"), F.lit(0).alias("_cell")), k)


def sparse_vector(text: str) -> list[tuple[int, float]]:
    """'[[token, weight], ...]' with equal tokens summed, sorted by token."""
    out: dict[int, float] = {}
    for token, weight in json.loads(text):
        if not isinstance(token, int) or not math.isfinite(weight):
            raise ValueError("tokens are integers and weights finite")
        out[token] = out.get(token, 0.0) + float(weight)
    return sorted(out.items())


def sparse_search(df: DataFrame, sparse_col: str, query: list[tuple[int, float]], k: int, id_col: str) -> DataFrame:
    """Sum of products over shared tokens; rows without one do not match. sparse_col: array of struct(token, weight)."""
    if not query:
        raise ValueError("a sparse query has one token at least")
    buckets = 1 << max(0, (len(query) - 1).bit_length())
    held: list[list[dict]] = [[] for _ in range(buckets)]
    for t, w in dict(query).items():
        held[int(t) % buckets].append({"t": int(t), "w": float(w)})
    # The query as a literal array of small arrays: a lookup is a place and an entry or two, and a row is scored where it is.
    places = F.from_json(F.lit(json.dumps(held)), "array<array<struct<t: int, w: double>>>")
    found = lambda e: F.get(F.filter(F.element_at(places, F.pmod(e["token"].cast("int"), F.lit(buckets)) + 1), lambda p: p["t"] == e["token"].cast("int")), 0)["w"]
    products = F.transform(df[sparse_col], lambda e: e["weight"].cast("double") * found(e))
    score = F.aggregate(products, F.lit(None).cast("double"), lambda s, x: F.coalesce(s + x, s, x))
    return top(df, score, k, id_col, "sparse_score")


def set_members(text: str) -> list[str]:
    """The JSON array's scalars, typed and canonical (strings quoted), sorted and distinct."""
    members = json.loads(text)
    if not isinstance(members, list) or any(isinstance(m, (list, dict)) or m is None for m in members):
        raise ValueError("a set is an array of strings, numbers and booleans")
    return sorted({json.dumps(m, ensure_ascii=False) for m in members})


def member_hash(member: str) -> int:
    """XXH3-64 of a canonical member: a type byte (1 string, 2 number, 3 boolean) and its text."""
    value = json.loads(member)
    if isinstance(value, bool):
        data = b"\x03" + (b"\x01" if value else b"\x00")
    elif isinstance(value, str):
        data = b"\x01" + value.encode()
    else:
        data = b"\x02" + member.encode()
    return xxhash.xxh3_64_intdigest(data)


def _splitmix(state: int) -> tuple[int, int]:
    state = (state + 0x9E3779B97F4A7C15) & MASK
    z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
    return state, z ^ (z >> 31)


@functools.cache
def coefficients(slots: int = 128, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the slots, drawn by splitmix64."""
    a, b = [], []
    for _ in range(slots):
        seed, x = _splitmix(seed)
        seed, y = _splitmix(seed)
        a.append(x | 1)
        b.append(y)
    return np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)


def signature(members: list[str], slots: int = 128) -> np.ndarray:
    """Per slot the least (a h + b) >> 32 over the members; all ones for the empty set."""
    if not len(members):
        return np.full(slots, 0xFFFFFFFF, dtype=np.int64)
    return _signed(np.array([member_hash(m) for m in members], dtype=np.uint64), slots)


def _signed(h: np.ndarray, slots: int) -> np.ndarray:
    a, b = coefficients(slots)
    return ((h[:, None] * a + b) >> np.uint64(32)).min(axis=0).astype(np.int64)


def signatures(members: Column, slots: int = 128) -> Column:
    def made(column: pa.Array) -> pa.Array:
        # Members are hashed once a batch, however many rows have them.
        words = column.flatten().dictionary_encode()
        hashes = np.array([member_hash(w) for w in words.dictionary.to_pylist()], dtype=np.uint64)
        h, starts = hashes[words.indices.to_numpy()], np.r_[0, np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy())]
        empty = np.full(slots, 0xFFFFFFFF, dtype=np.int64)
        rows = [_signed(h[i:j], slots) if j > i else empty for i, j in zip(starts, starts[1:], strict=False)]
        flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * slots, pa.int32()), pa.array(flat, pa.int64()), mask=column.is_null())

    return F.arrow_udf(made, "array<bigint>")(members)


def bitmaps(members: Column) -> Column:
    """1024 bits in 16 words: those that the hashes of a set's members name."""

    def made(column: pa.Array) -> pa.Array:
        words = column.flatten().dictionary_encode()
        bit = np.array([member_hash(w) & 1023 for w in words.dictionary.to_pylist()], dtype=np.int64)[words.indices.to_numpy()]
        marks = np.zeros((len(column), 1024), dtype=bool)
        marks[np.repeat(np.arange(len(column)), pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy()), bit] = True
        flat = np.packbits(marks, axis=1, bitorder="little").view(np.int64).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1) * 16, pa.int32()), pa.array(flat, pa.int64()))

    return F.arrow_udf(made, "array<bigint>")(members)


def _may_reach(na: Column, a: Column, nb: Column, b: Column, least: float) -> Column:
    """Whether bitmaps of two sets leave a similarity of `least` open: each bit of one alone is a member that both don't share."""
    alone = lambda x, y: functools.reduce(lambda s, t: s + t, [F.bit_count(F.get(x, i).bitwiseAND(F.bitwise_not(F.get(y, i)))) for i in range(16)])
    both = F.least(na - alone(a, b), nb - alone(b, a))
    return both * (1 + least) >= least * (na + nb) - 1e-6


def minhash_search(df: DataFrame, members_col: str, query: list[str], k: int, id_col: str, slots: int = 128, bands: int = 32) -> DataFrame:
    """Rows that share a band of the signature with the query, by the share of equal slots (estimated_jaccard)."""
    q = F.array(*[F.lit(int(x)) for x in signature(query, slots)])
    signed = df.withColumn("_sig", signatures(df[members_col], slots))
    same = F.zip_with(F.col("_sig"), q, lambda x, y: (x == y).cast("int"))
    width = slots // bands
    band = F.exists(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.forall(F.slice(F.col("_same"), i * width + 1, F.lit(width)), lambda x: x == 1))
    marked = signed.withColumn("_same", same).filter(band & (F.size(members_col) > 0)).drop("_sig")
    share = F.aggregate("_same", F.lit(0), lambda s, x: s + x) / F.lit(float(slots))
    return top(marked, share, k, id_col, "estimated_jaccard").drop("_same")


def jaccard(a: Column, b: Column) -> Column:
    """Exact similarity of two arrays as sets; null where both are empty. Each side is evaluated once."""
    share = lambda x, y, n: x / F.nullif((n + F.size(F.array_distinct(y)) - x).cast("double"), F.lit(0.0))
    return let(a, lambda x: let(b, lambda y: let(F.size(F.array_intersect(x, y)), lambda both: share(both, y, F.size(F.array_distinct(x))))))


def jaccard_to(a: Column, query: list[str]) -> Column:
    """jaccard with one query set."""
    members = sorted(set(query))
    literal = F.array(*[F.lit(m) for m in members]).cast("array<string>")
    n = F.lit(len(members))
    return let(F.array_distinct(a), lambda x: let(F.size(F.array_intersect(x, literal)), lambda both: both / F.nullif((F.size(x) + n - both).cast("double"), F.lit(0.0))))


def set_similarity(df: DataFrame, members_col: str, query: list[str], candidate_k: int, min_jaccard: float, limit: int, id_col: str) -> DataFrame:
    """MinHash candidates by exact Jaccard of min_jaccard and more; an empty query finds nothing."""
    found = minhash_search(df, members_col, query, candidate_k, id_col).drop("search_rank")
    return top(found, _least(jaccard_to(found[members_col], query), min_jaccard), limit, id_col, "exact_jaccard")


def _least(score: Column, least: float) -> Column:
    return let(score, lambda s: F.when(s >= least, s))


def jaccard_search(df: DataFrame, members_col: str, query: list[str], k: int, id_col: str, min_jaccard: float = 0.0) -> DataFrame:
    """Exact set similarity without candidates: one pass over all rows."""
    return top(df, _least(jaccard_to(df[members_col], query), min_jaccard), k, id_col, "exact_jaccard")


def minhash_search_all(df: DataFrame, queries: DataFrame, members_col: str, id_col: str, k: int, min_jaccard: float, slots: int = 128, bands: int = 32) -> DataFrame:
    """query_id, id, exact_jaccard, search_rank: for each query its k most similar other rows of min_jaccard and more that
    share a band with it. A pair of similarity s shares a band with probability 1 - (1 - s^(slots / bands))^bands.

    Equal sets meet once: a set stands for the k least of its ids, which is all that a top-k by similarity and id can use of
    it, and one more, as a query does not find itself. So a group of copies costs its size and not its square."""
    width = slots // bands
    keyed = lambda d: d.filter(F.size(members_col) > 0).select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(members_col)).alias("m")).withColumn("f", F.xxhash64("m"))
    banded = lambda d: d.withColumn("_sig", signatures(F.col("m"), slots)).select("f", "m", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("_sig", i * width + 1, F.lit(width))))).alias("band"))
    rows, asked = keyed(df), keyed(queries)
    sets = rows.groupBy("f").agg(F.first("m").alias("m"))
    # The k + 1 least ids of a set, ranked before they shuffle.
    w = Window.partitionBy("f").orderBy("id")
    ids = rows.select("f", "id").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k + 1).drop("_r")
    query_sets = asked.groupBy("f").agg(F.first("m").alias("m"))
    left = banded(query_sets).select(F.col("f").alias("qf"), "band")
    right = banded(sets).select("f", "band")
    pairs = left.join(right, "band").select("qf", "f").distinct()
    # Most pairs that share a band are not similar: bitmaps rule them out, so few pairs meet the members themselves.
    marked = lambda d, n, b: d.select("f", F.size("m").alias(n), bitmaps(F.col("m")).alias(b))
    pairs = pairs.join(marked(query_sets, "_qn", "_qb").withColumnRenamed("f", "qf"), "qf").join(marked(sets, "_n", "_b"), "f")
    pairs = pairs.filter(_may_reach(F.col("_qn"), F.col("_qb"), F.col("_n"), F.col("_b"), min_jaccard)).select("qf", "f")
    scored = pairs.join(query_sets.select(F.col("f").alias("qf"), F.col("m").alias("qm")), "qf").join(sets, "f")
    scored = scored.select("qf", "f", jaccard(F.col("qm"), F.col("m")).alias("exact_jaccard")).filter(F.col("exact_jaccard") >= min_jaccard)
    found = scored.join(ids, "f").join(asked.select(F.col("id").alias("query_id"), F.col("f").alias("qf")), "qf").filter("id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("exact_jaccard"), "id")
    return found.select("query_id", "id", "exact_jaccard").withColumn("search_rank", F.row_number().over(best)).filter(F.col("search_rank") <= _k(k))


@dataclass(frozen=True)
class Retriever:
    """A named ranked list: frame with id_col and search_rank, weight of its reciprocal ranks."""

    name: str
    frame: DataFrame
    weight: float = 1.0


def fuse(retrievers: list[Retriever], id_col: str, limit: int, constant: float = 60.0, method: str = "rrf", score_col: str | None = None) -> DataFrame:
    """id, fused_score, components (JSON by retriever name), search_rank.

    rrf: sum of weight / (constant + rank); max: the largest weighted score. A row that a retriever lists twice counts
    with its better rank. The order of the retrievers does not matter."""
    if len({r.name for r in retrievers}) != len(retrievers):
        raise ValueError("retriever names are unique")
    if not retrievers:
        raise ValueError("one retriever at least")
    lists = None
    for r in retrievers:
        raw = F.col(score_col).cast("double") if score_col else F.col("search_rank").cast("double")
        part = r.frame.select(F.col(id_col), F.lit(r.name).alias("_name"), F.lit(float(r.weight)).alias("_weight"), F.col("search_rank").alias("_rank"), raw.alias("_score"))
        lists = part if lists is None else lists.unionByName(part)
    single = lists.groupBy(id_col, "_name", "_weight").agg(F.min("_rank").alias("_rank"), F.max("_score").alias("_score"))
    gain = F.col("_weight") / (F.lit(constant) + F.col("_rank")) if method == "rrf" else F.col("_weight") * F.col("_score")
    parts = F.array_sort(F.collect_list(F.struct(F.col("_name").alias("name"), F.col("_rank").alias("rank"), gain.alias("score"))))
    # Added in the order of the names, so equal lists give equal doubles.
    total = F.aggregate("_parts", F.lit(0.0), lambda s, p: s + p["score"]) if method == "rrf" else F.array_max(F.transform("_parts", lambda p: p["score"]))
    fused = single.groupBy(id_col).agg(parts.alias("_parts")).withColumn("_total", total)
    return top(fused, F.col("_total"), limit, id_col, "fused_score").select(id_col, "search_rank", "fused_score", F.to_json("_parts").alias("components"))


def hybrid_search(df: DataFrame, request: dict, id_col: str) -> DataFrame:
    """A JSON request: must (conditions), retrievers [{name, kind: ann|sparse|minhash, column, query, k, weight, metric}],
    constant, rerank {column, query, metric, candidate_limit, weight}, limit, projection."""
    from tessera.operators.conditions import from_json, where

    base = where(df, [from_json(c) for c in request.get("must", [])])
    lists = []
    for r in request["retrievers"]:
        kind, column, k = r["kind"], r["column"], r.get("k", 100)
        if kind == "ann":
            found = hamming_search(base, column, r["query"], k, id_col) if r.get("metric") == "hamming" else vector_search(base, column, r["query"], k, id_col, r.get("metric", "cosine"))
        elif kind == "sparse":
            found = sparse_search(base, column, [tuple(x) for x in r["query"]], k, id_col)
        elif kind == "minhash":
            found = minhash_search(base, column, r["query"], k, id_col)
        else:
            raise ValueError(f"unknown retriever {kind!r}")
        lists.append(Retriever(r["name"], found, r.get("weight", 1.0)))
    limit, again = request.get("limit", 10), request.get("rerank")
    fused = fuse(lists, id_col, again.get("candidate_limit", 100) if again else limit, request.get("constant", 60.0))
    out = fused.join(base, id_col)
    if again:
        s = similarity(out[again["column"]], again["query"], again.get("metric", "cosine"))
        out = top(out.drop("search_rank"), F.col("fused_score") + F.lit(float(again.get("weight", 1.0))) * s, limit, id_col, "final_score")
    columns = request.get("projection") or []
    return out.select(id_col, "search_rank", "fused_score", "components", *[c for c in ("final_score",) if again], *columns)


def hash_embedder(dim: int = 64):
    """A deterministic provider of unit vectors from texts' words, for tests and offline use."""

    def embed(texts: list[str | None]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dim)
            for word in (text or "").lower().split():
                h = xxhash.xxh3_64_intdigest(word.encode())
                v[h % dim] += 1.0 if h >> 63 else -1.0
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else v).tolist())
        return out

    return embed


def embed_column(text: Column, provider, dim: int) -> Column:
    """Vectors of a text column from a provider, checked for dimension and finite entries."""

    @F.pandas_udf("array<float>")
    def made(s: pd.Series) -> pd.Series:
        vectors = provider(list(s))
        if any(len(v) != dim or not np.isfinite(v).all() for v in vectors):
            raise ValueError(f"the provider's vectors have finite entries and dimension {dim}")
        return pd.Series([np.asarray(v, dtype=np.float32) for v in vectors])

    return made(text)
