"""Operator 9, language identification: multinomial naive Bayes over hashed character n-grams.

Training sums n-gram bucket counts for each language over all labelled rows: each task adds up dense vectors of
`buckets` counts, which are merged in rounds; the result is one vector a language, fixed in size by `buckets` and
`max_languages`. The smoothed log-probability matrix is broadcast and batches are scored in numpy.

Defined cases: a text that is null or has no letter is `und` with score 0; if nothing can be learned every text is
`und`; ties between languages go to the first in sort order; a very long text counts whole; a row without an id is predicted,
and no fold holds it out or trains on it; repeated rows give repeated rows; an empty table gives an empty result; only id,
text and label enter the work, so further columns never clash. More than `max_languages` languages raise an error, because the matrix is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, tree_merge


def grams(text: str, buckets: int, orders: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """Bucket of every n-gram of the lower-cased text, as one flat array. buckets: a power of two."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    parts, rolled = [], np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, max(orders) + 1):
        if len(codes) < n:
            break
        rolled = (rolled[: len(codes) - n + 1] * np.uint32(0x01000193)) ^ codes[n - 1 :]
        if n in orders:
            parts.append(((rolled + np.uint32(n)) * np.uint32(0x9E3779B1)) >> shift)
    return np.concatenate(parts)


def train(rows: DataFrame, text_col: str = "text", label_col: str = "lang", buckets: int = 1 << 16, max_languages: int = 256, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """(languages in order, float32 matrix languages x buckets of log probabilities), from all rows with text and label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, text_col):
            for text, label in zip(batch.column(text_col).to_pylist(), batch.column(label_col).to_pylist(), strict=True):
                if label not in sums:
                    sums[label] = np.zeros(buckets, dtype=np.int64)
                    if len(sums) > max_languages:
                        raise ValueError(f"more than {max_languages} languages")
                got = grams(text, buckets)
                if len(got) * 8 > buckets:
                    sums[label] += np.bincount(got, minlength=buckets)
                else:
                    np.add.at(sums[label], got, 1)
        if sums:
            chunk = hash(tuple(int(v.sum()) for v in sums.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([chunk & 0x7FFFFFFF] * len(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["key", "chunk", "blob"])

    def plus(held: np.ndarray, blob: bytes) -> np.ndarray:
        held += np.frombuffer(blob, np.int64)
        return held

    usable = rows.select(rows[text_col], rows[label_col].cast("string").alias(label_col)).filter(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    parts = usable.mapInArrow(count, "key string, chunk long, blob binary")
    sums = tree_merge(parts, lambda: np.zeros(buckets, dtype=np.int64), plus, lambda a: a.tobytes())
    found = {r["key"]: np.frombuffer(r["blob"], np.int64) for r in sums.toLocalIterator()}
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    names = sorted(found)
    counts = np.array([found[n] for n in names], dtype=np.float64).reshape(len(names), buckets) + smoothing
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, names: list[str], logp: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id, lang_pred and score: the posterior under equal priors, with the evidence of a text taken as the
    mean over its n-grams times the square root of their number, so that long texts do not all round to 1."""
    model = docs.sparkSession.sparkContext.broadcast((names, np.ascontiguousarray(logp)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = model.value
        # A batch is a sparse matrix of rows of bucket numbers: one gather and one sum by rows for each language.
        for batch in slices(batches, text_col, 1 << 20):
            texts = batch.column(text_col).to_pylist()
            told = [i for i, t in enumerate(texts) if langs and t is not None and (t[:64].isalpha() or any(map(str.isalpha, t)))]
            best, scores = ["und"] * len(texts), np.zeros(len(texts))
            if told:
                rows = [grams(texts[i], matrix.shape[1]) for i in told]
                sizes = np.array([len(r) for r in rows])
                flat, starts = np.concatenate(rows), np.r_[0, np.cumsum(sizes)[:-1]]
                total = np.stack([np.add.reduceat(row[flat].astype(np.float64), starts) for row in matrix], axis=1)
                pick = total.argmax(axis=1)
                share = np.exp((total - total[np.arange(len(told)), pick][:, None]) / np.sqrt(sizes)[:, None])
                scores[told] = 1.0 / share.sum(axis=1)
                for i, k in zip(told, pick.tolist(), strict=True):
                    best[i] = langs[k]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(best, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col]).mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
