"""Operator 8, language-model scoring: a gated recurrent model beside an add-0.1 unigram, both learned from the corpus.

1. Each task counts its training texts' tokens batch by batch, Spark sums them: c of every token, N of all, V of distinct ones.
2. The most frequent tokens of at most TOKEN_BYTES bytes, at most `dictionary` of them (those with at least the count that
   this bound allows), go to every worker as a dictionary with their counts, so its size is bounded. Tokens outside it are
   handed on as rows and joined to the counts, so every token of every text is scored with its exact count, however large
   the vocabulary grows and however long its tokens are.
3. The recurrent model (tessera.llm.gru) knows the `vocabulary` most frequent tokens, the end and "other". It is trained
   in `rounds` rounds: in each, every task passes once over its part of the round's training texts and the tasks'
   parameters are averaged by tokens. Each round has another set of texts; together they are `share` of all (1: every
   training text is learned from once).
4. Whole texts are scored with the state carried from window to window. An "other" token costs the model's "other" and
   the token's share among other tokens by corpus counts (c + 0.1) / (N_other + 0.1 (V_other + 1)).

Defined cases: null and empty texts are their end alone; without training texts all counts are 0 and the base score of
a token is 0; repeated rows are scored each and learned from each; a row without an id has a null held_out, is scored and
never learned from; a very long text is scored whole, its state carried from window to window; an empty table gives an empty
result; only id, text and the fold enter the work, so further columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, slices, tidy, tree_merge
from tessera.llm.gru import GatedLm

END, OTHER, RESERVED = 0, 1, 2
SLICE = 1 << 17  # parameters averaged in one row
TOKEN_BYTES = 256


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts in a row, how many each has): maximal runs without ASCII blanks, A-Z lower-cased; null has none."""
    texts = pc.ascii_trim_whitespace(texts)
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.fill_null(pc.equal(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
    words = words.flatten()
    if blank.any():  # one empty word to Arrow
        words, sizes = words.filter(pc.greater(pc.binary_length(words), 0)), np.where(blank, 0, sizes)
    return words, sizes


def ranks_of(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Place of each word among the known ones; -1 for others."""
    return pc.fill_null(pc.index_in(words, value_set=known.cast(words.type)), -1).to_numpy(zero_copy_only=False)


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and how often each batch's texts have them; '' is the end."""
    for batch in slices(batches, "text", most_bytes=32 << 20, most_rows=1 << 14):
        found = words_of(batch.column("text"))[0].value_counts()
        for token, c in ((found.field(0), found.field(1)), (pa.array([""]), pa.array([batch.num_rows]))):
            yield from slices(iter([pa.RecordBatch.from_arrays([token.cast(pa.string()), c.cast(pa.int64())], names=["token", "c"])]), most_rows=1 << 16)
    tidy()


def repeats(owner: np.ndarray, tokens: pa.Array, texts: int) -> pa.Array:
    """A list for each text of its tokens, each once with how often it occurs; owner is each token's text, in order."""
    met = pa.table({"owner": owner, "token": tokens}).group_by(["owner", "token"], use_threads=False).aggregate([([], "count_all")])
    met = met.sort_by("owner").combine_chunks()
    offsets = np.r_[0, np.bincount(met["owner"].to_numpy(), minlength=texts).cumsum()]
    parts = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (met["token"].cast(pa.string()), met["count_all"].cast(pa.int64()))]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, names=["token", "times"]))


class LmScoring:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, held_out: Column, vocabulary: int, dictionary: int, share: float, rounds: int, hidden: int) -> None:
        self.docs = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].cast("string").alias("text"), held_out.alias("held_out"))
        self.spark, self.vocabulary, self.dictionary = docs.sparkSession, vocabulary, dictionary
        self.share, self.rounds, self.hidden = share, rounds, hidden
        self.training = self.docs.filter(~F.col("held_out"))

    def count(self) -> None:
        words = self.training.select("text").mapInArrow(tally, "token string, c long")
        self.counts = materialize(words.groupBy("token").agg(F.sum("c").alias("c")), "counts")
        self.n, self.v = (int(x or 0) for x in self.counts.agg(F.sum("c"), F.count("*")).first())
        self.n_end = int((self.counts.filter("token = ''").agg(F.sum("c")).first())[0] or 0)
        # The least count whose tokens fit the dictionary; equal counts go in or stay out together.
        short = self.counts.filter((F.col("token") != "") & (F.octet_length("token") <= TOKEN_BYTES))
        levels, room, least = short.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")), self.dictionary, None
        for row in levels.limit(self.dictionary + 1).toLocalIterator():
            if (room := room - row["n"]) < 0:
                break
            least = row["c"]
        chosen = short.filter(F.col("c") >= F.lit(least if least is not None else 1 << 62))
        table = chosen.select(F.col("token").cast("binary").alias("token"), "c").toArrow()
        table = table.sort_by([("c", "descending"), ("token", "ascending")])
        self.tokens, self.c = pa.concat_arrays(table.column("token").cast(pa.string()).chunks or [pa.array([], pa.string())]), table.column("c").to_numpy().astype(np.int64)
        known = self.c[: self.vocabulary - RESERVED]
        self.n_other, self.v_other = self.n - self.n_end - int(known.sum()), max(0, self.v - len(known) - (self.n_end > 0))
        self.start = GatedLm(np.r_[self.n_end, self.n_other, known], self.hidden)

    def shared(self):
        return self.spark.sparkContext.broadcast((self.tokens, self.c))

    def part(self, k: int) -> DataFrame:
        """The training texts of round k: the rounds' bounds meet, so no text falls between two of them."""
        bucket = F.pmod(F.xxhash64("doc"), F.lit(1000))
        low, high = (round(1000 * self.share * i / self.rounds) for i in (k, k + 1))
        return self.training.filter((bucket >= low) & (bucket < high))

    def train(self, table) -> np.ndarray:
        flat, top, hidden = self.start.flat(), self.vocabulary - RESERVED, self.hidden
        for k in range(self.rounds):
            sent = self.spark.sparkContext.broadcast(flat)

            def fit(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                ranks = table.value[0][:top]
                model, tokens, texts, held = None, 0, [], 0

                def learn() -> None:
                    nonlocal model, tokens
                    model = model or GatedLm(np.ones(len(ranks) + RESERVED), hidden, seed=None).load(sent.value)
                    tokens += model.fit(texts)

                for batch in slices(batches, "text"):
                    words, sizes = words_of(batch.column("text"))
                    got = ranks_of(words, ranks)
                    texts += np.split(np.where(got < 0, OTHER, got + RESERVED), sizes.cumsum()[:-1])
                    held += len(got)
                    if held > 1 << 20:
                        learn()
                        texts, held = [], 0
                if texts:
                    learn()
                if model is not None:
                    own, head = model.flat(), np.float64(tokens).tobytes()
                    for k in range(0, own.size, SLICE):  # slices meet in tasks of their own, so none holds many models
                        yield pa.RecordBatch.from_arrays([pa.array([str(k)]), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([head + own[k : k + SLICE].tobytes()], pa.binary())], names=["key", "chunk", "blob"])
                tidy()

            def add(held: tuple | None, blob: bytes) -> tuple:  # (tokens, sum of parameters by tokens); blobs hold the mean
                n = np.frombuffer(blob, np.float64, 1)[0]
                got = np.frombuffer(blob, np.float32, offset=8).astype(np.float64) * n
                return (n, got) if held is None else (held[0] + n, held[1] + got)

            def mean(held: tuple) -> bytes:
                return held[0].tobytes() + (held[1] / held[0]).astype(np.float32).tobytes()

            tasks = max(8, self.n // (self.rounds << 20))  # about 2^20 tokens a task at least: each task writes a whole model
            merged = tree_merge(self.part(k).select("text").coalesce(tasks).mapInArrow(fit, "key string, chunk long, blob binary"), lambda: None, add, mean).collect()
            if merged:
                flat = np.concatenate([np.frombuffer(r["blob"], np.float32, offset=8) for r in sorted(merged, key=lambda r: int(r["key"]))])
        return flat

    def score(self) -> DataFrame:
        self.count()
        table = self.shared()
        model = self.spark.sparkContext.broadcast(self.train(table))
        n, v, n_other, v_other, top = self.n, self.v, self.n_other, self.v_other, self.vocabulary - RESERVED
        hidden, n_end = self.hidden, self.n_end

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens, c = table.value
            # The last place, -1, is that of tokens outside the dictionary: they are joined later.
            base_of = np.r_[np.log10((c + 0.1) / (n + 0.1 * (v + 1))), 0.0]
            other_of = np.r_[np.log10((c + 0.1) / (n_other + 0.1 * (v_other + 1))), 0.0]
            other_of[: min(len(c), top)] = 0.0
            base_end = float(np.log10((n_end + 0.1) / (n + 0.1 * (v + 1))))
            lm = GatedLm(np.ones(min(len(tokens), top) + RESERVED), hidden, seed=None).load(model.value)
            row = TaskContext.get().partitionId() << 40

            def flush(parts: list[tuple], texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
                scores, at = lm.score(texts) / np.log(10), 0
                for *columns, other, rare in parts:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(other + scores[at : at + len(other)]), rare], names=["row", "doc", "held_out", "n_tokens", "n_known", "base", "score", "rare"])
                    at += len(other)

            parts, texts, held = [], [], 0
            for batch in slices(batches, "text"):
                size = batch.num_rows
                words, sizes = words_of(batch.column("text"))
                got = ranks_of(words, tokens)
                there, owner = got >= 0, np.repeat(np.arange(size), sizes)
                total = lambda of, owner=owner, size=size: np.bincount(owner, weights=of, minlength=size)
                parts.append((pa.array(row + np.arange(size)), batch.column("doc"), batch.column("held_out"), pa.array(sizes + 1), pa.array(total(there).astype(np.int64) + (n_end > 0)), pa.array(total(base_of[got]) + base_end), total(other_of[got]), repeats(owner[~there], words.filter(pa.array(~there)), size)))
                texts += np.split(np.where(there & (got < top), got + RESERVED, OTHER), sizes.cumsum()[:-1])
                row, held = row + size, held + len(got) + size
                if held > 1 << 21:
                    yield from flush(parts, texts)
                    parts, texts, held = [], [], 0
            if parts:
                yield from flush(parts, texts)
            del parts, texts
            tidy()

        schema = "row long, doc long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<token: string, times: long>>"
        done = materialize(self.docs.mapInArrow(run, schema), "scores")
        c = F.coalesce("c", F.lit(0))
        rare = done.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(self.counts, "token", "left")
        late = rare.groupBy("row").agg(
            F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("late_known"),
            F.sum(F.col("times") * F.log10((c + 0.1) / (n + 0.1 * (v + 1)))).alias("late_base"),
            F.sum(F.col("times") * F.log10((c + 0.1) / (n_other + 0.1 * (v_other + 1)))).alias("late_score"),
        )
        whole = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        return done.drop("rare").join(late, "row", "left").select("doc", "held_out", "n_tokens", whole("n_known", "late_known"), F.lit(n).cast("long").alias("train_tokens"), whole("base", "late_base"), whole("score", "late_score"))


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 1 << 14, dictionary: int = 1 << 19, share: float = 1.0, rounds: int = 2, hidden: int = 32) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10), one row for each row."""
    done = LmScoring(docs, id_col, text_col, held_out, vocabulary, dictionary, share, rounds, hidden).score()
    return done.withColumnsRenamed({"doc": "doc_id", "base": "base_score"})
