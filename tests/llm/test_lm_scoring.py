"""Operator 8: gradients, carried state, exact counts and base scores, and that the model beats the unigram."""

import inspect
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm.gru import NAMES, GatedLm
from tessera.llm.language_id import fold
from tessera.llm.lm_scoring import LmScoring, ranks_of, repeats, score_texts, words_of


def test_gradients():
    rnd = np.random.default_rng(0)
    m = GatedLm(rnd.integers(1, 50, 70), hidden=5)
    for name in NAMES:
        setattr(m, name, getattr(m, name).astype(np.float64))
    words, targets, fresh, h = rnd.integers(0, 70, (6, 4)), rnd.integers(0, 70, (6, 4)), rnd.random((6, 4)) < 0.2, rnd.standard_normal((4, 5)) * 0.1
    _, grads, _ = m.gradients(words, targets, fresh, h)
    for name, grad in zip(NAMES, grads, strict=True):
        a = getattr(m, name)
        for _ in range(5):
            at = tuple(int(rnd.integers(0, s)) for s in a.shape)
            old, two = a[at], []
            for d in (1e-5, -1e-5):
                a[at] = old + d
                two.append(m.gradients(words, targets, fresh, h)[0])
            a[at] = old
            assert abs((two[0] - two[1]) / 2e-5 - grad[at]) < 1e-6


def test_state_is_carried_through_whole_texts():
    rnd = np.random.default_rng(1)
    m = GatedLm(rnd.integers(1, 50, 70), hidden=8)
    texts = [rnd.integers(0, 70, n) for n in (0, 1, 5, 64, 63, 65, 200, 3)]
    for text, value in zip(texts, m.score(texts, width=3, window=16), strict=True):
        h, total = np.zeros((1, 8), np.float32), 0.0
        for a, b in zip(np.r_[0, text], np.r_[text, 0], strict=True):
            h = m.step(np.array([a]), h)[0]
            total += m.log_probs(h, np.array([b]))[0]
        assert value == pytest.approx(total, abs=1e-2)


def rows_of(n, seed=4):
    rnd = random.Random(seed)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    rows = [(i, " ".join(w for _ in range(rnd.randint(1, 60)) for w in ("The", rnd.choice(nouns), rnd.choice(verbs), f"x{rnd.randrange(10**6)}"))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "\t \n")]


def expected(rows):
    lower = lambda t: [w.lower() for w in (t or "").split()]  # noqa: E731  ASCII in these rows
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    counts = Counter(w for i, t in rows if not held[i] for w in [*lower(t), None])
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(lower(t)) + 1, sum(counts[w] > 0 for w in [*lower(t), None]), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*lower(t), None])) for i, t in rows}


@pytest.mark.parametrize("dictionary", [1 << 19, 40])
def test_counts_and_base_scores(spark, dictionary):
    rows = rows_of(160)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).repartition(3)
    got = score_texts(df, fold(F.col("doc_id"), 10) == 0, dictionary=dictionary, vocabulary=32, share=1.0, rounds=1, hidden=8).collect()
    want = expected(rows)
    assert len(got) == len(rows)
    for r in got:
        held, n_tokens, n_known, n, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n_tokens, n_known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])


@pytest.mark.parametrize("dictionary", [1 << 19, 45])
def test_scores_end_to_end(spark, dictionary):
    """score against one model trained here on the same texts and stepped token by token, with the share of OTHER tokens."""
    rows = [*rows_of(60), (990, "n1 " + "long" * 200), (991, "long" * 200 + " v2"), (992, "zzz")]
    vocabulary, hidden = 32, 8
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "doc_id long, text string")  # one task, so one model
    got = {r["doc_id"]: r["score"] for r in score_texts(df, fold(F.col("doc_id"), 10) == 0, dictionary=dictionary, vocabulary=vocabulary, rounds=1, hidden=hidden).collect()}
    lower = {i: [w.lower() for w in (t or "").split()] for i, t in rows}
    taught = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for i in taught for w in lower[i])
    n_end, n, v = len(taught), sum(counts.values()) + len(taught), len(counts) + 1
    order = sorted((w for w in counts if len(w) <= 256), key=lambda w: (-counts[w], w.encode()))
    kept = [w for w in order if sum(counts[x] >= counts[w] for x in order) <= dictionary][: vocabulary - 2]
    rank = {w: k + 2 for k, w in enumerate(kept)}
    n_other, v_other = n - n_end - sum(counts[w] for w in kept), v - 1 - len(kept)
    model = GatedLm(np.r_[n_end, n_other, [counts[w] for w in kept]], hidden)
    model.fit([np.array([rank.get(w, 1) for w in lower[i]], dtype=np.int64) for i in taught])
    for i, ws in lower.items():
        h, total = np.zeros((1, hidden), np.float32), 0.0
        for a, b in zip([None, *ws], [*ws, None], strict=True):
            code = lambda w: 0 if w is None else rank.get(w, 1)
            h = model.step(np.array([code(a)]), h)[0]
            total += model.log_probs(h, np.array([code(b)]))[0] / math.log(10)
            if b is not None and b not in rank:
                total += math.log10((counts[b] + 0.1) / (n_other + 0.1 * (v_other + 1)))
        assert got[i] == pytest.approx(total, rel=1e-3, abs=2e-2), i


def test_model_beats_the_unigram_on_held_out_texts(spark):
    df = spark.createDataFrame(rows_of(400), "doc_id long, text string").repartition(2)
    got = score_texts(df, fold(F.col("doc_id"), 10) == 0, vocabulary=128, share=1.0, rounds=2, hidden=16).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1] * 0.9  # log-probabilities: less negative


def test_nothing_to_learn_from_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = score_texts(df, F.lit(True)).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(0, 0, 0.0)] * 2
    assert score_texts(df.filter("doc_id > 5"), F.lit(False)).collect() == []


@pytest.mark.parametrize("changed", [{}, {"rounds": 3}])
def test_the_registered_setting_learns_from_every_training_text_once(spark, changed):
    df = spark.createDataFrame([(i, "a") for i in range(3000)], "doc_id long, text string")
    own = {k: p.default for k, p in inspect.signature(score_texts).parameters.items() if k in ("vocabulary", "dictionary", "share", "rounds", "hidden")} | changed
    lm = LmScoring(df, "doc_id", "text", fold(F.col("doc_id"), 10) == 0, **own)
    seen = Counter(r["doc"] for k in range(lm.rounds) for r in lm.part(k).collect())
    assert seen == {i: 1 for i in range(3000) if zlib.crc32(str(i).encode()) % 10}


def test_the_registered_vocabulary_covers_most_tokens(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{(i * 40 + j) % 5000}" for j in range(40))) for i in range(250)], "doc_id long, text string")
    own = {k: p.default for k, p in inspect.signature(score_texts).parameters.items() if k in ("vocabulary", "dictionary", "share", "rounds", "hidden")}
    lm = LmScoring(df, "doc_id", "text", F.lit(False), **own)
    lm.count()
    assert lm.n_other < lm.n / 2
    assert GatedLm(np.ones(own["vocabulary"])).class_b.size <= 2 * own["vocabulary"] ** 0.5


@pytest.mark.parametrize("words", [1, 3, 5, 70, 1000])
def test_classes_of_unlike_size_share_one_distribution(words):
    rnd = np.random.default_rng(2)
    m = GatedLm(np.sort(rnd.integers(1, 500, words))[::-1], hidden=6)
    for scale in (1, 30, 400):  # the last ones need each row's largest logit taken off
        for name in ("class_w", "word_w", "tail_w"):
            setattr(m, name, (rnd.standard_normal(getattr(m, name).shape) * 0.1 * scale).astype(np.float32))
        h = np.tanh(rnd.standard_normal((1, 6))).astype(np.float32)
        got = m.log_probs(np.repeat(h, words, axis=0), np.arange(words))
        layers = {c: (w[k], b[k]) for first, w, b in m.layers() for k, c in enumerate(range(first, first + len(w)))}

        def log_soft(w, b, h=h):
            x = (h[0].astype(np.float64) @ w) + b
            return x - x.max() - np.log(np.exp(x - x.max()).sum())

        head = log_soft(m.class_w, m.class_b)
        want = [head[m.group[i]] + (log_soft(*layers[int(m.group[i])])[m.cell[i]] if int(m.group[i]) in layers else 0) for i in range(words)]
        assert got == pytest.approx(np.array(want), rel=1e-4, abs=1e-3)


def test_gradients_of_large_weights():
    rnd = np.random.default_rng(3)
    m = GatedLm(rnd.integers(1, 50, 300), hidden=5)
    for name in NAMES:
        a = getattr(m, name).astype(np.float64)
        setattr(m, name, a * 2000 if name in ("class_w", "tail_w") else a)
    words, targets, fresh, h = rnd.integers(0, 300, (6, 4)), rnd.integers(0, 300, (6, 4)), rnd.random((6, 4)) < 0.2, np.zeros((4, 5))
    loss, grads, _ = m.gradients(words, targets, fresh, h)
    m.recur[1, 2] += 1e-7
    more = m.gradients(words, targets, fresh, h)[0]
    assert math.isfinite(loss) and (more - loss) / 1e-7 == pytest.approx(grads[1][1, 2], rel=1e-2, abs=1e-3)


def test_frequent_words_need_few_logits():
    """Of 2^14 words with counts by Zipf's law, a token needs much less than two square roots of them (256)."""
    counts = 1e6 / np.arange(1, (1 << 14) + 1)
    m = GatedLm(counts)
    size = np.zeros(m.class_b.size)
    for first, w, b in m.layers():
        size[first : first + len(w)] = b.shape[1]
    assert m.class_b.size + np.average(size[m.group], weights=counts) < 220
    assert np.bincount(m.group * 1000 + m.cell).max() == 1  # each word has a place of its own


def test_words_in_arrow_are_those_of_the_contract():
    texts = ["", None, " ", "\x1c", " a  B\t\nc\x0b\x0cD\r", "X Y   É\x1cz\x1f \u0085 \x00 Q", "abc", "\n", "é" * 300 + " " + "É"]
    words, sizes = words_of(pa.array(["skipped", *texts]).slice(1))
    want = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) for t in texts]
    assert (words.to_pylist(), sizes.tolist()) == ([w for t in want for w in t], [len(t) for t in want])
    assert ranks_of(words, pa.array(["c", "a"])).tolist() == [{"c": 0, "a": 1}.get(w, -1) for t in want for w in t]
    owner = np.repeat(np.arange(4), [0, 3, 0, 2])
    assert [{r["token"]: r["times"] for r in x} for x in repeats(owner, pa.array(["x", "y", "x", "x", "z"]), 5).to_pylist()] == [{}, {"x": 2, "y": 1}, {}, {"x": 1, "z": 1}, {}]
