"""Operator 7 against brute force over windows, its suffix order against plain comparison."""

import hashlib
import random

import numpy as np

from tessera.llm.suffix_dedup import copied_windows, longest_previous, remove_copies, rolling, window_minima


def brute(rows, length):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return out


def result(df, **kw):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in remove_copies(df, **kw).collect())


def corpus(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    shared = [" ".join(word() for _ in range(rnd.randint(15, 90))) for _ in range(6)]
    rows = []
    for doc in range(n):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 60))) for _ in range(3)]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randrange(len(s))
            parts.insert(rnd.randrange(len(parts) + 1), s[a : a + rnd.randint(50, 400)])
        text = "".join(parts)
        if rows and rnd.random() < 0.3:
            text = rnd.choice(rows)[1] or ""
            at = rnd.randrange(len(text) + 1)
            text = text[:at] + rnd.choice(("", "X", "yy")) + text[at + rnd.randint(0, 2) :]
        rows.append((doc * 3, text))
    return rows


def test_against_brute_force(spark):
    rows = corpus(2, 150) + [(1000, None), (1001, ""), (1002, "a" * 350), (1003, "a" * 99), (1004, "ab" * 300), (1005, "a" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for length in (100, 60):
        assert result(df, length=length) == brute(rows, length)


def test_no_rows_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "x" * 50 + "y" * 90, 1), (1, "x" * 50 + "y" * 90, 1), (2, "x" * 50 + "y" * 90, 2)], "doc_id long, text string, kept long")
    assert [(r[0], r[2]) for r in result(df)] == [(1, 0), (1, 0), (2, 140)]
    assert result(df.filter("doc_id > 5")) == []
    odd = spark.createDataFrame([(None, "x" * 300), (None, "x" * 300), (4, "x" * 300)], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in remove_copies(odd).collect()) == [(False, 299), (True, 0), (True, 0)]


def test_pieces():
    rnd = np.random.default_rng(0)
    data = rnd.integers(0, 3, 300).astype(np.uint8)
    h = rolling(data, 13)
    texts = [data[i : i + 13].tobytes() for i in range(288)]
    assert len(h) == 288 and all((h[i] == h[j]) == (texts[i] == texts[j]) for i in range(288) for j in range(288))
    values = rnd.integers(0, 5, 100)
    assert window_minima(values, 7).tolist() == [i + int(values[i : i + 7].argmin()) for i in range(94)]
    s = rnd.integers(0, 2, 60).astype(np.uint8).tobytes()
    order = np.array(sorted(range(60), key=lambda i: s[i:]))
    share = lambda a, b: next((k for k in range(60) if s[a + k : a + k + 1] != s[b + k : b + k + 1] or a + k >= 60), 60)
    common = np.array([0] + [share(order[i - 1], order[i]) for i in range(1, 60)])
    want = [max([share(i, j) for j in range(i)], default=0) for i in range(60)]
    assert longest_previous(order, common, 1000).tolist() == want
    assert [c.tolist() for c in copied_windows([b"abcabcab" * 2, b"xabcabcabx"], 8)] == [[i for i in range(9) if (b"abcabcab" * 2)[i : i + 8] in [(b"abcabcab" * 2)[j : j + 8] for j in range(i)]], [1]]
