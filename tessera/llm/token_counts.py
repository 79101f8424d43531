"""Operator 4, token counts: byte-pair merging of batched pre-tokens by rank-synchronous numpy rounds.

The tokenizer file is read, its library is not used: texts are cut into pre-tokens, the pre-tokens that a task has
not met lately are laid out as one ragged array of symbol ids, and each round merges, in every sequence at once, all
occurrences of that sequence's lowest-rank pair. The surviving symbols of a sequence are its tokens.

Defined cases: null text has 0 bytes and 0 tokens; empty text too; special strings inside a text count one token
each, as the library does by default; a very long text, or one word of any length, is counted whole; repeated rows give
repeated rows; a row without an id is counted; an empty table gives an empty result; further columns of the input, whatever
their names, are kept out of the result. Memory: one slice of texts and a cache of `cache_size` pre-tokens.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import slices

#: str.split() also splits at these four, which are not Unicode white space.
CONTROLS = re.compile("[\x1c-\x1f]")
SPACES = regex.compile(r"\p{White_Space}+")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class MergeTable:
    """Vocabulary and merge ranks as arrays: pair keys sorted for lookup, with the rank and the symbol made."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]], end: str) -> None:
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in chars], dtype=np.int64)
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.none = np.int32(len(merges))
        # Open addressing, at most a quarter full; a slot holds a merge's rank, and slot `none` no merge.
        self.bits = max(4, (4 * len(merges)).bit_length())
        slots = np.full(1 << self.bits, self.none, dtype=np.int32)
        left = np.arange(len(merges), dtype=np.int32)
        self.probes = 0
        while len(left):
            home = self._slot(keys[left], self.probes)
            first = np.zeros(len(left), dtype=bool)
            first[np.unique(home, return_index=True)[1]] = True
            first &= slots[home] == self.none
            slots[home[first]] = left[first]
            left = left[~first]
            self.probes += 1
        self.slots = slots
        self.keys, self.made = np.r_[keys, np.int64(-1)], np.r_[made, np.int64(-1)].astype(np.int32)

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (((mixed >> np.uint64(64 - self.bits)) + np.uint64(probe)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, `none` where it has none."""
        found = self.slots[self._slot(pairs, 0)]
        open_ = np.flatnonzero(self.keys[found] != pairs)
        for probe in range(1, self.probes):
            open_ = open_[found[open_] != self.none]
            if not len(open_):
                break
            found[open_] = self.slots[self._slot(pairs[open_], probe)]
            open_ = open_[self.keys[found[open_]] != pairs[open_]]
        found[open_] = self.none
        return found

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word; an empty word has none."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        result = np.zeros(len(words), dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes)[sizes > 0] - 1
        symbols[ends] = self.last[raw[ends]]
        while len(symbols):
            pair = (symbols[:-1] << 32) | symbols[1:]
            same = owner[:-1] == owner[1:]
            rank = np.where(same, self.ranks(pair), self.none)
            starts = np.flatnonzero(np.r_[True, ~same])
            lowest = np.minimum.reduceat(np.r_[rank, self.none], starts)
            lengths = np.diff(np.r_[starts, len(symbols)])
            live = lowest < self.none
            result[owner[starts[~live]]] = lengths[~live]
            hit = np.flatnonzero((rank < self.none) & (rank == np.repeat(np.where(live, lowest, -1), lengths)[:-1]))
            if not len(hit):
                break
            # In a run of overlapping occurrences (a a a) the first, third, ... merge.
            new_run = np.r_[True, np.diff(hit) > 1]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            keep = np.repeat(live, lengths)
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return result


_LOADED: dict[str, WordBpe] = {}


class WordBpe:
    """Counts tokens of texts as a word-ended BPE tokenizer.json defines them."""

    def __init__(self, spec: dict, cache_size: int = 1_000_000) -> None:
        model = spec["model"]
        self.table = MergeTable(model["vocab"], model["merges"], model["end_of_word_suffix"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(pattern).findall
        self.cache: dict[str, int] = {}
        self.cache_size = cache_size

    @classmethod
    def from_file(cls, path: str, **kw) -> WordBpe:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f), **kw)

    @classmethod
    def shared(cls, path: str) -> WordBpe:
        """One instance for each worker process, whose cache later tasks find filled."""
        if path not in _LOADED:
            _LOADED[path] = cls.from_file(path)
        return _LOADED[path]

    def chunks(self, text: str) -> tuple[list[str], int]:
        """The text's white-space-separated chunks, which no pre-token crosses, and the number of special strings in it."""
        if self.special and (parts := self.special.split(text))[1:]:
            return [c for part in parts for c in self.plain_chunks(part)], len(parts) - 1
        return self.plain_chunks(text), 0

    def plain_chunks(self, text: str) -> list[str]:
        # Lower-casing is by character, so a capital sigma never becomes the final form.
        text = unicodedata.normalize("NFC", text)
        text = (text.replace("Σ", "σ") if "Σ" in text else text).lower()
        return SPACES.split(text) if CONTROLS.search(text) else text.split()

    def learn(self, fresh: list[str]) -> None:
        """Put the token counts of these chunks into the cache."""
        cut = [[c] if c.isalpha() else [c[:-1], c[-1]] if c[:-1].isalpha() and not c[-1].isnumeric() else self.words(c) for c in fresh]
        counts = self.table.count([w.encode() for words in cut for w in words])
        ends = np.cumsum([len(words) for words in cut])
        sums = np.r_[0, np.cumsum(counts)][np.r_[0, ends]]
        self.cache.update(zip(fresh, np.diff(sums).tolist(), strict=True))

    def count_batch(self, texts: list[str]) -> list[int]:
        cut = [self.chunks(t) for t in texts]
        met = set().union(*(chunks for chunks, _ in cut))
        if fresh := list(met - self.cache.keys()):
            if len(self.cache) + len(fresh) > self.cache_size:
                self.cache.clear()
                fresh = list(met)
            for at in range(0, len(fresh), 100_000):
                self.learn(fresh[at : at + 100_000])
        return [sum(map(self.cache.__getitem__, chunks)) + extra for chunks, extra in cut]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text, and whether it has more than `limit` tokens.

    tokenizer: path of a word-ended BPE tokenizer.json, at the same place on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.shared(tokenizer)
        for batch in slices(batches, text_col, 8 << 20):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            tokens = bpe.count_batch(texts)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col]).mapInArrow(run, SCHEMA)
