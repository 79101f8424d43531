"""Operator 3, benchmark decontamination: a prefix-filtered join of word shingles with exact windows.

A window is `window` consecutive words of a benchmark item (the whole item if it is shorter). Seen as a set of
`width`-word shingles at fixed offsets, a window occurs in a document exactly if all its shingles do, at the same
distance from one start. So containment is joined as sets:

1. One pass over the texts hashes every `width`-word shingle and keeps those that any benchmark window has (a join
   against the benchmark's shingles, broadcast while they are at most `broadcast_shingles`, else a shuffle).
2. Shingles are ordered by rarity: the number of kept occurrences in the corpus. For containment the necessary prefix
   is the single rarest shingle of a window, so only its occurrences propose starts.
3. Length and positional bounds drop starts before the text's first word or past its last.
4. A start is verified by finding every other shingle of the window at its place; shingles are 64-bit hashes, and all
   of a window's must agree.

Everything is DataFrame operations; rows that shuffle are the kept occurrences, not the texts.

Defined cases: null and empty texts have no words; a very long text is one row like any other, matched to its end; an item
without words has no window; items with equal windows are all reported; rows that repeat an id count as one document, hit
where any of them is and as long as the longest (rows without an id too, and they have no hits); an empty benchmark leaves
all clean; an empty table gives an empty result; only id and text enter the work, so further columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, let, materialize, split_words

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text), GAPS)


def shingle_hashes(words: Column, width: int) -> Column:
    """64-bit hashes of every run of `width` words, in order; none where there are fewer words."""

    def of(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(ws) - width)
        return F.when(F.size(ws) < width, F.array().cast("array<bigint>")).otherwise(F.transform(starts, lambda i: F.xxhash64(F.lit(width), *[ws[i + j] for j in range(width)])))

    return let(words, of)


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 13, width: int = 5) -> DataFrame:
    """item, win (a 64-bit id of the window's content), length, w (its shingle width), off, h: a row for each shingle of each window."""
    items = benchmark.select(benchmark[id_col].cast("string").alias("item"), words_of(benchmark[text_col]).alias("ws")).filter(F.size("ws") > 0)
    length = F.least(F.size("ws"), F.lit(window))
    starts = F.sequence(F.lit(0), F.size("ws") - length)
    each = items.select("item", length.alias("length"), F.explode(F.transform(starts, lambda s: F.slice(F.col("ws"), s + 1, length))).alias("words"))
    each = each.select("item", "length", F.xxhash64(F.array_join("words", " ")).alias("win"), F.least(F.col("length"), F.lit(width)).alias("w"), "words").distinct()
    hashes = F.lit(None).cast("array<bigint>")
    for n in range(1, width + 1):
        hashes = F.when(F.col("w") == n, shingle_hashes(F.col("words"), n)).otherwise(hashes)
    return each.select("item", "win", "length", "w", F.posexplode(hashes).alias("off", "h"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, width: int = 5, percent: int = 5, broadcast_shingles: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids), contaminated (n_hit at least `percent` of n_words), one row
    for each document id."""
    wins = materialize(windows(benchmark, item_col, item_text_col, window, width), "windows")
    tokens = materialize(wins.select("h").distinct(), "shingles")
    shapes = materialize(wins.groupBy("win", "length", "off", "h").agg(F.lit(1).alias("_")).drop("_"), "shapes")
    # Each side that is broadcast is counted itself: a window has a row for every one of its shingles.
    few, few_shapes = tokens.count() <= broadcast_shingles, shapes.count() <= broadcast_shingles
    widths = sorted(r["w"] for r in wins.select("w").distinct().collect())  # at most `width` of them

    parsed = docs.select(docs[id_col].cast("long").alias("doc"), words_of(docs[text_col]).alias("ws"))
    def marked_with(n: int, hashes: Column) -> Column:
        return F.transform(hashes, lambda h, i: F.struct(F.lit(n).alias("w"), i.alias("pos"), h.alias("h")))

    # The first entry holds the number of words; it stays for every row, kept shingles or not.
    entries = let(F.col("ws"), lambda ws: F.concat(F.array(F.struct(F.lit(0).alias("w"), F.lit(-1).alias("pos"), F.size(ws).cast("long").alias("h"))), *[marked_with(n, shingle_hashes(ws, n)) for n in widths]))
    rows = parsed.select("doc", F.explode(entries).alias("e")).select("doc", "e.*")
    marked = tokens.withColumn("known", F.lit(True))
    if few:
        kept = rows.join(F.broadcast(marked), "h", "left").filter("w = 0 OR known").select("doc", "w", "pos", "h")
    else:
        kept = rows.filter("w > 0").join(marked, "h").select("doc", "w", "pos", "h").unionByName(rows.filter("w = 0").select("doc", "w", "pos", "h"))
    kept = materialize(kept, "occurrences")
    sizes = kept.filter("w = 0").groupBy("doc").agg(F.max("h").alias("n_words"))
    found = kept.filter("w > 0").select("doc", "pos", "h").distinct()

    rarity = found.groupBy("h").agg(F.count("*").alias("n"))
    prefix = shapes.join(rarity, "h").groupBy("win", "length").agg(F.min(F.struct("n", "h", "off")).alias("rare"), F.count("*").alias("n_shingles"))
    # A window with a shingle that no document has occurs nowhere.
    full = wins.groupBy("win").agg(F.count_distinct("off").alias("n_all"))
    prefix = prefix.join(full, "win").filter("n_shingles = n_all").select("win", "length", "n_all", F.col("rare.h").alias("h"), F.col("rare.off").alias("rare_off"))

    # A window has one row in prefix and several in shapes, whose rows have been counted.
    small = F.broadcast if few_shapes else lambda frame: frame
    starts = found.join(small(prefix), "h").select("doc", "win", "length", "n_all", (F.col("pos") - F.col("rare_off")).alias("start"))
    bounded = starts.join(sizes, "doc").filter("start >= 0 AND start + length <= n_words").select("doc", "win", "length", "n_all", "start").distinct()
    wanted = bounded.join(small(shapes.select("win", "off", "h")), "win").select("doc", "win", "length", "n_all", "start", "h", (F.col("start") + F.col("off")).alias("pos"))
    verified = wanted.join(found, ["doc", "pos", "h"]).groupBy("doc", "win", "length", "n_all", "start").agg(F.count("*").alias("n")).filter("n = n_all")
    verified = materialize(verified.select("doc", "win", "length", "start"), "verified")

    spans = verified.select("doc", "start", "length").distinct().groupBy("doc").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))).cast("long")
    items = verified.select("doc", "win").distinct().join(wins.select("win", "item").distinct(), "win").select("doc", "item").distinct()
    named = items.groupBy("doc").agg(F.array_sort(F.collect_list("item")).alias("items"))
    hits = spans.select("doc", covered.alias("n_hit")).join(named, "doc")
    joined = sizes.join(hits, "doc", "left").select("doc", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    bad = (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
    return joined.select(F.col("doc").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", bad.alias("contaminated"))
