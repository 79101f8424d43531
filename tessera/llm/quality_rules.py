"""Operator 1, quality rules: cutoffs whose false rejections are bounded by exact binomial tests on labelled rows.

Every row gets a fixed score from counts of its text (symbols, capitals, exclamation marks, repeated lines, repeated
words; higher is worse). Labelled good rows that pass the base rule are the holdout. For each stratum and each cutoff
of a fixed grid, H0 "more than `alpha` of the good rows score above the cutoff" is tested with the exact binomial tail
P(X <= k; n, alpha). The level `delta` is divided by the number of strata (Bonferroni); within a stratum the grid is
walked from the loosest cutoff to stricter ones and ends at the first that is not rejected, which keeps the level.
Of the cutoffs that passed, the one that rejects most labelled bad rows holds for the stratum, and among equals the
loosest; a stratum without one rejects nothing beyond the base rule.
With probability 1 - delta no stratum loses more than `alpha` of its good documents.

All of it is DataFrame expressions. Texts are read once; their counts are written to the shared folder. The cutoffs
are joined by broadcast while there are at most `broadcast_strata` of them, else by a shuffle on the stratum.

Defined cases: a null or empty text has zero words and fails the base rule; a null stratum is the stratum ''; labels
that are null or name no row count for nothing; a row that repeats an id counts as often as it appears; without labels
nothing but the base rule rejects; a very long text is counted whole; a row without an id is judged and names no label;
an empty table gives an empty result; only id, text and stratum enter the work, so further columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import UPPER, let, materialize, split_words

SYMBOLS, BLANK_CHARS = "#*$%&|<>", " \t\n\x0b\x0c\r"
#: Share of each count at which a text looks like junk; the score is the largest count over its share.
SCALES = {"symbols": 0.10, "capitals": 0.30, "shouts": 0.20, "lines": 0.30, "repeats": 0.30}
GRID = (3.0, 2.5, 2.0, 1.75, 1.5, 1.25, 1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)


def repeated_words(words: Column, window: int = 3) -> Column:
    """Words inside windows that occur at least twice in the array, first occurrences included."""

    def by_window(hashes: Column) -> Column:
        def covered(order: Column) -> Column:
            last = F.size(order) - 1

            def same(i: Column, j: Column) -> Column:
                return order[i]["h"] == order[j]["h"]

            twins = F.filter(F.sequence(F.lit(0), last), lambda i: ((i > 0) & same(F.greatest(i - 1, F.lit(0)), i)) | ((i < last) & same(i, F.least(i + 1, last))))
            spots = F.flatten(F.transform(twins, lambda i: F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda j: order[i]["i"] + j)))
            return F.size(F.array_distinct(spots))

        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(ordered, covered))

    def of(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(ws) - window)
        return F.when(F.size(ws) <= window, 0).otherwise(let(F.transform(starts, lambda i: F.xxhash64(*[ws[i + j] for j in range(window)])), by_window))

    return let(words, of)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts of every whole text."""
    text = F.coalesce(docs[text_col], F.lit(""))
    dropped = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != "")
    both = let(lines, lambda ls: F.struct(F.size(ls).alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines")))
    words = let(split_words(text), lambda ws: F.struct(F.size(ws).alias("n_words"), repeated_words(ws).alias("n_repeat_words")))
    wide = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[stratum_col].cast("string"), F.lit("")).alias("stratum"), words.alias("w"), both.alias("l"),
        F.length(F.translate(text, BLANK_CHARS, "")).cast("long").alias("word_chars"), dropped(SYMBOLS).alias("n_symbols"), dropped(UPPER).alias("n_capitals"), dropped("!").alias("n_shouts"),
    )
    long = {f"{s}.{n}": n for s, n in (("w", "n_words"), ("w", "n_repeat_words"), ("l", "n_lines"), ("l", "n_dup_lines"))}
    return wide.select("doc_id", "stratum", *[F.col(k).cast("long").alias(n) for k, n in long.items()], "word_chars", "n_symbols", "n_capitals", "n_shouts")


def score() -> Column:
    share = lambda part, whole, key: F.col(part) / F.greatest(F.col(whole), F.lit(1)) / F.lit(SCALES[key])
    return F.greatest(share("n_symbols", "word_chars", "symbols"), share("n_capitals", "word_chars", "capitals"), share("n_shouts", "n_words", "shouts"), share("n_dup_lines", "n_lines", "lines"), share("n_repeat_words", "n_words", "repeats"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), summed term by term in logarithms: exact to rounding, for k up to about p n."""
    odds = F.log(F.lit(p)) - F.log(F.lit(1 - p))
    first = F.struct((n * F.log(F.lit(1 - p))).alias("term"), F.exp(n * F.log(F.lit(1 - p))).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, first, step, lambda acc: F.least(acc["total"], F.lit(1.0)))


def cutoffs(scored: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """stratum, cutoff, n_good, n_above, n_bad_above, p_value: of the cutoffs of a stratum that passed their tests, the
    one that rejects most bad rows, the loosest of equals."""
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), (labels[label_col] == 1).alias("good")).filter("good IS NOT NULL").groupBy("doc_id").agg(F.min("good").alias("good"))
    holdout = scored.filter(~F.col("base_failed")).select("doc_id", "stratum", "score").join(known, "doc_id")
    grid = holdout.select("stratum", "good", "score", F.explode(F.array(*[F.lit(c) for c in GRID])).alias("cutoff"))
    above = F.col("score") > F.col("cutoff")
    tested = grid.groupBy("stratum", "cutoff").agg(F.count_if("good").alias("n_good"), F.count_if(F.col("good") & above).alias("n_above"), F.count_if(~F.col("good") & above).alias("n_bad_above"))
    # Beyond alpha n errors the tail is above one half: no test passes there and no sum is needed.
    p_value = F.when(F.col("n_above") > alpha * F.col("n_good"), 1.0).otherwise(binomial_tail(F.col("n_above"), F.col("n_good"), alpha))
    tested = materialize(tested.withColumn("p_value", p_value), "tests")
    strata = max(1, tested.select("stratum").distinct().count())
    # The tail grows as the cutoff falls, so all that pass come before the walk's end.
    best = F.max_by(F.struct("cutoff", "n_good", "n_above", "n_bad_above", "p_value"), F.struct("n_bad_above", "cutoff"))
    return tested.filter(F.col("p_value") <= delta / strata).groupBy("stratum").agg(best.alias("c")).select("stratum", "c.*")


def quality_verdicts(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", broadcast_strata: int = 10_000) -> DataFrame:
    """doc_id, the counts, score, base_failed, cutoff (null where the stratum has none) and kept, one row for each row."""
    scored = materialize(counts(docs, id_col, text_col, stratum_col).withColumn("score", score()).withColumn("base_failed", base_failed()), "quality")
    chosen = materialize(cutoffs(scored, labels, alpha, delta).select("stratum", "cutoff"), "cutoffs")
    few = chosen.count() <= broadcast_strata
    joined = scored.join(F.broadcast(chosen) if few else chosen, "stratum", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("score") > F.col("cutoff"), F.lit(False)))
