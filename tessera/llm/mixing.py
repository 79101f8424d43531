"""Operator 10, mixing sources to target weights: temperature, bisected, realised by budgeted block permutations.

Weights are w_s ~ p_s ** alpha for the sources' token shares p_s. alpha = 1 keeps the shares, 0 makes them equal. It is
found by bisection: the entropy of w rises as alpha falls to 0, and so does the largest number of epochs w_s B / T_s a
source is read in, so the flattest mixture is taken that stays at or below the wanted entropy and within the
repetition limit. The budget B is given, or the least that reads every source at least once.

A source's share of the budget is whole epochs and a rest. An epoch is a permutation in two levels: documents are dealt
to about sqrt(n) blocks by a hash, blocks are ordered by a hash that depends on the epoch, and documents within a block
by another. The rest epoch takes documents in that order while their tokens fit the budget: whole blocks by block
sums, one block in part. So the only ordered sums run over the blocks of a source and over one block; a source with a
third of all rows is as parallel as its blocks. Every number that decides is an integer or rounded to one.

Sources are few (`max_sources`, checked); their statistics are on the driver, documents never are.

Defined cases: a null source is the source ''; null texts have no tokens and take part like empty ones (they go with
the first block they are dealt to); sources without tokens get weight 0 and are read once; an empty table gives an
empty result; repeated rows, rows of one id in several sources and rows without an id are each a document of their own, in
their own source's plan; a very long text is one document. mix() replaces columns named epoch, block_order and doc_order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import split_words

STEPS = 60


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(tokens: list[int], alpha: float) -> list[float]:
    """Normalised powers of the token shares; 0 for sources without tokens."""
    total = max(1, sum(tokens))
    raw = [(t / total) ** alpha if t else 0.0 for t in tokens]
    whole = math.fsum(raw)
    return [r / whole for r in raw] if whole else raw


def epochs(tokens: list[int], alpha: float, budget: int | None) -> list[float]:
    """Times each source is read; without a budget the one read least is read once."""
    weights = tempered(tokens, alpha)
    rates = [w / t if t else 0.0 for w, t in zip(weights, tokens, strict=True)]
    if budget is None:
        least = min((r for r in rates if r), default=1.0)
        return [r / least for r in rates]
    return [r * budget for r in rates]


def solve_alpha(tokens: list[int], target_entropy: float | None = None, max_epochs: float | None = 4.0, budget: int | None = None) -> float:
    """The least alpha in [0, 1] whose mixture has at most the entropy target_entropy and no source read more than
    max_epochs times; 1 where even the plain shares break a limit."""

    def fits(alpha: float) -> bool:
        flat = target_entropy is None or entropy(tempered(tokens, alpha)) <= target_entropy
        return flat and (max_epochs is None or max(epochs(tokens, alpha, budget), default=0.0) <= max_epochs)

    if fits(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def _hash(*parts: Column) -> Column:
    """A 60-bit number from the md5 of the parts, the same in other SQL engines."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def plan_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = None, max_epochs: float | None = 4.0, budget: int | None = None, seed: int = 17, max_sources: int = 100_000) -> DataFrame:
    """id, source, n_tokens, epoch (from 0), block_order, doc_order (the place in the epoch is their order) and weight,
    a row for each time a document is read."""
    return _planned(docs, id_col, text_col, source_col, target_entropy, max_epochs, budget, seed, max_sources, [])


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, target_entropy: float | None, max_epochs: float | None, budget: int | None, seed: int, max_sources: int, carried: list[Column]) -> DataFrame:
    """The plan, with further columns of docs carried along, so that nothing needs to be joined back to its document."""
    sized = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source"), F.size(split_words(docs[text_col])).cast("long").alias("n_tokens"), *carried)
    stats = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).limit(max_sources + 1).collect()
    if len(stats) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    stats = sorted(stats, key=lambda r: r["source"])
    tokens = [int(r["tokens"]) for r in stats]
    alpha = solve_alpha(tokens, target_entropy, max_epochs, budget)
    times, weights = epochs(tokens, alpha, budget), tempered(tokens, alpha)
    plan = []
    for r, t, share, w in zip(stats, tokens, times, weights, strict=True):
        whole, rest = (int(round(share * t)) // t, int(round(share * t)) % t) if t else (1, 0)
        plan.append((r["source"], max(1, math.isqrt(r["docs"])), whole, rest, float(w)))
    spark = docs.sparkSession
    quota = F.broadcast(spark.createDataFrame(plan, "source string, blocks long, whole long, rest long, weight double"))

    # A row for each epoch the document may be in: the whole ones, and the rest where there is one.
    last = F.col("whole") + F.when(F.col("rest") > 0, 1).otherwise(0) - 1
    dealt = sized.join(quota, "source").filter(last >= 0).withColumn("block", F.pmod(_hash(F.lit(str(seed)), F.col("id").cast("string")), F.col("blocks")))
    each = dealt.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    key = lambda *c: _hash(F.lit(str(seed)), F.col("epoch").cast("string"), *c)
    each = each.withColumn("block_order", key(F.col("source"), F.col("block").cast("string"))).withColumn("doc_order", key(F.col("id").cast("string")))

    full = each.filter("epoch < whole")
    partial = each.filter("epoch = whole")
    order = ["block_order", "block"]
    sums = partial.groupBy("source", "rest", *order).agg(F.sum("n_tokens").alias("block_tokens"))
    before = sums.withColumn("before", F.sum("block_tokens").over(Window.partitionBy("source").orderBy(*order)) - F.col("block_tokens")).filter("before < rest").select("source", "block", "before")
    inside = Window.partitionBy("source", "block").orderBy("doc_order", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    taken = partial.join(before, ["source", "block"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside)).filter("upto <= rest")
    columns = ["id", "source", "n_tokens", "epoch", "block_order", "doc_order", "weight", *sized.columns[3:]]
    return full.select(*columns).unionByName(taken.select(*columns))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = None, max_epochs: float | None = 4.0, budget: int | None = None, seed: int = 17, max_sources: int = 100_000) -> DataFrame:
    """The columns of docs once for each time a document is read, with epoch, block_order and doc_order. A row is read by its
    own plan, whatever id it has, so the budget holds for repeated ids and rows without one too."""
    names = [c for c in docs.columns if c.lower() not in ("epoch", "block_order", "doc_order")]
    whole = F.struct(*[docs[c].alias(c) for c in names]).alias("_document")
    plan = _planned(docs, id_col, text_col, source_col, target_entropy, max_epochs, budget, seed, max_sources, [whole])
    return plan.select(*[F.col("_document").getField(c).alias(c) for c in names], "epoch", "block_order", "doc_order")
