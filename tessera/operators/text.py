"""Full-text search: a query language, scoring, snippets and highlights over ASCII-lower-cased word tokens.

Grammar: terms are ANDed; OR separates groups; NOT x and -x forbid; "a b" is a phrase; pre* a prefix. A row matches if
a group is satisfied and nothing forbidden occurs in that group; its score is the largest over its groups of the sum of
the clauses' counts (a phrase counts its length for each occurrence)."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.retrieval import top


@dataclass(frozen=True)
class Clause:
    tokens: tuple[str, ...]
    prefix: bool = False
    forbidden: bool = False


@dataclass(frozen=True)
class FtsOptions:
    case_sensitive: bool = False
    prefix_queries: bool = True
    min_token_len: int = 1
    stopwords: frozenset[str] = frozenset()


def tokens(text: str | None, options: FtsOptions = FtsOptions()) -> list[str]:
    words = re.findall(r"[A-Za-z0-9]+", text or "")
    words = words if options.case_sensitive else [w.lower() for w in words]
    return [w for w in words if len(w) >= options.min_token_len and w not in options.stopwords]


def parse(query: str, options: FtsOptions = FtsOptions()) -> list[list[Clause]]:
    groups: list[list[Clause]] = [[]]
    forbid = False
    for m in re.finditer(r'(-?)"([^"]*)"|(\S+)', query):
        word = m[3]
        if word == "OR":
            groups.append([])
            forbid = False
            continue
        if word == "NOT":
            forbid = True
            continue
        no = forbid or m[1] == "-" or bool(word and word.startswith("-"))
        forbid = False
        body = m[2] if word is None else word.lstrip("-")
        prefix = options.prefix_queries and word is not None and body.endswith("*")
        if found := tokens(body, options):
            groups[-1].append(Clause(tuple(found), prefix, no))
    return [g for g in groups if any(not c.forbidden for c in g)]


def count(clause: Clause, words: list[str]) -> int:
    n, want = len(clause.tokens), clause.tokens
    if clause.prefix:
        return sum(words[i : i + n - 1] == list(want[:-1]) and words[i + n - 1].startswith(want[-1]) for i in range(len(words) - n + 1)) * n
    if n == 1:
        return words.count(want[0])
    return sum(tuple(words[i : i + n]) == want for i in range(len(words) - n + 1)) * n


def score(groups: list[list[Clause]], words: list[str]) -> float | None:
    best = None
    for group in groups:
        counts = [(c, count(c, words)) for c in group]
        if any(n and c.forbidden for c, n in counts) or any(not n and not c.forbidden for c, n in counts):
            continue
        best = max(best or 0.0, float(sum(n for c, n in counts if not c.forbidden)))
    return best


def _wanted(groups: list[list[Clause]]) -> tuple[set[str], tuple[str, ...]]:
    clauses = [c for g in groups for c in g if not c.forbidden]
    return {t for c in clauses for t in (c.tokens[:-1] if c.prefix else c.tokens)}, tuple(c.tokens[-1] for c in clauses if c.prefix)


def snippet(text: str, groups: list[list[Clause]], options: FtsOptions = FtsOptions()) -> str:
    """Up to eight words: three before the first hit and four after it, every hit among them in brackets."""
    exact, starts = _wanted(groups)
    shown = []
    for w in re.findall(r"[A-Za-z0-9]+", text or ""):
        key = w if options.case_sensitive else w.lower()
        if tokens(w, options):
            shown.append((w, key in exact or (bool(starts) and key.startswith(starts))))
    first = next((i for i, (_, hit) in enumerate(shown) if hit), 0)
    left, right = max(0, first - 3), min(len(shown), first + 5)
    body = [f"[{w}]" if hit else w for w, hit in shown[left:right]]
    return " ".join([*(["..."] if left else []), *body, *(["..."] if right < len(shown) else [])])


def highlight(text: str, groups: list[list[Clause]], options: FtsOptions = FtsOptions()) -> str:
    exact, starts = _wanted(groups)

    def mark(m: re.Match) -> str:
        key = m[0] if options.case_sensitive else m[0].lower()
        return f"<b>{m[0]}</b>" if key in exact or (starts and key.startswith(starts)) else m[0]

    return re.sub(r"[A-Za-z0-9]+", mark, text or "")


def matches(df: DataFrame, text_col: str, query: str, options: FtsOptions = FtsOptions()) -> DataFrame:
    """All matching rows with rank, in no order. A coarse filter on the terms runs in the JVM first, so Python sees rows
    that can match."""
    groups = parse(query, options)
    if not groups:
        return df.filter(F.lit(False)).select(*df.columns, F.lit(0.0).alias("rank"))
    text = F.col(text_col) if options.case_sensitive else F.lower(F.col(text_col))
    coarse = F.lit(False)
    for group in groups:
        own = F.lit(True)
        for c in (c for c in group if not c.forbidden):
            for t in c.tokens:
                own = own & text.contains(t)
        coarse = coarse | own

    @F.pandas_udf("double")
    def ranked(s: pd.Series) -> pd.Series:
        return pd.Series([score(groups, tokens(t, options)) for t in s], dtype="float64").where(lambda v: v.notna(), None)

    return df.filter(coarse).withColumn("rank", ranked(F.col(text_col))).filter(~F.isnan("rank") & F.col("rank").isNotNull())


def search(df: DataFrame, text_col: str, query: str, id_col: str, limit: int = 100, options: FtsOptions = FtsOptions()) -> DataFrame:
    """The `limit` best matching rows, best first, with rank, snippet, highlight and search_rank."""
    groups = parse(query, options)
    if not groups:
        return df.filter(F.lit(False)).select(*df.columns, F.lit(0.0).alias("rank"), F.lit("").alias("snippet"), F.lit("").alias("highlight"), F.lit(0).alias("search_rank"))

    best = top(matches(df, text_col, query, options), F.col("rank"), limit, id_col, "rank")
    return shown(best, text_col, query, options).select(*df.columns, "rank", "snippet", "highlight", "search_rank")


def shown(df: DataFrame, text_col: str, query: str, options: FtsOptions = FtsOptions()) -> DataFrame:
    """df with snippet and highlight."""
    groups = parse(query, options)

    @F.pandas_udf("struct<snippet: string, highlight: string>")
    def made(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"snippet": [snippet(t, groups, options) for t in s], "highlight": [highlight(t, groups, options) for t in s]})

    return df.withColumn("_shown", made(F.col(text_col))).select(*df.columns, "_shown.snippet", "_shown.highlight")


def rtree_intersects(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Whether closed rectangles (min x, max x, min y, max y) meet; false where a bound is null."""
    meet = (a[0] <= b[1]) & (b[0] <= a[1]) & (a[2] <= b[3]) & (b[2] <= a[3])
    return F.coalesce(meet, F.lit(False))


def rectangle_join(left: DataFrame, right: DataFrame, cols: tuple[str, str, str, str], cell: float, left_id: str, right_id: str, most: int = 4096) -> DataFrame:
    """(left id, right id) of meeting rectangles: both sides are dealt to the grid cells they touch, so the join is by
    cell and each pair is reported in the cell of its common lower corner alone. Equal rectangles are one row with at most
    `most` of their ids while they are dealt and compared; pairs of ids are made in place, after a pair of rows met."""

    def dealt(df: DataFrame, side: str, key: str) -> DataFrame:
        span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
        bounds = df.filter(" AND ".join(f"{c} IS NOT NULL" for c in cols)).filter(f"{cols[0]} <= {cols[1]} AND {cols[2]} <= {cols[3]}")
        bounds = bounds.select(F.col(key).alias("_id"), *[F.col(c).alias(f"{side}{i}") for i, c in enumerate(cols)])
        box = [f"{side}{i}" for i in range(4)]
        # Ids without a value stay, each as a struct; a shape held by very many rows is cut by a hash of its ids.
        shape = bounds.groupBy(*box).agg(F.ceil(F.count("*") / F.lit(most // 2)).alias("_n"))
        same = [F.col(f"{side}{i}") == F.col(f"_s{i}") for i in range(4)]
        shape = shape.withColumnsRenamed({f"{side}{i}": f"_s{i}" for i in range(4)})
        held = bounds.join(shape, same).withColumn("_part", F.pmod(F.xxhash64("_id"), "_n"))
        held = held.groupBy(*box, "_part").agg(F.collect_list(F.struct("_id")).alias(f"{side}_ids"))
        return held.withColumn("_x", span(box[0], box[1])).withColumn("_y", span(box[2], box[3])).select("_x", "_y", f"{side}_ids", *box)

    both = dealt(left, "l", left_id).join(dealt(right, "r", right_id), ["_x", "_y"])
    meets = rtree_intersects(tuple(F.col(f"l{i}") for i in range(4)), tuple(F.col(f"r{i}") for i in range(4)))
    here = (F.floor(F.greatest("l0", "r0") / cell) == F.col("_x")) & (F.floor(F.greatest("l2", "r2") / cell) == F.col("_y"))
    met = both.filter(meets & here).select(F.explode("l_ids").alias("_l"), "r_ids").select("_l", F.explode("r_ids").alias("_r"))
    return met.select(F.col("_l._id").alias(f"left_{left_id}"), F.col("_r._id").alias(f"right_{right_id}"))
