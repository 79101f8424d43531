"""Retrieval by name in SQL text: scored table functions, top-k predicates, and full-text MATCH.

A scored function names its table, so it is resolved while the text is read: its frame, built by the retrieval operators,
becomes a view for the statement and the call becomes the view's name. A predicate (ann_search(vec, '[..]', k)) becomes
membership of the row's key among the k found ones.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.sql import FunctionError, calls
from tessera.functions.sql import literal as _literal
from tessera.operators import retrieval as V
from tessera.operators import text as T

TABLES = ("ann_search_scored", "ann_search_exact", "minhash_search_scored", "set_similarity_scored", "sparse_search_scored", "hybrid_search_scored")
PREDICATES = ("ann_search", "sparse_match", "minhash_match")


def literal(arg: str) -> str:
    return _literal(arg, raw=True)


class Sources:
    """What retrieval needs to know of tables: frame(name), the key column, and whether a vector column is quantized."""

    def __init__(self, frame: Callable[[str], DataFrame], key: Callable[[str], str], hamming: Callable[[str, str], bool]) -> None:
        self.frame, self.key, self.hamming = frame, key, hamming


def sparse_column(df: DataFrame, column: str) -> DataFrame:
    """The column as an array of (token, weight), also where it is JSON text [[token, weight], ...]."""
    if df.schema[column].dataType.typeName() != "string":
        return df
    pairs = F.from_json(column, "array<array<double>>")
    return df.withColumn(column, F.transform(pairs, lambda p: F.struct(p[0].cast("int").alias("token"), p[1].cast("float").alias("weight"))))


def set_column(df: DataFrame, column: str) -> DataFrame:
    """The column as an array of canonical JSON members, also where it is the text of a JSON array."""
    if df.schema[column].dataType.typeName() != "string":
        return df
    members: Column = F.expr(f"transform(try_variant_get(try_parse_json(`{column}`), '$', 'array<variant>'), v -> to_json(v))")
    return df.withColumn(column, F.array_sort(F.array_distinct(members)))


def set_query(text: str) -> list[str]:
    return V.set_members(text)


def projection(text: str | None, df: DataFrame, key: str) -> list[str]:
    if text is None or not text.strip():
        return [key]
    if text.strip() == "*":
        return df.columns
    return json.loads(text) if text.strip().startswith("[") else [c.strip() for c in text.split(",")]


def scored(name: str, args: list[str], sources: Sources) -> DataFrame:
    """The frame of a scored table function: the projection, search_rank and the scores."""
    table = literal(args[0])
    df, key = sources.frame(table), sources.key(table)
    text = lambda i: literal(args[i]) if len(args) > i else None
    if name == "hybrid_search_scored":
        columns = projection(text(2), df, key)
        return hybrid(df, json.loads(text(1)), key, columns)
    column = text(1)
    if column not in df.columns:
        raise FunctionError(f"no column {column!r} in {table}")
    if name == "ann_search_scored":
        query, k, columns = json.loads(text(2)), int(args[3]), projection(text(4), df, key)
        if sources.hamming(table, column):
            return V.hamming_search(df, column, query, k, key).select(*columns, "search_rank", "ann_distance")
        return V.vector_search(df, column, query, k, key).select(*columns, "search_rank", "ann_cosine_distance")
    if name == "ann_search_exact":
        query, candidates, limit, metric, columns = json.loads(text(2)), int(args[3]), int(args[4]), text(5), projection(text(6), df, key)
        near = V.hamming_search(df, column, query, candidates, key) if sources.hamming(table, column) else V.vector_search(df, column, query, candidates, key)
        return V.rerank(near, column, query, limit, key, metric).select(*columns, "search_rank", "exact_score")
    if name == "sparse_search_scored":
        query, k, columns = V.sparse_vector(text(2)), int(args[3]), projection(text(4), df, key)
        return V.sparse_search(sparse_column(df, column), column, query, k, key).select(*columns, "search_rank", F.col("sparse_score").cast("float").alias("sparse_score"))
    members = set_query(text(2))
    if name == "minhash_search_scored":
        return V.minhash_search(set_column(df, column), column, members, int(args[3]), key).select(*projection(text(4), df, key), "search_rank", "estimated_jaccard")
    found = V.set_similarity(set_column(df, column), column, members, int(args[3]), float(args[4]), int(args[5]), key)
    return found.select(*projection(text(6), df, key), "search_rank", "estimated_jaccard", "exact_jaccard")


def hybrid(df: DataFrame, request: dict, key: str, columns: list[str]) -> DataFrame:
    """hybrid_search of a request whose retrievers hold their kind as a key ({"name", "ann": {column, query, k}}) or as `kind`."""
    retrievers = []
    for r in request["retrievers"]:
        kind = r.get("kind") or next(k for k in ("ann", "sparse", "minhash") if k in r)
        own = {**r, **r.get(kind, {}), "kind": kind}
        column = own["column"]
        if kind == "sparse":
            df = sparse_column(df, column)
        elif kind == "minhash":
            df = set_column(df, column)
            own["query"] = set_query(json.dumps(own.get("query", own.get("members"))))
        retrievers.append(own)
    shown = V.hybrid_search(df, {**request, "retrievers": retrievers, "projection": [c for c in columns if c != key]}, key)
    scores = [c for c in ("search_rank", "fused_score", "components", "final_score") if c in shown.columns]
    return shown.select(*columns, *scores)


def resolve(sql: str, sources: Sources) -> tuple[str, list[str]]:
    """(the text with scored functions and predicates replaced by views, the views' names)."""
    views: list[str] = []

    def view(df: DataFrame) -> str:
        name = f"tessera_found_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(name)
        views.append(name)
        return name

    while found := next(calls(sql, TABLES), None):
        name, args, start, end = found
        sql = sql[:start] + view(scored(name, args, sources)) + sql[end:]
    while found := next(calls(sql, PREDICATES), None):
        name, args, start, end = found
        column = args[0].split(".")[-1]
        prefix = args[0][: -len(column)]
        m = re.search(rf"\bfrom\s+(\w+)(?:\s+(?:as\s+)?{re.escape(prefix.rstrip('.'))}\b)?" if prefix else r"\bfrom\s+(\w+)", sql, re.I)
        if not m:
            raise FunctionError(f"{name} is a predicate of a table's rows")
        of = {"ann_search": "ann_search_scored", "sparse_match": "sparse_search_scored", "minhash_match": "minhash_search_scored"}[name]
        key = sources.key(m[1])
        hits = view(scored(of, [f"'{m[1]}'", f"'{column}'", *args[1:]], sources).select(key))
        sql = f"{sql[:start]}{prefix}{key} IN (SELECT {key} FROM {hits}){sql[end:]}"
    return sql, views


_MATCH = r"'(?:[^']|'')*'|(?<![\w.])(?:(?P<what>[\w.]+)\s+match|(?:(?P<of>\w+)\.)?query\s*=)\s*(?P<q>'(?:[^']|'')*')"


def match(sql: str, docs: dict[str, dict], frame: Callable[[str], DataFrame]) -> tuple[str, dict[str, DataFrame]]:
    """(the text without its MATCH predicates, the frames of the full-text tables it names). docs: options by table.

    `docs MATCH 'q'`, `alias MATCH`, `column MATCH` and the hidden `query = 'q'` give the matching rows with query, rank,
    snippet and highlight; a table without such a predicate gives all rows with those columns null."""
    frames: dict[str, DataFrame] = {}
    for table, options in docs.items():
        named = re.search(rf"\b{re.escape(table)}\b(?:\s+(?:as\s+)?(?!where\b|join\b|on\b|order\b|group\b|limit\b|match\b)(\w+))?", sql, re.I)
        if not named:
            continue
        names, query = {table.lower(), (named[1] or table).lower()}, None

        def put(m: re.Match, names=names) -> str:
            nonlocal query
            if m["q"] is None:
                return m[0]
            owner = (m["of"] or (m["what"] or "").split(".")[0]).lower()
            if owner and owner not in names and owner not in ("text", "doc_id", ""):
                return m[0]
            query = literal(m["q"])
            return "TRUE"

        sql = re.sub(_MATCH, put, sql, flags=re.I)
        df, fts = frame(table), T.FtsOptions(**options)
        if query is None:
            frames[table] = df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("query", "string"), ("rank", "double"), ("snippet", "string"), ("highlight", "string"))])
        else:
            frames[table] = T.shown(T.matches(df, "text", query, fts), "text", query, fts).select(*df.columns, F.lit(query).alias("query"), "rank", "snippet", "highlight")
    return sql, frames
