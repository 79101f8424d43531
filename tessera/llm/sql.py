"""DuckDB SQL of the opN_ queries that SQL can express over whole tables."""

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UP, _LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def line_dedup(source: str = "documents", min_chars: int = 20, min_docs: int = 3, texts: bool = False) -> str:
    kept = "coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')"
    result = f"{kept} AS text" if texts else f"sha256({kept}) AS kept_sha256"
    return f"""WITH given AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {source}),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM given),
k AS (SELECT *, translate(trim(line, {_BLANK}), {_UP}, {_LOW}) AS key FROM l),
r AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}),
m AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND r.holder <> k.doc_id AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
 {result} FROM m GROUP BY doc_id"""


def warc() -> str:
    chars = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> {}) & 31)::INT, 1)"
    five = " || ".join(chars.format(s) for s in (15, 10, 5, 0))
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT x, max(page_id) AS keeper FROM p GROUP BY x),
b AS (SELECT x, string_agg({five}, '' ORDER BY i) AS b32 FROM (SELECT x, i, ('0x' || substr(x, (5 * i + 1)::INT, 5))::BIGINT AS v FROM d, range(8) t(i)) GROUP BY x)
SELECT p.page_id, strlen(h)::BIGINT AS payload_bytes, b32 AS payload_digest,
 CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM p JOIN d USING (x) JOIN b USING (x)"""


def quality_rules(alpha: float = 0.05, delta: float = 0.05, source: str = "documents") -> str:
    from tessera.llm.quality_rules import GRID, SCALES

    tail = f"lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({alpha}) + (n_good - i) * ln(1 - {alpha})"
    return f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM {source}),
c AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws,
 list_filter(string_split(text, chr(10)), lambda x: trim(x, {_BLANK}) <> '') AS ls FROM t),
g AS (SELECT rid, i, ws[i:i + 2] AS g FROM c, LATERAL (SELECT unnest(range(1, len(ws) - 1)) AS i)),
f AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
r AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM f, range(3) x(j) GROUP BY rid),
b AS (SELECT doc_id, stratum, len(ws)::BIGINT AS n_words, length(translate(text, {_BLANK}, ''))::BIGINT AS word_chars,
 (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
 coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
 length(text) - length(translate(text, {_UP}, '')) AS n_capitals, length(text) - length(replace(text, '!', '')) AS n_shouts FROM c LEFT JOIN r USING (rid)),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 greatest(n_symbols::DOUBLE / greatest(word_chars, 1) / {SCALES["symbols"]}::DOUBLE, n_capitals::DOUBLE / greatest(word_chars, 1) / {SCALES["capitals"]}::DOUBLE,
  n_shouts::DOUBLE / greatest(n_words, 1) / {SCALES["shouts"]}::DOUBLE, n_dup_lines::DOUBLE / greatest(n_lines, 1) / {SCALES["lines"]}::DOUBLE,
  n_repeat_words::DOUBLE / greatest(n_words, 1) / {SCALES["repeats"]}::DOUBLE) AS score FROM b),
q AS (SELECT doc_id, min(quality = 1) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT stratum, score, good FROM s JOIN q USING (doc_id) WHERE NOT base_failed),
k AS (SELECT stratum, cutoff, count(*) FILTER (good) AS n_good, count(*) FILTER (good AND score > cutoff) AS n_above, count(*) FILTER (NOT good AND score > cutoff) AS n_bad FROM h, (SELECT unnest({list(GRID)}::DOUBLE[]) AS cutoff) GROUP BY ALL),
p AS (SELECT stratum, cutoff, n_bad, (SELECT sum(exp({tail})) FROM range(0, n_above + 1) x(i)) AS p_value FROM k WHERE n_above <= {alpha} * n_good),
z AS (SELECT stratum, arg_max(cutoff, n_bad * 1000 + cutoff) AS cutoff FROM p WHERE p_value <= {delta} / (SELECT greatest(1, count(DISTINCT stratum)) FROM k) GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(score > cutoff, false) AS kept, score, cutoff
FROM s LEFT JOIN z USING (stratum)"""


def decontamination(source: str = "documents", window: int = 13, percent: int = 5) -> str:
    cut = f"list_filter(string_split_regex(translate(coalesce(text, ''), {_UP}, {_LOW}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"""WITH i AS (SELECT item_id::VARCHAR AS item, {cut} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(ws), {window}) AS n, array_to_string(ws[s:s + least(len(ws), {window}) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), {window}) + 2)) AS s FROM i WHERE len(ws) > 0)),
d AS (SELECT doc_id, {cut} AS ws FROM {source}),
dw AS (SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw))),
v AS (SELECT DISTINCT doc_id, dw.n, s, item FROM dw JOIN iw USING (win, n)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM v) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM v) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 100 * coalesce(n_hit, 0) >= {percent} * len(ws) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


def mixing(source: str = "documents", max_epochs: float = 4.0, seed: int = 17, steps: int = 60) -> str:
    def fits(alpha: str) -> str:
        return f"(SELECT max(pow(p, {alpha}) / t) / min(pow(p, {alpha}) / t) <= {max_epochs}::DOUBLE FROM s WHERE t > 0)"

    md = lambda *parts: "('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 15))::BIGINT"
    words = f"len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))"
    return f"""WITH RECURSIVE d AS (SELECT doc_id AS id, coalesce(source, '') AS source, {words}::BIGINT AS n_tokens FROM {source}),
s AS (SELECT source, sum(n_tokens)::BIGINT AS t, count(*) AS n, sum(n_tokens)::DOUBLE / (SELECT greatest(1, sum(n_tokens)) FROM d) AS p FROM d GROUP BY source),
b AS (SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high UNION ALL
 SELECT i + 1, CASE WHEN f THEN low ELSE (low + high) / 2 END, CASE WHEN f THEN (low + high) / 2 ELSE high END FROM (SELECT *, {fits("(low + high) / 2")} AS f FROM b WHERE i < {steps})),
a AS (SELECT CASE WHEN {fits("0.0::DOUBLE")} THEN 0.0 ELSE (SELECT high FROM b WHERE i = {steps}) END AS alpha),
w AS (SELECT source, t, n, CASE WHEN t > 0 THEN pow(p, alpha) ELSE 0 END AS r FROM s, a),
q AS (SELECT source, t, greatest(1, floor(sqrt(n)))::BIGINT AS blocks, r / (SELECT sum(r) FROM w) AS weight,
 CASE WHEN t > 0 THEN round(r / (SELECT min(r / t) FROM w WHERE t > 0))::BIGINT END AS quota FROM w),
z AS (SELECT *, CASE WHEN t > 0 THEN quota // t ELSE 1 END AS whole, CASE WHEN t > 0 THEN quota % t ELSE 0 END AS rest FROM q),
e AS (SELECT *, unnest(range(0, whole + (rest > 0)::INT)) AS epoch, {md(f"'{seed}'", "id::VARCHAR")} % blocks AS block FROM d JOIN z USING (source)),
o AS (SELECT *, {md(f"'{seed}'", "epoch::VARCHAR", "source", "block::VARCHAR")} AS block_order, {md(f"'{seed}'", "epoch::VARCHAR", "id::VARCHAR")} AS doc_order FROM e),
u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY block_order, block, doc_order, id ROWS UNBOUNDED PRECEDING) AS upto,
 sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY block_order, block RANGE UNBOUNDED PRECEDING) AS to_block, sum(n_tokens) OVER (PARTITION BY source, epoch, block) AS own FROM o)
SELECT id AS doc_id, source, n_tokens, epoch, block_order, doc_order, round(weight, 9) AS weight FROM u WHERE epoch < whole OR (upto <= rest AND to_block - own < rest)"""


def ngram_join(source: str = "documents", n: int = 4, percent: int = 85) -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_UP}, {_LOW}), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM {source}),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {n} THEN [array_to_string(ws, ' ')]
 ELSE list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' ')) END) AS g FROM w),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * i.n >= {percent} * (x.n + y.n - i.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM w UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT node AS doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, min(seen) AS component_id FROM r LEFT JOIN c ON c.doc_id = node GROUP BY ALL"""


def pipeline() -> str:
    """The five stages over documents, each reading what the one before kept."""
    columns = "doc_id, text, lang, source, n_chars"
    return f"""WITH s1 AS MATERIALIZED (SELECT {columns} FROM documents WHERE doc_id IN (SELECT doc_id FROM ({quality_rules()}) WHERE kept)),
s2 AS MATERIALIZED (SELECT doc_id, x.text, lang, source, length(x.text)::BIGINT AS n_chars FROM s1 JOIN ({line_dedup("s1", texts=True)}) x USING (doc_id)),
s3 AS MATERIALIZED (SELECT {columns} FROM s2 WHERE doc_id IN (SELECT doc_id FROM ({ngram_join("s2")}) WHERE component_id = doc_id)),
s4 AS MATERIALIZED (SELECT {columns} FROM s3 WHERE doc_id IN (SELECT doc_id FROM ({decontamination("s3")}) WHERE NOT contaminated))
SELECT doc_id, text, lang, s4.source, n_chars, epoch, block_order, doc_order FROM s4 JOIN ({mixing("s4")}) x USING (doc_id)"""
