"""The function library through SQL text: each query is a text for the session beside one that spells the meaning out."""

from __future__ import annotations

from tessera.plans.relational import shared

for _name, _sql, _oracle in (
    (
        "sql_dates",
        "SELECT event_id, date(ts) AS d, time(ts, '+90 minutes') AS t, datetime(ts, 'start of day') AS s, julianday(ts) AS j, unixepoch(ts) AS u, strftime('%d/%m/%Y %Hh %%', ts) AS f, timediff(ts, '2024-01-01') AS diff FROM events",
        "SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts + INTERVAL 90 MINUTE, '%H:%M:%S') AS t, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS s, floor(epoch(ts)) / 86400.0 + 2440587.5 AS j, floor(epoch(ts))::BIGINT AS u, strftime(ts, '%d/%m/%Y %Hh') || ' %' AS f, (epoch_us(ts) // 1000 - epoch_ms(TIMESTAMP '2024-01-01')) / 1000.0 AS diff FROM events",
    ),
    (
        "sql_json_read",
        "SELECT event_id, json(props) AS whole, json_valid(props) AS ok, json_extract(props, '$.k') AS k, json_extract(props, '$.k', '$.none') AS pair, json_type(props, '$.k') AS kind, json_array_length(json_array(event_id, event_type, NULL)) AS n, json_error_position(props) AS bad FROM events",
        """SELECT event_id, '{"k":' || (props->>'$.k') || '}' AS whole, 1 AS ok, props->>'$.k' AS k, '[' || (props->>'$.k') || ',null]' AS pair, 'integer' AS kind, 3::BIGINT AS n, 0::BIGINT AS bad FROM events""",
    ),
    (
        "sql_json_write",
        "SELECT event_id, json_set(props, '$.v', event_id) AS a, json_insert(props, '$.k', 0) AS b, json_replace(props, '$.k', 0) AS c, json_remove(props, '$.k') AS d, json_patch(props, '{\"z\":null,\"y\":[1]}') AS e, json_object('id', event_id, 'kind', event_type) AS f, json_array(event_id, NULL, true) AS g, json_quote(event_type) AS h, json_array_insert('[1,3]', '$[1]', event_id) AS i, json_pretty('[]') AS p FROM events",
        """SELECT event_id, '{"k":' || k || ',"v":' || event_id || '}' AS a, '{"k":' || k || '}' AS b, '{"k":0}' AS c, '{}' AS d, '{"k":' || k || ',"y":[1]}' AS e, '{"id":' || event_id || ',"kind":"' || event_type || '"}' AS f, '[' || event_id || ',null,true]' AS g, '"' || event_type || '"' AS h, '[1,' || event_id || ',3]' AS i, '[]' AS p FROM (SELECT *, props->>'$.k' AS k FROM events)""",
    ),
    (
        "sql_json_each",
        "SELECT e.event_id, j.key, j.value, j.type, j.fullkey FROM events e, json_each(e.props) j UNION ALL SELECT e.event_id, t.key, t.value, t.type, t.fullkey FROM events e, jsonb_tree(e.props) t",
        """WITH k AS (SELECT event_id, props->>'$.k' AS v FROM events) SELECT event_id, 'k' AS key, v AS value, 'integer' AS type, '$.k' AS fullkey FROM k UNION ALL SELECT event_id, 'k', v, 'integer', '$.k' FROM k UNION ALL SELECT event_id, NULL, '{"k":' || v || '}', 'object', '$' FROM k""",
    ),
    (
        "sql_strings",
        """SELECT c_custkey, instr(c_name, '#') AS at, quote(c_name) AS q, quote(c_acctbal > 0) AS qb, hex(c_custkey) AS hx, unhex(hex(c_name)) AS back, printf('%05d|%-4.2s|', c_custkey, c_name) AS pf, char(67, 64 + c_nationkey) AS ch, concat(c_name, NULL, c_mktsegment) AS cat,
        concat_ws('-', c_name, NULL, c_mktsegment) AS ws, like('CUSTOMER%1', c_name) AS lk, glob('*[0-3]', c_name) AS gl, regexp('0+5', c_name) AS rx, regexp('(', c_name) AS rbad, length(c_name) AS n, octet_length(c_name) AS o FROM customer""",
        """SELECT c_custkey, instr(c_name, '#') AS at, '''' || c_name || '''' AS q, CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END AS qb, upper(hex(c_custkey::VARCHAR)) AS hx, c_name AS back, printf('%05d|', c_custkey) || left(c_name, 2) || '  |' AS pf, 'C' || chr(64 + c_nationkey) AS ch, c_name || c_mktsegment AS cat,
        c_name || '-' || c_mktsegment AS ws, (c_name ILIKE 'customer%1')::INT AS lk, (c_name GLOB '*[0-3]')::INT AS gl, regexp_matches(c_name, '0+5')::INT AS rx, 0 AS rbad, length(c_name)::INT AS n, strlen(c_name)::INT AS o FROM customer""",
    ),
    (
        "sql_strings_more",
        """SELECT c_custkey, replace(c_name, '#', '\\') AS rp, replace(c_name, '', 'x') AS rn, substr(c_name, 3, 4) AS sa, substring(c_name, -3) AS sb, substr(c_name, -99, 3) AS sc, substr(c_name, 2, -1) AS sd, typeof(c_custkey) AS ta, typeof(c_acctbal) AS tb, typeof(nullif(c_name, c_name)) AS tc, unicode(c_name) AS uc, unistr('\\0041\\u0042') AS us,
        unistr_quote(c_name) AS uq, lower(c_name) AS lo, upper(c_mktsegment) AS up, trim(c_mktsegment, 'BG') AS tr, ltrim('  a') AS lt, rtrim(c_mktsegment, 'G') AS rt, soundex('Ashcraft') AS sx, likely(c_custkey) AS li, likelihood(c_custkey, 0.5) AS lh, ifnull(nullif(c_custkey, '1'), -1) AS nf, iif(c_custkey % 2, 'odd', 'even') AS ii,
        length(randomblob(5)) AS rb, hex(zeroblob(2)) AS zb, random() = random() AS rr, max(c_custkey, 50) AS mx, min(c_custkey, NULL) AS mn, coalesce(NULL, c_name) AS co FROM customer""",
        """SELECT c_custkey, replace(c_name, '#', '\\') AS rp, c_name AS rn, substr(c_name, 3, 4) AS sa, right(c_name, 3) AS sb, left(c_name, 3) AS sc, '' AS sd, 'integer' AS ta, 'real' AS tb, 'null' AS tc, unicode(c_name)::BIGINT AS uc, 'AB' AS us,
        '''' || c_name || '''' AS uq, lower(c_name) AS lo, upper(c_mktsegment) AS up, trim(c_mktsegment, 'BG') AS tr, 'a' AS lt, rtrim(c_mktsegment, 'G') AS rt, 'A226' AS sx, c_custkey AS li, c_custkey AS lh, CASE WHEN c_custkey = 1 THEN -1 ELSE c_custkey END AS nf, CASE WHEN c_custkey % 2 = 1 THEN 'odd' ELSE 'even' END AS ii,
        5 AS rb, '0000' AS zb, false AS rr, greatest(c_custkey, 50) AS mx, NULL::BIGINT AS mn, c_name AS co FROM customer""",
    ),
    (
        "sql_math",
        """SELECT l_orderkey, l_linenumber, abs(l_linenumber - 4) AS ab, mod(l_quantity, 7) AS md, mod(l_quantity, 0) AS mz, round(pow(l_tax, 2), 9) AS pw, round(pi(), 9) AS pi, round(l_extendedprice / 3, 2) AS rd, sign(l_quantity - 25) AS sg, round(acos(l_quantity), 9) AS ac, round(asin(l_tax), 9) AS sa, round(atan(l_tax), 9) AS ta, round(acosh(l_quantity), 9) AS ach, round(asinh(l_tax), 9) AS ash, round(atanh(l_tax), 9) AS ath,
        round(atan2(l_tax, l_quantity), 9) AS at2, ceil(l_tax) AS ce, floor(-l_tax) AS fl, round(cos(l_tax), 9) AS co, round(cosh(l_tax), 9) AS coh, round(sin(l_tax), 9) AS si, round(sinh(l_tax), 9) AS sih, round(tan(l_tax), 9) AS tn, round(tanh(l_tax), 9) AS tnh, round(degrees(l_tax), 9) AS dg, round(radians(l_quantity), 9) AS ra, round(exp(l_tax), 9) AS ex FROM lineitem""",
        """SELECT l_orderkey, l_linenumber, abs(l_linenumber - 4) AS ab, fmod(l_quantity, 7) AS md, NULL::DOUBLE AS mz, round(pow(l_tax, 2), 9) AS pw, round(pi(), 9) AS pi, round(l_extendedprice / 3, 2) AS rd, CASE WHEN l_quantity > 25 THEN 1 WHEN l_quantity < 25 THEN -1 ELSE 0 END::BIGINT AS sg, CASE WHEN l_quantity <= 1 THEN round(acos(l_quantity), 9) END AS ac, round(asin(l_tax), 9) AS sa, round(atan(l_tax), 9) AS ta, round(acosh(l_quantity), 9) AS ach, round(asinh(l_tax), 9) AS ash, round(atanh(l_tax), 9) AS ath,
        round(atan2(l_tax, l_quantity), 9) AS at2, ceil(l_tax) AS ce, floor(-l_tax) AS fl, round(cos(l_tax), 9) AS co, round(cosh(l_tax), 9) AS coh, round(sin(l_tax), 9) AS si, round(sinh(l_tax), 9) AS sih, round(tan(l_tax), 9) AS tn, round(tanh(l_tax), 9) AS tnh, round(degrees(l_tax), 9) AS dg, round(radians(l_quantity), 9) AS ra, round(exp(l_tax), 9) AS ex FROM lineitem""",
    ),
    (
        "sql_logs",
        "SELECT l_orderkey, l_linenumber, round(log(l_quantity), 9) AS lg, round(log(2, l_quantity), 9) AS lb, log(-l_quantity) AS neg, ln(l_discount - l_discount) AS inf, round(log10(l_quantity), 9) AS l10, round(log2(l_quantity), 9) AS l2, round(sqrt(l_quantity), 9) AS sq, sqrt(-l_quantity) AS nn FROM lineitem",
        "SELECT l_orderkey, l_linenumber, round(log10(l_quantity), 9) AS lg, round(ln(l_quantity) / ln(2), 9) AS lb, NULL::DOUBLE AS neg, '-inf'::DOUBLE AS inf, round(log10(l_quantity), 9) AS l10, round(log2(l_quantity), 9) AS l2, round(sqrt(l_quantity), 9) AS sq, NULL::DOUBLE AS nn FROM lineitem",
    ),
    (
        "sql_percentiles",
        "SELECT p_brand, median(p_retailprice) AS me, round(percentile(p_retailprice, 90), 6) AS p9, round(percentile_cont(p_retailprice, 0.25), 6) AS pc, percentile_disc(p_retailprice, 0.3) AS pd, total(p_size) FILTER (WHERE p_size > 10) AS tot, median(p_size) FILTER (WHERE p_size > 99) AS none FROM part GROUP BY p_brand",
        "SELECT p_brand, quantile_cont(p_retailprice, 0.5) AS me, round(quantile_cont(p_retailprice, 0.9), 6) AS p9, round(quantile_cont(p_retailprice, 0.25), 6) AS pc, list_sort(list(p_retailprice))[1 + floor(0.3 * (count(p_retailprice) - 1))::INT] AS pd, coalesce((sum(p_size) FILTER (WHERE p_size > 10))::DOUBLE, 0.0) AS tot, NULL::DOUBLE AS none FROM part GROUP BY p_brand",
    ),
    (
        "sql_fts_rank",
        "SELECT doc_id, round(fts_rank(text, 'the and The'), 9) AS r FROM documents",
        """WITH w AS (SELECT doc_id, string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{L}\\p{N}]+') AS ws FROM documents),
        c AS (SELECT doc_id, len(list_filter(ws, lambda x: x = 'the'))::DOUBLE AS a, len(list_filter(ws, lambda x: x = 'and'))::DOUBLE AS b FROM w) SELECT doc_id, round(b * 2.2 / (b + 1.2) + 2 * a * 2.2 / (a + 1.2), 9) AS r FROM c""",
    ),
    (
        "sql_rtree",
        "SELECT o_orderkey FROM orders WHERE rtree_intersects(o_custkey % 100, o_custkey % 100 + 3, o_orderkey % 90, o_orderkey % 90 + 2, 10, 12, 30, 33)",
        "SELECT o_orderkey FROM orders WHERE o_custkey % 100 <= 12 AND o_custkey % 100 + 3 >= 10 AND o_orderkey % 90 <= 33 AND o_orderkey % 90 + 2 >= 30",
    ),
    (
        "sql_ann_search",
        "SELECT vec_id, label FROM embeddings WHERE ann_search(embedding, '[{}]', 15)".format(",".join(str((i % 7 - 3) / 4) for i in range(64))),
        "SELECT vec_id, label FROM (SELECT *, list_cosine_similarity(embedding::DOUBLE[], [{}]::DOUBLE[]) AS c FROM embeddings) ORDER BY c DESC, vec_id LIMIT 15".format(",".join(str((i % 7 - 3) / 4) for i in range(64))),
    ),
    (
        "sql_ann_scored",
        "SELECT vec_id, search_rank, round(exact_score, 5) AS score FROM ann_search_exact('embeddings', 'embedding', '[{}]', 100, 7, 'l2', 'vec_id')".format(",".join(str((i % 5 - 2) / 4) for i in range(64))),
        "WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS v, [{}]::DOUBLE[] AS q FROM embeddings), n AS (SELECT vec_id, v, q FROM c ORDER BY list_cosine_similarity(v, q) DESC, vec_id LIMIT 100) SELECT vec_id, row_number() OVER (ORDER BY list_distance(v, q), vec_id)::INTEGER AS search_rank, round(list_distance(v, q), 5) AS score FROM n QUALIFY search_rank <= 7".format(",".join(str((i % 5 - 2) / 4) for i in range(64))),
    ),
):
    shared(_name, _sql, _oracle)
