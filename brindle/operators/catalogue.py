"""Statements of the dialect, each with its DuckDB equivalent where the text differs."""

from __future__ import annotations

import tempfile

from ..session import Engine
from ..sources.files import TABLES, StatementLog, register_folder

#: name: (statement, SQL of the oracle if it differs)
STATEMENTS: dict[str, tuple[str, str | None]] = {
    'scan_region': (
        'SELECT r_regionkey, r_name FROM region',
        None,
    ),
    'scan_project_alias': (
        'SELECT c_custkey AS id, c_name AS name FROM customer',
        None,
    ),
    'filter_eq': (
        "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
        None,
    ),
    'filter_and_or': (
        "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND o_totalprice > 100000",
        None,
    ),
    'filter_not_2vl': (
        'SELECT s.s_suppkey FROM supplier s LEFT JOIN few_nations n ON s.s_nationkey = n.n_nationkey WHERE NOT (n.n_regionkey = 1)',
        'SELECT s.s_suppkey FROM supplier s LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 10) n ON s.s_nationkey = n.n_nationkey WHERE NOT coalesce(n.n_regionkey = 1, false)',
    ),
    'filter_in_list': (
        'SELECT p_partkey FROM part WHERE p_size IN (1, 5, 10)',
        None,
    ),
    'filter_not_in_null': (
        'SELECT p_partkey FROM part WHERE p_size NOT IN (1, NULL, 5)',
        'SELECT p_partkey FROM part WHERE p_size IS NOT NULL AND NOT coalesce(p_size IN (1, 5), false)',
    ),
    'filter_between': (
        'SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12',
        None,
    ),
    'filter_not_between': (
        'SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45',
        None,
    ),
    'filter_like_prefix': (
        "SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'B%'",
        None,
    ),
    'filter_like_contains': (
        "SELECT doc_id FROM documents WHERE text LIKE '%the%'",
        None,
    ),
    'filter_like_escape': (
        "SELECT event_id FROM events WHERE event_type NOT LIKE 'c\\_%' AND event_type LIKE '_l%'",
        "SELECT event_id FROM events WHERE event_type NOT LIKE 'c\\_%' ESCAPE '\\' AND event_type LIKE '_l%'",
    ),
    'filter_is_null': (
        'SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL',
        None,
    ),
    'filter_is_not_null': (
        'SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL',
        None,
    ),
    'expr_arith': (
        'SELECT l_orderkey, l_linenumber, l_linenumber * 2 + 1 AS e, -l_linenumber AS neg FROM lineitem',
        'SELECT l_orderkey, l_linenumber, CAST(l_linenumber * 2 + 1 AS BIGINT) AS e, -l_linenumber AS neg FROM lineitem',
    ),
    'expr_int_div': (
        'SELECT o_orderkey, o_custkey / 7 AS q FROM orders',
        'SELECT o_orderkey, o_custkey // 7 AS q FROM orders',
    ),
    'expr_case_searched': (
        "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS bucket FROM part",
        None,
    ),
    'expr_case_simple': (
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders",
        None,
    ),
    'expr_coalesce_nullif': (
        'SELECT d.doc_id, coalesce(l.quality, -1) AS q, nullif(l.toxic, 0) AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id',
        None,
    ),
    'expr_cast': (
        'SELECT o_orderkey, CAST(o_orderkey AS TEXT) AS s, CAST(o_totalprice AS INT) AS i FROM orders',
        'SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(trunc(o_totalprice) AS BIGINT) AS i FROM orders',
    ),
    'fn_numeric': (
        'SELECT c_custkey, ABS(c_acctbal) AS a, CEIL(c_acctbal) AS c, FLOOR(c_acctbal) AS f, MOD(c_custkey, 7) AS m, POWER(c_custkey, 2) AS p FROM customer',
        'SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f, c_custkey % 7 AS m, power(CAST(c_custkey AS DOUBLE), 2) AS p FROM customer',
    ),
    'fn_round': (
        'SELECT c_custkey, round(c_acctbal) AS r0 FROM customer',
        None,
    ),
    'fn_string': (
        "SELECT p_partkey, LENGTH(p_name) AS n, UPPER(p_name) AS u, LOWER(p_name) AS l, SUBSTRING(p_name, 2, 3) AS s, TRIM(p_name) AS t, CONCAT(p_brand, '-', p_type) AS c FROM part",
        "SELECT p_partkey, length(p_name) AS n, upper(p_name) AS u, lower(p_name) AS l, substring(p_name, 2, 3) AS s, trim(p_name) AS t, p_brand || '-' || p_type AS c FROM part",
    ),
    'agg_global': (
        'SELECT COUNT(*) AS n, COUNT(l_orderkey) AS c, MIN(l_quantity) AS mn, MAX(l_quantity) AS mx, SUM(l_linenumber) AS s FROM lineitem',
        'SELECT count(*) AS n, count(l_orderkey) AS c, min(l_quantity) AS mn, max(l_quantity) AS mx, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem',
    ),
    'agg_empty': (
        'SELECT COUNT(*) AS n, SUM(o_custkey) AS s, MAX(o_orderkey) AS m FROM orders WHERE o_orderkey < 0',
        'SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0',
    ),
    'agg_group': (
        'SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(l_quantity) AS INT) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus',
        'SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus',
    ),
    'agg_group_expr': (
        'SELECT MOD(o_custkey, 10) AS k, COUNT(*) AS n FROM orders GROUP BY MOD(o_custkey, 10)',
        'SELECT o_custkey % 10 AS k, count(*) AS n FROM orders GROUP BY o_custkey % 10',
    ),
    'agg_group_null': (
        'SELECT l.quality, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality',
        None,
    ),
    'agg_having': (
        'SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15',
        None,
    ),
    'agg_count_distinct': (
        'SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority',
        None,
    ),
    'agg_avg': (
        'SELECT event_type, AVG(user_id) AS a FROM events GROUP BY event_type',
        'SELECT event_type, avg(CAST(user_id AS DOUBLE)) AS a FROM events GROUP BY event_type',
    ),
    'agg_expr': (
        'SELECT o_orderstatus, SUM(o_custkey) / COUNT(*) AS mean_int FROM orders GROUP BY o_orderstatus',
        'SELECT o_orderstatus, CAST(sum(o_custkey) AS BIGINT) // count(*) AS mean_int FROM orders GROUP BY o_orderstatus',
    ),
    'sort_topk': (
        'SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10',
        None,
    ),
    'sort_offset': (
        'SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 30',
        None,
    ),
    'sort_nulls_last_desc': (
        'SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC, d.doc_id LIMIT 50',
        'SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC NULLS LAST, d.doc_id LIMIT 50',
    ),
    'sort_nulls_last_asc': (
        'SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality, d.doc_id LIMIT 50',
        'SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality ASC NULLS LAST, d.doc_id LIMIT 50',
    ),
    'sort_group_agg': (
        'SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY n DESC, c_mktsegment LIMIT 3',
        None,
    ),
    'distinct_col': (
        'SELECT DISTINCT o_orderpriority FROM orders',
        None,
    ),
    'distinct_order_limit': (
        'SELECT DISTINCT p_size FROM part ORDER BY p_size LIMIT 5',
        None,
    ),
    'join_inner': (
        'SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey',
        None,
    ),
    'join_left': (
        'SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey',
        None,
    ),
    'join_right': (
        'SELECT l.doc_id AS lid, d.doc_id FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id',
        None,
    ),
    'join_cross': (
        'SELECT r.r_regionkey, n.n_nationkey FROM region r CROSS JOIN nation n',
        None,
    ),
    'join_using': (
        'SELECT doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)',
        None,
    ),
    'join_theta': (
        'SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey',
        None,
    ),
    'join_nonequi': (
        'SELECT a.r_regionkey AS a, b.r_regionkey AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey',
        None,
    ),
    'join_left_residual': (
        'SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000',
        None,
    ),
    'join_multi_key': (
        'SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber',
        None,
    ),
    'join_chain4': (
        'SELECT r.r_name, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name',
        None,
    ),
    'join_limit3': (
        'SELECT count(*) AS n FROM (SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey LIMIT 25) t',
        None,
    ),
    'set_union': (
        'SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier',
        None,
    ),
    'set_union_all': (
        'SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier',
        None,
    ),
    'set_intersect': (
        'SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier',
        None,
    ),
    'set_intersect_all': (
        'SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier',
        None,
    ),
    'set_except': (
        'SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey AS k FROM customer WHERE c_nationkey < 12',
        'SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 12',
    ),
    'set_except_all': (
        'SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier',
        None,
    ),
    'set_left_assoc': (
        'SELECT 1 AS k UNION SELECT 2 AS k INTERSECT SELECT 2 AS k',
        'SELECT k FROM (SELECT 1 AS k UNION SELECT 2) a INTERSECT SELECT 2 AS k',
    ),
    'set_order_limit': (
        'SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier ORDER BY k DESC LIMIT 4',
        None,
    ),
    'win_row_number': (
        'SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders',
        None,
    ),
    'win_rank_dense': (
        'SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part',
        None,
    ),
    'win_rank_no_order': (
        'SELECT n_nationkey, rank() OVER (PARTITION BY n_regionkey) AS r FROM nation',
        None,
    ),
    'win_running_sum': (
        'SELECT p_partkey, SUM(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS s FROM part',
        'SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS s FROM part',
    ),
    'win_partition_agg': (
        'SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, min(o_totalprice) OVER (PARTITION BY o_custkey) AS mn, max(o_totalprice) OVER (PARTITION BY o_custkey) AS mx FROM orders',
        None,
    ),
    'win_named': (
        'SELECT p_partkey, ROW_NUMBER() OVER w AS rn, AVG(p_size) OVER (PARTITION BY p_brand) AS a FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)',
        'SELECT p_partkey, row_number() OVER w AS rn, avg(CAST(p_size AS DOUBLE)) OVER (PARTITION BY p_brand) AS a FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)',
    ),
    'win_nulls_last': (
        'SELECT d.doc_id, ROW_NUMBER() OVER (ORDER BY l.quality DESC, d.doc_id) AS rn FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id',
        'SELECT d.doc_id, row_number() OVER (ORDER BY l.quality DESC NULLS LAST, d.doc_id) AS rn FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id',
    ),
    'sub_from': (
        'SELECT t.k, t.n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE t.n > 12',
        None,
    ),
    'sub_in': (
        'SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)',
        None,
    ),
    'sub_not_in': (
        'SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)',
        None,
    ),
    'sub_not_in_nulls': (
        'SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT quality FROM labels)',
        'SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.quality = d.doc_id)',
    ),
    'sub_exists': (
        "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
        None,
    ),
    'sub_not_exists': (
        'SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)',
        None,
    ),
    'sub_scalar': (
        'SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)',
        None,
    ),
    'sub_scalar_corr': (
        'SELECT c.c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c',
        None,
    ),
    'sub_corr_compare': (
        'SELECT p.p_partkey FROM part p WHERE p.p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)',
        None,
    ),
    'cte_basic': (
        'WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT o_custkey, n FROM t WHERE n > 12',
        None,
    ),
    'cte_multi_ref': (
        'WITH t AS (SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY n_regionkey), u AS (SELECT max(n) AS m FROM t) SELECT t.r, t.n, u.m FROM t CROSS JOIN u',
        None,
    ),
    'cte_shadow': (
        'WITH region AS (SELECT 99 AS r_regionkey) SELECT r_regionkey FROM region',
        None,
    ),
    'cte_recursive_all': (
        'WITH RECURSIVE s AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM s WHERE n < 150) SELECT n FROM s',
        'WITH RECURSIVE s AS (SELECT CAST(1 AS BIGINT) AS n UNION ALL SELECT n + 1 FROM s WHERE n < 150) SELECT n FROM s',
    ),
    'cte_recursive_distinct': (
        'WITH RECURSIVE s AS (SELECT 0 AS n UNION SELECT MOD(n * 7 + 3, 50) AS n FROM s) SELECT n FROM s',
        'WITH RECURSIVE s AS (SELECT CAST(0 AS BIGINT) AS n UNION SELECT (n * 7 + 3) % 50 FROM s) SELECT n FROM s',
    ),
    'json_value': (
        "SELECT event_id, JSON_VALUE(props, '$.k') AS k FROM events",
        "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    ),
    'json_exists': (
        "SELECT event_id, JSON_EXISTS(props, '$.k') AS h, JSON_EXISTS(props, '$.zz') AS m FROM events",
        "SELECT event_id, json_exists(props, '$.k') AS h, json_exists(props, '$.zz') AS m FROM events",
    ),
    'json_where_cast': (
        "SELECT event_id FROM events WHERE CAST(JSON_VALUE(props, '$.k') AS INT) >= 50",
        "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50",
    ),
    'json_is_json': (
        'SELECT event_id, props IS JSON AS a, event_type IS JSON AS b FROM events',
        'SELECT event_id, json_valid(props) AS a, json_valid(event_type) AS b FROM events',
    ),
    'json_object': (
        "SELECT n_nationkey, JSON_OBJECT('id', n_nationkey, 'name', n_name) AS j FROM nation",
        'SELECT n_nationkey, \'{"id":\' || n_nationkey || \',"name":"\' || n_name || \'"}\' AS j FROM nation',
    ),
    'json_array': (
        'SELECT n_nationkey, JSON_ARRAY(n_nationkey, n_name, NULL) AS j FROM nation',
        'SELECT n_nationkey, \'[\' || n_nationkey || \',"\' || n_name || \'",null]\' AS j FROM nation',
    ),
    'json_group': (
        "SELECT JSON_VALUE(props, '$.k') AS k, COUNT(*) AS n FROM events GROUP BY JSON_VALUE(props, '$.k')",
        "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1",
    ),
    'json_table': (
        'SELECT * FROM JSON_TABLE(\'[{"name":"alice","age":30},{"name":"bob","age":25},{"age":40}]\', \'$[*]\' COLUMNS (name TEXT PATH \'$.name\', age INT PATH \'$.age\')) AS t',
        "SELECT * FROM (VALUES ('alice', CAST(30 AS BIGINT)), ('bob', 25), (NULL, 40)) t(name, age)",
    ),
    'fts_word': (
        "SELECT doc_id FROM documents WHERE text @@ 'the'",
        "SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^a-z0-9\\x{80}-\\x{10FFFF}]+'), 'the')",
    ),
    'fts_bigram': (
        "SELECT doc_id FROM documents_bigram WHERE text @@ 'the'",
        "SELECT doc_id FROM documents WHERE contains(lower(text), 'the')",
    ),
    'fts_and_or': (
        "SELECT doc_id FROM documents_bigram WHERE (text @@ 'ou' OR text @@ 'er') AND text @@ 'an'",
        "SELECT doc_id FROM documents WHERE (contains(lower(text), 'ou') OR contains(lower(text), 'er')) AND contains(lower(text), 'an')",
    ),
    'tpch_q1_like': (
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(l_quantity) AS INT) AS q, MIN(l_discount) AS d FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q, min(l_discount) AS d FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    ),
    'tpch_q3_like': (
        "SELECT o.o_orderkey, count(*) AS n FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY o.o_orderkey ORDER BY n DESC, o.o_orderkey LIMIT 10",
        None,
    ),
    'cast_float_text': (
        'SELECT c_custkey, CAST(c_custkey * 1234567.25 AS TEXT) AS large, CAST(c_custkey / 65536.0 AS TEXT) AS small, CAST(c_nationkey * 100000000000000000000.0 AS TEXT) AS huge, CAST(-c_nationkey / 4.0 AS TEXT) AS neg FROM customer',
        "SELECT c_custkey, rtrim(rtrim(printf('%.2f', c_custkey * 1234567.25), '0'), '.') AS large, CASE WHEN c_custkey % 65536 = 0 THEN CAST(c_custkey // 65536 AS VARCHAR) ELSE rtrim(printf('%.16f', c_custkey / 65536.0), '0') END AS small, CASE WHEN c_nationkey = 0 THEN '0' ELSE c_nationkey || '00000000000000000000' END AS huge, rtrim(rtrim(printf('%.2f', 0 - c_nationkey / 4.0), '0'), '.') AS neg FROM customer",
    ),
    'json_float': (
        "SELECT n_nationkey, JSON_ARRAY(n_nationkey * 0.5, 0.0000005, 1234567.5, 1000000000000000000000.0) AS j FROM nation",
        "SELECT n_nationkey, '[' || CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey // 2 AS VARCHAR) ELSE (n_nationkey // 2) || '.5' END || ',5e-7,1234567.5,1e+21]' AS j FROM nation",
    ),
    'arith_subquery': (
        'SELECT r_regionkey, (SELECT COUNT(*) FROM region) / 2 AS h, (SELECT AVG(r_regionkey) FROM region) / 4 AS f FROM region',
        'SELECT r_regionkey, CAST(2 AS BIGINT) AS h, 0.5::DOUBLE AS f FROM region',
    ),
    'arith_case_mixed': (
        "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2.5 END / 2 AS x, COALESCE(NULLIF(o_custkey, 7), 0.5) / 2 AS y FROM orders",
        "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1.25 END::DOUBLE AS x, CASE WHEN o_custkey = 7 THEN 0.25 ELSE o_custkey // 2 END::DOUBLE AS y FROM orders",
    ),
    'fn_round_digits': (
        'SELECT c_custkey, ROUND(c_acctbal, 1) AS a, ROUND(c_acctbal, -2) AS b, ROUND(c_custkey, -1) AS c FROM customer',
        'SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END * floor(abs(c_acctbal) * 10 + 0.5) / 10 AS a, CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END * floor(abs(c_acctbal) * 0.01 + 0.5) / 0.01 AS b, CAST((c_custkey + 5) // 10 * 10 AS BIGINT) AS c FROM customer',
    ),
    'fn_mod_negative': (
        'SELECT c_custkey, MOD(-c_custkey, 7) AS a, MOD(c_custkey, -7) AS b, -c_custkey / 7 AS d FROM customer',
        'SELECT c_custkey, CAST(-(c_custkey % 7) AS BIGINT) AS a, c_custkey % 7 AS b, CAST(-(c_custkey // 7) AS BIGINT) AS d FROM customer',
    ),
    'agg_bare_column': (
        'SELECT n_regionkey, r_name, COUNT(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey',
        'SELECT n_regionkey, any_value(r_name) AS r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey',
    ),
    'sub_in_corr_group': (
        'SELECT c.c_custkey FROM customer c WHERE c.c_nationkey IN (SELECT MOD(o.o_orderkey, 25) FROM orders o WHERE o.o_custkey = c.c_custkey GROUP BY MOD(o.o_orderkey, 25))',
        'SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderkey % 25 = c.c_nationkey)',
    ),
    'sub_in_corr_distinct': (
        'SELECT c.c_custkey FROM customer c WHERE c.c_nationkey NOT IN (SELECT DISTINCT MOD(o.o_orderkey, 5) FROM orders o WHERE o.o_custkey = c.c_custkey)',
        'SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderkey % 5 = c.c_nationkey)',
    ),
    'sub_in_corr_union': (
        "SELECT r.r_regionkey FROM region r WHERE 3 IN (SELECT n.n_nationkey FROM nation n WHERE n.n_regionkey = r.r_regionkey UNION SELECT s.s_suppkey FROM supplier s WHERE s.s_nationkey = r.r_regionkey)",
        "SELECT r.r_regionkey FROM region r WHERE EXISTS (SELECT 1 FROM nation n WHERE n.n_regionkey = r.r_regionkey AND n.n_nationkey = 3) OR EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = r.r_regionkey AND s.s_suppkey = 3)",
    ),
    'json_path_array': (
        "SELECT JSON_VALUE('{\"a\":[{\"b\":\"x\"},{\"b\":\"y\"}]}', '$.a[1].b') AS v, JSON_QUERY('{\"a\":[1,2]}', '$.a') AS q, JSON_EXISTS('{\"a\":[1,2]}', '$.a[5]') AS e",
        "SELECT 'y' AS v, '[1,2]' AS q, false AS e",
    ),
    'distinct_order_hidden': (
        'SELECT DISTINCT o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 3',
        'SELECT o_orderpriority FROM (SELECT o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1) ORDER BY k LIMIT 3',
    ),
    'having_global': (
        'SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 1000000',
        None,
    ),
    'json_query': (
        "SELECT event_id, JSON_QUERY(props, '$') AS q, JSON_QUERY(props, '$.k') AS s FROM events",
        'SELECT event_id, CAST(json(props) AS VARCHAR) AS q, CAST(NULL AS VARCHAR) AS s FROM events',
    ),
    'like_negated': (
        "SELECT p_partkey FROM part WHERE NOT (p_type LIKE '%A%') AND p_brand NOT LIKE '%3'",
        None,
    ),
    'sub_in_case': (
        "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%'))",
        None,
    ),
    'agg_sum_distinct': (
        'SELECT o_orderstatus, SUM(DISTINCT MOD(o_custkey, 10)) AS s FROM orders GROUP BY o_orderstatus',
        'SELECT o_orderstatus, CAST(sum(DISTINCT o_custkey % 10) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus',
    ),
}


CUSTOMERS = (
    "CREATE TABLE c (id INT PRIMARY KEY, seg TEXT, nat INT, bal FLOAT)",
    "INSERT INTO c SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal FROM customer",
)
OF_C = "SELECT c_custkey AS id, c_mktsegment AS seg, c_nationkey::BIGINT AS nat, c_acctbal AS bal FROM customer"

ARTICLES = ("CREATE TABLE a (id INT PRIMARY KEY, body TEXT)", "INSERT INTO a SELECT doc_id, text FROM documents")
WORD_INDEX = (*ARTICLES, "CREATE INDEX g ON a (body) USING GIN")
PAIR_INDEX = (*ARTICLES, "CREATE INDEX g ON a (body) USING GIN WITH (tokenizer = 'bigram')")
PATH_INDEX = ("CREATE TABLE e (id INT, props JSONB)", "INSERT INTO e SELECT event_id, props FROM events", "CREATE INDEX g ON e (props) USING GIN")
HAS_WORD = "list_contains(regexp_split_to_array(lower(text), '[^a-z0-9\\x{80}-\\x{10FFFF}]+'), '%s')"

#: name: (statements that change an engine of their own, a query of what they made, SQL of the oracle)
SCRIPTS: dict[str, tuple[tuple[str, ...], str, str]] = {
    'dml_insert_values': (
        ("CREATE TABLE t (id INT PRIMARY KEY, name TEXT, score FLOAT DEFAULT 1.5)", "INSERT INTO t (id, name) VALUES (1, 'a'), (2, NULL)", "INSERT INTO t VALUES (3, 'c', 2)"),
        'SELECT id, name, score FROM t',
        "SELECT * FROM (VALUES (1::BIGINT, 'a', 1.5::DOUBLE), (2, NULL, 1.5), (3, 'c', 2.0)) t(id, name, score)",
    ),
    'dml_insert_select': (CUSTOMERS, 'SELECT id, seg, nat, bal FROM c', OF_C),
    'dml_insert_select_again': (
        (*CUSTOMERS, "INSERT INTO c (id, seg) SELECT id + 1000000, CONCAT(seg, '2') FROM c WHERE nat < 5"),
        'SELECT id, seg, nat, bal FROM c',
        f"WITH c AS ({OF_C}) SELECT * FROM c UNION ALL SELECT id + 1000000, seg || '2', NULL, NULL FROM c WHERE nat < 5",
    ),
    'dml_update': (
        (*CUSTOMERS, "UPDATE c SET bal = bal * 2, seg = LOWER(seg) WHERE seg = 'BUILDING' AND nat > 3"),
        'SELECT id, seg, nat, bal FROM c',
        f"WITH c AS ({OF_C}) SELECT id, CASE WHEN seg = 'BUILDING' AND nat > 3 THEN lower(seg) ELSE seg END AS seg, nat, CASE WHEN seg = 'BUILDING' AND nat > 3 THEN bal * 2 ELSE bal END AS bal FROM c",
    ),
    'dml_update_order_limit': (
        (*CUSTOMERS, "UPDATE c SET nat = -1 WHERE seg = 'MACHINERY' ORDER BY bal DESC, id LIMIT 7"),
        'SELECT id, nat FROM c',
        f"WITH c AS ({OF_C}), m AS (SELECT id FROM c WHERE seg = 'MACHINERY' ORDER BY bal DESC, id LIMIT 7) SELECT id, CASE WHEN id IN (FROM m) THEN -1 ELSE nat END AS nat FROM c",
    ),
    'dml_delete': ((*CUSTOMERS, "DELETE FROM c WHERE bal < 0 OR nat IN (1, 2)"), 'SELECT id FROM c', f"WITH c AS ({OF_C}) SELECT id FROM c WHERE NOT (bal < 0 OR nat IN (1, 2))"),
    'dml_delete_order_limit': ((*CUSTOMERS, "DELETE FROM c WHERE nat = 4 ORDER BY id DESC LIMIT 3"), 'SELECT id FROM c', f"WITH c AS ({OF_C}) SELECT id FROM c WHERE id NOT IN (SELECT id FROM c WHERE nat = 4 ORDER BY id DESC LIMIT 3)"),
    'ddl_alter_add': ((*CUSTOMERS, "ALTER TABLE c ADD COLUMN note TEXT DEFAULT 'new'", "INSERT INTO c (id) VALUES (-1)"), 'SELECT id, note FROM c', f"WITH c AS ({OF_C}) SELECT id, 'new' AS note FROM c UNION ALL SELECT -1, 'new'"),
    'ddl_alter_drop': ((*CUSTOMERS, "ALTER TABLE c DROP COLUMN seg"), 'SELECT * FROM c', f"WITH c AS ({OF_C}) SELECT id, nat, bal FROM c"),
    'ddl_truncate': ((*CUSTOMERS, "TRUNCATE TABLE c", "INSERT INTO c (id) VALUES (5)"), 'SELECT id, seg FROM c', "SELECT 5::BIGINT AS id, NULL::VARCHAR AS seg"),
    'ddl_drop_and_create': ((*CUSTOMERS, "DROP TABLE c", "CREATE TABLE c (a INT, b TEXT)", "INSERT INTO c SELECT r_regionkey, r_name FROM region"), 'SELECT a, b FROM c', "SELECT r_regionkey::BIGINT AS a, r_name AS b FROM region"),
    'ddl_unique_index': (
        ("CREATE TABLE n (id INT, name TEXT UNIQUE)", "INSERT INTO n SELECT n_nationkey, n_name FROM nation", "CREATE UNIQUE INDEX u ON n (id)", "CREATE INDEX b ON n (name)", "DROP INDEX b"),
        "SELECT id, name FROM n WHERE id IN (3, 4) OR name LIKE 'A%'",
        "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation WHERE n_nationkey IN (3, 4) OR n_name LIKE 'A%'",
    ),
    'ddl_databases': (
        ("CREATE DATABASE d", "USE d", "CREATE TABLE t (k INT, v TEXT)", "INSERT INTO t VALUES (1, 'one'), (3, 'three')"),
        'SELECT r.r_name, t.v FROM default.region r JOIN t ON r.r_regionkey = t.k',
        "SELECT r_name, CASE r_regionkey WHEN 1 THEN 'one' ELSE 'three' END AS v FROM region WHERE r_regionkey IN (1, 3)",
    ),
    'ddl_show_tables': (("CREATE DATABASE d", "USE d", "CREATE TABLE b (k INT)", "CREATE TABLE a (k INT)"), 'SHOW TABLES', "SELECT unnest(['a', 'b']) AS \"table\""),
    'ddl_show_databases': (("CREATE DATABASE d", "CREATE DATABASE e", "DROP DATABASE d"), 'SHOW DATABASES', "SELECT unnest(['default', 'e']) AS database"),
    'pk_lookup': (CUSTOMERS, 'SELECT id, seg FROM c WHERE id = 17', f"WITH c AS ({OF_C}) SELECT id, seg FROM c WHERE id = 17"),
    'gin_word_match': (WORD_INDEX, "SELECT id FROM a WHERE body @@ 'the'", f"SELECT doc_id AS id FROM documents WHERE {HAS_WORD % 'the'}"),
    'gin_word_and_or': (
        WORD_INDEX,
        "SELECT id FROM a WHERE (body @@ 'License' OR body @@ 'email') AND id > 100",
        f"SELECT doc_id AS id FROM documents WHERE ({HAS_WORD % 'license'} OR {HAS_WORD % 'email'}) AND doc_id > 100",
    ),
    'gin_kept_by_changes': (
        (*WORD_INDEX, "DELETE FROM a WHERE id < 50", "INSERT INTO a VALUES (-1, 'the end'), (-2, 'nothing')"),
        "SELECT id FROM a WHERE body @@ 'the'",
        f"SELECT doc_id AS id FROM documents WHERE doc_id >= 50 AND {HAS_WORD % 'the'} UNION ALL SELECT -1",
    ),
    'gin_bigram_match': (PAIR_INDEX, "SELECT id FROM a WHERE body @@ 'icen'", "SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'icen')"),
    'gin_like': (PAIR_INDEX, "SELECT id FROM a WHERE body LIKE '%License%'", "SELECT doc_id AS id FROM documents WHERE text LIKE '%License%'"),
    'gin_equal_in': (
        (*WORD_INDEX, "INSERT INTO a VALUES (-1, 'one two'), (-2, 'two one'), (-3, 'One Two')"),
        "SELECT id FROM a WHERE body = 'one two' OR body IN ('One Two', 'three')",
        "SELECT unnest([-1::BIGINT, -3]) AS id",
    ),
    'gin_json_path': (PATH_INDEX, "SELECT id FROM e WHERE JSON_VALUE(props, '$.k') = '50' OR JSON_VALUE(props, '$.k') IN ('7', '8')", "SELECT event_id AS id FROM events WHERE json_extract_string(props, '$.k') IN ('50', '7', '8')"),
    'jsonb_column': (
        PATH_INDEX,
        "SELECT id, JSON_VALUE(props, '$.k') AS k FROM e WHERE CAST(JSON_VALUE(props, '$.k') AS INT) < 50",
        "SELECT event_id AS id, json_extract_string(props, '$.k') AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) < 50",
    ),
    'json_column': (
        ("CREATE TABLE e (id INT, props JSON)", "INSERT INTO e SELECT event_id, props FROM events"),
        "SELECT id, JSON_EXISTS(props, '$.k') AS k, props IS JSON AS j FROM e",
        "SELECT event_id AS id, json_exists(props, '$.k') AS k, true AS j FROM events",
    ),
    'explain_access': (
        (*CUSTOMERS, "CREATE INDEX by_nat ON c (nat)"),
        "EXPLAIN SELECT c.id FROM c JOIN nation n ON c.nat = n.n_nationkey WHERE c.id IN (SELECT id FROM c WHERE nat = 3 UNION SELECT id FROM c WHERE id = 9)",
        """SELECT * FROM (VALUES (1, 'SELECT', 'c', 'full scan', 'PRIMARY, by_nat', '', 'Using where'), (2, 'INNER JOIN', 'nation', 'full scan', '', '', 'Using join condition; Using hash join'),
        (3, 'SELECT', 'c', 'ref', 'PRIMARY, by_nat', 'by_nat', ''), (4, 'UNION', '', '', '', '', ''), (5, 'SELECT', 'c', 'const', 'PRIMARY, by_nat', 'PRIMARY', '')) t(id, operation, "table", "type", possible_keys, "key", extra)""",
    ),
    'explain_derived': (
        (),
        "EXPLAIN SELECT t.k FROM (SELECT o_custkey AS k FROM orders GROUP BY o_custkey) t ORDER BY t.k LIMIT 3",
        """SELECT * FROM (VALUES (1, 'SELECT', '<subquery>', 'subquery', '', '', 'FROM subquery; Using filesort; Using limit'), (2, 'DERIVED', 'orders', 'full scan', '', '', 'Using group by')) t(id, operation, "table", "type", possible_keys, "key", extra)""",
    ),
    'stmt_log_replay': (
        (*CUSTOMERS, "DELETE FROM c WHERE nat > 2", "UPDATE c SET seg = NULL WHERE nat = 1"),
        'SELECT id, seg FROM c',
        f"WITH c AS ({OF_C}) SELECT id, CASE WHEN nat = 1 THEN NULL ELSE seg END AS seg FROM c WHERE nat <= 2",
    ),
}


def engine_for(spark, sf_dir: str) -> Engine:
    """The shared tables, one of them again under an index that makes @@ match parts of words."""
    engine = register_folder(Engine(spark), sf_dir, TABLES)
    engine.register("documents_bigram", lambda: spark.read.parquet(f"{sf_dir}/documents.parquet"))
    engine.sql("CREATE INDEX parts ON documents_bigram (text) USING GIN WITH (tokenizer = 'bigram')")
    engine.register("few_nations", lambda: engine.sql("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey < 10"))
    return engine


def _query(text: str):
    return lambda spark, sf_dir: engine_for(spark, sf_dir).sql(text)


def run_script(spark, sf_dir: str, name: str):
    """The result of a script's query. What was logged is replayed in a second engine, where the script says so."""
    statements, query, _ = SCRIPTS[name]
    if name == "stmt_log_replay":
        with tempfile.TemporaryDirectory() as folder:
            first = engine_for(spark, sf_dir)
            first.log = StatementLog(f"{folder}/log")
            for text in statements:
                first.sql(text)
            engine = engine_for(spark, sf_dir)
            engine.log = first.log
            engine.replay()
    else:
        engine = engine_for(spark, sf_dir)
        for text in statements:
            engine.sql(text)
    out = engine.sql(query)
    return out.drop("plan") if query.startswith("EXPLAIN") else out


def _script(name: str):
    return lambda spark, sf_dir: run_script(spark, sf_dir, name)


QUERIES = {name: _query(text) for name, (text, _) in STATEMENTS.items()} | {name: _script(name) for name in SCRIPTS}
SQL = {name: other or text for name, (text, other) in STATEMENTS.items()} | {name: sql for name, (_, _, sql) in SCRIPTS.items()}
