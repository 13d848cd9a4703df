"""Queries over the driver's tables, one for each operator or group of functions, with the same in SQL."""

from __future__ import annotations

_JOIN = "customer c JOIN orders o ON c.c_custkey = o.o_custkey"

#: name: (query, SQL)
EXAMPLES: dict[str, tuple[str, str]] = {
    "flagship": (
        """// customers with more than three orders in 1996
        FIND customers c, orders o FILTER count(o) > 3 AND o.order_date BETWEEN "1996-01-01" AND "1996-12-31" FETCH c.name customer, count(o) n DESC""",
        f"SELECT c.c_name AS customer, count(o.o_orderkey) AS n FROM {_JOIN} WHERE o.o_orderdate >= DATE '1996-01-01' AND o.o_orderdate < DATE '1997-01-01' GROUP BY c.c_name HAVING count(o.o_orderkey) > 3",
    ),
    "scan_project": ("FIND nations n FETCH n.nationkey k, n.name name", "SELECT n_nationkey AS k, n_name AS name FROM nation"),
    "filter_comparisons": (
        "FIND parts p FILTER p.size >= 10 AND p.size < 40 AND p.retailprice > 910 AND p.retailprice <= 990.5 AND NOT p.brand = 'Brand#11' FETCH p.partkey, p.size, p.retailprice",
        "SELECT p_partkey AS partkey, p_size AS size, p_retailprice AS retailprice FROM part WHERE p_size >= 10 AND p_size < 40 AND p_retailprice > 910 AND p_retailprice <= 990.5 AND p_brand <> 'Brand#11'",
    ),
    "filter_like": ("FIND parts p FILTER p.type LIKE '%O%' AND NOT p.name LIKE 'b_%' AND p.name like '%g%' FETCH p.partkey, p.type, p.name", "SELECT p_partkey AS partkey, p_type AS type, p_name AS name FROM part WHERE p_type LIKE '%O%' AND p_name NOT LIKE 'b_%' AND p_name LIKE '%g%'"),
    "filter_in_list": ("FIND orders o FILTER o.orderstatus IN ('F', 'O') AND NOT o.orderkey IN (1, 2, 3) FETCH o.orderkey, o.orderstatus", "SELECT o_orderkey AS orderkey, o_orderstatus AS orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey NOT IN (1, 2, 3)"),
    "filter_in_subselect": (
        "FIND customers c FILTER c.custkey IN (FIND orders o FILTER o.totalprice > 400000 FETCH o.custkey) FETCH c.custkey, c.name",
        "SELECT c_custkey AS custkey, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    ),
    "filter_not_in_subselect": (
        "FIND customers c FILTER NOT c.custkey IN (FIND orders o FILTER o.orderstatus = 'F' FETCH o.custkey) FETCH c.custkey, c.acctbal",
        "SELECT c_custkey AS custkey, c_acctbal AS acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    ),
    "filter_between_dates": (
        """FIND orders o FILTER o.order_date BETWEEN "1996-03-01" AND "1996-03-31" FETCH o.orderkey, o.order_date""",
        "SELECT o_orderkey AS orderkey, o_orderdate AS order_date FROM orders WHERE o_orderdate >= DATE '1996-03-01' AND o_orderdate < DATE '1996-04-01'",
    ),
    "filter_between_timestamps": (
        """FIND events e FILTER e.ts BETWEEN "2024-01-01 06:00:00" AND "2024-01-02 01:00:00" FETCH e.event_id, e.ts""",
        "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-01 06:00:00' AND ts < TIMESTAMP '2024-01-03 00:00:00'",
    ),
    "filter_between_numbers": ("FIND customers c FILTER c.acctbal BETWEEN 100 AND 200.5 FETCH c.custkey, c.acctbal", "SELECT c_custkey AS custkey, c_acctbal AS acctbal FROM customer WHERE c_acctbal BETWEEN 100 AND 200.5"),
    "filter_isnull": (
        "FIND customers c, + orders o FILTER o.totalprice > 450000 FETCH c.custkey k, case(o.orderkey ISNULL, 'none', 'some') found",
        "SELECT c.c_custkey AS k, CASE WHEN o.o_orderkey IS NULL THEN 'none' ELSE 'some' END AS found FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 450000",
    ),
    "filter_nested_logic": (
        "FIND parts p FILTER NOT (p.size < 5 OR p.size > 45 AND NOT p.brand LIKE '%1%') AND (p.type LIKE 'S%' OR p.retailprice < 950) FETCH p.partkey, p.size",
        "SELECT p_partkey AS partkey, p_size AS size FROM part WHERE NOT (p_size < 5 OR (p_size > 45 AND NOT p_brand LIKE '%1%')) AND (p_type LIKE 'S%' OR p_retailprice < 950)",
    ),
    "exists": (
        "FIND customers c FILTER EXISTS (c orders o, lineitems l FILTER l.quantity > 49 AND o.orderstatus = 'F') FETCH c.custkey, c.name",
        "SELECT c_custkey AS custkey, c_name AS name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_custkey = c.c_custkey AND l.l_quantity > 49 AND o.o_orderstatus = 'F')",
    ),
    "not_exists": (
        "FIND customers c, nations n FILTER NOT EXISTS (c orders o FILTER o.orderstatus = 'F') FETCH n.name nation, count(c) n DESC",
        "SELECT n_name AS nation, count(c_custkey) AS n FROM customer c JOIN nation ON c_nationkey = n_nationkey WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') GROUP BY n_name",
    ),
    "exists_under_or": (
        "FIND customers c FILTER c.acctbal < -500 OR EXISTS (c orders o FILTER o.totalprice > 450000 OR o.orderkey < 100) FETCH c.custkey, c.acctbal",
        "SELECT c_custkey AS custkey, c_acctbal AS acctbal FROM customer c WHERE c_acctbal < -500 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND (o.o_totalprice > 450000 OR o.o_orderkey < 100))",
    ),
    "exists_with_outer_reference": (
        "FIND customers c FILTER EXISTS (c orders o FILTER o.totalprice > 60 * c.acctbal AND c.acctbal > 0) FETCH c.custkey",
        "SELECT c_custkey AS custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 60 * c.c_acctbal AND c.c_acctbal > 0)",
    ),
    "scalar_subselect": (
        "FIND customers c FILTER c.acctbal > (FIND customers c2 FETCH avg(c2.acctbal)) FETCH c.custkey, c.acctbal",
        "SELECT c_custkey AS custkey, c_acctbal AS acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
    ),
    "scalar_subselect_correlated": (
        "FIND customers c FETCH c.custkey k, (FIND orders o FILTER o.custkey = c.custkey FETCH max(o.totalprice)) largest",
        "SELECT c_custkey AS k, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c.c_custkey) AS largest FROM customer c",
    ),
    "inner_chain": (
        "FIND regions r, nations n, customers c, orders o FILTER r.name = 'ASIA' AND o.totalprice > 300000 FETCH r.name region, n.name nation, c.custkey custkey, o.orderkey orderkey",
        f"SELECT r_name AS region, n_name AS nation, c_custkey AS custkey, o_orderkey AS orderkey FROM {_JOIN} JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_totalprice > 300000",
    ),
    "named_link": ("FIND customers c, c VIA lives_in nations n FILTER n.name LIKE 'NATION_1%' FETCH c.custkey, n.name nation", "SELECT c_custkey AS custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name LIKE 'NATION_1%'"),
    "inverse_link": ("FIND nations n, customers c VIA home_of FETCH n.name nation, count(c) n", "SELECT n_name AS nation, count(c_custkey) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name"),
    "outer_link_filter_on": (
        "FIND customers c, c + orders o FILTER o.totalprice > 300000 FETCH c.custkey k, count(o) n",
        "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_custkey",
    ),
    "outer_subtree": (
        "FIND customers c, + orders o, o lineitems l FILTER l.quantity > 48 AND c.custkey < 300 FETCH c.custkey k, count(l) n",
        "SELECT c_custkey AS k, count(l_orderkey) AS n FROM customer LEFT JOIN (SELECT o_custkey, l_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 48) ON c_custkey = o_custkey WHERE c_custkey < 300 GROUP BY c_custkey",
    ),
    "self_join": (
        "FIND customers c, nations n, n customers c2 FILTER c.custkey < c2.custkey AND c.mktsegment = c2.mktsegment AND c.acctbal > 9000 AND c2.acctbal > 9000 FETCH c.custkey a, c2.custkey b",
        "SELECT c.c_custkey AS a, d.c_custkey AS b FROM customer c JOIN nation ON c.c_nationkey = n_nationkey JOIN customer d ON d.c_nationkey = n_nationkey WHERE c.c_custkey < d.c_custkey AND c.c_mktsegment = d.c_mktsegment AND c.c_acctbal > 9000 AND d.c_acctbal > 9000",
    ),
    "back_reference": (
        "FIND customers c, orders o, lineitems l, suppliers s, nations n, c nations n FETCH n.name nation, count(l) n",
        "SELECT n_name AS nation, count(l_orderkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey AND c_nationkey = n_nationkey GROUP BY n_name",
    ),
    "aggregates": (
        "FIND lineitems l FETCH l.returnflag flag, l.linestatus status, count(l) n, round(sum(l.quantity), 2) total, round(avg(l.extendedprice), 4) mean, min(l.discount) low, max(l.tax) high",
        "SELECT l_returnflag AS flag, l_linestatus AS status, count(l_orderkey) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_extendedprice), 4) AS mean, min(l_discount) AS low, max(l_tax) AS high FROM lineitem GROUP BY ALL",
    ),
    "aggregate_global": ("FIND orders o FETCH count(o) n, min(o.order_date) first, max(o.order_date) last", "SELECT count(o_orderkey) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders"),
    "aggregate_expressions": (
        "FIND orders o FETCH o.orderpriority priority, round(sum(o.totalprice) / count(o), 4) mean, count(o) * 2 + 1 odd",
        "SELECT o_orderpriority AS priority, round(sum(o_totalprice) / count(o_orderkey), 4) AS mean, count(o_orderkey) * 2 + 1 AS odd FROM orders GROUP BY o_orderpriority",
    ),
    "bit_aggregates": ("FIND nations n FETCH n.regionkey r, bit_and(n.nationkey) a, bit_or(n.nationkey) o, bit_xor(n.nationkey) x", "SELECT n_regionkey AS r, bit_and(n_nationkey) AS a, bit_or(n_nationkey) AS o, bit_xor(n_nationkey) AS x FROM nation GROUP BY n_regionkey"),
    "string_agg": ("FIND nations n, regions r FETCH r.name region, length(string_agg(n.name, ', ')) size", "SELECT r_name AS region, CAST(length(string_agg(n_name, ', ')) AS INTEGER) AS size FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "group_by_expression": (
        "FIND orders o FETCH year(o.order_date) y, month(o.order_date) m, count(o) n",
        "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, count(o_orderkey) AS n FROM orders GROUP BY ALL",
    ),
    "having": ("FIND orders o FILTER sum(o.totalprice) > 2000000 FETCH o.custkey", "SELECT o_custkey AS custkey FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 2000000"),
    "having_and_where": (
        "FIND orders o FILTER o.orderstatus = 'O' AND 3 < count(o) AND (count(o) > 6 OR sum(o.totalprice) > 900000) FETCH o.custkey, count(o) n",
        "SELECT o_custkey AS custkey, count(o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey HAVING 3 < count(o_orderkey) AND (count(o_orderkey) > 6 OR sum(o_totalprice) > 900000)",
    ),
    "rollup": (
        "FIND nations n, regions r, n customers c FETCH r.name region, n.name nation, count(c) n ROLLUP",
        "SELECT r_name AS region, n_name AS nation, count(c_custkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (r_name, n_name)",
    ),
    "distinct": ("FIND customers c, orders o FETCH DISTINCT c.mktsegment segment, o.orderstatus status", f"SELECT DISTINCT c_mktsegment AS segment, o_orderstatus AS status FROM {_JOIN}"),
    "order_top_k": (
        "FIND orders o FETCH o.orderkey ASC 2, o.totalprice DESC 1 LIMIT 25",
        "SELECT o_orderkey AS orderkey, o_totalprice AS totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25",
    ),
    "union_distinct": ("FIND customers c FETCH c.nationkey k UNION FIND suppliers s FETCH s.nationkey", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "union_all": ("FIND customers c FETCH c.nationkey k UNIONALL FIND suppliers s FETCH s.nationkey", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "minus": ("FIND nations n FETCH n.nationkey k MINUS FIND suppliers s FILTER s.acctbal > 5000 FETCH s.nationkey", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000"),
    "intersect_binds_tighter": (
        "FIND regions r FETCH r.regionkey k UNION FIND customers c FILTER c.acctbal > 9500 FETCH c.nationkey INTERSECT FIND suppliers s FETCH s.nationkey",
        "SELECT r_regionkey AS k FROM region UNION (SELECT c_nationkey FROM customer WHERE c_acctbal > 9500 INTERSECT SELECT s_nationkey FROM supplier)",
    ),
    "set_in_parentheses": (
        "FIND customers c FETCH c.nationkey k, c.mktsegment s MINUS (FIND customers c FILTER c.acctbal > 9000 FETCH c.nationkey, c.mktsegment UNION FIND customers c FILTER c.acctbal < -500 FETCH c.nationkey, c.mktsegment)",
        "SELECT c_nationkey AS k, c_mktsegment AS s FROM customer EXCEPT (SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9000 UNION SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal < -500)",
    ),
    "block": (
        "WITH large AS (FIND orders o FILTER o.totalprice > 300000 FETCH o.custkey custkey, count(o) n) FIND large x FILTER x.n > 1 FETCH x.custkey, x.n",
        "SELECT o_custkey AS custkey, count(o_orderkey) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey HAVING count(o_orderkey) > 1",
    ),
    "blocks_chained": (
        "WITH a AS (FIND orders o FETCH o.custkey k, sum(o.totalprice) total), b AS (FIND a x FILTER x.total > 1500000 FETCH x.k, x.total) FIND b y FETCH y.k, round(y.total, 2) total",
        "WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT k, round(total, 2) AS total FROM a WHERE total > 1500000",
    ),
    "block_join_inferred_column": (
        "WITH sales AS (FIND orders o, lineitems l FETCH sum(l.extendedprice) revenue) FIND customers c, sales s FETCH c.name customer, round(sum(s.revenue), 2) revenue",
        "WITH sales AS (SELECT sum(l_extendedprice) AS revenue, o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey) SELECT c_name AS customer, round(sum(revenue), 2) AS revenue FROM customer JOIN sales ON c_custkey = o_custkey GROUP BY c_name",
    ),
    "count_over_block": (
        "WITH open AS (FIND orders o FILTER o.orderstatus = 'O' FETCH o.totalprice price) FIND customers c, + open x FETCH c.mktsegment segment, count(x) n",
        "SELECT c_mktsegment AS segment, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') ON c_custkey = o_custkey GROUP BY c_mktsegment",
    ),
    "recursive_block": (
        """WITH step AS (FIND regions r FILTER r.regionkey = 0 FETCH r.regionkey k, r.name name, 0 depth
        UNIONALL FIND step s FILTER s.depth < 6 FETCH s.k, s.name, s.depth + 1)
        FIND step s FETCH s.k, s.name, s.depth""",
        "WITH RECURSIVE step AS (SELECT r_regionkey AS k, r_name AS name, 0 AS depth FROM region WHERE r_regionkey = 0 UNION ALL SELECT k, name, depth + 1 FROM step WHERE depth < 6) SELECT k, name, depth FROM step",
    ),
    "window_ranks": (
        "FIND orders o FETCH o.orderkey, row_number() OVER (PARTITION o.custkey ORDER o.totalprice DESC) rn, rank() OVER (PARTITION o.orderstatus ORDER o.orderpriority) r, dense_rank() OVER (PARTITION o.orderstatus ORDER o.orderpriority) d",
        "SELECT o_orderkey AS orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rn, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS r, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS d FROM orders",
    ),
    "window_lag_lead": (
        "FIND orders o FETCH o.orderkey, o.totalprice - lag(o.totalprice) OVER (PARTITION o.custkey ORDER o.orderkey) step, lead(o.orderkey, 2) OVER (PARTITION o.custkey ORDER o.orderkey) later",
        "SELECT o_orderkey AS orderkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS later FROM orders",
    ),
    "window_running_total": (
        "FIND orders o FETCH o.orderkey, round(sum(o.totalprice) OVER (PARTITION o.custkey ORDER o.orderkey), 2) running, round(avg(o.totalprice) OVER (PARTITION o.custkey ORDER o.orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) moving",
        "SELECT o_orderkey AS orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS running, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM orders",
    ),
    "window_share_of_total": (
        "FIND nations n, regions r, n customers c FETCH r.name region, n.name nation, round(sum(c.acctbal), 2) total, round(sum(c.acctbal) / sum(sum(c.acctbal)) OVER (PARTITION r.name), 8) share",
        "SELECT r_name AS region, n_name AS nation, round(sum(c_acctbal), 2) AS total, round(sum(c_acctbal) / sum(sum(c_acctbal)) OVER (PARTITION BY r_name), 8) AS share FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name",
    ),
    "window_distribution": (
        "FIND nations n FETCH n.nationkey k, ntile(4) OVER (ORDER n.nationkey) t, round(percent_rank() OVER (ORDER n.nationkey), 6) p, round(cume_dist() OVER (ORDER n.nationkey), 6) c, first_value(n.name) OVER (PARTITION n.regionkey ORDER n.nationkey) f, last_value(n.name) OVER (PARTITION n.regionkey ORDER n.nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) l, nth_value(n.name, 2) OVER (PARTITION n.regionkey ORDER n.nationkey) s",
        "SELECT n_nationkey AS k, ntile(4) OVER (ORDER BY n_nationkey) AS t, round(percent_rank() OVER (ORDER BY n_nationkey), 6) AS p, round(cume_dist() OVER (ORDER BY n_nationkey), 6) AS c, first_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS f, last_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(n_name, 2) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS s FROM nation",
    ),
    "string_case_and_size": (
        "FIND customers c FETCH c.custkey k, upper(c.name) u, lower(c.mktsegment) l, length(c.name) n, octet_length(c.name) o, bit_length(c.name) b, reverse(c.name) r, left(c.name, 3) f, right(c.name, 4) e, repeat(c.mktsegment, 2) d",
        "SELECT c_custkey AS k, upper(c_name) AS u, lower(c_mktsegment) AS l, CAST(length(c_name) AS INTEGER) AS n, CAST(strlen(c_name) AS INTEGER) AS o, CAST(bit_length(c_name) AS INTEGER) AS b, reverse(c_name) AS r, left(c_name, 3) AS f, right(c_name, 4) AS e, repeat(c_mktsegment, 2) AS d FROM customer",
    ),
    "string_parts": (
        "FIND customers c FETCH c.custkey k, substr(c.name, 3, 5) a, substring(c.name, 10) b, split_part(c.name, '#', 2) p, strpos(c.name, '#') i, position('mer', c.name) j, replace(c.name, '0', '-') x, translate(c.name, 'Cu', 'cU') t, starts_with(c.name, 'Cust') s",
        "SELECT c_custkey AS k, substr(c_name, 3, 5) AS a, substring(c_name, 10) AS b, split_part(c_name, '#', 2) AS p, CAST(strpos(c_name, '#') AS INTEGER) AS i, CAST(instr(c_name, 'mer') AS INTEGER) AS j, replace(c_name, '0', '-') AS x, translate(c_name, 'Cu', 'cU') AS t, starts_with(c_name, 'Cust') AS s FROM customer",
    ),
    "string_pad_and_trim": (
        "FIND nations n FETCH n.nationkey k, lpad(n.name, 12, '*') a, rpad(n.name, 4) b, trim(concat('  ', n.name, ' ')) c, ltrim(n.name, 'NA') d, rtrim(n.name, '0123') e, btrim(n.name, 'N1') f",
        "SELECT n_nationkey AS k, lpad(n_name, 12, '*') AS a, rpad(n_name, 4, ' ') AS b, trim(concat('  ', n_name, ' ')) AS c, ltrim(n_name, 'NA') AS d, rtrim(n_name, '0123') AS e, trim(n_name, 'N1') AS f FROM nation",
    ),
    "string_concat": (
        "FIND nations n, regions r FETCH n.nationkey k, concat(n.name, NULL, '/', r.name, n.nationkey) a, concat_ws('-', n.name, r.name) b, ascii(n.name) c, chr(65 + n.regionkey) d, md5(n.name) m, to_hex(n.nationkey + 200) h, sha256(n.name) s",
        "SELECT n_nationkey AS k, concat(n_name, NULL, '/', r_name, n_nationkey) AS a, concat_ws('-', n_name, r_name) AS b, ascii(n_name) AS c, chr(CAST(65 + n_regionkey AS INTEGER)) AS d, md5(n_name) AS m, to_hex(n_nationkey + 200) AS h, sha256(n_name) AS s FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "regular_expressions": (
        "FIND parts p FETCH p.partkey k, regexp_like(p.name, '^.*[aeiou]{2}') l, regexp_replace(p.name, '[0-9]', '_') r, coalesce(regexp_substr(p.name, '[0-9]+'), '') s, regexp_count(p.name, '[0-9]') n, regexp_like(p.type, 'STEEL', 'i') i",
        "SELECT p_partkey AS k, regexp_matches(p_name, '^.*[aeiou]{2}') AS l, regexp_replace(p_name, '[0-9]', '_', 'g') AS r, regexp_extract(p_name, '[0-9]+') AS s, CAST(len(regexp_extract_all(p_name, '[0-9]')) AS INTEGER) AS n, regexp_matches(p_type, 'STEEL', 'i') AS i FROM part",
    ),
    "mathematics": (
        "FIND customers c FETCH c.custkey k, abs(c.acctbal) a, round(c.acctbal) r, ceil(c.acctbal) u, floor(c.acctbal) d, mod(c.custkey, 7) m, round(sqrt(abs(c.acctbal)), 6) q, round(power(c.custkey, 2), 2) p, truncate(c.acctbal) t, c.custkey / 2 h, -c.acctbal n",
        "SELECT c_custkey AS k, abs(c_acctbal) AS a, round(c_acctbal) AS r, ceil(c_acctbal) AS u, floor(c_acctbal) AS d, c_custkey % 7 AS m, round(sqrt(abs(c_acctbal)), 6) AS q, round(power(c_custkey, 2), 2) AS p, trunc(c_acctbal) AS t, c_custkey / 2 AS h, -c_acctbal AS n FROM customer",
    ),
    "conditionals": (
        "FIND customers c FETCH c.custkey k, case(c.acctbal < 0, 'debt', c.acctbal < 5000 AND NOT c.mktsegment = 'BUILDING', 'some', 'rich') kind, coalesce(case(c.acctbal > 9000, c.acctbal), 0) top",
        "SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 AND NOT c_mktsegment = 'BUILDING' THEN 'some' ELSE 'rich' END AS kind, coalesce(CASE WHEN c_acctbal > 9000 THEN c_acctbal END, 0) AS top FROM customer",
    ),
    "conversions": (
        "FIND orders o FETCH o.orderkey k, to_integer(o.totalprice) i, to_float(o.orderkey) f, to_text(o.orderkey) t, to_text(starts_with(o.orderstatus, 'F')) b, to_date(o.order_date) d, to_decimal(o.totalprice, 12, 1) c, to_boolean('true') y",
        "SELECT o_orderkey AS k, CAST(trunc(o_totalprice) AS INTEGER) AS i, CAST(o_orderkey AS DOUBLE) AS f, CAST(o_orderkey AS VARCHAR) AS t, CAST(starts_with(o_orderstatus, 'F') AS VARCHAR) AS b, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(12, 1)) AS c, CAST('true' AS BOOLEAN) AS y FROM orders",
    ),
    "date_parts": (
        "FIND events e FETCH e.event_id id, year(e.ts) y, month(e.ts) mo, day(e.ts) d, hour(e.ts) h, minute(e.ts) mi, second(e.ts) s, date_trunc('hour', e.ts) t, date(e.ts) dt",
        "SELECT event_id AS id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS mo, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS t, CAST(ts AS DATE) AS dt FROM events",
    ),
    "date_begin_and_end": (
        "FIND orders o FETCH o.orderkey k, month_begin(date(o.order_date)) mb, quarter_begin(o.order_date) qb, year_begin(date(o.order_date)) yb, day_begin(o.order_date) db, month_end(o.order_date) me, quarter_end(o.order_date) qe, year_end(o.order_date) ye",
        "SELECT o_orderkey AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS mb, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS qb, CAST(date_trunc('year', o_orderdate) AS DATE) AS yb, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS db, last_day(o_orderdate) AS me, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS qe, make_date(year(o_orderdate), 12, 31) AS ye FROM orders",
    ),
    "date_add": (
        "FIND orders o FETCH o.orderkey k, day_add(date(o.order_date), 10) d, month_add(date(o.order_date), 1) m, year_add(date(o.order_date), -1) y, o.order_date + 1mo2d l, date(o.order_date) - 1w w, o.order_date + 2h30min t",
        "SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 DAY AS DATE) AS d, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS m, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 YEAR AS DATE) AS y, o_orderdate + INTERVAL 1 MONTH + INTERVAL 2 DAY AS l, CAST(CAST(o_orderdate AS DATE) - INTERVAL 7 DAY AS DATE) AS w, o_orderdate + INTERVAL 2 HOUR + INTERVAL 30 MINUTE AS t FROM orders",
    ),
    "date_distance": (
        """FIND lineitems l, orders o FETCH l.orderkey k, l.linenumber n, days_between(date(o.order_date), date(l.ship_date)) d, months_between(date(o.order_date), date(l.ship_date)) m, years_between("1990-05-17", date(l.ship_date)) y, l.ship_date - o.order_date s""",
        "SELECT l_orderkey AS k, l_linenumber AS n, CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS INTEGER) AS d, CAST(12 * year(age(l_shipdate, o_orderdate)) + month(age(l_shipdate, o_orderdate)) AS INTEGER) AS m, CAST(year(age(l_shipdate, TIMESTAMP '1990-05-17')) AS INTEGER) AS y, CAST(epoch(l_shipdate - o_orderdate) AS BIGINT) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    ),
    "date_make_and_parse": (
        "FIND orders o FETCH o.orderkey k, make_date(year(o.order_date), 2, 28) a, make_timestamp(2020, 1, 31, 12, 30, 15) b, parse_date('31.01.2020', 'DD.MM.YYYY') c, parse_timestamp('2020-01-31 08:09:10', '%Y-%m-%d %H:%M:%S') d, to_char(o.order_date, 'YYYY-MM') e",
        "SELECT o_orderkey AS k, make_date(year(o_orderdate), 2, 28) AS a, TIMESTAMP '2020-01-31 12:30:15' AS b, DATE '2020-01-31' AS c, TIMESTAMP '2020-01-31 08:09:10' AS d, strftime(o_orderdate, '%Y-%m') AS e FROM orders",
    ),
    "time_zones": (
        "FIND events e FETCH e.event_id id, at_zone(e.ts, 'America/New_York') ny, to_utc(e.ts, 'Asia/Tokyo') t",
        "SELECT event_id AS id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny, (ts AT TIME ZONE 'Asia/Tokyo') AT TIME ZONE 'UTC' AS t FROM events",
    ),
    "time_of_day": (
        """FIND events e FILTER time(e.ts) >= "06:00:00" AND time(e.ts) + 20h < "12:00:00" FETCH e.event_id id, hour(time(e.ts) + 20h) h, to_text(time(e.ts)) t""",
        "SELECT event_id AS id, CAST(hour(ts + INTERVAL 20 HOUR) AS INTEGER) AS h, strftime(ts, '%H:%M:%S') AS t FROM events WHERE CAST(date_trunc('second', ts) AS TIME) >= TIME '06:00:00' AND CAST(date_trunc('second', ts + INTERVAL 20 HOUR) AS TIME) < TIME '12:00:00'",
    ),
    "duration_comparison": (
        "FIND lineitems l, orders o FILTER l.ship_date - o.order_date > 60d AND date(l.ship_date) - date(o.order_date) < 90d FETCH l.orderkey k, l.linenumber n",
        "SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE epoch(l_shipdate - o_orderdate) > 60 * 86400 AND CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) < 90",
    ),
    "labels_of_documents": ("FIND documents d, labels l FETCH d.lang lang, l.toxic toxic, count(d) n", "SELECT lang, toxic, count(doc_id) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang, toxic"),
    "recursive_through_link": (
        """WITH tree AS (FIND nations n FILTER n.nationkey < 2 FETCH n.nationkey nationkey, n.name name, 0 depth
        UNIONALL FIND tree t, t VIA hub_of nations m FILTER t.depth < 3 FETCH m.nationkey, m.name, t.depth + 1)
        FIND tree t FETCH t.nationkey k, t.name, t.depth, count(t.name) n""",
        "WITH RECURSIVE tree AS (SELECT n_nationkey AS k, n_name AS name, 0 AS depth FROM nation WHERE n_nationkey < 2 UNION ALL SELECT m.n_nationkey, m.n_name, depth + 1 FROM tree JOIN nation m ON m.n_regionkey = k WHERE depth < 3) SELECT k, name, depth, count(name) AS n FROM tree GROUP BY ALL",
    ),
    "recursive_union_distinct": (
        "WITH step AS (FIND nations n FILTER n.nationkey < 10 FETCH n.regionkey k UNION FIND step s FILTER s.k < 8 FETCH s.k + 2) FIND step s FETCH s.k k",
        "WITH RECURSIVE step AS (SELECT n_regionkey AS k FROM nation WHERE n_nationkey < 10 UNION SELECT k + 2 FROM step WHERE k < 8) SELECT CAST(k AS INTEGER) AS k FROM step",
    ),
    "composite_key_link": (
        "FIND conversations a, a VIA same_turn conversations b FILTER a.turn < 3 FETCH a.conv_id c, a.turn t, count(b) n",
        "SELECT a.conv_id AS c, a.turn AS t, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn WHERE a.turn < 3 GROUP BY ALL",
    ),
    "count_rows_and_values": (
        "FIND customers c, c + orders o FILTER o.totalprice > 300000 FETCH c.mktsegment s, count() rows, count(o.totalprice) vals, count(o) n, count(case(c.acctbal > 5000, 1)) rich",
        "SELECT c_mktsegment AS s, count(*) AS rows, count(o_totalprice) AS vals, count(o_orderkey) AS n, count(CASE WHEN c_acctbal > 5000 THEN 1 END) AS rich FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY 1",
    ),
    "window_two_keys": (
        "FIND orders o FETCH o.orderkey, row_number() OVER (PARTITION o.orderstatus ORDER o.orderpriority, o.orderkey DESC) rn, round(sum(o.totalprice) OVER (PARTITION o.orderstatus ORDER o.orderpriority, o.orderkey DESC ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), 2) ahead",
        "SELECT o_orderkey AS orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderkey DESC) AS rn, round(sum(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderkey DESC ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), 2) AS ahead FROM orders",
    ),
    "order_nulls_last": (
        "FIND customers c FETCH case(c.acctbal > 9000, c.acctbal) top DESC 1, c.custkey k ASC 2 LIMIT 400",
        "SELECT CASE WHEN c_acctbal > 9000 THEN c_acctbal END AS top, c_custkey AS k FROM customer ORDER BY top DESC NULLS LAST, k LIMIT 400",
    ),
    "order_nulls_last_ascending": (
        "FIND customers c FETCH case(c.acctbal > 2000, c.acctbal) low ASC 1, c.custkey k ASC 2 LIMIT 300",
        "SELECT CASE WHEN c_acctbal > 2000 THEN c_acctbal END AS low, c_custkey AS k FROM customer ORDER BY low ASC NULLS LAST, k LIMIT 300",
    ),
    "date_plus_time": (
        """FIND events e FETCH e.event_id id, date(e.ts) + time(e.ts) t, to_text(date(e.ts) + "06:30:00") h""",
        "SELECT event_id AS id, date_trunc('second', ts) AS t, strftime(CAST(ts AS DATE) + INTERVAL 390 MINUTE, '%Y-%m-%d %H:%M:%S') AS h FROM events",
    ),
    "time_minus_time": (
        """FIND events e FILTER time(e.ts) - "06:00:00" > 2h FETCH e.event_id id, time(e.ts) - "06:00:00" s""",
        "SELECT event_id AS id, CAST(epoch(date_trunc('second', ts) - date_trunc('day', ts)) - 21600 AS BIGINT) AS s FROM events WHERE epoch(date_trunc('second', ts) - date_trunc('day', ts)) - 21600 > 7200",
    ),
    "times_duration": (
        "FIND orders o FETCH o.orderkey k, date(o.order_date) + 3 * 1w d, o.order_date + 2 * 6h t, o.order_date - (1d + 2 * 12h) u",
        "SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) + INTERVAL 21 DAY AS TIMESTAMP) AS d, o_orderdate + INTERVAL 12 HOUR AS t, o_orderdate - INTERVAL 48 HOUR AS u FROM orders",
    ),
    "date_against_timestamp": (
        """FIND events e FILTER date(e.ts) <= e.ts AND e.ts < "2024-01-10" AND NOT date(e.ts) = e.ts FETCH e.event_id id""",
        "SELECT event_id AS id FROM events WHERE CAST(ts AS DATE) <= ts AND ts < TIMESTAMP '2024-01-10' AND CAST(ts AS DATE) <> ts",
    ),
    "to_interval_units": (
        "FIND orders o FETCH o.orderkey k, date(o.order_date) + to_interval(2, 'MONTH') m, o.order_date + to_interval(0, 1, 2, 3, 4, 5) t",
        "SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS TIMESTAMP) AS m, o_orderdate + INTERVAL 1 MONTH + INTERVAL 2 DAY + INTERVAL 11045 SECOND AS t FROM orders",
    ),
    "to_time_and_timestamp": (
        "FIND orders o FETCH o.orderkey k, hour(to_time('13:14:15')) h, minute(to_time(1, 2, 3)) m, hour(to_time('02-01', 'MI-HH24')) x, to_timestamp(year(o.order_date), 1, 31, 10, 5, 7) a, to_timestamp('31.01.2024 10', 'DD.MM.YYYY HH24') b, to_timestamp('31.01.2024 10', 'DD.MM.YYYY HH24', 'Asia/Tokyo') c, to_date(2024, 1, 31) d, to_date('31.01.2024', 'DD.MM.YYYY') e, minute(parse_time('01:02', 'HH24:MI')) f",
        "SELECT o_orderkey AS k, 13 AS h, 2 AS m, 1 AS x, make_timestamp(year(o_orderdate), 1, 31, 10, 5, 7.0) AS a, TIMESTAMP '2024-01-31 10:00:00' AS b, TIMESTAMP '2024-01-31 01:00:00' AS c, DATE '2024-01-31' AS d, DATE '2024-01-31' AS e, 2 AS f FROM orders",
    ),
    "string_start_zero": (
        "FIND nations n FETCH n.nationkey k, substr(n.name, 0, 3) a, substr(n.name, -3, 2) b, substring(n.name, 0) c, substr(n.name, 1, 0) d, initcap(lower(n.name)) e, overlay(n.name, 'xy', 2) f, printf('%s-%d', n.name, n.nationkey) g",
        "SELECT n_nationkey AS k, substr(n_name, 0, 3) AS a, substr(n_name, -3, 2) AS b, substring(n_name, 0) AS c, substr(n_name, 1, 0) AS d, upper(left(n_name, 1)) || lower(substr(n_name, 2)) AS e, left(n_name, 1) || 'xy' || substr(n_name, 4) AS f, printf('%s-%d', n_name, n_nationkey) AS g FROM nation",
    ),
    "string_agg_in_order": (
        "WITH s AS (FIND nations n, regions r FETCH r.name region, n.name nation, string_agg(n.name, '|') OVER (PARTITION r.name ORDER n.name) names) FIND s x FETCH x.region, x.nation, x.names",
        "SELECT r_name AS region, n_name AS nation, string_agg(n_name, '|') OVER (PARTITION BY r_name ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "mathematics_more": (
        "FIND customers c FILTER c.custkey < 200 FETCH c.custkey k, round(ln(c.custkey + 1), 8) l, round(exp(c.custkey / 100), 8) e, round(sin(c.custkey), 8) s, round(cos(c.custkey), 8) o, round(tan(c.custkey), 6) t, round(atan2(c.custkey, 7), 8) a, round(log10(c.custkey + 1), 8) g, sign(c.acctbal) i, bit_count(c.custkey) b, greatest(c.custkey, 50) h, least(c.custkey, 50) m, to_number('1,234.50', '9,999.00') n",
        "SELECT c_custkey AS k, round(ln(c_custkey + 1), 8) AS l, round(exp(c_custkey / 100), 8) AS e, round(sin(c_custkey), 8) AS s, round(cos(c_custkey), 8) AS o, round(tan(c_custkey), 6) AS t, round(atan2(c_custkey, 7), 8) AS a, round(log10(c_custkey + 1), 8) AS g, CAST(sign(c_acctbal) AS DOUBLE) AS i, CAST(bit_count(c_custkey) AS INTEGER) AS b, greatest(c_custkey, 50) AS h, least(c_custkey, 50) AS m, CAST(1234.50 AS DECIMAL(38, 10)) AS n FROM customer WHERE c_custkey < 200",
    ),
    "decimals": (
        "FIND orders o FILTER o.orderkey < 500 FETCH o.orderkey k, to_decimal(o.totalprice, 12, 2) + 1 a, to_decimal(o.totalprice, 12, 2) * to_decimal(2, 4, 1) m, to_text(to_decimal(o.totalprice, 12, 2)) t",
        "SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(12, 2)) + 1 AS a, CAST(CAST(o_totalprice AS DECIMAL(12, 2)) * 2 AS DECIMAL(17, 3)) AS m, CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS VARCHAR) AS t FROM orders WHERE o_orderkey < 500",
    ),
    "filter_isnull": (
        "FIND customers c, c + orders o FILTER o.totalprice > 490000 AND c.custkey < 700 FETCH c.custkey k, count(o) n, coalesce(max(o.totalprice), -1) m",
        "SELECT c_custkey AS k, count(o_orderkey) AS n, coalesce(max(o_totalprice), -1) AS m FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 490000 WHERE c_custkey < 700 GROUP BY 1",
    ),
    "duration_sums": (
        "FIND lineitems l, orders o FETCH l.returnflag f, sum(l.ship_date - o.order_date) s, max(l.ship_date - o.order_date) m",
        "SELECT l_returnflag AS f, CAST(sum(epoch(l_shipdate - o_orderdate)) AS BIGINT) AS s, CAST(max(epoch(l_shipdate - o_orderdate)) AS BIGINT) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    ),
    "conversions_more": (
        "FIND orders o FETCH o.orderkey k, to_smallint('12') s, to_bigint(o.orderkey) b, to_varchar(o.orderstatus, 5) v, to_text(o.order_date) t, to_boolean('false') f, to_char(o.order_date, 'DD.MM.YYYY') c, to_number('12', '99') n",
        "SELECT o_orderkey AS k, CAST(12 AS SMALLINT) AS s, o_orderkey AS b, o_orderstatus AS v, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS t, false AS f, strftime(o_orderdate, '%d.%m.%Y') AS c, CAST(12 AS DECIMAL(38, 10)) AS n FROM orders",
    ),
    "rollup_expression": (
        "FIND orders o FETCH year(o.order_date) y, o.orderstatus s, count(o) n, round(sum(o.totalprice), 2) t ROLLUP",
        "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus AS s, count(o_orderkey) AS n, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY ROLLUP (1, 2)",
    ),
    "no_fetch": ("FIND regions r FILTER r.regionkey < 3", "SELECT 1 AS _1 FROM region WHERE r_regionkey < 3"),
}


def runner(name: str):
    """A function of (spark, sf_dir) that runs an example."""

    def run(spark, sf_dir):
        from querent.engine import driver_engine

        return driver_engine(spark, sf_dir).query(EXAMPLES[name][0])

    return run
