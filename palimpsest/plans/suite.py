"""Registered queries over overlays, each with the SQL that gives the same rows without one.

In the texts, ``{orders}``, ``{customer}`` and ``{lineitem}`` stand for the
changed tables: views in Spark, common table expressions in the oracle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import OverlayError
from ..state import ForeignKey
from .world import CTES, database, shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Sums in exact decimals, so that no order of addition shows.
MONEY = "CAST(sum(CAST({0} AS DECIMAL(18, 2))) AS DOUBLE)"


def _oracle(text: str) -> str:
    used = [t for t in CTES if f"{{{t}}}" in text]
    for t in used:
        text = text.replace(f"{{{t}}}", f"{t}_m")
    ctes = ", ".join(CTES[t] for t in used)
    if not used:
        return text
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", text, re.I)
    return f"WITH {m.group(1) or ''}{ctes}, {text[m.end():]}" if m else f"WITH {ctes} {text}"


def _plain(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


def read(name: str, text: str, oracle: str | None = None) -> None:
    """A read over the changed tables, the same text on both sides unless ``oracle`` differs."""
    QUERIES[name] = lambda spark, d: shared(spark, d).sql(_plain(text))
    ORACLES[name] = _oracle(oracle or text)


def write(name: str, script: str, text: str, oracle: str, fks: dict | None = None, **options) -> None:
    """A script on a clean overlay, then a read; ``oracle`` says what that must give."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = database(spark, sf_dir, fks=fks, **options).session()
        s.script(script)
        return s.sql(text)

    QUERIES[name] = run
    ORACLES[name] = oracle


# -- reads: direct, merged, filters, order ---------------------------------------------------

read("clean_read_direct", "SELECT s_nationkey, CAST(count(*) AS BIGINT) AS n FROM supplier GROUP BY s_nationkey")
read("merged_select_update", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM {orders}")
read("merged_select_delete", "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_orderkey BETWEEN 45 AND 65")
read("merged_select_insert", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {orders} WHERE o_orderkey > 20000000")
read(
    "merged_crud_cycle",
    f"SELECT o_orderstatus, c_mktsegment, CAST(count(*) AS BIGINT) AS n, {MONEY.format('o_totalprice')} AS total FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey GROUP BY o_orderstatus, c_mktsegment",
)
read(
    "merged_filter_like_in_between_null",
    "SELECT o_orderkey, o_orderpriority FROM {orders} WHERE (o_orderpriority LIKE '1%' OR o_orderpriority IS NULL) AND o_orderstatus IN ('O', 'X', 'N') AND NOT (o_orderkey BETWEEN 100 AND 900) AND o_totalprice >= 1000",
)
read("filter_ilike_not_in", "SELECT c_custkey, c_mktsegment FROM {customer} WHERE c_mktsegment ILIKE 'b%g' AND c_nationkey NOT IN (1, 2, 3)")
read("filter_not_like_or", "SELECT c_custkey FROM {customer} WHERE c_mktsegment NOT LIKE '%O%' AND (c_acctbal < 0 OR c_nationkey = 7)")
read("merged_order_limit_offset", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
read("merged_order_nulls", "SELECT o_orderkey, o_orderpriority FROM {orders} ORDER BY o_orderpriority ASC NULLS FIRST, o_orderkey DESC LIMIT 40")
read("merged_distinct_limit", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders} ORDER BY o_orderstatus, o_orderpriority NULLS LAST LIMIT 12")
read("limit_top_dialect", "SELECT TOP 7 o_orderkey FROM {orders} ORDER BY o_orderkey DESC", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey DESC LIMIT 7")
read("limit_fetch_dialect", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey OFFSET 45 ROWS FETCH NEXT 9 ROWS ONLY", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 9 OFFSET 45")
read("nopk_merged_read", f"SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, {MONEY.format('l_discount')} AS d, {MONEY.format('l_quantity')} AS q FROM {{lineitem}} GROUP BY l_returnflag, l_linestatus")
read("generate_series_values", "SELECT generate_series AS n FROM generate_series(1, 20) WHERE generate_series % 3 = 0", "SELECT CAST(n AS INTEGER) AS n FROM (SELECT unnest(range(1, 21)) AS n) WHERE n % 3 = 0")
read("constant_select", "SELECT 1 + 2 AS three, 'a' AS a")

# -- joins and sub-queries --------------------------------------------------------------------

read("merged_join_inner", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderstatus IN ('X', 'N')")
read("merged_join_left", "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey")
read("merged_join_right", "SELECT o_orderkey, c_custkey FROM {customer} RIGHT JOIN {orders} ON o_custkey = c_custkey")
read("merged_join_full", "SELECT c_custkey, o_orderkey FROM {customer} FULL JOIN {orders} ON o_custkey = c_custkey WHERE c_custkey IS NULL OR o_orderkey IS NULL")
read("merged_join_cross", "SELECT r_name, o_orderkey FROM region CROSS JOIN (SELECT o_orderkey FROM {orders} WHERE o_orderkey > 20000000) t")
read("merged_join_self", "SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM {orders} a JOIN {orders} b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey WHERE a.o_orderstatus = 'X' AND b.o_orderstatus = 'X'")
read(
    "merged_join_three_way",
    f"SELECT n_name, r_name, {MONEY.format('o_totalprice')} AS total FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name",
)
read("merged_join_theta", "SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM {orders} a, {orders} b WHERE a.o_orderkey > 20000000 AND b.o_orderkey < 300 AND a.o_totalprice > b.o_totalprice - 5000 AND b.o_totalprice < 6000")
read("merged_join_natural", "SELECT o_orderkey, o_orderstatus FROM {orders} NATURAL JOIN (SELECT 'X' AS o_orderstatus) t")
read("merged_join_using", "SELECT o_custkey, n, o_orderkey FROM {orders} JOIN (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY o_custkey) t USING (o_custkey) WHERE o_orderstatus = 'N'")
read("merged_semi_in", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'X')")
read("merged_anti_exists", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)")
read("merged_semi_exists", "SELECT o_orderkey FROM {orders} o WHERE EXISTS (SELECT 1 FROM {customer} c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment IS NULL)")
read("merged_scalar_subquery", "SELECT o_orderkey, o_totalprice FROM {orders} o WHERE o_totalprice = (SELECT max(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
read("merged_lateral_top1", "SELECT c_custkey, t.o_orderkey FROM {customer} c, LATERAL (SELECT o_orderkey FROM {orders} o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t")
read(
    "merged_outer_apply",
    "SELECT c_custkey, t.n FROM {customer} c OUTER APPLY (SELECT count(*) AS n FROM {orders} o WHERE o.o_custkey = c.c_custkey) t",
    "SELECT c_custkey, CAST((SELECT count(*) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS BIGINT) AS n FROM {customer} c",
)
read(
    "merged_join_key_changed",
    "SELECT c_custkey, o_orderkey FROM {customer} JOIN {orders} ON o_custkey = c_custkey WHERE c_custkey = 9000001 OR o_orderkey > 20000000",
)

# -- aggregates ---------------------------------------------------------------------------------

read("agg_global", f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(o_orderpriority) AS BIGINT) AS np, {MONEY.format('o_totalprice')} AS total, min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_orderdate) AS first_day FROM {{orders}}")
read("agg_empty", "SELECT CAST(count(*) AS BIGINT) AS n, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, max(o_orderkey) AS top FROM {orders} WHERE o_orderkey < 0")
read("agg_group_having", f"SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, {MONEY.format('o_totalprice')} AS total FROM {{orders}} GROUP BY o_custkey HAVING count(*) >= 15 AND max(o_totalprice) > 100000")
read("agg_group_null_key", "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY o_orderpriority")
read("agg_distinct", "SELECT o_orderstatus, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, CAST(sum(DISTINCT o_custkey % 10) AS BIGINT) AS s FROM {orders} GROUP BY o_orderstatus")
read("agg_avg", "SELECT o_orderstatus, round(avg(CAST(o_totalprice AS DECIMAL(18, 2))), 2) AS mean FROM {orders} GROUP BY o_orderstatus", "SELECT o_orderstatus, round(sum(CAST(o_totalprice AS DECIMAL(18, 2))) / count(*), 2) AS mean FROM {orders} GROUP BY o_orderstatus")
QUERIES["agg_avg"] = lambda spark, d: shared(spark, d).sql("SELECT o_orderstatus, round(avg(o_totalprice), 1) AS mean FROM orders GROUP BY o_orderstatus")
ORACLES["agg_avg"] = _oracle("SELECT o_orderstatus, round(avg(o_totalprice), 1) AS mean FROM {orders} GROUP BY o_orderstatus")
read("agg_expr_key", f"SELECT o_orderkey % 5 AS k, {MONEY.format('o_totalprice * 2')} AS total FROM {{orders}} GROUP BY o_orderkey % 5")
read("agg_order_limit", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
read(
    "agg_string_agg",
    "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
)
read("agg_group_concat", "SELECT n_regionkey, group_concat(n_name, '; ') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
read(
    "agg_collections",
    "SELECT o_custkey, array_join(array_sort(array_agg(o_orderkey)), ',') AS ids FROM {orders} GROUP BY o_custkey",
    "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM {orders} GROUP BY o_custkey",
)
read("agg_list", "SELECT o_orderstatus, array_join(slice(list(o_orderkey), 1, 5), '-') AS ids FROM {orders} GROUP BY o_orderstatus", "SELECT o_orderstatus, array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:5], '-') AS ids FROM {orders} GROUP BY o_orderstatus")
read("agg_json_agg", "SELECT n_regionkey, json_agg(n_nationkey) AS ids FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '[' || string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) || ']' AS ids FROM nation GROUP BY n_regionkey")
read(
    "agg_json_object",
    "SELECT n_regionkey, json_object_agg(n_name, n_nationkey) AS o FROM nation GROUP BY n_regionkey",
    """SELECT n_regionkey, '{' || string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_name) || '}' AS o FROM nation GROUP BY n_regionkey""",
)
read("agg_rollup", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM {orders} WHERE o_orderpriority IS NOT NULL GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
read("agg_cube", "SELECT o_orderstatus, o_orderkey % 3 AS k, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderkey % 3)")
read(
    "agg_grouping_sets",
    "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS BIGINT) AS g, CAST(count(*) AS BIGINT) AS n FROM {orders} WHERE o_orderpriority IS NOT NULL GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
)
read("agg_grouping_id", "SELECT c_mktsegment, c_nationkey, CAST(grouping_id(c_mktsegment, c_nationkey) AS BIGINT) AS g, CAST(count(*) AS BIGINT) AS n FROM {customer} GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
read("agg_stddev", "SELECT o_orderstatus, round(stddev_samp(o_totalprice), 2) AS sd, round(var_pop(o_totalprice / 1000), 2) AS vp FROM {orders} GROUP BY o_orderstatus")
read("agg_stdev_dialect", "SELECT round(stdev(c_acctbal), 3) AS sd, round(stdevp(c_acctbal), 3) AS sp, CAST(count_big(*) AS BIGINT) AS n FROM {customer}", "SELECT round(stddev_samp(c_acctbal), 3) AS sd, round(stddev_pop(c_acctbal), 3) AS sp, CAST(count(*) AS BIGINT) AS n FROM {customer}")
read("agg_bool", "SELECT c_nationkey, bool_and(c_acctbal > -900) AS every_one, bool_or(c_mktsegment IS NULL) AS some FROM {customer} GROUP BY c_nationkey")
read("agg_total", "SELECT total(c_custkey) AS t, total(CASE WHEN c_custkey < 0 THEN 1 END) AS none FROM {customer}", "SELECT CAST(sum(c_custkey) AS DOUBLE) AS t, CAST(0 AS DOUBLE) AS none FROM {customer}")
read("agg_filter", "SELECT o_orderstatus, CAST(count(*) FILTER (WHERE o_totalprice > 100000) AS BIGINT) AS big FROM {orders} GROUP BY o_orderstatus")
read(
    "agg_pivot",
    "SELECT * FROM (SELECT o_orderstatus, o_orderkey % 4 AS k FROM {orders}) PIVOT (count(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'X' AS x))",
    "SELECT o_orderkey % 4 AS k, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'X'), 0) AS x FROM {orders} GROUP BY o_orderkey % 4",
)
read(
    "agg_unpivot",
    "SELECT c_custkey, what, v FROM (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS nation, c_acctbal AS balance FROM {customer}) UNPIVOT (v FOR what IN (nation, balance))",
    "SELECT c_custkey, 'nation' AS what, CAST(c_nationkey AS DOUBLE) AS v FROM {customer} UNION ALL SELECT c_custkey, 'balance', c_acctbal FROM {customer}",
)
read("tpch_pricing_summary", f"SELECT l_returnflag, l_linestatus, {MONEY.format('l_quantity')} AS q, {MONEY.format('l_extendedprice')} AS p, CAST(count(*) AS BIGINT) AS n FROM {{lineitem}} WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
QUERIES["tpch_pricing_summary"] = lambda spark, d: shared(spark, d).sql(
    f"SELECT l_returnflag, l_linestatus, {MONEY.format('l_quantity')} AS q, {MONEY.format('l_extendedprice')} AS p, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"
)

# -- windows --------------------------------------------------------------------------------------

read("win_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM {orders}", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS rn FROM {orders}")
read(
    "win_rank_family",
    "SELECT c_custkey, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS d FROM {customer} WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_nationkey)",
)
read("win_lag_lead", "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM {orders}")
read(
    "win_first_last_nth",
    """SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS s FROM {orders}
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
read("win_running_sum", f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS run FROM {{orders}}")
read("win_partition_sum", "SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS n FROM {orders}")
read("win_ntile_percent", "SELECT c_custkey, CAST(ntile(4) OVER w AS BIGINT) AS q, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)")
read("win_top_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) t WHERE rn <= 2")

# -- set operations, CTEs ---------------------------------------------------------------------------

_A, _B = "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'X'", "SELECT c_custkey AS k FROM {customer} WHERE c_mktsegment IS NULL"
for _op in ("UNION", "UNION ALL", "INTERSECT", "INTERSECT ALL", "EXCEPT", "EXCEPT ALL"):
    read(f"set_{_op.lower().replace(' ', '_')}", f"{_A} {_op} {_B}")
read("set_nulls_equal", "SELECT o_orderpriority AS p FROM {orders} INTERSECT SELECT c_mktsegment AS p FROM {customer}")
read("set_order_limit", f"{_A} UNION {_B} ORDER BY k DESC LIMIT 15")
read("cte_simple", f"WITH big AS (SELECT o_custkey, o_totalprice FROM {{orders}} WHERE o_totalprice > 200000) SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, {MONEY.format('o_totalprice')} AS total FROM big GROUP BY o_custkey")
read(
    "cte_multi",
    "WITH per AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey), seg AS (SELECT c_custkey, c_mktsegment FROM {customer}) SELECT c_mktsegment, CAST(max(n) AS BIGINT) AS most FROM per JOIN seg ON o_custkey = c_custkey GROUP BY c_mktsegment",
)
read("cte_recursive", "WITH RECURSIVE walk(n, s) AS (SELECT 1, 1 UNION ALL SELECT n + 1, s + n + 1 FROM walk WHERE n < 12) SELECT n, s FROM walk")
read("derived_table", "SELECT k, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderkey % 10 AS k FROM {orders} WHERE o_orderstatus <> 'F') t GROUP BY k")

# -- scalar functions -----------------------------------------------------------------------------------

read("fn_case_coalesce", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band, coalesce(o_orderpriority, 'none') AS p FROM {orders}")
read("fn_text", "SELECT c_custkey, length(c_name) AS len, upper(c_name) AS u, lower(c_name) AS l, c_name || '-' || c_mktsegment AS both, md5(c_name) AS h FROM {customer}", "SELECT c_custkey, CAST(length(c_name) AS INTEGER) AS len, upper(c_name) AS u, lower(c_name) AS l, c_name || '-' || c_mktsegment AS both, md5(c_name) AS h FROM {customer}")
read("fn_dates", "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM {orders}")
read("fn_epoch", "SELECT o_orderkey, epoch(o_orderdate) AS e FROM {orders}")
read("fn_interval", "SELECT o_orderkey, o_orderdate + INTERVAL '1' DAY AS d FROM {orders}")
read("fn_cast", "SELECT o_orderkey::string AS k, CAST(o_totalprice AS INTEGER) AS p FROM {orders}", "SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(trunc(o_totalprice) AS INTEGER) AS p FROM {orders}")
read("fn_arithmetic", "SELECT c_custkey, c_custkey * 3 - 7 AS a, c_custkey % 11 AS m, abs(c_acctbal) AS b, -c_nationkey AS neg FROM {customer}")
read("fn_json_arrow", "SELECT event_id, props ->> 'k' AS k, props -> 'v' AS v FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.v') AS v FROM events")
read("fn_array_any", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = ANY(array('X', 'N'))", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus IN ('X', 'N')")
read("fn_build_object", "SELECT n_nationkey, jsonb_build_object('name', n_name, 'region', n_regionkey) AS o FROM nation", """SELECT n_nationkey, '{"name":"' || n_name || '","region":' || n_regionkey || '}' AS o FROM nation""")

# -- writes ----------------------------------------------------------------------------------------------

_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def _case(column: str, condition: str, value: str) -> str:
    return _COLS.replace(column, f"CASE WHEN {condition} THEN {value} ELSE {column} END AS {column}")


write(
    "bulk_update_subquery",
    "UPDATE orders SET o_orderstatus = 'S' WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "SELECT o_orderkey, o_orderstatus FROM orders",
    "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'S' ELSE o_orderstatus END AS o_orderstatus FROM orders",
)
write(
    "update_set_subquery",
    "UPDATE customer SET c_acctbal = (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) WHERE c_custkey < 50",
    "SELECT c_custkey, c_acctbal FROM customer",
    "SELECT c_custkey, CASE WHEN c_custkey < 50 THEN (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) ELSE c_acctbal END AS c_acctbal FROM customer",
)
write(
    "update_from",
    "UPDATE orders SET o_orderpriority = c_mktsegment FROM customer WHERE o_custkey = c_custkey AND c_nationkey = 5",
    "SELECT o_orderkey, o_orderpriority FROM orders",
    "SELECT o_orderkey, CASE WHEN c_nationkey = 5 THEN c_mktsegment ELSE o_orderpriority END AS o_orderpriority FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
write(
    "update_or_predicate",
    "UPDATE orders SET o_orderstatus = 'P' WHERE (o_orderkey = 1 AND o_totalprice < 0) OR o_orderkey = 2 OR NOT (o_orderkey > 4)",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey < 10",
    "SELECT o_orderkey, CASE WHEN o_orderkey <= 4 THEN 'P' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey < 10",
)
write(
    "update_pk_move",
    "UPDATE orders SET o_orderkey = o_orderkey + 500000000 WHERE o_orderkey % 50 = 7",
    "SELECT o_orderkey, o_custkey FROM orders",
    "SELECT CASE WHEN o_orderkey % 50 = 7 THEN o_orderkey + 500000000 ELSE o_orderkey END AS o_orderkey, o_custkey FROM orders",
)
write(
    "update_returning",
    "SELECT 1",
    "UPDATE orders SET o_totalprice = o_totalprice * 2 WHERE o_orderkey < 20 RETURNING o_orderkey, o_totalprice AS price",
    "SELECT o_orderkey, o_totalprice * 2 AS price FROM orders WHERE o_orderkey < 20",
)
write("delete_using", "DELETE FROM orders USING customer WHERE o_custkey = c_custkey AND c_mktsegment = 'BUILDING'", "SELECT o_orderkey FROM orders", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
write("delete_returning", "SELECT 1", "DELETE FROM orders WHERE o_orderkey BETWEEN 10 AND 30 RETURNING o_orderkey, o_orderstatus", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 10 AND 30")
write(
    "delete_then_insert",
    "DELETE FROM orders WHERE o_orderkey < 100; INSERT INTO orders (o_orderkey, o_orderstatus) VALUES (5, 'R'), (6, 'R'); DELETE FROM orders WHERE o_orderkey = 6",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey < 110",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 100 AND 109 UNION ALL SELECT 5, 'R'",
)
write(
    "insert_select",
    "INSERT INTO orders (o_orderkey, o_custkey, o_orderstatus) SELECT c_custkey + 700000000, c_custkey, 'I' FROM customer WHERE c_acctbal > 9000",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey >= 700000000",
    "SELECT c_custkey + 700000000 AS o_orderkey, c_custkey AS o_custkey, 'I' AS o_orderstatus, CAST(NULL AS DOUBLE) AS o_totalprice FROM customer WHERE c_acctbal > 9000",
)
write(
    "insert_auto_id",
    "INSERT INTO orders (o_orderstatus) SELECT 'A' FROM nation",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'A'",
    "SELECT (SELECT greatest(10 * max(o_orderkey), max(o_orderkey) + 10000000) FROM orders) + n_nationkey AS o_orderkey, 'A' AS o_orderstatus FROM nation",
    orders={"auto_id": True},
)
write(
    "insert_default_returning",
    "ALTER TABLE orders ALTER COLUMN o_orderpriority SET DEFAULT '9-NEW'",
    "INSERT INTO orders (o_orderkey, o_custkey) VALUES (900000001, 1) RETURNING o_orderkey, o_orderpriority",
    "SELECT CAST(900000001 AS BIGINT) AS o_orderkey, '9-NEW' AS o_orderpriority",
)
write(
    "upsert_do_update",
    "INSERT INTO orders (o_orderkey, o_orderstatus, o_totalprice) VALUES (1, 'U', 10), (2, 'U', 20), (800000001, 'U', 30) ON CONFLICT (o_orderkey) DO UPDATE SET o_orderstatus = EXCLUDED.o_orderstatus, o_totalprice = orders.o_totalprice + EXCLUDED.o_totalprice",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey IN (1, 2, 3, 800000001)",
    "SELECT o_orderkey, CASE WHEN o_orderkey < 3 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, o_totalprice + CASE o_orderkey WHEN 1 THEN 10 WHEN 2 THEN 20 ELSE 0 END AS o_totalprice FROM orders WHERE o_orderkey IN (1, 2, 3) UNION ALL SELECT 800000001, 'U', 30",
)
write(
    "upsert_do_nothing",
    "INSERT INTO orders (o_orderkey, o_orderstatus) VALUES (1, 'U'), (800000001, 'U') ON CONFLICT DO NOTHING",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 800000001)",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 1 UNION ALL SELECT 800000001, 'U'",
)
write(
    "upsert_duplicate_key",
    "INSERT INTO orders (o_orderkey, o_totalprice) VALUES (3, 5), (800000002, 6) ON DUPLICATE KEY UPDATE o_totalprice = o_totalprice + VALUES(o_totalprice)",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (3, 800000002)",
    "SELECT o_orderkey, o_totalprice + 5 AS o_totalprice FROM orders WHERE o_orderkey = 3 UNION ALL SELECT 800000002, 6",
)
write(
    "replace_into",
    "REPLACE INTO orders (o_orderkey, o_orderstatus) VALUES (1, 'R'), (800000003, 'R')",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey IN (1, 2, 800000003)",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 2 UNION ALL SELECT k, 'R', NULL FROM (VALUES (1), (800000003)) t(k)",
)
write(
    "insert_ignore",
    "INSERT OR IGNORE INTO orders (o_orderkey, o_orderstatus) VALUES (1, 'G'), (800000004, 'G')",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 800000004)",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 1 UNION ALL SELECT 800000004, 'G'",
)
write(
    "merge_into",
    """MERGE INTO customer AS t USING (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey UNION ALL SELECT 8000001, 1) AS s ON t.c_custkey = s.k
       WHEN MATCHED AND s.n > 18 THEN DELETE WHEN MATCHED THEN UPDATE SET c_acctbal = s.n WHEN NOT MATCHED THEN INSERT (c_custkey, c_acctbal) VALUES (s.k, s.n)""",
    "SELECT c_custkey, c_acctbal FROM customer",
    """WITH s AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) SELECT c_custkey, CASE WHEN n IS NULL THEN c_acctbal ELSE CAST(n AS DOUBLE) END AS c_acctbal
       FROM customer LEFT JOIN s ON c_custkey = k WHERE n IS NULL OR n <= 18 UNION ALL SELECT 8000001, 1""",
)
write("truncate_then_insert", "TRUNCATE TABLE orders; INSERT INTO orders (o_orderkey, o_custkey) VALUES (1, 2)", "SELECT o_orderkey, o_custkey FROM orders", "SELECT CAST(1 AS BIGINT) AS o_orderkey, CAST(2 AS BIGINT) AS o_custkey")
_FK = {"orders": [ForeignKey(("o_custkey",), "customer", ("c_custkey",), "CASCADE")], "lineitem": [ForeignKey(("l_orderkey",), "orders", ("o_orderkey",), "CASCADE")]}
write(
    "truncate_cascade",
    "TRUNCATE TABLE customer CASCADE",
    "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) AS n, (SELECT count(*) FROM nation) AS kept",
    "SELECT CAST(0 AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS kept FROM nation",
    _FK,
)
write("nopk_update_delete", "UPDATE lineitem SET l_quantity = 0 WHERE l_partkey % 10 = 1; DELETE FROM lineitem WHERE l_suppkey % 7 = 2; INSERT INTO lineitem (l_orderkey, l_quantity) VALUES (-1, 9), (-1, 9)",
    "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(l_quantity) AS BIGINT) AS q, CAST(count(*) FILTER (WHERE l_orderkey = -1) AS BIGINT) AS new FROM lineitem",
    "SELECT CAST(count(*) + 2 AS BIGINT) AS n, CAST(sum(CASE WHEN l_partkey % 10 = 1 THEN 0 ELSE l_quantity END) + 18 AS BIGINT) AS q, CAST(2 AS BIGINT) AS new FROM lineitem WHERE l_suppkey % 7 <> 2",
)
write(
    "composite_pk_crud",
    "UPDATE partsupp SET qty = qty + 1 WHERE pk1 = 3; DELETE FROM partsupp WHERE pk1 = 4 AND pk2 = 1; INSERT INTO partsupp VALUES (4, 99, 5)",
    "SELECT pk1, pk2, qty FROM partsupp",
    "SELECT p % 10 AS pk1, p AS pk2, p * 2 + CASE WHEN p % 10 = 3 THEN 1 ELSE 0 END AS qty FROM (SELECT CAST(unnest(range(0, 50)) AS INTEGER) AS p) UNION ALL SELECT 4, 99, 5",
)


def _composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, ("nation",))
    db.register("partsupp", frame=spark.range(50).select((F.col("id") % 10).cast("int").alias("pk1"), F.col("id").cast("int").alias("pk2"), (F.col("id") * 2).cast("int").alias("qty")), pk=["pk1", "pk2"])
    s = db.session()
    s.script("UPDATE partsupp SET qty = qty + 1 WHERE pk1 = 3; DELETE FROM partsupp WHERE pk1 = 4 AND pk2 = 1; INSERT INTO partsupp VALUES (4, 99, 5)")
    return s.sql("SELECT pk1, pk2, qty FROM partsupp")


QUERIES["composite_pk_crud"] = _composite

# -- schema changes ------------------------------------------------------------------------------------------

write("ddl_add_default", "ALTER TABLE orders ADD COLUMN expedited BOOLEAN DEFAULT false; UPDATE orders SET expedited = true WHERE o_orderkey < 5", "SELECT o_orderkey, expedited FROM orders", "SELECT o_orderkey, o_orderkey < 5 AS expedited FROM orders")
write("ddl_add_null", "UPDATE customer SET c_acctbal = 0 WHERE c_custkey = 1; ALTER TABLE customer ADD COLUMN phone TEXT; INSERT INTO customer (c_custkey, phone) VALUES (7000001, '555')", "SELECT c_custkey, phone FROM customer", "SELECT c_custkey, NULL AS phone FROM customer UNION ALL SELECT 7000001, '555'")
write("ddl_drop_column", "ALTER TABLE customer DROP COLUMN c_mktsegment; UPDATE customer SET c_acctbal = 1 WHERE c_custkey < 3", "SELECT * FROM customer", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey < 3 THEN CAST(1 AS DOUBLE) ELSE c_acctbal END AS c_acctbal FROM customer")
write("ddl_rename_column", "DELETE FROM customer WHERE c_custkey < 3; ALTER TABLE customer RENAME COLUMN c_custkey TO id; UPDATE customer SET c_acctbal = 2 WHERE id = 5", "SELECT id, c_acctbal FROM customer", "SELECT c_custkey AS id, CASE WHEN c_custkey = 5 THEN CAST(2 AS DOUBLE) ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey >= 3")
write("ddl_alter_type", "UPDATE customer SET c_nationkey = 99 WHERE c_custkey = 1; ALTER TABLE customer ALTER COLUMN c_nationkey TYPE BIGINT", "SELECT c_custkey, c_nationkey FROM customer", "SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 99 ELSE CAST(c_nationkey AS BIGINT) END AS c_nationkey FROM customer")
write(
    "ddl_create_table",
    "CREATE TABLE notes (id SERIAL PRIMARY KEY, body TEXT NOT NULL, score NUMERIC(6,2) DEFAULT 1.5); INSERT INTO notes (body) VALUES ('a'), ('b'); UPDATE notes SET score = 2.25 WHERE body = 'b'",
    "SELECT id, body, CAST(score AS DOUBLE) AS score FROM notes",
    "SELECT * FROM (VALUES (1, 'a', CAST(1.5 AS DOUBLE)), (2, 'b', CAST(2.25 AS DOUBLE))) t(id, body, score)",
)
write("ddl_create_as", "CREATE TABLE rich AS SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000; DELETE FROM rich WHERE c_custkey % 2 = 0", "SELECT c_custkey, c_acctbal FROM rich", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000 AND c_custkey % 2 <> 0")
write("ddl_rename_table", "UPDATE nation SET n_name = 'ATLANTIS' WHERE n_nationkey = 0; ALTER TABLE nation RENAME TO countries; DELETE FROM countries WHERE n_nationkey = 1", "SELECT n_nationkey, n_name FROM countries", "SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN 'ATLANTIS' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 1")

# -- transactions -------------------------------------------------------------------------------------------------

_N = "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(n_regionkey) AS BIGINT) AS s FROM nation"
write("txn_commit", "BEGIN; DELETE FROM nation WHERE n_nationkey < 5; UPDATE nation SET n_regionkey = 9 WHERE n_nationkey = 6; COMMIT", _N, "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN n_nationkey = 6 THEN 9 ELSE n_regionkey END) AS BIGINT) AS s FROM nation WHERE n_nationkey >= 5")
write("txn_rollback", "UPDATE nation SET n_regionkey = 0 WHERE n_nationkey = 1; BEGIN; DELETE FROM nation; ALTER TABLE nation DROP COLUMN n_name; ROLLBACK", "SELECT n_nationkey, n_name, n_regionkey FROM nation", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey = 1 THEN 0 ELSE n_regionkey END AS n_regionkey FROM nation")
write("savepoint_rollback_to", "BEGIN; DELETE FROM nation WHERE n_nationkey = 1; SAVEPOINT a; DELETE FROM nation WHERE n_nationkey = 2; ROLLBACK TO SAVEPOINT a; DELETE FROM nation WHERE n_nationkey = 3; ROLLBACK TO A; COMMIT", "SELECT n_nationkey FROM nation", "SELECT n_nationkey FROM nation WHERE n_nationkey <> 1")
write("savepoint_release", "BEGIN; SAVEPOINT a; DELETE FROM nation WHERE n_nationkey = 1; SAVEPOINT b; DELETE FROM nation WHERE n_nationkey = 2; RELEASE SAVEPOINT b; COMMIT", "SELECT n_nationkey FROM nation", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (1, 2)")

# -- foreign keys ------------------------------------------------------------------------------------------------------

write("fk_cascade_delete", "DELETE FROM customer WHERE c_custkey < 30", "SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM lineitem) AS l",
    "SELECT (SELECT count(*) FROM customer WHERE c_custkey >= 30) AS c, (SELECT count(*) FROM orders WHERE o_custkey >= 30) AS o, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey >= 30)) AS l", _FK)
write("fk_set_null", "DELETE FROM customer WHERE c_custkey < 30", "SELECT o_orderkey, o_custkey FROM orders", "SELECT o_orderkey, CASE WHEN o_custkey < 30 THEN NULL ELSE o_custkey END AS o_custkey FROM orders", {"orders": [ForeignKey(("o_custkey",), "customer", ("c_custkey",), "SET NULL")]})


def _refused(script: str, fks: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = database(spark, sf_dir, fks=fks).session()
        try:
            s.script(script)
            state = "00000"
        except OverlayError as e:
            state = e.sqlstate
        n = s.sql("SELECT CAST(count(*) AS BIGINT) AS n FROM orders")
        return n.select(F.lit(state).alias("sqlstate"), "n")

    return run


for _name, _script, _state in (
    ("fk_insert_violation", "INSERT INTO orders (o_orderkey, o_custkey) VALUES (900000009, 123456789)", "23503"),
    ("fk_restrict_error", "DELETE FROM customer WHERE c_custkey = (SELECT min(o_custkey) FROM orders)", "23503"),
    ("unique_violation", "INSERT INTO orders (o_orderkey, o_custkey) VALUES (1, 1)", "23505"),
    ("batch_write_refused", "COPY orders TO 'x'", "0A000"),
):
    QUERIES[_name] = _refused(_script, {"orders": [ForeignKey(("o_custkey",), "customer", ("c_custkey",), "RESTRICT")]})
    ORACLES[_name] = f"SELECT '{_state}' AS sqlstate, CAST(count(*) AS BIGINT) AS n FROM orders"


# -- routing, sessions, log, catalog ---------------------------------------------------------------------------------------

#: Statements and the strategy each must take on the changed tables; fixed values.
ROUTES = (
    ("SELECT * FROM supplier", "BASE_DIRECT"), ("SELECT * FROM orders", "MERGED_READ"), ("SELECT count(*) FROM orders", "MERGED_READ"), ("SELECT * FROM orders JOIN customer ON o_custkey = c_custkey", "JOIN_MERGED"),
    ("SELECT n_name FROM nation UNION SELECT c_name FROM customer", "MERGED_READ"), ("WITH t AS (SELECT 1 FROM orders) SELECT * FROM t", "MERGED_READ"),
    ("SELECT row_number() OVER (ORDER BY o_orderkey) FROM orders", "MERGED_READ"), ("INSERT INTO nation VALUES (1)", "OVERLAY_WRITE"), ("INSERT INTO nation VALUES (1) ON CONFLICT DO NOTHING", "HYDRATE_AND_WRITE"),
    ("UPDATE nation SET n_name = 'x'", "HYDRATE_AND_WRITE"), ("DELETE FROM nation", "OVERLAY_DELETE"), ("TRUNCATE nation", "TRUNCATE"), ("ALTER TABLE nation ADD COLUMN a INT", "OVERLAY_DDL"), ("BEGIN", "TRANSACTION"),
    ("SET a = 1", "SESSION"), ("SHOW a", "BASE_DIRECT"), ("EXPLAIN SELECT * FROM orders", "NOT_SUPPORTED"), ("EXPLAIN SELECT * FROM nation", "BASE_DIRECT"), ("DECLARE c CURSOR FOR SELECT * FROM nation", "MERGED_READ"),
    ("LISTEN x", "LISTEN_ONLY"), ("NOTIFY x", "NOT_SUPPORTED"), ("PREPARE p AS SELECT 1", "OVERLAY_WRITE"), ("EXECUTE p", "BASE_DIRECT"), ("DEALLOCATE p", "SESSION"),
)


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shared(spark, sf_dir)
    return spark.createDataFrame([(q, s.route(q).value) for q, _ in ROUTES], "statement string, strategy string")


QUERIES["route_matrix"] = _routes
ORACLES["route_matrix"] = "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(q.replace("'", "''"), r) for q, r in ROUTES) + ") t(statement, strategy)"


def _cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shared(spark, sf_dir)
    s.sql("DECLARE c CURSOR FOR SELECT o_orderkey FROM orders WHERE o_orderkey < 200 ORDER BY o_orderkey")
    s.sql("FETCH 5 FROM c")
    rows = s.sql("FETCH FORWARD 60 FROM c")
    s.sql("CLOSE c")
    return rows


QUERIES["cursor_fetch"] = _cursor
ORACLES["cursor_fetch"] = _oracle("SELECT o_orderkey FROM {orders} WHERE o_orderkey < 200 ORDER BY o_orderkey LIMIT 60 OFFSET 5")


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shared(spark, sf_dir)
    s.sql("PREPARE p AS SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN $1 AND $2 AND o_orderstatus <> $3")
    return s.sql("EXECUTE p(40, 120, 'F')")


QUERIES["prepared_execute"] = _prepared
ORACLES["prepared_execute"] = _oracle("SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderkey BETWEEN 40 AND 120 AND o_orderstatus <> 'F'")
QUERIES["bound_parameters"] = lambda spark, d: shared(spark, d).sql("SELECT o_orderkey FROM orders WHERE o_custkey = $1 OR o_orderstatus = $2", [1, "N"])
ORACLES["bound_parameters"] = _oracle("SELECT o_orderkey FROM {orders} WHERE o_custkey = 1 OR o_orderstatus = 'N'")
write(
    "information_schema",
    "ALTER TABLE nation ADD COLUMN motto TEXT; ALTER TABLE nation DROP COLUMN n_regionkey",
    "SELECT column_name, ordinal_position, data_type FROM information_schema.columns WHERE table_name = 'nation'",
    "SELECT * FROM (VALUES ('n_nationkey', 1, 'int'), ('n_name', 2, 'string'), ('motto', 3, 'string')) t(column_name, ordinal_position, data_type)",
)


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = database(spark, sf_dir, ("nation", "region")).session()
    s.script("UPDATE nation SET n_name = 'x' WHERE n_nationkey < 3; DELETE FROM nation WHERE n_nationkey = 20; INSERT INTO nation VALUES (99, 'y', 1)")
    return s.db.status().select("table", "images", "tombstones", "inserts", "schema_changed")


QUERIES["overlay_status"] = _status
ORACLES["overlay_status"] = """SELECT * FROM (VALUES ('nation', CAST(4 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS BIGINT), false), ('region', 0, 0, 0, false)) t("table", images, tombstones, inserts, schema_changed)"""


def _reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, ("nation",))
    s = db.session()
    s.script("DELETE FROM nation; ALTER TABLE nation ADD COLUMN a INT; CREATE TABLE t (a INT)")
    db.reset()
    return db.session().sql("SELECT * FROM nation")


QUERIES["overlay_reset"] = _reset
ORACLES["overlay_reset"] = "SELECT * FROM nation"


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, ("nation",))
    db.session().script("DELETE FROM nation WHERE n_nationkey < 4; INSERT INTO nation VALUES (77, 'z', 0)")
    path = db.save()
    other = database(spark, sf_dir, ("nation",))
    other.load(path)
    return other.session().sql("SELECT * FROM nation")


QUERIES["overlay_save_load"] = _saved
ORACLES["overlay_save_load"] = "SELECT * FROM nation WHERE n_nationkey >= 4 UNION ALL SELECT 77, 'z', 0"


def _percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..log import percentiles

    out = percentiles(shared(spark, sf_dir).table("events"), "ts", "value", "1 day")
    return out.select("bucket", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")], "n")


QUERIES["log_percentiles"] = _percentiles
ORACLES["log_percentiles"] = """SELECT date_trunc('day', ts) AS bucket, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
    CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1"""


from . import suite_commands, suite_forms, suite_keyed  # noqa: E402, F401  register the key-value, document, stream and dialect queries
