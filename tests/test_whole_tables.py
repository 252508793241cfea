"""Queries in which filtering is not the feature read whole tables, and match their SQL there."""

import re

import pytest

import __spark_entry__ as entry
from palimpsest.session import Database

from .test_queries import DATA, duck, plain  # noqa: F401

NAMES = [
    "merged_select_update", "merged_join_right", "merged_join_natural", "merged_scalar_subquery", "merged_lateral_top1", "merged_outer_apply", "agg_collections", "agg_stddev", "agg_unpivot", "win_row_number", "win_lag_lead",
    "win_first_last_nth", "win_running_sum", "win_partition_sum", "win_ntile_percent", "set_nulls_equal", "fn_case_coalesce", "fn_text", "fn_dates", "fn_epoch", "fn_interval", "fn_cast", "fn_arithmetic", "fn_json_arrow",
]


@pytest.mark.parametrize("name", NAMES)
def test_whole_table_matches_its_sql(spark, duck, name):  # noqa: F811
    sql = entry.oracle_sql()[name]
    read = re.sub(r"^WITH .*?\) SELECT", "SELECT", sql) if not sql.startswith("SELECT") else sql
    assert not re.search(r"(WHERE|AND) (o_orderkey|o_custkey|c_custkey|event_id) (<|%) \d+( = 0)?(\s+(GROUP|INTERSECT|UNION|WINDOW)\b|\s*$)", read)
    assert plain(entry.queries()[name](spark, DATA).toPandas()) == plain(duck.sql(sql).df())


def test_limit_of_a_lateral_query_keeps_its_order(spark):
    # By chance small tables come out right without it, so the plan is asked for the order by a column that isn't selected.
    plan = entry.queries()["merged_lateral_top1"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"row_number\(\) windowspecdefinition\((?:o_custkey#\w+, )?o_totalprice#\w+ DESC NULLS LAST, o_orderkey#\w+ ASC", plan)


def test_limit_of_a_lateral_query_is_one_for_each_row(spark):
    db = Database(spark)
    db.register("c", frame=spark.range(20).selectExpr("id AS c"), pk=["c"])
    # The condition casts k, and the order is by what isn't selected.
    db.register("o", frame=spark.range(0, 400, 1, 8).selectExpr("id AS o", "CAST(id % 25 AS INT) AS k", "(id * 7919) % 401 AS p"), pk=["o"])
    o = sorted(((-(i * 7919 % 401), i, i % 25) for i in range(400)))
    s = db.session()
    for n, skip in ((1, 0), (2, 0), (2, 3)):
        want = [(c, i) for c in range(20) for _, i, k in [x for x in o if x[2] == c][skip : skip + n]]
        got = s.sql(f"SELECT c, t.o FROM c, LATERAL (SELECT o FROM o WHERE k = c ORDER BY p DESC, o LIMIT {n} OFFSET {skip}) t").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    # A key that is a name or a place of the select list means that column.
    got = s.sql("SELECT c, t.y FROM c CROSS APPLY (SELECT TOP 1 -o AS y FROM o WHERE k = c ORDER BY y) t").collect()
    assert sorted(map(tuple, got)) == [(c, -375 - c) for c in range(20)]
