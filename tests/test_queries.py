"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
#: One query of each kind; the driver compares them all.
NAMES = [
    "merged_crud_cycle", "nopk_merged_read", "merged_join_full", "merged_lateral_top1", "agg_grouping_sets", "win_first_last_nth", "set_except_all", "cte_recursive", "update_pk_move", "merge_into", "upsert_do_update",
    "ddl_rename_table", "savepoint_rollback_to", "fk_cascade_delete", "kv_hash_change", "doc_order_limit", "stream_merged_read", "route_matrix", "insert_auto_id", "constraint_states", "statement_states", "concurrent_upserts",
    "agg_order_filter", "agg_group_concat_order", "json_contains_nested", "json_any_key", "top_with_ties", "top_percent", "fn_convert", "cross_apply", "replace_last_wins", "insert_ignore_first_wins", "insert_nextval", "procedure_calls",
    "registry_reopen", "log_json_lines", "kv_each_zsets", "kv_cmd_bits", "kv_cmd_zsets", "kv_cmd_streams", "kv_cmd_geo", "kv_cmd_server", "doc_value_order", "doc_value_filters", "doc_requests", "doc_stream_writes", "stream_fan_in",
    "stream_windowed_counts",
]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    cell = lambda v: "null" if v is None or v is pd.NA or v != v else str(pd.Timestamp(v).replace(tzinfo=None)) if hasattr(v, "isoformat") else f"{float(v):.6f}" if isinstance(v, int | float) or hasattr(v, "dtype") else str(v)
    return sorted(tuple(cell(v) for v in row) for row in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
