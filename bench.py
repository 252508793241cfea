"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Merged reads are timed beside the same read of the clean base: with nothing,
1 % and 10 % of the rows changed, in turns, the median of seven. Other queries
run once to warm up, then the median of three counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Registered queries that are timed.
QUERIES = (
    "clean_read_direct merged_crud_cycle nopk_merged_read merged_join_three_way merged_join_left merged_semi_in agg_group_having agg_rollup agg_distinct win_running_sum win_top_per_group set_union set_except cte_multi "
    "tpch_pricing_summary merged_order_limit_offset bulk_update_subquery upsert_do_update merge_into update_pk_move nopk_update_delete fk_cascade_delete kv_hash_change doc_filter"
).split()
LINEITEM = "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, sum(l_extendedprice) AS p, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus"


def timed(f, rounds: int = 3) -> float:
    f()
    out = []
    for _ in range(rounds):
        begin = time.perf_counter()
        f()
        out.append(time.perf_counter() - begin)
    return round(statistics.median(out), 4)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from palimpsest.plans.suite import QUERIES as registered
    from palimpsest.plans.world import database

    times: dict[str, float] = {}
    sessions = {}
    for share, where in (("0", ""), ("1", "l_orderkey % 100 = 7"), ("10", "l_orderkey % 10 = 7")):
        sessions[share] = s = database(spark, SF_DIR, ("lineitem",)).session()
        if where:
            begin = time.perf_counter()
            s.sql(f"UPDATE lineitem SET l_quantity = l_quantity + 1 WHERE {where}")
            times[f"write_{share}_percent"] = round(time.perf_counter() - begin, 4)
    # The three cases take turns, so that none is favoured by what the JVM has compiled already.
    taken: dict[str, list[float]] = {share: [] for share in sessions}
    for turn in range(12):
        for share, s in sessions.items():
            begin = time.perf_counter()
            s.sql(LINEITEM).collect()
            if turn >= 5:
                taken[share].append(time.perf_counter() - begin)
    for share, seconds in taken.items():
        times[f"lineitem_merged_{share}_percent"] = round(statistics.median(seconds), 4)
    for name in QUERIES:
        rounds = 3 if name not in ("fk_cascade_delete", "merge_into") else 1
        try:
            times[name] = timed(lambda n=name: registered[n](spark, SF_DIR).write.format("noop").mode("overwrite").save(), rounds)
        except Exception as e:  # a query that fails must not hide the others' times
            print(f"{name}: {type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
