"""Databases that the registered queries run on: the tables of a folder under one overlay."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..session import Database, OverlaySession
from ..state import ForeignKey

#: Key columns of the driver's tables; lineitem has none. Fixed values.
KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": (),
    "events": ("event_id",),
}

#: Changes that the read queries see: rows changed, deleted and inserted in tables with and without a key.
SCRIPT = """
UPDATE orders SET o_orderstatus = 'X', o_totalprice = o_totalprice + 100 WHERE o_orderkey % 100 = 0;
UPDATE orders SET o_orderpriority = NULL WHERE o_orderkey % 7 = 0;
DELETE FROM orders WHERE o_orderkey BETWEEN 50 AND 59;
INSERT INTO orders (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)
  VALUES (20000001, 1, 'N', 123.45, TIMESTAMP_NTZ '1998-01-01 00:00:00', '1-URGENT'), (20000002, 9000001, 'N', 50.5, TIMESTAMP_NTZ '1998-02-01 00:00:00', NULL);
UPDATE customer SET c_mktsegment = NULL WHERE c_custkey % 13 = 0;
DELETE FROM customer WHERE c_custkey BETWEEN 20 AND 29;
INSERT INTO customer VALUES (9000001, 'Customer#new', 3, 77.25, 'BUILDING');
UPDATE lineitem SET l_discount = 0.5 WHERE l_orderkey % 50 = 3;
DELETE FROM lineitem WHERE l_orderkey % 97 = 5;
"""

#: The same tables as they are after the changes, for DuckDB.
CTES = {
    "orders": """orders_m AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 100 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
        CASE WHEN o_orderkey % 100 = 0 THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice, o_orderdate, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
        FROM orders WHERE NOT o_orderkey BETWEEN 50 AND 59
        UNION ALL VALUES (20000001, 1, 'N', CAST(123.45 AS DOUBLE), TIMESTAMP '1998-01-01', '1-URGENT'), (20000002, 9000001, 'N', CAST(50.5 AS DOUBLE), TIMESTAMP '1998-02-01', NULL))""",
    "customer": """customer_m AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
        FROM customer WHERE NOT c_custkey BETWEEN 20 AND 29 UNION ALL VALUES (9000001, 'Customer#new', 3, CAST(77.25 AS DOUBLE), 'BUILDING'))""",
    "lineitem": """lineitem_m AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, CASE WHEN l_orderkey % 50 = 3 THEN CAST(0.5 AS DOUBLE) ELSE l_discount END AS l_discount,
        l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem WHERE l_orderkey % 97 <> 5)""",
}

_shared: dict[tuple, Database] = {}


def database(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] | None = None, fks: dict[str, list[ForeignKey]] | None = None, **options) -> Database:
    """A clean overlay over the folder's tables."""
    db = Database(spark)
    for name in tables or tuple(KEYS):
        db.register(name, f"{sf_dir}/{name}.parquet", pk=KEYS.get(name, ()), fks=(fks or {}).get(name, ()), **options.get(name, {}))
    return db


def shared(spark: SparkSession, sf_dir: str) -> OverlaySession:
    """A session on the changed tables; the changes are made once for a Spark application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _shared:
        db = database(spark, sf_dir)
        s = db.session()
        s.sql("BEGIN")
        s.script(SCRIPT)
        s.sql("COMMIT")
        db.compact()
        _shared[key] = db
    return _shared[key].session()
