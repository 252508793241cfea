"""Registered queries of dialect forms, constraints, conflicts, procedure calls and sequences."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import OverlayError
from ..registry import Registry
from ..sources.store import shared_folder
from .suite import ORACLES, QUERIES, _oracle, read, write
from .world import KEYS, database, shared

# -- aggregates with an order -------------------------------------------------------------------

read("agg_string_agg_order", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
read("agg_array_agg_order", "SELECT n_regionkey, array_join(array_agg(n_nationkey ORDER BY n_name DESC), ',') AS ids FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(array_agg(n_nationkey ORDER BY n_name DESC), ',') AS ids FROM nation GROUP BY n_regionkey")
read("agg_json_agg_order", "SELECT n_regionkey, json_agg(n_name ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY n_regionkey", """SELECT n_regionkey, '[' || string_agg('"' || n_name || '"', ',' ORDER BY n_nationkey DESC) || ']' AS names FROM nation GROUP BY n_regionkey""")
read("agg_group_concat_order", "SELECT n_regionkey, GROUP_CONCAT(DISTINCT n_name ORDER BY n_name DESC SEPARATOR ';') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
read(
    "agg_order_filter",
    "SELECT o_orderstatus, array_join(slice(array_agg(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) FILTER (WHERE o_totalprice > 1000), 1, 5), ',') AS top FROM {orders} GROUP BY o_orderstatus",
    "SELECT o_orderstatus, array_to_string((array_agg(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) FILTER (WHERE o_totalprice > 1000))[1:5], ',') AS top FROM {orders} GROUP BY o_orderstatus",
)
read("agg_order_nulls", "SELECT c_nationkey, string_agg(c_custkey, ' ' ORDER BY c_mktsegment DESC, c_custkey) AS ids FROM {customer} GROUP BY c_nationkey", "SELECT c_nationkey, string_agg(CAST(c_custkey AS VARCHAR), ' ' ORDER BY c_mktsegment DESC NULLS FIRST, c_custkey) AS ids FROM {customer} GROUP BY c_nationkey")
read("agg_checksum", "SELECT c_nationkey, checksum_agg(c_custkey) = checksum_agg(c_custkey + 0) AS same, checksum_agg(c_custkey) IS NULL AS none FROM {customer} GROUP BY c_nationkey", "SELECT DISTINCT c_nationkey, true AS same, false AS none FROM {customer}")

# -- JSON -------------------------------------------------------------------------------------------

read("json_contains", "SELECT event_id FROM events WHERE props @> '{\"k\": 3}'", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) = 3")
_JSON = """(VALUES (1, '{"a":{"b":[1,2,3],"c":"x"}}'), (2, '{"a":{"b":[1],"c":"x"}}'), (3, '[1,{"z":null},"2"]'), (4, '{"a.b":1,"it''s":"2","w x":{"y":[0]}}'), (5, '{"a":null}')) t(i, j)"""
read(
    "json_contains_nested",
    f"""SELECT i, j @> '{{"a":{{"b":[3,1.0]}}}}' AS n, j @> '[{{"z":null}},1]' AS l, j @> '"2"' AS s, j @> '{{}}' AS o, j @> '{{"a":{{"c":"x"}}}}' AS x FROM {_JSON}""",
    "SELECT * FROM (VALUES (1, true, false, false, true, true), (2, false, false, false, true, true), (3, false, true, true, false, false), (4, false, false, false, true, false), (5, false, false, false, true, false)) t(i, n, l, s, o, x)",
)
read(
    "json_any_key",
    f"SELECT i, j ->> 'a.b' AS p, j ->> 'it''s' AS q, j -> 'w x' AS w, j -> 'a' ->> 'c' AS c FROM {_JSON}",
    """SELECT * FROM (VALUES (1, NULL, NULL, NULL, 'x'), (2, NULL, NULL, NULL, 'x'), (3, NULL, NULL, NULL, NULL), (4, '1', '2', '{"y":[0]}', NULL), (5, NULL, NULL, NULL, NULL)) t(i, p, q, w, c)""",
)

# -- TOP, CONVERT, array literals, locks -----------------------------------------------------------------

read("top_subquery", "SELECT o_orderkey FROM (SELECT TOP 30 o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey) t WHERE o_orderkey % 2 = 0", "SELECT o_orderkey FROM (SELECT o_orderkey FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 30) WHERE o_orderkey % 2 = 0")
read("top_distinct", "SELECT DISTINCT TOP (2) o_orderstatus FROM {orders} ORDER BY o_orderstatus", "SELECT DISTINCT o_orderstatus FROM {orders} ORDER BY o_orderstatus LIMIT 2")
read("top_with_ties", "SELECT TOP 3 WITH TIES n_regionkey, n_nationkey FROM nation ORDER BY n_regionkey", "SELECT n_regionkey, n_nationkey FROM nation QUALIFY rank() OVER (ORDER BY n_regionkey) <= 3")
read("top_percent", "SELECT TOP 10 PERCENT o_orderkey FROM {orders} ORDER BY o_orderkey", "SELECT o_orderkey FROM {orders} QUALIFY row_number() OVER (ORDER BY o_orderkey) <= ceil(count(*) OVER () * 10 / 100.0)")
read("fn_convert", "SELECT n_nationkey, CONVERT(VARCHAR(10), n_nationkey) AS s, TRY_CONVERT(INT, n_name) AS bad, CONVERT(n_regionkey, CHAR) AS m FROM nation", "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS s, CAST(NULL AS INTEGER) AS bad, CAST(n_regionkey AS VARCHAR) AS m FROM nation")
read("fn_array_literal", "SELECT o_orderkey, size(ARRAY['a', 'b', o_orderstatus]) AS n FROM {orders} WHERE o_orderstatus = ANY(ARRAY['X', 'N'])", "SELECT o_orderkey, CAST(3 AS INTEGER) AS n FROM {orders} WHERE o_orderstatus IN ('X', 'N')")
read("fn_uuid", "SELECT CAST(count(DISTINCT u) AS BIGINT) AS n, max(length(u)) AS len FROM (SELECT uuid_generate_v4() AS u FROM {customer}) t", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(36 AS INTEGER) AS len FROM {customer}")
read("select_for_update", "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderstatus = 'X' FOR UPDATE SKIP LOCKED", "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderstatus = 'X'")
read(
    "cross_apply",
    "SELECT c_custkey, t.o_orderkey FROM {customer} c CROSS APPLY (SELECT TOP 2 o_orderkey FROM {orders} o WHERE o.o_custkey = c.c_custkey ORDER BY o_orderkey DESC) t",
    "SELECT c_custkey, o_orderkey FROM {customer} JOIN {orders} ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey DESC) <= 2",
)

# -- writes ---------------------------------------------------------------------------------------------------

write(
    "insert_nextval",
    "INSERT INTO orders (o_orderkey, o_orderstatus) VALUES (nextval('orders_o_orderkey_seq'), 'Q'), (nextval('orders_o_orderkey_seq'), 'R'); INSERT INTO orders (o_orderstatus) VALUES ('Q')",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('Q', 'R')",
    "SELECT g + i AS o_orderkey, s AS o_orderstatus FROM (SELECT greatest(10 * max(o_orderkey), max(o_orderkey) + 10000000) AS g FROM orders), (VALUES (0, 'Q'), (1, 'R'), (2, 'Q')) t(i, s)",
    orders={"auto_id": True},
)
write("update_returning_alias", "SELECT 1", "UPDATE orders AS x SET o_totalprice = x.o_totalprice + 1 WHERE x.o_orderkey < 30 RETURNING x.o_orderkey, x.o_totalprice AS price", "SELECT o_orderkey, o_totalprice + 1 AS price FROM orders WHERE o_orderkey < 30")
write(
    "upsert_returning",
    "SELECT 1",
    "INSERT INTO orders (o_orderkey, o_orderstatus) VALUES (1, 'U'), (800000001, 'V') ON CONFLICT (o_orderkey) DO UPDATE SET o_orderstatus = EXCLUDED.o_orderstatus RETURNING o_orderkey, o_orderstatus, o_custkey",
    "SELECT o_orderkey, 'U' AS o_orderstatus, o_custkey FROM orders WHERE o_orderkey = 1 UNION ALL SELECT 800000001, 'V', NULL",
)
write("replace_last_wins", "REPLACE INTO orders (o_orderkey, o_orderstatus) VALUES (5, 'a'), (5, 'b'), (1, 'c'), (5, 'd')", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 5)", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'c'), (5, 'd')) t(o_orderkey, o_orderstatus)")
write("insert_ignore_first_wins", "INSERT IGNORE INTO orders (o_orderkey, o_orderstatus) VALUES (900000005, 'a'), (900000005, 'b'), (900000006, 'c')", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 900000005", "SELECT * FROM (VALUES (CAST(900000005 AS BIGINT), 'a'), (900000006, 'c')) t(o_orderkey, o_orderstatus)")
write("ddl_drop_table", "CREATE TABLE gone (a INT); INSERT INTO gone VALUES (1); DROP TABLE gone; CREATE TABLE gone (a INT, b TEXT); INSERT INTO gone VALUES (2, 'x')", "SELECT a, b FROM gone", "SELECT 2 AS a, 'x' AS b")
write("ddl_create_index", "CREATE INDEX o_idx ON orders (o_custkey); CREATE UNIQUE INDEX c_idx ON customer (c_custkey); DROP INDEX o_idx", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus")


def _states(spark: SparkSession, sf_dir: str, statements: Sequence[tuple[str, str]], **options) -> DataFrame:
    """Each statement, and 00000 or the state of its error."""
    s = database(spark, sf_dir, ("nation", "region", "orders"), **options).session()
    out = []
    for i, (text, _) in enumerate(statements):
        try:
            s.sql(text)
            state = "00000"
        except OverlayError as e:
            state = e.sqlstate
        out.append((i, text, state))
    return spark.createDataFrame(out, "i int, statement string, state string")


#: Statements in turn, and the state that each must give; fixed values.
STATES = {
    "constraint_states": (
        ("CREATE TABLE t (id INT PRIMARY KEY, name TEXT NOT NULL, mail TEXT UNIQUE, age INT CHECK (age >= 0), low INT, high INT, CONSTRAINT span CHECK (low <= high), UNIQUE (low, high))", "00000"),
        ("INSERT INTO t VALUES (1, 'a', 'm1', 5, 1, 2)", "00000"), ("INSERT INTO t (id, mail) VALUES (2, 'm2')", "23502"), ("INSERT INTO t VALUES (NULL, 'a', 'm3', 5, 1, 3)", "23502"), ("INSERT INTO t VALUES (2, 'b', 'm1', 5, 1, 3)", "23505"),
        ("INSERT INTO t VALUES (2, 'b', 'm2', -1, 1, 3)", "23514"), ("INSERT INTO t VALUES (2, 'b', 'm2', 1, 4, 3)", "23514"), ("INSERT INTO t VALUES (2, 'b', NULL, NULL, NULL, 3), (3, 'c', NULL, 1, NULL, 3)", "00000"), ("INSERT INTO t VALUES (4, 'd', 'x', 1, 5, 6), (5, 'd', 'x', 1, 5, 7)", "23505"),
        ("UPDATE t SET name = NULL WHERE id = 1", "23502"), ("UPDATE t SET age = age - 10 WHERE id = 1", "23514"), ("UPDATE t SET mail = 'm1' WHERE id = 2", "23505"), ("UPDATE t SET mail = 'm2' WHERE id = 2", "00000"), ("INSERT INTO t VALUES (9, 'z', 'm1', 1, 8, 9) ON CONFLICT DO NOTHING", "00000"),
        ("INSERT INTO t VALUES (1, 'z', 'm2', 1, 8, 9) ON CONFLICT (id) DO UPDATE SET mail = EXCLUDED.mail", "23505"), ("ALTER TABLE t ALTER COLUMN mail SET NOT NULL", "23502"), ("ALTER TABLE t ADD CONSTRAINT old CHECK (age > 3)", "23514"), ("ALTER TABLE t ADD CONSTRAINT big CHECK (age < 99)", "00000"),
        ("UPDATE t SET age = 100 WHERE id = 1", "23514"), ("ALTER TABLE t DROP CONSTRAINT big", "00000"), ("UPDATE t SET age = 100 WHERE id = 1", "00000"), ("ALTER TABLE t RENAME COLUMN age TO years", "00000"), ("UPDATE t SET years = -5 WHERE id = 1", "23514"), ("ALTER TABLE t ALTER COLUMN name DROP NOT NULL", "00000"),
        ("UPDATE t SET name = NULL WHERE id = 1", "00000"), ("ALTER TABLE nation ALTER COLUMN n_name SET NOT NULL", "00000"), ("INSERT INTO nation VALUES (100, NULL, 1)", "23502"), ("INSERT INTO nation VALUES (100, 'x', 1)", "00000"), ("ALTER TABLE t ADD CONSTRAINT twice UNIQUE (high)", "23505"),
        ("ALTER TABLE t ADD CONSTRAINT once UNIQUE (low)", "00000"),
    ),
    "statement_states": (
        ("MERGE INTO nation AS t USING (SELECT 1 AS k, 'a' AS n UNION ALL SELECT 1, 'b') AS s ON t.n_nationkey = s.k WHEN MATCHED THEN UPDATE SET n_name = s.n", "21000"), ("WITH gone AS (DELETE FROM nation RETURNING *) SELECT * FROM gone", "0A000"), ("SELECT * FROM missing", "42P01"),
        ("INSERT INTO nation (nothing) VALUES (1)", "42703"), ("DROP TABLE nation", "00000"), ("DROP TABLE nation", "42P01"), ("DROP TABLE IF EXISTS nation", "00000"), ("NOTIFY x", "0A000"), ("INSERT INTO orders (o_orderkey) VALUES (1)", "23505"), ("SELECT nextval('none_seq')", "42P01"), ("COMMIT", "25P02"),
        ("EXPLAIN SELECT * FROM region", "00000"), ("DELETE FROM region", "00000"), ("EXPLAIN SELECT * FROM region", "0A000"),
    ),
}


def _register(name: str) -> None:
    statements = STATES[name]
    QUERIES[name] = lambda spark, d: _states(spark, d, statements)
    ORACLES[name] = "SELECT * FROM (VALUES " + ", ".join("({}, '{}', '{}')".format(i, t.replace("'", "''"), s) for i, (t, s) in enumerate(statements)) + ") t(i, statement, state)"


for _name in STATES:
    _register(_name)


def _first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts of two sessions, one between the two steps of the other, keep their own rows."""
    db = database(spark, sf_dir, ("nation", "region"))
    a, b = db.session(), db.session()
    inner = a.writer.query

    def between(sql, version):
        if "__excluded" in sql:
            a.writer.query = inner
            b.sql("INSERT INTO region (r_regionkey, r_name) VALUES (0, 'from b') ON CONFLICT (r_regionkey) DO UPDATE SET r_name = EXCLUDED.r_name")
        return inner(sql, version)

    a.writer.query = between
    a.sql("INSERT INTO nation (n_nationkey, n_name) VALUES (0, 'from a') ON CONFLICT (n_nationkey) DO UPDATE SET n_name = EXCLUDED.n_name")
    s = db.session()
    return s.sql("SELECT n_name AS name FROM nation WHERE n_nationkey = 0").unionByName(s.sql("SELECT r_name AS name FROM region WHERE r_regionkey = 0"))


QUERIES["concurrent_upserts"] = _first_wins
ORACLES["concurrent_upserts"] = "SELECT * FROM (VALUES ('from a'), ('from b')) t(name)"


# -- procedure calls ---------------------------------------------------------------------------------------------


def _called(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shared(spark, sf_dir)
    one = s.sql("EXEC sp_executesql N'SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN @low AND @high', N'@low int, @high int', @high = 80, @low = 40")
    h = s.sql("EXEC sp_prepare @h OUTPUT, N'@s nvarchar(1)', N'SELECT o_orderkey FROM orders WHERE o_orderstatus = @s'").first()["handle"]
    two = s.sql(f"EXEC sp_execute {h}, N'N'")
    s.sql(f"EXEC sp_unprepare {h}")
    c = s.sql("EXEC sp_cursoropen @c OUTPUT, N'SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC'").first()["handle"]
    s.sql(f"EXEC sp_cursorfetch {c}, 2, 0, 3")
    three = s.sql(f"EXEC sp_cursorfetch {c}, 2, 0, 4")
    s.sql(f"EXEC sp_cursorclose {c}")
    return one.withColumn("part", F.lit(1)).unionByName(two.withColumn("part", F.lit(2))).unionByName(three.withColumn("part", F.lit(3)))


QUERIES["procedure_calls"] = _called
ORACLES["procedure_calls"] = _oracle(
    "SELECT o_orderkey, 1 AS part FROM {orders} WHERE o_orderkey BETWEEN 40 AND 80 UNION ALL SELECT o_orderkey, 2 FROM {orders} WHERE o_orderstatus = 'N' UNION ALL SELECT * FROM (SELECT o_orderkey, 3 FROM {orders} ORDER BY o_orderkey DESC LIMIT 4 OFFSET 3)"
)


def _restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry that another one reads again, as after a restart."""
    root = f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"
    first = Registry(spark, root)
    db = first.create("world", {"nation": {"path": f"{sf_dir}/nation.parquet", "pk": list(KEYS["nation"])}})
    db.session().script("DELETE FROM nation WHERE n_nationkey < 10; UPDATE nation SET n_name = 'new' WHERE n_nationkey = 12")
    first.save("world")
    first.create("brief", {})
    first.drop("brief")
    again = Registry(spark, root)
    return again.open("world").session().sql("SELECT n_nationkey, n_name FROM nation").crossJoin(again.list().select("name", "tables"))


QUERIES["registry_reopen"] = _restarted
ORACLES["registry_reopen"] = "SELECT n_nationkey, CASE WHEN n_nationkey = 12 THEN 'new' ELSE n_name END AS n_name, 'world' AS name, CAST(1 AS INTEGER) AS tables FROM nation WHERE n_nationkey >= 10"


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log, partly written as JSON lines, partly held."""
    s = database(spark, sf_dir, ("nation",)).session()
    s.sql("SELECT * FROM nation")
    s.sql("DELETE FROM nation WHERE n_nationkey = 1")
    s.db.log.flush()
    s.sql("SELECT count(*) FROM nation")
    return s.db.log.frame().select("sql", "op", "strategy", F.array_join("tables", ",").alias("tables"))


QUERIES["log_json_lines"] = _logged
ORACLES["log_json_lines"] = "SELECT * FROM (VALUES ('SELECT * FROM nation', 'READ', 'BASE_DIRECT', 'nation'), ('DELETE FROM nation WHERE n_nationkey = 1', 'WRITE', 'OVERLAY_DELETE', 'nation'), ('SELECT count(*) FROM nation', 'READ', 'MERGED_READ', 'nation')) t(sql, op, strategy, tables)"
