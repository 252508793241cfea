"""Registered queries of the key-value, document and streaming surfaces, on datasets made of events."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, kv
from ..session import Database
from ..sources.store import shared_folder
from ..streaming.merged import fan_in, read_stream, windowed
from .suite import ORACLES, QUERIES
from .world import database

NOW = datetime.datetime(2024, 6, 1, tzinfo=datetime.UTC)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def key_values(spark: SparkSession, sf_dir: str) -> kv.KeyValue:
    """Hashes ``h:<event>``, strings ``s:<event>``, and per user a list, a set and a sorted set."""
    e = _events(spark, sf_dir)
    null = {f.name: F.lit(None).cast(f.dataType) for f in kv.SCHEMA.fields}

    def rows(df: DataFrame, key, kind: str, value) -> DataFrame:
        made = null | {"key": key, "type": F.lit(kind), kv.COLUMN_OF[kind]: value}
        return df.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in kv.SCHEMA.fields])

    per = e.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")).alias("l"),
        F.array_sort(F.collect_set("event_type")).alias("s"),
        F.array_sort(F.collect_list(F.struct(F.col("value").alias("score"), F.col("event_id").cast("string").alias("member")))).alias("z"),
    )
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    frame = rows(e, F.concat(F.lit("h:"), event), "hash", F.create_map(F.lit("user"), user, F.lit("type"), F.col("event_type")))
    frame = frame.unionByName(rows(e, F.concat(F.lit("s:"), event), "string", user.cast("binary")))
    for prefix, kind, column in (("l:", "list", "l"), ("t:", "set", "s"), ("z:", "zset", "z")):
        frame = frame.unionByName(rows(per, F.concat(F.lit(prefix), user), kind, F.col(column)))
    db = Database(spark)
    db.register("kv", frame=frame, pk=["key"])
    return kv.KeyValue(db.session(), now=lambda: NOW)


def _kv(name: str, run, oracle: str) -> None:
    QUERIES[name] = lambda spark, d: run(key_values(spark, d))
    ORACLES[name] = oracle


def _then(*steps):
    """Bulk writes, then a bulk read of (command, pattern, arguments)."""

    def run(store: kv.KeyValue) -> DataFrame:
        for s in steps[:-1]:
            (store.change_each if s[0] in kv.WRITES else store.execute)(*s)
        return store.each(*steps[-1])

    return run


_PER = "SELECT user_id, list(event_id ORDER BY event_id) AS l FROM events GROUP BY user_id"
_kv("kv_get", _then(("GET", "s:*")), "SELECT 's:' || event_id AS key, CAST(user_id AS VARCHAR) AS value FROM events")
_kv("kv_incrby", _then(("INCRBY", "s:1*", 5), ("APPEND", "s:2*", "0"), ("GET", "s:*")), "SELECT 's:' || event_id AS key, CASE WHEN CAST(event_id AS VARCHAR) LIKE '1%' THEN CAST(user_id + 5 AS VARCHAR) WHEN CAST(event_id AS VARCHAR) LIKE '2%' THEN user_id || '0' ELSE CAST(user_id AS VARCHAR) END AS value FROM events")
_kv("kv_strlen", _then(("STRLEN", "s:*")), "SELECT 's:' || event_id AS key, CAST(length(CAST(user_id AS VARCHAR)) AS BIGINT) AS value FROM events")
_kv("kv_hash_change", _then(("HINCRBY", "h:*5", "user", 1), ("HDEL", "h:*7", "user", "type"), ("HGET", "h:*", "user")), "SELECT 'h:' || event_id AS key, CAST(user_id + CASE WHEN event_id % 10 = 5 THEN 1 ELSE 0 END AS VARCHAR) AS value FROM events WHERE event_id % 10 <> 7")
_kv("kv_hset_hlen", _then(("HSET", "h:??", "new", "x", "type", "y"), ("HLEN", "h:*")), "SELECT 'h:' || event_id AS key, CAST(CASE WHEN event_id BETWEEN 10 AND 99 THEN 3 ELSE 2 END AS BIGINT) AS value FROM events")
_kv("kv_list_push_len", _then(("RPUSH", "l:*", "a", "b"), ("LLEN", "l:*")), f"SELECT 'l:' || user_id AS key, CAST(len(l) + 2 AS BIGINT) AS value FROM ({_PER})")
_kv("kv_list_index", _then(("LPUSH", "l:1*", "first"), ("LINDEX", "l:*", 0)), f"SELECT 'l:' || user_id AS key, CASE WHEN CAST(user_id AS VARCHAR) LIKE '1%' THEN 'first' ELSE CAST(l[1] AS VARCHAR) END AS value FROM ({_PER})")
_kv("kv_list_trim", lambda s: _then(("LTRIM", "l:*", 1, -2), ("LRANGE", "l:*", 0, 2))(s).select("key", F.array_join("value", ",").alias("value")), f"SELECT 'l:' || user_id AS key, array_to_string(l[2:len(l) - 1][1:3], ',') AS value FROM ({_PER}) WHERE len(l) > 2")
_kv("kv_set_members", lambda s: _then(("SADD", "t:*", "zz"), ("SREM", "t:*", "click"), ("SMEMBERS", "t:*"))(s).select("key", F.array_join("value", ",").alias("value")), "SELECT 't:' || user_id AS key, array_to_string(list_sort(list_append(list(DISTINCT event_type) FILTER (WHERE event_type <> 'click'), 'zz')), ',') AS value FROM events GROUP BY user_id")
_kv("kv_set_ismember", _then(("SISMEMBER", "t:*", "error")), "SELECT 't:' || user_id AS key, CAST(bool_or(event_type = 'error') AS INTEGER) AS value FROM events GROUP BY user_id")
_kv("kv_zset_range", lambda s: s.each("ZREVRANGE", "z:*", 0, 2).select("key", F.array_join("value", ",").alias("value")), "SELECT 'z:' || user_id AS key, array_to_string(list(CAST(event_id AS VARCHAR) ORDER BY value DESC, CAST(event_id AS VARCHAR) DESC)[1:3], ',') AS value FROM events GROUP BY user_id")
_kv("kv_zset_count", _then(("ZREMRANGEBYSCORE", "z:*", "-inf", "(10"), ("ZCOUNT", "z:*", 10, 100)), "SELECT 'z:' || user_id AS key, CAST(count(*) FILTER (WHERE value <= 100) AS BIGINT) AS value FROM events WHERE value >= 10 GROUP BY user_id")
_kv("kv_expire", _then(("EXPIRE", "s:1*", -1), ("EXPIRE", "s:2*", 100), ("GET", "s:*")), "SELECT 's:' || event_id AS key, CAST(user_id AS VARCHAR) AS value FROM events WHERE CAST(event_id AS VARCHAR) NOT LIKE '1%'")
_kv("kv_keys_glob", lambda s: s.keys("[sh]:?5"), "SELECT p || event_id AS key FROM events, (VALUES ('s:'), ('h:')) t(p) WHERE event_id BETWEEN 10 AND 99 AND event_id % 10 = 5")


def _point(store: kv.KeyValue) -> DataFrame:
    """One key after the other, in a transaction; the replies."""
    store.execute("MULTI")
    for command in (("SET", "p", "10"), ("INCR", "p"), ("DEL", "s:1", "s:2", "none"), ("EXISTS", "s:1", "s:3"), ("SETNX", "p", "x"), ("GETDEL", "p"), ("EXISTS", "p")):
        store.execute(*command)
    replies = store.execute("EXEC")
    return store.session.spark.createDataFrame([(i, str(r)) for i, r in enumerate(replies)], "i int, reply string")


_kv("kv_transaction", _point, "SELECT * FROM (VALUES (0, 'OK'), (1, '11'), (2, '2'), (3, '1'), (4, '0'), (5, '11'), (6, '0')) t(i, reply)")


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c, kv.strategy_of(c)) for c, _ in KV_ROUTES], "command string, strategy string")


KV_ROUTES = (
    ("GET", "MERGED_READ"), ("MGET", "MERGED_READ"), ("SET", "OVERLAY_WRITE"), ("INCR", "HYDRATE_AND_WRITE"), ("HSET", "HYDRATE_AND_WRITE"), ("HDEL", "OVERLAY_DELETE"), ("DEL", "OVERLAY_DELETE"), ("LTRIM", "TRUNCATE"),
    ("SUNIONSTORE", "OVERLAY_WRITE"), ("RENAME", "HYDRATE_AND_WRITE"), ("FLUSHALL", "OVERLAY_DDL"), ("MULTI", "TRANSACTION"), ("PING", "BASE_DIRECT"), ("PUBLISH", "NOT_SUPPORTED"), ("SHUTDOWN", "NOT_SUPPORTED"),
)
QUERIES["kv_route_matrix"] = _routes
ORACLES["kv_route_matrix"] = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{s}')" for c, s in KV_ROUTES) + ") t(command, strategy)"


# Many read commands of one type on every key, in one job.


def _all(name: str, pattern: str, commands: dict, columns: dict, oracle: str) -> None:
    """``columns`` are expressions over the commands' values, by name."""
    _kv(name, lambda s: s.read_each(pattern, **commands).select("key", *[F.expr(e).alias(c) for c, e in columns.items()]), oracle)


_all(
    "kv_each_strings",
    "s:*",
    {"g": ("GETRANGE", 0, 0), "n": ("STRLEN",), "t": ("TYPE",), "b": ("GETBIT", 7), "p": ("BITPOS", 1)},
    {c: c for c in "gntbp"},
    "SELECT 's:' || event_id AS key, CAST(user_id AS VARCHAR)[1] AS g, CAST(length(CAST(user_id AS VARCHAR)) AS BIGINT) AS n, 'string' AS t, CAST(ascii(CAST(user_id AS VARCHAR)) % 2 AS INTEGER) AS b, CAST(2 AS BIGINT) AS p FROM events",
)
_all(
    "kv_each_hashes",
    "h:*",
    {"m": ("HMGET", "type", "none"), "k": ("HKEYS",), "v": ("HVALS",), "e": ("HEXISTS", "user"), "s": ("HSTRLEN", "type"), "a": ("HGETALL",), "c": ("HSCAN", 0, "MATCH", "u*")},
    {"m": "m[0]", "none": "m[1] IS NULL", "k": "array_join(k, ',')", "v": "array_join(v, ',')", "e": "e", "s": "s", "a": "a['user']", "c": "array_join(map_keys(c), ',')"},
    "SELECT 'h:' || event_id AS key, event_type AS m, true AS none, 'type,user' AS k, event_type || ',' || user_id AS v, CAST(1 AS INTEGER) AS e, CAST(length(event_type) AS BIGINT) AS s, CAST(user_id AS VARCHAR) AS a, 'user' AS c FROM events",
)
_all(
    "kv_each_lists",
    "l:*",
    {"n": ("LLEN",), "z": ("LINDEX", -1), "r": ("LRANGE", -2, -1), "p": ("LPOS", "7")},
    {"n": "n", "z": "z", "r": "array_join(r, ',')", "p": "p"},
    f"SELECT 'l:' || user_id AS key, CAST(len(l) AS BIGINT) AS n, CAST(l[-1] AS VARCHAR) AS z, array_to_string(l[-2:], ',') AS r, CAST(list_position(l, 7) - 1 AS BIGINT) AS p FROM ({_PER})".replace("list_position(l, 7) - 1", "nullif(list_position(l, 7), 0) - 1"),
)
_all(
    "kv_each_sets",
    "t:*",
    {"n": ("SCARD",), "m": ("SMISMEMBER", "click", "none"), "c": ("SSCAN", 0, "MATCH", "c*")},
    {"n": "n", "m": "m[0]", "none": "m[1]", "c": "array_join(c, ',')"},
    "SELECT 't:' || user_id AS key, CAST(count(DISTINCT event_type) AS BIGINT) AS n, CAST(bool_or(event_type = 'click') AS INTEGER) AS m, CAST(0 AS INTEGER) AS none, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (WHERE event_type LIKE 'c%'), '') AS c FROM events GROUP BY user_id",
)
_all(
    "kv_each_zsets",
    "z:*",
    {"n": ("ZCARD",), "c": ("ZCOUNT", 10, "(50"), "f": ("ZRANGE", 0, 0), "s": ("ZRANGEBYSCORE", 20, "+inf", "LIMIT", 0, 2), "r": ("ZREVRANGEBYSCORE", "(20", "-inf", "LIMIT", 0, 1)},
    {"n": "n", "c": "c", "f": "f[0]", "s": "array_join(s, ',')", "r": "array_join(r, ',')"},
    """SELECT 'z:' || user_id AS key, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE value >= 10 AND value < 50) AS BIGINT) AS c, list(CAST(event_id AS VARCHAR) ORDER BY value, CAST(event_id AS VARCHAR))[1] AS f,
       coalesce(array_to_string((list(CAST(event_id AS VARCHAR) ORDER BY value, CAST(event_id AS VARCHAR)) FILTER (WHERE value >= 20))[1:2], ','), '') AS s,
       coalesce((list(CAST(event_id AS VARCHAR) ORDER BY value DESC, CAST(event_id AS VARCHAR) DESC) FILTER (WHERE value < 20))[1], '') AS r FROM events GROUP BY user_id""",
)

# -- documents ---------------------------------------------------------------------------------------------


def store_of(spark: SparkSession, sf_dir: str) -> documents.Documents:
    e = _events(spark, sf_dir)
    at = F.col("ts").cast("timestamp")
    fields = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("value").alias("value"), F.array(F.lit("all"), F.col("event_type")).alias("tags"), F.from_json("props", "k int").alias("props")))
    user = F.col("user_id").cast("string")
    frame = e.select(F.concat(F.lit("users/"), user, F.lit("/events/"), F.col("event_id").cast("string")).alias("path"), F.concat(F.lit("users/"), user, F.lit("/events")).alias("collection"), F.col("event_id").cast("string").alias("doc_id"), fields.alias("fields"), at.alias("create_time"), at.alias("update_time"))
    db = Database(spark)
    db.register("docs", frame=frame, pk=["path"])
    return documents.Documents(db.session(), now=lambda: NOW)


def _doc(name: str, run, oracle: str) -> None:
    QUERIES[name] = lambda spark, d: run(store_of(spark, d))
    ORACLES[name] = oracle


_ID = lambda df: df.select(F.col("doc_id").cast("long").alias("id"))
_doc("doc_filter", lambda d: _ID(d.query("events", {"and": [("kind", "=", "click"), ("props.k", ">=", 50), ("value", "<", 20)]}, group=True)), "SELECT event_id AS id FROM events WHERE event_type = 'click' AND CAST(json_extract(props, '$.k') AS INTEGER) >= 50 AND value < 20")
_doc("doc_or_in", lambda d: _ID(d.query("events", {"or": [("kind", "IN", ["error", "signup"]), ("props.k", "=", 3)]}, group=True)), "SELECT event_id AS id FROM events WHERE event_type IN ('error', 'signup') OR CAST(json_extract(props, '$.k') AS INTEGER) = 3")
_doc("doc_array_contains", lambda d: _ID(d.query("events", ("tags", "ARRAY_CONTAINS_ANY", ["view", "none"]), group=True)), "SELECT event_id AS id FROM events WHERE event_type = 'view'")
_doc("doc_missing_and_type", lambda d: _ID(d.query("events", {"or": [("none", "IS_NOT_NULL"), ("kind", ">", 5), ("value", "IS_NAN"), ("props.k", "NOT_IN", [1, 2])]}, group=True)), "SELECT event_id AS id FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) NOT IN (1, 2)")
_doc("doc_order_limit", lambda d: _ID(d.query("events", None, [("props.k", "desc"), ("value", "asc"), ("__name__", "asc")], 50, group=True)), "SELECT event_id AS id FROM events ORDER BY CAST(json_extract(props, '$.k') AS INTEGER) DESC, value, 'users/' || user_id || '/events/' || event_id LIMIT 50")
_doc("doc_aggregate", lambda d: d.aggregate("users/7/events", [("COUNT", None, "n"), ("SUM", "props.k", "s"), ("AVG", "kind", "a")]), "SELECT CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum(CAST(json_extract(props, '$.k') AS INTEGER)), 0) AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS a FROM events WHERE user_id = 7")


def _written(d: documents.Documents) -> DataFrame:
    d.create("users/7/events", "new", {"kind": "made", "value": 1.5})
    d.commit([{"transform": "users/7/events/new", "transforms": {"value": ("increment", 2), "tags": ("array_union", ["x"])}}])
    first = d.query("users/7/events", ("kind", "!=", "made"), [("__name__", "asc")], 1).first()["path"]
    d.delete(first)
    rows = d.query("users/7/events")
    return rows.select("path", documents.Value("value").number.alias("value"))


_doc("doc_write_cycle", _written, "SELECT 'users/7/events/' || event_id AS path, value FROM events WHERE user_id = 7 AND 'users/7/events/' || event_id <> (SELECT min('users/7/events/' || event_id) FROM events WHERE user_id = 7) UNION ALL SELECT 'users/7/events/new', 3.5")


#: Values of every type in their order, with ties of whole and broken numbers, places and times with zones; fixed values.
ORDERED = (
    None, False, True, -5, 1, 1.5, 2, float("nan"), datetime.datetime(2024, 1, 1, 12, tzinfo=datetime.timezone(datetime.timedelta(hours=5))), datetime.datetime(2024, 1, 1, 9, tzinfo=datetime.UTC), "", "a", "b", b"\x01", b"\x02", {"$ref": "a/1"}, {"$ref": "b"},
    {"$geo": [-10, 5]}, {"$geo": [9, 1]}, {"$geo": [10, -1]}, [], [9], [9, 1], [10], ["a"], {"a": 1}, {"a": 2}, {"a": 2, "b": 0}, {"b": 0},
)


def _typed(spark: SparkSession) -> documents.Documents:
    """A document for each of ``ORDERED``, by the place in it; one more without the field."""
    fields = [documents.encode({"v": v}) for v in ORDERED] + ["{}"]
    rows = [(f"t/{i:02d}", "t", f"{i:02d}", f, NOW, NOW) for i, f in enumerate(fields)]
    db = Database(spark)
    db.register("docs", frame=spark.createDataFrame(rows, documents.SCHEMA), pk=["path"])
    return documents.Documents(db.session(), now=lambda: NOW)


def _ordered(spark: SparkSession, _: str) -> DataFrame:
    got = [r["doc_id"] for r in _typed(spark).query("t", None, [("v", "asc")]).select("doc_id").collect()]
    return spark.createDataFrame(list(enumerate(got)), "place int, doc_id string")


QUERIES["doc_value_order"] = _ordered
ORACLES["doc_value_order"] = "SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS INTEGER) AS place, printf('%02d', i) AS doc_id FROM range(" + str(len(ORDERED)) + ") t(i)"


def _filtered(spark: SparkSession, _: str) -> DataFrame:
    """How many documents fit each filter."""
    d = _typed(spark)
    d.commit([{"update": f"l/{i}", "fields": {"v": v}} for i, v in enumerate(([1], [1.0, 2], ["1"], [[1]], [{"a": 1}], []))])
    cases = [
        ("l", "ARRAY_CONTAINS", 1.0), ("l", "ARRAY_CONTAINS", "1"), ("l", "ARRAY_CONTAINS", {"a": 1.0}), ("l", "ARRAY_CONTAINS_ANY", [2, [1]]), ("t", "<", [10]), ("t", ">=", [9, 1]), ("t", "=", {"a": 2}), ("t", ">", {"a": 1}),
        ("t", "<=", datetime.datetime(2024, 1, 1, 8, tzinfo=datetime.UTC)), ("t", ">", b"\x01"), ("t", "IN", [1, "a", [9]]), ("t", "NOT_IN", [1, 2, "a"]), ("t", "!=", [9]), ("t", "IS_NAN", None), ("t", "IS_NULL", None),
    ]
    parts = []
    for c in ("t", "l"):  # one job for each collection
        own = [(i, documents.where(("v", op, v))) for i, (k, op, v) in enumerate(cases) if k == c]
        counts = d.query(c).agg(*[F.count_if(w).alias(str(i)) for i, w in own]).first()
        parts += [(i, counts[str(i)]) for i, _ in own]
    return spark.createDataFrame(sorted(parts), "i int, n long")


QUERIES["doc_value_filters"] = _filtered
ORACLES["doc_value_filters"] = "SELECT CAST(i AS INTEGER) AS i, CAST(n AS BIGINT) AS n FROM (VALUES " + ", ".join(f"({i}, {n})" for i, n in enumerate((2, 1, 1, 2, 3, 3, 1, 3, 1, 1, 3, 25, 27, 1, 2))) + ") t(i, n)"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single requests by the names of their methods, a transaction and preconditions: a text for each reply."""
    from ..errors import OverlayError

    d = store_of(spark, sf_dir)
    out: list[str] = []

    def say(run) -> None:
        try:
            out.append(str(run()))
        except OverlayError as e:
            out.append(e.sqlstate)

    d.call("CreateDocument", collection="c", doc_id="a", fields={"n": 1, "tags": ["x", "y"]})
    say(lambda: d.call("GetDocument", path="c/a")["n"])
    say(lambda: d.call("GetDocument", path="c/none"))
    say(lambda: [f is not None for _, f in d.call("BatchGetDocuments", paths=["c/none", "c/a"])])
    d.call("Commit", writes=[{"update": "c/b", "fields": {"n": 5}}, {"update": "c/c", "fields": {"n": 7}, "exists": False}])
    say(lambda: [p for p, _ in d.call("ListDocuments", collection="c", page_size=2)[0]])
    say(lambda: d.call("ListDocuments", collection="c", page_size=2)[1])
    say(lambda: d.call("ListCollectionIds"))
    say(lambda: d.call("CreateDocument", collection="c", doc_id="a", fields={}))
    say(lambda: d.call("DeleteDocument", path="c/none", exists=True))
    d.commit([{"transform": "c/a", "transforms": {"n": ("maximum", 4), "tags": ("array_remove", ["x"]), "at": ("server_timestamp", None)}}])
    say(lambda: [d.get("c/a")[k] for k in ("n", "tags")] + [d.get("c/a")["at"] == NOW])
    d.commit([{"transform": "c/b", "transforms": {"n": ("minimum", 2)}}])
    say(lambda: d.get("c/b")["n"])
    tx = d.call("BeginTransaction")
    say(lambda: tx.get("c/b")["n"])
    d.now = lambda: NOW + datetime.timedelta(seconds=1)
    d.call("UpdateDocument", path="c/b", fields={"n": 100})
    say(lambda: tx.get("c/b")["n"])
    say(lambda: tx.commit([{"update": "c/b", "fields": {"n": 0}}]))
    tx = d.begin()
    say(lambda: tx.get("c/b")["n"])
    say(lambda: tx.commit([{"update": "c/b", "fields": {"n": 0}}]))
    say(lambda: d.get("c/b")["n"])
    say(lambda: tx.rollback())
    say(lambda: d.call("PartitionQuery", collection="c", n=2).count())
    say(lambda: documents.classify_method("Listen"))
    say(lambda: documents.classify_method("DropEverything"))
    return spark.createDataFrame(list(enumerate(out)), "i int, reply string")


#: The replies, in order; fixed values.
_REPLIES = ("1", "P0404", "[False, True]", "['c/a', 'c/b']", "c/c", "['c', 'users']", "P0412", "P0412", "[4, ['y'], True]", "2", "2", "2", "40001", "100", "1", "0", "25P02", "3", "base only", "0A000")
QUERIES["doc_requests"] = _requests
ORACLES["doc_requests"] = "SELECT * FROM (VALUES " + ", ".join("({}, '{}')".format(i, r.replace("'", "''")) for i, r in enumerate(_REPLIES)) + ") t(i, reply)"

# -- streams -----------------------------------------------------------------------------------------------------


def _drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream to its end and return what it wrote."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = database(spark, sf_dir, ("events",)).session()
    s.script("DELETE FROM events WHERE event_id % 10 = 3; UPDATE events SET value = 0 WHERE event_id % 10 = 4; INSERT INTO events (event_id, event_type, value) VALUES (-5, 'click', 7)")
    out = _drain(read_stream(s, "events"), "append")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


QUERIES["stream_merged_read"] = _streamed
ORACLES["stream_merged_read"] = """SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM
    (SELECT event_type, CASE WHEN event_id % 10 = 4 THEN 0 ELSE value END AS value FROM events WHERE event_id % 10 <> 3 UNION ALL SELECT 'click', 7) GROUP BY event_type"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = database(spark, sf_dir, ("events",)).session()
    s.sql("DELETE FROM events WHERE event_type = 'view'")
    stream = read_stream(s, "events", images=False).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _drain(windowed(stream, "ts", ["event_type"], delay="0 seconds", width="6 hours"), "append")
    return out.select(F.col("window.start").alias("begin"), "event_type", "n")


QUERIES["stream_windowed_counts"] = _windows
#: A window is written once the watermark, the latest event, has passed its end.
ORACLES["stream_windowed_counts"] = """SELECT CAST(b AS TIMESTAMPTZ) AS begin, event_type, CAST(count(*) AS BIGINT) AS n FROM
    (SELECT event_type, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS b FROM events WHERE event_type <> 'view')
    WHERE b + INTERVAL '6 hours' <= (SELECT max(ts) FROM events WHERE event_type <> 'view') GROUP BY b, event_type"""


def _fanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the base and of an overlay's own as one stream, kept to the channels of two patterns."""
    s = database(spark, sf_dir, ("events",)).session()
    s.script("DELETE FROM events WHERE event_type = 'error'; INSERT INTO events (event_id, event_type, value) VALUES (-1, 'signal', 1), (-2, 'view', 2)")
    base = read_stream(s, "events", images=False).select("event_id", "event_type")
    both = read_stream(s, "events").select("event_id", "event_type").filter("event_id < 0")
    return _drain(fan_in([base, both], F.col("event_type"), ["c*", "sign[au]?*"]), "append")


QUERIES["stream_fan_in"] = _fanned
ORACLES["stream_fan_in"] = "SELECT event_id, event_type FROM events WHERE event_type LIKE 'c%' OR event_type LIKE 'signa%' OR event_type LIKE 'signu%' UNION ALL SELECT -1, 'signal'"


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of document writes; of several of one path the last by number counts."""
    root = f"{shared_folder(spark)}/writes-{uuid.uuid4().hex}"
    e = _events(spark, sf_dir)
    path = F.concat(F.lit("w/"), F.col("user_id").cast("string"))
    writes = e.select(F.when(F.col("event_type") == "error", "delete").otherwise("set").alias("op"), path.alias("path"), F.to_json(F.struct(F.col("event_id").alias("last"))).alias("fields"), F.col("event_id").alias("seq"))
    writes.repartition(3).write.parquet(f"{root}/in")
    d = store_of(spark, sf_dir)
    d.apply_stream(d.session.spark.readStream.schema(writes.schema).parquet(f"{root}/in"), f"{root}/state").awaitTermination()
    return d.query("w").select("path", documents.Value("last").number.cast("long").alias("last"))


QUERIES["doc_stream_writes"] = _applied
ORACLES["doc_stream_writes"] = "SELECT 'w/' || user_id AS path, max(event_id) AS last FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'"
