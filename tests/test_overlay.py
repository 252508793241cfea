"""The overlay on small tables: writes, schema changes, transactions, references, surfaces, persistence."""

import datetime
import hashlib
import json
import pathlib
import random
import uuid
from fractions import Fraction

import pytest

from palimpsest import errors, tools
from palimpsest.operators import documents, kv
from palimpsest.registry import Registry
from palimpsest.session import Database
from palimpsest.state import ForeignKey, deserialize_key, serialize_key

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def db(spark):
    d = Database(spark)
    d.register("nation", f"{DATA}/nation.parquet", pk=["n_nationkey"], fks=[ForeignKey(("n_regionkey",), "region", ("r_regionkey",), "CASCADE")])
    d.register("region", f"{DATA}/region.parquet", pk=["r_regionkey"])
    d.register("lineitem", f"{DATA}/lineitem.parquet")
    return d


def rows(s, sql):
    return sorted(tuple(r) for r in s.sql(sql).collect())


def test_random_writes_match_a_plain_model(spark):
    """Inserts, updates, deletes, upserts, key moves, truncation and savepoints against a dict."""
    rng = random.Random(12)
    for _ in range(2):
        base = {i: (f"v{i % 3}", i) for i in range(12)}
        d = Database(spark)
        d.register("t", frame=spark.createDataFrame([(k, *v) for k, v in base.items()], "id int, a string, b int"), pk=["id"])
        s, model, marks = d.session(), dict(base), []
        s.sql("BEGIN")
        for step in range(14):
            what = rng.choice(["insert", "update", "update", "delete", "upsert", "move", "save", "back", "ignore"])
            k, n = rng.randrange(20), rng.randrange(100)
            if what == "insert":
                try:
                    s.sql(f"INSERT INTO t VALUES ({k}, 'i{n}', {n})")
                    assert k not in model
                    model[k] = (f"i{n}", n)
                except errors.UniqueViolation:
                    assert k in model
                    s.failed = False
            elif what == "update":
                s.sql(f"UPDATE t SET b = b + {n}, a = 'u' WHERE id % 3 = {k % 3} AND b < 60")
                model = {i: ("u", b + n) if i % 3 == k % 3 and b < 60 else (a, b) for i, (a, b) in model.items()}
            elif what == "delete":
                s.sql(f"DELETE FROM t WHERE id = {k} OR b > 150")
                model = {i: v for i, v in model.items() if not (i == k or v[1] > 150)}
            elif what == "upsert":
                s.sql(f"INSERT INTO t VALUES ({k}, 'x', {n}) ON CONFLICT (id) DO UPDATE SET b = t.b + EXCLUDED.b")
                model[k] = (model[k][0], model[k][1] + n) if k in model else ("x", n)
            elif what == "ignore":
                s.sql(f"INSERT OR IGNORE INTO t VALUES ({k}, 'g', {n})")
                model.setdefault(k, ("g", n))
            elif what == "move":
                s.sql(f"UPDATE t SET id = id + {100 + 20 * step} WHERE id = {k}")
                if k in model:
                    model[k + 100 + 20 * step] = model.pop(k)
            elif what == "save":
                s.sql(f"SAVEPOINT p{step}")
                marks.append((f"p{step}", dict(model)))
            elif marks:
                name, model = marks[-1][0], dict(marks[-1][1])
                s.sql(f"ROLLBACK TO {name}")
            if step % 4 == 3:
                assert rows(s, "SELECT id, a, b FROM t") == sorted((k, *v) for k, v in model.items())
        s.sql("COMMIT")
        assert rows(d.session(), "SELECT id, a, b FROM t") == sorted((k, *v) for k, v in model.items())


def test_base_files_never_change(db):
    def mark():
        return {p: hashlib.sha256(pathlib.Path(f"{DATA}/{p}.parquet").read_bytes()).hexdigest() for p in ("nation", "lineitem")}

    before, s = mark(), db.session()
    s.script("UPDATE nation SET n_name = 'x'; DELETE FROM lineitem WHERE l_orderkey < 100; TRUNCATE nation; DROP TABLE lineitem")
    assert mark() == before
    with pytest.raises(errors.WriteGuard):
        db.catalog.guard_path(f"{DATA}/nation.parquet/x")
    with pytest.raises(errors.UnknownTable):
        s.sql("SELECT * FROM lineitem")


def test_merged_plan_broadcasts_keys_and_pushes_filters(db):
    s = db.session()
    s.sql("UPDATE nation SET n_name = 'x' WHERE n_nationkey = 3")
    plan = s.sql("SELECT n_name FROM nation WHERE n_regionkey = 1")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and plan.count("PushedFilters: [IsNotNull(n_regionkey), EqualTo(n_regionkey,1)]") >= 1


def test_rows_without_a_key_are_a_multiset(spark):
    folder = f"/tmp/palimpsest-test-{uuid.uuid4().hex}"
    spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "k string, v int").write.parquet(folder)
    d = Database(spark)
    d.register("t", folder)
    s = d.session()
    s.sql("INSERT INTO t VALUES ('a', 1), ('c', 5)")
    assert rows(s, "SELECT k, count(*) FROM t GROUP BY k") == [("a", 3), ("b", 1), ("c", 1)]
    assert s.execute("UPDATE t SET v = 9 WHERE k = 'a'") == 3 and s.execute("DELETE FROM t WHERE v IS NULL OR k = 'c'") == 2
    assert rows(s, "SELECT k, v FROM t") == [("a", 9)] * 3


def test_transactions_are_isolated_and_conflicts_are_found(db):
    a, b = db.session(), db.session()
    a.sql("BEGIN")
    a.sql("DELETE FROM nation WHERE n_nationkey = 1")
    assert rows(a, "SELECT count(*) FROM nation") == [(24,)] and rows(b, "SELECT count(*) FROM nation") == [(25,)]
    b.sql("UPDATE region SET r_name = 'z' WHERE r_regionkey = 0")  # another table
    a.sql("COMMIT")
    assert rows(b, "SELECT count(*) FROM nation") == [(24,)] and rows(a, "SELECT r_name FROM region WHERE r_regionkey = 0") == [("z",)]
    a.sql("BEGIN")
    a.sql("DELETE FROM nation WHERE n_nationkey = 2")
    b.sql("DELETE FROM nation WHERE n_nationkey = 3")
    with pytest.raises(errors.Conflict):
        a.sql("COMMIT")
    assert rows(a, "SELECT count(*) FROM nation") == [(23,)]


def test_failed_transactions_must_be_rolled_back(db):
    s = db.session()
    s.sql("BEGIN")
    s.sql("DELETE FROM nation WHERE n_nationkey = 1")
    with pytest.raises(errors.UniqueViolation):
        s.sql("INSERT INTO nation VALUES (2, 'x', 1)")
    with pytest.raises(errors.TransactionState):
        s.sql("SELECT 1")
    s.sql("ROLLBACK")
    assert rows(s, "SELECT count(*) FROM nation") == [(25,)]
    for sql in ("COMMIT", "SAVEPOINT a", "ROLLBACK"):
        with pytest.raises(errors.TransactionState):
            s.sql(sql)


def test_references(db):
    s = db.session()
    with pytest.raises(errors.ForeignKeyViolation):
        s.sql("INSERT INTO nation VALUES (50, 'x', 77)")
    s.sql("INSERT INTO nation VALUES (50, 'x', NULL)")
    with pytest.raises(errors.ForeignKeyViolation):
        s.sql("UPDATE nation SET n_regionkey = 99 WHERE n_nationkey = 1")
    assert s.execute("DELETE FROM region WHERE r_regionkey = 2") == 1
    assert rows(s, "SELECT count(*) FROM nation WHERE n_regionkey = 2") == [(0,)]
    s.sql("INSERT INTO region VALUES (2, 'back')")
    s.sql("INSERT INTO nation VALUES (60, 'y', 2)")  # a key that was deleted and put back
    with pytest.raises(errors.ForeignKeyViolation):
        s.sql("UPDATE region SET r_regionkey = 44 WHERE r_regionkey = 1")


def test_reference_actions(spark):
    for action, want in (("SET NULL", [(1, None), (2, 20)]), ("SET DEFAULT", [(1, 20), (2, 20)])):
        d = Database(spark)
        d.register("p", frame=spark.createDataFrame([(10,), (20,)], "id int"), pk=["id"])
        d.register("c", frame=spark.createDataFrame([(1, 10), (2, 20)], "id int, p int"), pk=["id"], defaults={"p": "20"}, fks=[ForeignKey(("p",), "p", ("id",), action)])
        s = d.session()
        s.sql("DELETE FROM p WHERE id = 10")
        assert [tuple(r) for r in s.sql("SELECT id, p FROM c ORDER BY id").collect()] == want


def test_schema_changes_on_changed_rows(db):
    s = db.session()
    s.script("UPDATE nation SET n_name = 'mine' WHERE n_nationkey = 0; ALTER TABLE nation ADD COLUMN size INT DEFAULT 7, RENAME COLUMN n_name TO label; INSERT INTO nation (n_nationkey, label) VALUES (90, 'new')")
    s.sql("ALTER TABLE nation ALTER COLUMN size TYPE BIGINT")
    assert rows(s, "SELECT label, size FROM nation WHERE n_nationkey IN (0, 90)") == [("mine", 7), ("new", 7)]
    assert dict(s.sql("SELECT * FROM nation").dtypes)["size"] == "bigint"
    s.sql("ALTER TABLE nation DROP COLUMN size")
    with pytest.raises(errors.NotSupported):
        s.sql("ALTER TABLE nation DROP COLUMN n_nationkey")
    with pytest.raises(errors.UnknownColumn):
        s.sql("UPDATE nation SET size = 1")
    s.sql("CREATE TABLE made (id SERIAL PRIMARY KEY, r INT REFERENCES region(r_regionkey) ON DELETE CASCADE, note VARCHAR(10) DEFAULT 'n')")
    assert rows(s, "INSERT INTO made (r) VALUES (1), (2) RETURNING id, note") == [(1, "n"), (2, "n")]
    s.sql("DELETE FROM region WHERE r_regionkey = 1")
    assert rows(s, "SELECT id FROM made") == [(2,)]
    s.script("RENAME TABLE made TO kept; DROP TABLE IF EXISTS made")
    with pytest.raises(errors.UnknownTable):
        s.sql("SELECT * FROM made")
    assert rows(s, "SELECT count(*) FROM kept") == [(1,)]


def test_parameters_prepared_statements_and_cursors(db):
    s = db.session()
    assert s.execute("UPDATE nation SET n_name = $1 WHERE n_nationkey = $2", ["it's", 3]) == 1
    assert rows(s, "SELECT n_name FROM nation WHERE n_nationkey = 3") == [("it's",)]
    s.sql("PREPARE d AS DELETE FROM nation WHERE n_nationkey = $1")
    s.sql("EXECUTE d(4)")
    s.sql("DECLARE c CURSOR FOR SELECT n_nationkey FROM nation ORDER BY n_nationkey")
    s.sql("DELETE FROM nation")  # the cursor keeps what it saw
    assert [r[0] for r in s.sql("FETCH 5 FROM c").collect()] == [0, 1, 2, 3, 5]
    s.sql("CLOSE c")
    with pytest.raises(errors.UnknownTable):
        s.sql("FETCH 1 FROM c")
    s.sql("SET a.b = 'x'")
    assert s.sql("SHOW a.b").first()[0] == "x"
    assert s.json_rows("SELECT 1 AS one") == ['{"one":1}']


def test_save_load_reset_status_and_log(spark, db):
    s = db.session()
    s.script("DELETE FROM nation WHERE n_nationkey < 3; UPDATE nation SET n_name = 'u' WHERE n_nationkey = 5; ALTER TABLE region ADD COLUMN x INT")
    status = {r["table"]: r for r in db.status().collect()}
    assert (status["nation"]["images"], status["nation"]["tombstones"], status["region"]["schema_changed"]) == (1, 3, True)
    assert sorted(tuple(r) for r in db.inspect("nation").collect()) == [("0", "deleted"), ("1", "deleted"), ("2", "deleted"), ("5", "changed")]
    path = db.save()
    other = Database(spark)
    for n, k in (("nation", ["n_nationkey"]), ("region", ["r_regionkey"])):
        other.register(n, f"{DATA}/{n}.parquet", pk=k)
    other.load(path)
    assert rows(other.session(), "SELECT * FROM nation") == rows(s, "SELECT * FROM nation")
    db.reset()
    assert rows(s, "SELECT count(*) FROM nation") == [(25,)] and not any(r["images"] for r in db.status().collect())
    with pytest.raises(errors.NotSupported):
        s.sql("COPY nation TO 'x'")
    log = db.log.frame().collect()
    assert log[-1]["error"].startswith("NotSupported") and {"MERGED_READ", "OVERLAY_DELETE"} <= {r["strategy"] for r in log}
    assert db.log.metrics().count() >= 1


def test_keys_as_text():
    assert serialize_key(["a"], {"a": 5}) == "5"
    text = serialize_key(["a", "b"], {"b": "x", "a": 1})
    assert text == '{"a":1,"b":"x"}' and deserialize_key(["a", "b"], text) == {"a": 1, "b": "x"}


def test_key_value_commands(spark):
    now = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    d = Database(spark)
    blank = [None] * 7
    data = [("user:1", "string", bytearray(b"Alice"), *blank[:6]), ("z", "zset", None, None, None, None, [(1.0, "a"), (2.0, "b"), (3.0, "c")], None, None), ("l", "list", None, None, ["1", "2", "3"], None, None, None, None)]
    d.register("kv", frame=spark.createDataFrame(data, kv.SCHEMA), pk=["key"])
    s = kv.KeyValue(d.session(), now=lambda: now)
    for command, want in (
        (("GET", "user:1"), "Alice"), (("GET", "none"), None), (("APPEND", "user:1", "é"), 7), (("INCRBY", "n", 5), 5), (("HSET", "h", "a", 1, "b", 2), 2), (("HGETALL", "h"), {"a": "1", "b": "2"}), (("HDEL", "h", "a", "b"), 2),
        (("TYPE", "h"), "none"), (("LRANGE", "l", -2, -1), ["2", "3"]), (("LREM", "l", -1, "3"), 1), (("ZINCRBY", "z", 5, "a"), 6.0), (("ZRANGE", "z", 0, -1), ["b", "c", "a"]), (("ZRANGEBYSCORE", "z", "(2", "+inf", "WITHSCORES"), ["c", "3", "a", "6"]),
        (("SETEX", "t", 10, "v"), "OK"), (("TTL", "t"), 10), (("EXPIRE", "t", -1), 1), (("EXISTS", "t"), 0), (("SADD", "s1", "a", "b"), 2), (("SADD", "s2", "b"), 1), (("SINTER", "s1", "s2"), ["b"]), (("SDIFFSTORE", "s3", "s1", "s2"), 1),
        (("DEL", "user:1", "none"), 1), (("SET", "user:1", "x"), "OK"), (("GET", "user:1"), "x"), (("KEYS", "s?"), ["s1", "s2", "s3"]), (("SETBIT", "b", 9, 1), 0), (("BITCOUNT", "b"), 1),
    ):
        assert s.execute(*command) == want, command
    with pytest.raises(kv.WrongType):
        s.execute("LPUSH", "z", "x")
    for bad in ("PUBLISH", "EVAL", "SHUTDOWN"):
        with pytest.raises(errors.NotSupported):
            s.execute(bad, "x")
    s.execute("WATCH", "n")
    kv.KeyValue(d.session(), now=lambda: now).execute("INCR", "n")
    s.execute("MULTI")
    s.execute("SET", "n", "0")
    assert s.execute("EXEC") is None and s.execute("GET", "n") == "6"
    assert s.execute("FLUSHALL") == "OK" and s.execute("DBSIZE") == 0


def test_stream_groups(spark):
    clock = [datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)]
    d = Database(spark)
    d.register("kv", frame=spark.createDataFrame([], kv.SCHEMA), pk=["key"])
    s = kv.KeyValue(d.session(), now=lambda: clock[0])
    for i in (1, 2, 3):
        s.execute("XADD", "x", f"{i}-0", "n", i)
    assert s.execute("XGROUP", "CREATE", "x", "g", "0") == "OK"
    assert [e["id"] for e in s.execute("XREADGROUP", "GROUP", "g", "a", "COUNT", 2, "STREAMS", "x", ">")["x"]] == ["1-0", "2-0"]
    s.execute("XADD", "x", "4-0", "n", 4)
    assert s.execute("XACK", "x", "g", "1-0", "9-9") == 1 and s.execute("XPENDING", "x", "g") == [1, "2-0", "2-0", {"a": 1}]
    clock[0] += datetime.timedelta(seconds=5)
    assert [e["id"] for e in s.execute("XCLAIM", "x", "g", "b", 1000, "2-0")] == ["2-0"] and s.execute("XAUTOCLAIM", "x", "g", "c", 1000)[1] == []
    assert [e["id"] for e in s.execute("XREADGROUP", "GROUP", "g", "b", "STREAMS", "x", ">")["x"]] == ["3-0", "4-0"]
    assert s.execute("XINFO", "GROUPS", "x") == [{"name": "g", "consumers": 2, "pending": 3, "last": "4-0"}]
    assert s.execute("XLEN", "x") == 4 and s.execute("XTRIM", "x", "MAXLEN", 1) == 3 and s.execute("XREADGROUP", "GROUP", "g", "b", "STREAMS", "x", ">") == {}
    assert s.execute("RPUSH", "l", "3", "1", "2") == 3 and s.execute("SORT", "l", "STORE", "m") == 3 and s.execute("LRANGE", "m", 0, -1) == ["1", "2", "3"]
    assert s.execute("OBJECT", "ENCODING", "l") == "quicklist"


def test_document_requests(spark):
    at = datetime.datetime(2024, 1, 1)
    values = {"a": {"v": "s"}, "b": {"v": 3}, "c": {"v": None}, "d": {}, "e": {"v": 2.5}, "f": {"v": [1, "x"]}, "g": {"v": True}, "h": {"v": at}, "i": {"v": float("nan")}}
    d = Database(spark)
    d.register("docs", frame=spark.createDataFrame([(f"m/{k}", "m", k, documents.encode(v), at, at) for k, v in values.items()], documents.SCHEMA), pk=["path"])
    s = documents.Documents(d.session(), now=lambda: at)
    ids = lambda df: "".join(r["doc_id"] for r in df.collect())
    assert ids(s.query("m", None, [("v", "asc")]))[:4] == "cgeb" and ids(s.query("m", None, [("v", "desc")]))[0] == "f"
    assert ids(s.query("m", ("v", "IS_NULL"), [("__name__", "asc")])) == "cd" and ids(s.query("m", ("v", "IS_NAN"))) == "i"
    assert ids(s.query("m", ("v", "ARRAY_CONTAINS", "x"))) == "f" and ids(s.query("m", ("v", "<", 3))) == "e"
    assert s.aggregate("m", [("COUNT", None, None), ("SUM", "w", "s")]).first().asDict() == {"field_1": 9, "s": 0.0}
    with pytest.raises(errors.PreconditionFailed):
        s.commit([{"update": "m/z", "fields": {"v": 1}}, {"delete": "m/none", "exists": True}])
    with pytest.raises(errors.NotFound):
        s.get("m/z")
    s.commit([{"update": "m/z", "fields": {"v": 1, "w": {"x": 1}}}, {"update": "m/a", "fields": {"w": 5}, "mask": ["w"]}, {"delete": "m/b"}])
    assert s.get("m/a") == {"v": "s", "w": 5} and s.batch_get(["m/b", "m/z"]) == [("m/b", None), ("m/z", {"v": 1, "w": {"x": 1}})]
    s.create("m", "b", {})
    assert s.get("m/b") == {} and s.list("m", 3)[1] == "m/d"


@pytest.mark.parametrize("format", ["csv", "json", "orc"])
def test_other_file_formats(spark, format):
    folder = f"/tmp/palimpsest-test-{uuid.uuid4().hex}"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string").write.format(format).option("header", True).save(folder)
    d = Database(spark)
    d.register("t", folder, format=format, pk=["id"], header="true", inferSchema="true")
    s = d.session()
    s.script("UPDATE t SET v = 'x' WHERE id = 2; DELETE FROM t WHERE id = 1")
    assert sorted((r["id"], r["v"]) for r in s.sql("SELECT id, v FROM t").collect()) == [(2, "x"), (3, None)]
    keyless = Database(spark)
    keyless.register("t", folder, format=format, header="true", inferSchema="true")
    with pytest.raises(errors.NotSupported):
        keyless.session().sql("DELETE FROM t")


def test_registry_keeps_named_databases(spark):
    r = Registry(spark, f"/tmp/palimpsest-test-{uuid.uuid4().hex}")
    db = r.create("one", {"nation": {"path": f"{DATA}/nation.parquet", "pk": ["n_nationkey"]}})
    db.session().sql("DELETE FROM nation WHERE n_nationkey < 5")
    r.save("one")
    db.session().sql("DELETE FROM nation")
    again = r.reopen("one").session()
    assert rows(again, "SELECT count(*) FROM nation") == [(20,)] and r.list().first()["name"] == "one"
    r.reset("one")
    assert rows(r.open("one").session(), "SELECT count(*) FROM nation") == [(25,)]
    with pytest.raises(errors.OverlayError):
        r.create("one", {})
    r.drop("one")
    with pytest.raises(errors.UnknownTable):
        r.open("one")


def test_tools_speak_json(spark, db):
    s = db.session()
    assert json.loads(tools.db_query(s, "SELECT 1 AS a")) == {"columns": ["a"], "rows": [{"a": 1}]}
    assert json.loads(tools.db_query(s, "DELETE FROM nation WHERE n_nationkey = 1"))["rows"] == [{"affected": 1}]
    assert json.loads(tools.db_query(s, "INSERT INTO nation VALUES (2, 'x', 1)"))["sqlstate"] == "23505"
    d = Database(spark)
    d.register("kv", frame=spark.createDataFrame([], kv.SCHEMA), pk=["key"])
    k = kv.KeyValue(d.session())
    assert tools.kv_command(k, "HSET h 'a b' 1") == "1" and tools.kv_hgetall(k, "h") == '{"a b": "1"}' and tools.kv_keys(k) == '["h"]'
    d.register("docs", frame=spark.createDataFrame([], documents.SCHEMA), pk=["path"])
    docs = documents.Documents(d.session())
    docs.create("c", "x", {"n": 1})
    assert tools.doc_get(docs, "c/x") == '{"n":1}' and tools.doc_get(docs, "c/none") == "null"
    assert json.loads(tools.doc_query(docs, "c", ["n", "=", 1])) == json.loads(tools.doc_list(docs, "c"))["documents"]


def test_other_dialects_of_change(db):
    s = db.session()
    s.script("EXEC sp_rename 'nation.n_name', 'label', 'COLUMN'; EXEC sp_rename 'region', 'area'; ALTER TABLE area CHANGE COLUMN r_name title VARCHAR(20)")
    assert rows(s, "SELECT label FROM nation ORDER BY n_nationkey LIMIT 2, 1") == rows(s, "SELECT label FROM nation WHERE n_nationkey = 2")
    assert s.sql("SELECT * FROM area").columns == ["r_regionkey", "title"]
    out = s.sql("UPDATE nation SET label = 'q' OUTPUT inserted.n_nationkey WHERE n_nationkey = 3")
    assert [tuple(r) for r in out.collect()] == [(3,)]
    assert [tuple(r) for r in s.sql("DELETE FROM nation OUTPUT deleted.label WHERE n_nationkey = 3").collect()] == [("q",)]


def test_null_keys_and_compaction(spark):
    d = Database(spark)
    d.register("t", frame=spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "id int, v string"), pk=["id"])
    s = d.session()
    for sql in ("UPDATE t SET v = 'x' WHERE v = 'b'", "DELETE FROM t WHERE id = 1", "UPDATE t SET v = 'y' WHERE id = 3", "INSERT INTO t VALUES (4, 'd')", "DELETE FROM t WHERE id = 4", "UPDATE t SET v = 'z' WHERE id = 3"):
        s.sql(sql)
    want = [(None, "x"), (3, "z")]
    assert [tuple(r) for r in s.sql("SELECT id, v FROM t ORDER BY id").collect()] == want
    d.compact()
    assert len(d.version.get("t").segments) == 1
    assert [tuple(r) for r in s.sql("SELECT id, v FROM t ORDER BY id").collect()] == want


def test_document_order_makes_keys_once_for_a_row(spark):
    """Sort keys are columns: the sort itself compares attributes, and the result has the table's columns alone."""
    d = Database(spark)
    fields = ('{"a":1,"b":"x"}', '{"a":2}', '{"a":2,"b":null}', '{"a":"t","b":[1]}', '{"b":3}', '{"a":2,"b":"w"}')
    d.register("docs", frame=spark.createDataFrame([(f"c/{i}", "c", str(i), f, None, None) for i, f in enumerate(fields)], documents.SCHEMA), pk=["path"])
    docs = documents.Documents(d.session())
    found = docs.query("c", None, [("a", "desc"), ("b", "asc")], 3, 1)
    assert found.columns == documents.SCHEMA.names and [r["doc_id"] for r in found.collect()] == ["2", "5", "0"]
    assert [r["doc_id"] for r in docs.query("c", None, [("a", "desc")]).collect()] == ["3", "5", "2", "1", "0"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    (sort,) = [line for line in plan.splitlines() if "Sort [" in line]
    assert "variant" not in sort and "CASE" not in sort


def test_top_percent_is_not_one_task(spark):
    d = Database(spark)
    d.register("t", frame=spark.range(0, 1001, 1, 8).selectExpr("id", "(id * 7919) % 1009 AS p", "CAST(id % 3 AS STRING) AS g"), pk=["id"])
    s = d.session()
    order = sorted(((i * 7919 % 1009, i) for i in range(1001)), reverse=True)
    for n in ("10", "(0.05)", "33.3", "100", "0"):
        found = s.sql(f"WITH u AS (SELECT * FROM t) SELECT TOP {n} PERCENT id, id AS id, p + 1 AS q FROM u ORDER BY p DESC")
        want = [(i, i, p + 1) for p, i in order[: -(-int(Fraction(n.strip("()")) * 1001 * 1000) // 100000)]]
        assert found.columns == ["id", "id", "q"] and [tuple(r) for r in found.collect()] == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SinglePartition" not in plan
    # Equal rows are counted one by one; a table without rows gives none; nested and typeless columns go the other way.
    assert [r[0] for r in s.sql("SELECT TOP 50 PERCENT g FROM t ORDER BY g").collect()] == ["0"] * 334 + ["1"] * 167
    assert s.sql("SELECT TOP 50 PERCENT id FROM t WHERE id < 0 ORDER BY id").collect() == []
    assert s.sql("SELECT count(*) FROM (SELECT TOP 50 PERCENT id FROM t ORDER BY id) x").first()[0] == 501
    assert s.sql("SELECT TOP 1 PERCENT id, NULL AS n FROM t ORDER BY id").count() == 11


def test_slices_of_ordered_aggregates_collect_no_group(spark):
    d = Database(spark)
    d.register("t", frame=spark.range(0, 600, 1, 8).selectExpr("id", "IF(id % 4 = 3, NULL, id % 4) AS g", "IF(id % 11 = 0, NULL, (id * 7919) % 101) AS p"), pk=["id"])
    s = d.session()
    rows = [(i, None if i % 4 == 3 else i % 4, None if i % 11 == 0 else i * 7919 % 101) for i in range(600)]
    want = set()
    for g in (0, 1, 2, None):
        mine = [r for r in rows if r[1] == g]
        down = [r[0] for r in sorted((r for r in mine if r[0] > 60 and g != 2), key=lambda r: (r[2] is not None, -(r[2] or 0), r[0]))]
        want.add((g, len(mine), tuple(down[1:5]) if g != 2 else None, ",".join(str(r[2]) for r in sorted((r for r in mine if r[2] is not None), key=lambda r: r[2])[:3])))
    q = "SELECT g, count(*) AS n, slice(array_agg(id ORDER BY p DESC, id) FILTER (WHERE id > 60 AND g <> 2 OR g IS NULL AND id > 60), 2, 4) AS a, array_join(slice(list(p), 1, 3), ',') AS b FROM t GROUP BY g"
    found = s.sql(q)
    assert {(r[0], r[1], tuple(r[2]) if r[2] else None, r[3]) for r in found.collect()} == want
    # Each task keeps the first rows of a group before they meet.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("WindowGroupLimit") == 2
    # Other forms stay as they are.
    assert s.sql("SELECT slice(array_agg(id ORDER BY id), 1, 2) AS a FROM t").first()[0] == [0, 1]
    assert [tuple(r) for r in s.sql("SELECT g, size(array_agg(id ORDER BY id)) AS a FROM t GROUP BY g ORDER BY g").collect()] == [(None, 150), (0, 150), (1, 150), (2, 150)]
