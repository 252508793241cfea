"""Statement text, classification, routing and dialects; no rows needed."""

import pytest

from palimpsest.errors import NotSupported, SyntaxProblem, WriteGuard
from palimpsest.plans.classify import Classification, Op, Sub, check_supported, classify
from palimpsest.plans.dialect import rewrite
from palimpsest.plans.router import Strategy, route
from palimpsest.plans.text import Cursor, split_top, statements, tokens


def test_statements_ignore_semicolons_in_strings_and_comments():
    assert statements("SELECT ';' -- a;b\n; SELECT 2 /* ; */;") == ["SELECT ';' -- a;b", "SELECT 2 /* ; */"]
    assert split_top("a, f(b, c), 'd,e'") == ["a", "f(b, c)", "'d,e'"]
    with pytest.raises(SyntaxProblem):
        tokens("SELECT (1")


def test_cursor_stops_at_keywords_outside_case_and_parentheses():
    c = Cursor("SET a = CASE WHEN x THEN (SELECT 1 FROM t WHERE y) END WHERE z")
    c.expect("SET")
    assert c.until([["WHERE"]]) == "a = CASE WHEN x THEN (SELECT 1 FROM t WHERE y) END"
    assert c.rest() == "WHERE z"


@pytest.mark.parametrize(
    ("sql", "op", "sub", "tables"),
    [
        ("SELECT * FROM users u JOIN orders AS o ON u.id = o.user_id", Op.READ, Sub.SELECT, ("users", "orders")),
        ("SELECT * FROM a, b LEFT JOIN c USING (x)", Op.READ, Sub.SELECT, ("a", "b", "c")),
        ("SELECT * FROM (SELECT * FROM t) d", Op.READ, Sub.SELECT, ("t",)),
        ("WITH c AS (SELECT * FROM t) SELECT * FROM c JOIN u ON true", Op.READ, Sub.SELECT, ("t", "u")),
        ("SELECT EXTRACT(YEAR FROM ts) FROM t WHERE a IS DISTINCT FROM b", Op.READ, Sub.SELECT, ("t",)),
        ("SELECT a FROM t WHERE x IN (SELECT y FROM s)", Op.READ, Sub.SELECT, ("t", "s")),
        ('SELECT * FROM "Odd Name"', Op.READ, Sub.SELECT, ("odd name",)),
        ("SELECT 1", Op.READ, Sub.SELECT, ()),
        ("INSERT INTO t (a) VALUES (1)", Op.WRITE, Sub.INSERT, ("t",)),
        ("INSERT INTO t SELECT * FROM s", Op.WRITE, Sub.INSERT, ("t", "s")),
        ("REPLACE INTO t VALUES (1)", Op.WRITE, Sub.INSERT, ("t",)),
        ("INSERT OR IGNORE INTO t VALUES (1)", Op.WRITE, Sub.INSERT, ("t",)),
        ("UPDATE t SET a = 1 FROM s WHERE t.i = s.i", Op.WRITE, Sub.UPDATE, ("t", "s")),
        ("DELETE FROM t USING s WHERE t.i = s.i", Op.WRITE, Sub.DELETE, ("t", "s")),
        ("MERGE INTO t USING s ON t.i = s.i WHEN MATCHED THEN DELETE", Op.WRITE, Sub.MERGE, ("t", "s")),
        ("TRUNCATE TABLE t CASCADE", Op.WRITE, Sub.TRUNCATE, ("t",)),
        ("CREATE TABLE IF NOT EXISTS t (a INT)", Op.DDL, Sub.CREATE, ("t",)),
        ("ALTER TABLE t ADD COLUMN b INT", Op.DDL, Sub.ALTER, ("t",)),
        ("DROP TABLE t", Op.DDL, Sub.DROP, ("t",)),
        ("CREATE UNIQUE INDEX i ON t (a)", Op.DDL, Sub.CREATE, ("t",)),
        ("START TRANSACTION", Op.TRANSACTION, Sub.BEGIN, ()),
        ("ROLLBACK TO SAVEPOINT a", Op.TRANSACTION, Sub.ROLLBACK, ()),
        ("SAVE TRAN a", Op.TRANSACTION, Sub.SAVEPOINT, ()),
        ("SET search_path = x", Op.OTHER, Sub.SET, ()),
        ("DECLARE c CURSOR FOR SELECT * FROM t", Op.OTHER, Sub.CURSOR, ("t",)),
        ("EXPLAIN SELECT * FROM t", Op.OTHER, Sub.EXPLAIN, ("t",)),
        ("LISTEN ch", Op.OTHER, Sub.LISTEN, ()),
    ],
)
def test_kind_and_tables(sql, op, sub, tables):
    c = classify(sql)
    assert (c.op, c.sub, c.tables) == (op, sub, tables)


@pytest.mark.parametrize(
    ("sql", "flags"),
    [
        ("SELECT count(*) FROM t", {"has_aggregate"}),
        ("SELECT a, sum(b) FROM t GROUP BY a HAVING sum(b) > 1", {"has_aggregate"}),
        ("SELECT string_agg(a, ',') FROM t", {"has_aggregate", "has_complex_aggregate"}),
        ("SELECT sum(a) OVER (PARTITION BY b) FROM t", {"has_window", "is_complex"}),
        ("SELECT a FROM t UNION ALL SELECT b FROM s", {"has_set_op"}),
        ("WITH c AS (SELECT 1 FROM t) SELECT * FROM c", {"has_cte", "is_complex"}),
        ("SELECT * FROM (SELECT a FROM t) d", {"has_derived", "is_complex"}),
        ("SELECT DISTINCT a FROM t", {"has_distinct"}),
        ("SELECT * FROM a JOIN b ON a.i = b.i", {"is_join"}),
        ("SELECT * FROM information_schema.tables", {"is_metadata"}),
        ("INSERT INTO t VALUES (1) ON CONFLICT (a) DO NOTHING RETURNING a", {"has_on_conflict", "has_returning"}),
        ("SELECT a FROM t", set()),
    ],
)
def test_flags(sql, flags):
    c = classify(sql)
    assert {k for k, v in vars(c).items() if v is True} == flags


def test_limit_order_and_keys():
    c = classify("SELECT * FROM t WHERE id = 5 AND $1 = code ORDER BY a DESC, b LIMIT 10 OFFSET 3", ["x"])
    assert (c.limit, c.offset, c.order_by) == (10, 3, "a DESC, b") and c.keys == (("id", "5"), ("code", "x"))
    assert classify("SELECT TOP 4 a FROM t").limit == 4
    assert classify("SELECT a FROM t ORDER BY a OFFSET 2 ROWS FETCH NEXT 6 ROWS ONLY").limit == 6


@pytest.mark.parametrize("sql", ["NOTIFY x", "COPY t TO 'f'", "LOCK TABLE t", "DO $$ x $$", "CALL p()", "EXEC p", "EXPLAIN ANALYZE SELECT 1", "WITH d AS (DELETE FROM t RETURNING *) SELECT * FROM d", "SELECT 1; DELETE FROM t"])
def test_refused(sql):
    with pytest.raises(NotSupported):
        check_supported(classify(sql))


def test_unknown_text_is_an_error():
    with pytest.raises(SyntaxProblem):
        classify("FROBNICATE t")


def test_routes_depend_on_what_is_affected():
    dirty = {"t"}.__contains__
    assert route(classify("SELECT * FROM s"), dirty) is Strategy.BASE_DIRECT
    assert route(classify("SELECT * FROM t"), dirty) is Strategy.MERGED_READ
    assert route(classify("SELECT * FROM s JOIN t ON true"), dirty) is Strategy.JOIN_MERGED
    assert route(classify("SELECT count(*) FROM s JOIN t ON true"), dirty) is Strategy.MERGED_READ
    assert route(classify("EXPLAIN SELECT * FROM t"), dirty) is Strategy.NOT_SUPPORTED
    assert route(classify("DELETE FROM s"), dirty) is Strategy.OVERLAY_DELETE


def test_guard_stops_a_write_on_its_way_to_the_base(monkeypatch):
    monkeypatch.setattr("palimpsest.plans.router._route", lambda c, a: Strategy.BASE_DIRECT)
    with pytest.raises(WriteGuard):
        route(Classification(Op.WRITE, Sub.UPDATE), lambda t: False)


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT a -> 'b' ->> 'c' FROM t", "SELECT get_json_object(get_json_object(a, '$.b'), '$.c') FROM t"),
        ("SELECT 1 FROM t WHERE x = ANY(tags)", "SELECT 1 FROM t WHERE array_contains(tags, x)"),
        ('SELECT "a""b" FROM t', 'SELECT `a"b` FROM t'),
        ("SELECT * FROM t CROSS APPLY (SELECT 1) x", "SELECT * FROM t CROSS JOIN LATERAL (SELECT 1) x"),
        ("SELECT TOP (3) a FROM t", "SELECT a FROM t LIMIT 3"),
        ("SELECT a FROM t WHERE b = $1", "SELECT a FROM t WHERE b = :p1"),
        ("SELECT transform(a, x -> x + 1) FROM t", "SELECT transform(a, x -> x + 1) FROM t"),
        ("SELECT 'it''s' || 'x'", r"SELECT 'it\u0027s' || 'x'"),
    ],
)
def test_rewrites(sql, want):
    assert rewrite(sql) == want
