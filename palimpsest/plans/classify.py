"""What a statement is and which tables and features it uses."""

from __future__ import annotations

import enum
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from ..errors import NotSupported, SyntaxProblem
from .text import Cursor, Token, name_of, statements, tokens


class Op(enum.Enum):
    READ = "READ"
    WRITE = "WRITE"
    DDL = "DDL"
    TRANSACTION = "TRANSACTION"
    OTHER = "OTHER"


class Sub(enum.Enum):
    SELECT = "SELECT"
    INSERT = "INSERT"
    UPDATE = "UPDATE"
    DELETE = "DELETE"
    TRUNCATE = "TRUNCATE"
    MERGE = "MERGE"
    CREATE = "CREATE"
    ALTER = "ALTER"
    DROP = "DROP"
    BEGIN = "BEGIN"
    COMMIT = "COMMIT"
    ROLLBACK = "ROLLBACK"
    SAVEPOINT = "SAVEPOINT"
    RELEASE = "RELEASE"
    SET = "SET"
    SHOW = "SHOW"
    EXPLAIN = "EXPLAIN"
    CURSOR = "CURSOR"
    PREPARE = "PREPARE"
    EXECUTE = "EXECUTE"
    DEALLOCATE = "DEALLOCATE"
    LISTEN = "LISTEN"
    NOTIFY = "NOTIFY"
    NOT_SUPPORTED = "NOT_SUPPORTED"
    OTHER = "OTHER"


#: Aggregates that can be summed up again, and those that need all rows of a group; fixed values.
SIMPLE_AGGREGATES = frozenset("COUNT SUM AVG MIN MAX BOOL_AND BOOL_OR TOTAL STDEV STDEVP STDDEV STDDEV_SAMP STDDEV_POP VAR VARP VARIANCE VAR_SAMP VAR_POP COUNT_BIG CHECKSUM_AGG GROUPING GROUPING_ID ANY_VALUE".split())
COMPLEX_AGGREGATES = frozenset("ARRAY_AGG STRING_AGG JSON_AGG JSONB_AGG JSON_OBJECT_AGG JSONB_OBJECT_AGG GROUP_CONCAT JSON_ARRAYAGG JSON_OBJECTAGG LIST LISTAGG COLLECT_LIST COLLECT_SET".split())
#: Statements that are refused, with what to say; fixed values.
REFUSED = {
    "NOTIFY": "NOTIFY would reach other clients of the base",
    "COPY": "COPY moves rows past the overlay",
    "LOCK": "LOCK TABLE would lock the base",
    "DO": "DO blocks can't be inspected",
    "CALL": "CALL runs code that can't be inspected",
    "EXEC": "EXEC runs code that can't be inspected",
    "EXPORT": "EXPORT moves rows past the overlay",
    "IMPORT": "IMPORT moves rows past the overlay",
    "ATTACH": "ATTACH opens another database",
    "VACUUM": "VACUUM would change the base",
}


@dataclass(frozen=True)
class Classification:
    op: Op = Op.OTHER
    sub: Sub = Sub.OTHER
    tables: tuple[str, ...] = ()
    target: str | None = None
    is_join: bool = False
    has_aggregate: bool = False
    has_complex_aggregate: bool = False
    has_set_op: bool = False
    has_window: bool = False
    has_cte: bool = False
    has_derived: bool = False
    has_distinct: bool = False
    has_returning: bool = False
    has_on_conflict: bool = False
    is_metadata: bool = False
    is_complex: bool = False
    limit: int | None = None
    offset: int | None = None
    order_by: str = ""
    keys: tuple[tuple[str, str], ...] = ()
    params: tuple = ()
    reason: str = ""
    sql: str = field(default="", compare=False)


_ENDS = frozenset("WHERE GROUP HAVING ORDER LIMIT OFFSET FETCH UNION INTERSECT EXCEPT MINUS WINDOW ON USING SET VALUES RETURNING QUALIFY WHEN SELECT FOR TABLESAMPLE".split())
_JOINS = frozenset("JOIN LEFT RIGHT FULL INNER CROSS NATURAL OUTER APPLY LATERAL STRAIGHT_JOIN".split())


def _sources(ts: list[Token], ctes: set[str]) -> tuple[list[str], bool, bool]:
    """(tables after FROM, JOIN and commas, whether tables are joined, whether a table is derived)."""
    found: list[str] = []
    joined = derived = False
    for i, t in enumerate(ts):
        if t.upper not in ("FROM", "JOIN", "APPLY", "USING", "UPDATE", "INTO", "TABLE") or t.kind != "word":
            continue
        if t.upper == "FROM" and i >= 2 and any(x.upper == "EXTRACT" for x in ts[max(0, i - 4) : i]) and t.depth > 0:
            continue  # EXTRACT(x FROM y)
        if t.upper == "FROM" and i and ts[i - 1].upper == "DISTINCT":
            continue  # IS DISTINCT FROM
        if t.upper in ("JOIN", "APPLY"):
            joined = True
        j, expecting = i + 1, True
        if t.upper == "USING" and j < len(ts) and ts[j].text == "(" and t.depth == ts[j].depth and (j + 1 < len(ts) and ts[j + 1].upper not in ("SELECT", "WITH", "VALUES")):
            continue  # JOIN ... USING (columns)
        while j < len(ts) and ts[j].depth >= t.depth:
            x = ts[j]
            if x.depth > t.depth:
                j += 1
                continue
            if x.text == ")" or (x.kind == "word" and x.upper in _ENDS):
                break
            if x.text == ",":
                if t.upper != "FROM":
                    break
                expecting, joined = True, True
            elif x.kind == "word" and x.upper in _JOINS | {"AS", "ONLY"}:
                joined |= x.upper in _JOINS
                if x.upper == "JOIN":
                    break
            elif expecting:
                if x.text == "(":
                    derived = derived or (j + 1 < len(ts) and ts[j + 1].upper in ("SELECT", "WITH", "VALUES"))
                elif x.kind in ("word", "quoted"):
                    k = j
                    while k + 2 < len(ts) and ts[k + 1].text == ".":
                        k += 2
                    called = k + 1 < len(ts) and ts[k + 1].text == "(" and t.upper not in ("INTO", "TABLE")
                    full = ".".join(name_of(ts[n]) for n in range(j, k + 1, 2)).lower()
                    if not called and full not in ctes and full not in found:
                        found.append(full)
                    j = k
                expecting = False
            j += 1
    return found, joined, derived


def _ctes(ts: list[Token]) -> set[str]:
    names = set()
    if ts and ts[0].upper == "WITH":
        for i, t in enumerate(ts[:-1]):
            if t.depth == 0 and t.kind in ("word", "quoted"):
                j = i + 1
                if ts[j].text == "(":  # column names
                    while j < len(ts) and not (ts[j].text == ")" and ts[j].depth == 0):
                        j += 1
                    j += 1
                if j + 1 < len(ts) and ts[j].upper == "AS" and (ts[j + 1].text == "(" or ts[j + 1].upper in ("MATERIALIZED", "NOT")):
                    names.add(name_of(t).lower())
    return names


def _keys(ts: list[Token], params: Sequence) -> tuple[tuple[str, str], ...]:
    """Literals that columns are compared with by = in WHERE; for reports only."""
    out = []
    seen = False
    for i, t in enumerate(ts):
        seen = seen or t.upper == "WHERE"
        if not seen or t.text != "=" or not 0 < i < len(ts) - 1:
            continue
        for a, b in ((ts[i - 1], ts[i + 1]), (ts[i + 1], ts[i - 1])):
            if a.kind in ("word", "quoted") and b.kind in ("number", "string", "param"):
                value = b.text.strip("'")
                if b.kind == "param" and b.text[1:].isdigit() and int(b.text[1:]) <= len(params):
                    value = str(params[int(b.text[1:]) - 1])
                out.append((name_of(a).lower(), value))
                break
    return tuple(out)


def classify(sql: str, params: Sequence | Mapping = ()) -> Classification:
    """Classify one statement, or a batch that only reads (by its last statement)."""
    parts = statements(sql)
    if not parts:
        raise SyntaxProblem("empty statement")
    if len(parts) > 1:
        found = [classify(p, params) for p in parts]
        if any(c.op in (Op.WRITE, Op.DDL) for c in found):
            return Classification(Op.OTHER, Sub.NOT_SUPPORTED, reason="a batch of statements may not change anything", sql=sql)
        return found[-1]
    return replace(_one(parts[0], params), sql=parts[0])


def _one(sql: str, params: Sequence | Mapping) -> Classification:
    ts = tokens(sql)
    c = Cursor(sql)
    first, second = c.peek(), c.peek(1)
    given = tuple(params) if not isinstance(params, Mapping) else ()
    if first in ("EXEC", "EXECUTE") and second == "SP_RENAME":
        target = c.all[2].text.strip("'").split(".")[-2 if "." in c.all[2].text else -1].strip("[]").lower()
        return Classification(Op.DDL, Sub.ALTER, (target,), target)
    if first in REFUSED:
        return Classification(Op.WRITE if first == "NOTIFY" else Op.OTHER, Sub.NOTIFY if first == "NOTIFY" else Sub.NOT_SUPPORTED, reason=REFUSED[first])
    if first in ("SELECT", "WITH", "VALUES", "TABLE", "(", "FROM"):
        return _select(sql, ts, given)
    returning = any(t.depth == 0 and t.upper in ("RETURNING", "OUTPUT") for t in ts)
    words = {t.upper for t in ts if t.kind == "word"}
    if first in ("INSERT", "REPLACE"):
        tables, _, _ = _sources(ts, set())
        conflict = first == "REPLACE" or "CONFLICT" in words or ("DUPLICATE" in words and "KEY" in words) or second == "OR"
        c.at += 1
        while c.peek() not in ("INTO", "OVERWRITE", "") and c.peek() in ("OR", "REPLACE", "IGNORE"):
            c.at += 1
        c.take("INTO") or c.take("OVERWRITE")
        target = c.name().lower()
        return Classification(Op.WRITE, Sub.INSERT, tuple(dict.fromkeys([target, *tables])), target, has_returning=returning, has_on_conflict=conflict, params=given)
    if first in ("UPDATE", "DELETE", "MERGE", "TRUNCATE"):
        c.at += 1
        c.take("FROM") or c.take("INTO") or c.take("TABLE")
        c.take("ONLY")
        target = c.name().lower()
        tables, joined, _ = _sources(ts, set())
        sub = Sub[first] if first != "MERGE" else Sub.MERGE
        return Classification(Op.WRITE, sub, tuple(dict.fromkeys([target, *tables])), target, is_join=joined or len(tables) > 1, has_returning=returning, keys=_keys(ts, given), params=given)
    if first in ("CREATE", "ALTER", "DROP", "RENAME"):
        kind = c.peek(1)
        c.at += 2
        if kind in ("UNIQUE", "TEMP", "TEMPORARY", "OR"):
            while c.peek() not in ("TABLE", "INDEX", "VIEW", ""):
                c.at += 1
            kind = c.peek()
            c.at += 1
        c.take("IF", "NOT", "EXISTS") or c.take("IF", "EXISTS")
        target = None
        if kind == "TABLE" and not c.done:
            target = c.name().lower()
        elif kind == "INDEX":
            while not c.done and c.peek() != "ON":
                c.at += 1
            if c.take("ON"):
                target = c.name().lower()
        sub = {"CREATE": Sub.CREATE, "DROP": Sub.DROP}.get(first, Sub.ALTER)
        return Classification(Op.DDL, sub, (target,) if target else (), target)
    if first in ("BEGIN", "START"):
        return Classification(Op.TRANSACTION, Sub.BEGIN)
    if first in ("COMMIT", "END"):
        return Classification(Op.TRANSACTION, Sub.COMMIT)
    if first in ("ROLLBACK", "ABORT"):
        return Classification(Op.TRANSACTION, Sub.ROLLBACK)
    if first in ("SAVEPOINT", "SAVE"):
        return Classification(Op.TRANSACTION, Sub.SAVEPOINT)
    if first == "RELEASE":
        return Classification(Op.TRANSACTION, Sub.RELEASE)
    if first == "EXPLAIN":
        if second == "ANALYZE" or (second == "(" and "ANALYZE" in words):
            return Classification(Op.OTHER, Sub.NOT_SUPPORTED, reason="EXPLAIN ANALYZE runs its statement")
        tables, joined, _ = _sources(ts, set())
        return Classification(Op.OTHER, Sub.EXPLAIN, tuple(tables), is_join=joined)
    if first in ("SET", "RESET", "USE"):
        return Classification(Op.OTHER, Sub.SET)
    if first in ("SHOW", "PRAGMA", "DESCRIBE", "DESC"):
        return Classification(Op.OTHER, Sub.SHOW, is_metadata=True)
    if first in ("DECLARE", "FETCH", "CLOSE", "MOVE"):
        tables, joined, _ = _sources(ts, set()) if first == "DECLARE" else ([], False, False)
        return Classification(Op.OTHER, Sub.CURSOR, tuple(tables), is_join=joined)
    simple = {"PREPARE": Sub.PREPARE, "EXECUTE": Sub.EXECUTE, "DEALLOCATE": Sub.DEALLOCATE, "LISTEN": Sub.LISTEN, "UNLISTEN": Sub.LISTEN}
    if first in simple:
        return Classification(Op.OTHER, simple[first])
    raise SyntaxProblem(f"can't tell what {first!r} begins")


def _select(sql: str, ts: list[Token], params: tuple) -> Classification:
    ctes = _ctes(ts)
    if ts[0].upper == "WITH":
        for i, t in enumerate(ts):
            if t.upper in ("INSERT", "UPDATE", "DELETE", "MERGE") and (t.depth == 0 or ts[i - 1].text == "("):
                return Classification(Op.WRITE, Sub.NOT_SUPPORTED, reason="a WITH clause that changes rows")
    tables, joined, derived = _sources(ts, ctes)
    calls = {t.upper for t, n in zip(ts, ts[1:]) if t.kind == "word" and n.text == "("}
    windowed = {i for i, t in enumerate(ts) if t.upper == "OVER"}
    # A call is a plain aggregate unless OVER follows its parentheses.
    plain: set[str] = set()
    for i, t in enumerate(ts[:-1]):
        if t.kind == "word" and ts[i + 1].text == "(" and t.upper in SIMPLE_AGGREGATES | COMPLEX_AGGREGATES:
            j = i + 2
            while j < len(ts) and not (ts[j].text == ")" and ts[j].depth == ts[i + 1].depth):
                j += 1
            if j + 1 >= len(ts) or ts[j + 1].upper not in ("OVER", "FILTER", "WITHIN") or (ts[j + 1].upper != "OVER" and not any(k > j for k in windowed)):
                plain.add(t.upper)
    top = [t for t in ts if t.depth == 0]
    after = lambda word: next((top[i + 1] for i, t in enumerate(top[:-1]) if t.upper == word), None)
    limit, offset = after("LIMIT") or after("TOP"), after("OFFSET")
    if limit is None:
        fetch = [t for i, t in enumerate(top) if i > 1 and top[i - 1].upper in ("NEXT", "FIRST") and top[i - 2].upper == "FETCH"]
        limit = fetch[0] if fetch else None
    order = ""
    for i, t in enumerate(top[:-1]):
        if t.upper == "ORDER" and top[i + 1].upper == "BY":
            stop = next((x.start for x in top[i + 2 :] if x.upper in ("LIMIT", "OFFSET", "FETCH", "FOR")), len(sql))
            order = sql[top[i + 1].end : stop].strip()
    number = lambda t: int(t.text) if t is not None and t.kind == "number" and t.text.isdigit() else None
    window = bool(windowed) or "WINDOW" in {t.upper for t in top}
    return Classification(
        Op.READ, Sub.SELECT, tuple(tables), None,
        is_join=joined,
        has_aggregate=bool(plain) or any(t.upper == "GROUP" for t in top),
        has_complex_aggregate=bool(plain & COMPLEX_AGGREGATES),
        has_set_op=any(t.upper in ("UNION", "INTERSECT", "EXCEPT", "MINUS") for t in top),
        has_window=window, has_cte=bool(ctes), has_derived=derived,
        has_distinct=any(t.upper == "DISTINCT" and ts[i - 1].upper == "SELECT" for i, t in enumerate(ts)),
        is_metadata=any(t.startswith(("information_schema.", "pg_catalog.", "sqlite_")) for t in tables),
        is_complex=bool(ctes) or derived or window or "LATERAL" in {t.upper for t in ts} or "PIVOT" in calls | {t.upper for t in ts},
        limit=number(limit), offset=number(offset), order_by=order, keys=_keys(ts, params), params=params,
    )


def check_supported(c: Classification) -> None:
    if c.sub in (Sub.NOT_SUPPORTED, Sub.NOTIFY):
        raise NotSupported(c.reason or "not supported")
