"""Databases and sessions: the front door for SQL text and for frames."""

from __future__ import annotations

import json
import math
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import replace
from fractions import Fraction
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .errors import CardinalityViolation, Conflict, NotSupported, OverlayError, SyntaxProblem, TransactionState, UnknownTable
from .log import QueryLog
from . import procedures
from .operators import ddl
from .operators.dml import Writer, require
from .operators.merge import merged, overlay_rows
from .plans.classify import Classification, Op, Sub, check_supported, classify
from .plans.dialect import outer_percent, rewrite
from .plans.router import Strategy, route
from .plans.text import Cursor, split_top, statements, tokens
from .sources.catalog import Catalog
from .sources.store import Store
from .state import DEAD, ForeignKey, TableState, Version


class Database:
    """Base tables, the committed version all sessions see, and the query log."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        # Views of this database are in a Spark session of its own, which all its sessions share.
        self.spark = spark.newSession()
        for k, v in spark.conf.getAll.items():
            if k.startswith("spark.sql.") and self.spark.conf.get(k, None) != v and self.spark.conf.isModifiable(k):
                self.spark.conf.set(k, v)
        spark = self.spark
        self.views: dict[str, TableState] = {}
        self.frames: dict[str, tuple[TableState, DataFrame]] = {}
        self.catalog = Catalog(spark)
        if root is not None:
            self.catalog.guard_path(root)
        self.store = Store(spark, root)
        self.version = Version()
        self.lock = threading.RLock()
        self.log = QueryLog(spark, f"{self.store.root}/log")

    def register(self, name: str, path: str | None = None, **options: Any) -> None:
        """Add a read-only base table (see ``Catalog.register``)."""
        state = self.catalog.register(name, path, **options)
        self.catalog.guard_path(self.store.root)
        with self.lock:
            self.version = self.version.put(state)

    def session(self) -> OverlaySession:
        return OverlaySession(self)

    def publish(self, begun: Version, ours: Version) -> None:
        """Make a version the committed one. Changes that others committed meanwhile are kept if they touch other tables."""
        with self.lock:
            if self.version is not begun:
                mine, theirs = ours.changed_since(begun), self.version.changed_since(begun)
                if mine & theirs:
                    raise Conflict(f"changed by another session: {', '.join(sorted(mine & theirs))}")
                ours = Version({**self.version.tables, **{n: ours.tables[n] for n in mine if n in ours.tables}})
            self.version = ours

    def compact(self, *tables: str) -> None:
        """Make the segments of each table (or of those named) one, in the background of reads: only the committed version is replaced."""
        writer = self.session().writer
        begun = ours = self.version
        for name in tables or list(begun.tables):
            state = begun.get(name)
            if state is not None and len(state.segments) > 1:
                ours = ours.put(writer.compact(state))
        if ours is not begun:
            self.publish(begun, ours)

    def reset(self) -> None:
        """Forget all local rows, deletions and schema changes; base tables are as at first."""
        with self.lock:
            clean = Version()
            for base in self.catalog.bases.values():
                clean = clean.put(self.catalog.register(base.name, base.path, frame=base.frame, format=base.format, pk=base.meta.pk, fks=base.meta.fks, defaults=dict(base.meta.defaults), generated=base.meta.generated, auto_id=base.meta.auto_id, schema=base.schema, **dict(base.options)))
            self.version = clean

    # -- persistence -------------------------------------------------------------------------

    def save(self) -> str:
        """Write a manifest of the committed version beside its segments; returns its path."""
        from .persist import manifest

        path = f"{self.store.root}/manifest-{uuid.uuid4().hex[:12]}"
        self.spark.createDataFrame([(json.dumps(manifest(self.version)),)], "value string").coalesce(1).write.text(path)
        return path

    def load(self, path: str) -> None:
        """Take over a saved version; the same base tables must be registered."""
        from .persist import restore

        text = "".join(r[0] for r in self.spark.read.text(path).collect())
        with self.lock:
            self.version = restore(self.spark, json.loads(text), self.version)

    # -- introspection ------------------------------------------------------------------------

    def status(self, version: Version | None = None) -> DataFrame:
        """A row for each table: rows changed, deleted and inserted here, and whether its schema differs."""
        rows = [
            (s.name, s.base is not None, s.rows - s.tombstones, s.tombstones, s.inserts, s.diff.changed, s.diff.fully_shadowed, s.dropped)
            for s in (version or self.version).tables.values()
        ]
        return self.spark.createDataFrame(rows, "table string, has_base boolean, images long, tombstones long, inserts long, schema_changed boolean, fully_shadowed boolean, dropped boolean")

    def inspect(self, table: str) -> DataFrame:
        """The keys that are overlaid in one table, and how."""
        state = require(self.version, table)
        rows = overlay_rows(state)
        if rows is None:
            return self.spark.createDataFrame([], "key string, state string")
        key = F.col(state.key_columns[0]).cast("string") if len(state.key_columns) == 1 else F.to_json(F.struct(*[F.col(k).alias(n) for k, n in zip(state.key_columns, state.meta.pk or state.key_columns)]))
        return rows.select(key.alias("key"), F.when(F.col(DEAD), "deleted").otherwise("changed").alias("state"))


class OverlaySession:
    """One connection: its own transaction, savepoints, cursors, prepared statements and settings."""

    def __init__(self, db: Database):
        self.db = db
        self.spark = db.spark
        self.begun: Version | None = None
        self.current: Version | None = None
        self.savepoints: list[tuple[str, Version]] = []
        self.failed = False
        self.settings: dict[str, str] = {}
        self.prepared: dict[str, str] = {}
        self.cursors: dict[str, Iterator[Row]] = {}
        self.listening: set[str] = set()
        self._writer: Writer | None = None
        self._alias = ""
        self.handles: dict[int, Any] = {}
        self.affected = 0

    # -- versions and views ---------------------------------------------------------------------

    @property
    def version(self) -> Version:
        return self.current if self.current is not None else self.db.version

    @property
    def in_transaction(self) -> bool:
        return self.current is not None

    @property
    def writer(self) -> Writer:
        if self._writer is None:
            self._writer = Writer(self.spark, self.db.catalog, self.db.store, self._query)
        return self._writer

    def _views_for(self, sql: str, version: Version) -> None:
        """Point the views that a statement names at the version."""
        words = {t.text.strip('"`[]').lower() for t in tokens(sql) if t.kind in ("word", "quoted")}
        held = self.db.views
        for name in words:
            keyed = name.startswith("__k_")
            state = version.tables.get(name.removeprefix("__k_"))
            if state is None:
                if held.pop(name, None) is not None:
                    self.spark.catalog.dropTempView(name)
            elif held.get(name) is not state:
                if state.dropped:
                    self.spark.catalog.dropTempView(name)
                else:
                    merged(self.spark, self.db.catalog, state, keyed).createOrReplaceTempView(name)
                held[name] = state
        if "information_schema" in words or "pg_catalog" in words:
            self._information_schema(version)

    def _query(self, sql: str, version: Version, args: Any = None) -> DataFrame:
        # Names are resolved while the lock is held; the frame that comes back no longer depends on the views.
        with self.db.lock:
            self._views_for(sql, version)
            return self._resolved(sql, version, args)

    def _resolved(self, sql: str, version: Version, args: Any) -> DataFrame:
        for word in {t.text.lower() for t in tokens(sql) if t.kind == "word"}:
            state = version.tables.get(word)
            if state is not None and state.dropped and re.search(rf"\b(?:from|join)\s+{word}\b", sql, re.I):
                raise UnknownTable(f"table {word} does not exist")
        try:
            return self.spark.sql(sql, args=args) if args else self.spark.sql(sql)
        except AnalysisException as e:
            if e.getSqlState() == UnknownTable.sqlstate:
                raise UnknownTable(str(e)) from e
            raise

    def _information_schema(self, version: Version) -> None:
        alive = [s for s in version.tables.values() if not s.dropped]
        tables = [("main", s.name, "BASE TABLE") for s in alive]
        columns = [("main", s.name, n, i + 1, t, s.meta.default_of(n)) for s in alive for i, (n, t, _, _) in enumerate(s.diff.columns)]
        keys = [("main", s.name, c, i + 1, "PRIMARY KEY") for s in alive for i, c in enumerate(s.meta.pk)]
        make = self.spark.createDataFrame
        make(tables, "table_schema string, table_name string, table_type string").createOrReplaceTempView("information_schema_tables")
        make(columns, "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, column_default string").createOrReplaceTempView("information_schema_columns")
        make(keys, "table_schema string, table_name string, column_name string, ordinal_position int, constraint_type string").createOrReplaceTempView("information_schema_key_column_usage")

    def table(self, name: str) -> DataFrame:
        """The merged relation of a table, for the DataFrame API; made once for each state of the table."""
        state = require(self.version, name)
        held = self.db.frames.get(state.name)
        if held is None or held[0] is not state:
            self.db.frames[state.name] = held = (state, merged(self.spark, self.db.catalog, state))
        return held[1]

    # -- statements --------------------------------------------------------------------------------

    def classify(self, sql: str, params: Sequence = ()) -> Classification:
        return classify(sql, params)

    def route(self, sql: str) -> Strategy:
        return route(classify(sql), self._affected)

    def _affected(self, table: str) -> bool:
        state = self.version.tables.get(table.rpartition(".")[2])
        return state is not None and (state.affected or state.dropped)

    def sql(self, text: str, args: Any = None) -> DataFrame:
        """Run one statement. Reads return their rows, writes the rows of RETURNING or one row ``affected``."""
        begin = time.time()
        error, c, strategy = "", None, None
        if (call := re.match(r"\s*EXEC(?:UTE)?\s+(?:sys\s*\.\s*)?sp_(\w+)\b(?!\s*\()", text, re.I)) and call.group(1).lower() in procedures.CALLS:
            return procedures.run(self, call.group(1).lower(), text[call.end() :])
        try:
            c = classify(text, args or ())
            strategy = route(c, self._affected)
            if self.failed and c.sub not in (Sub.ROLLBACK,):
                raise TransactionState("the transaction failed; roll it back first")
            check_supported(c)
            if strategy is Strategy.NOT_SUPPORTED:
                raise NotSupported("EXPLAIN of a table with local changes")
            return self._dispatch(c, args)
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if self.in_transaction and (c is None or c.op is not Op.TRANSACTION):
                self.failed = True
            raise
        finally:
            self.db.log.add(self, text, c, strategy, (time.time() - begin) * 1000, error)

    def execute(self, text: str, args: Any = None) -> int:
        """Run a write and return how many rows it changed."""
        self.affected = 0
        self.sql(text, args)
        return self.affected

    def script(self, text: str) -> None:
        """Run statements one after the other."""
        for s in statements(text):
            self.sql(s)

    def json_rows(self, text: str, limit: int = 1000) -> list[str]:
        """Rows of a read as JSON texts, for tools."""
        if classify(text).op is not Op.READ:
            raise NotSupported("only reads return JSON rows")
        return self.sql(text).limit(limit).toJSON().collect()

    def _dispatch(self, c: Classification, args: Any) -> DataFrame:
        if c.op is Op.READ:
            return self._read(c.sql, args)
        if c.op in (Op.WRITE, Op.DDL):
            return self._write(c, args)
        if c.op is Op.TRANSACTION:
            return self._transaction(c)
        return self._other(c, args)

    def _read(self, sql: str, args: Any = None) -> DataFrame:
        sql = re.sub(r"\b(information_schema|pg_catalog)\s*\.\s*(\w+)", r"\1_\2 /* \1 */", sql, flags=re.I)
        if "nextval" in sql.lower():
            self._start = self.version
            version, sql = self._sequences(self.version, sql)
            if version is not self.version:
                self._save(version)
        percent = outer_percent(sql)
        text = rewrite(percent[0] if percent else sql)
        if "information_schema_" in text.lower():
            self._information_schema(self.version)
        if isinstance(args, list | tuple):
            if "?" in text:
                args = list(args)
            else:
                args = {f"p{i + 1}": v for i, v in enumerate(args)}
        rows = self._query(text, self.version, args)
        if percent and not any(f.dataType.typeName() in ("void", "interval") for f in rows.schema):
            return self._first_share(rows, percent[1])
        return self._query(rewrite(sql), self.version, args) if percent else rows

    def _first_share(self, rows: DataFrame, share: Fraction) -> DataFrame:
        """The first rows of a sorted frame, up to a share of their number. The sorted rows are written once with their partition
        and their place in it; the rows of each partition are counted, and one comparison with the last place does the rest, so
        that no task sees them all."""
        names = [f"c{i}" for i in range(len(rows.columns))]
        held, _, counts = self.db.store.write(rows.toDF(*names).withColumn("__at", F.monotonically_increasing_id()), "sorted")
        left, end = math.ceil(counts["n"] * share), 0
        for part, n in held.groupBy(F.shiftright("__at", 33).alias("part")).count().orderBy("part").collect():
            if left <= 0:
                break
            end = (part << 33) + min(left, n)
            left -= n
        return held.filter(F.col("__at") < end).orderBy("__at").select(names).toDF(*rows.columns)

    def _one(self, value: Any, name: str, kind: str) -> DataFrame:
        return self.spark.createDataFrame([(value,)], f"{name} {kind}")

    def _save(self, version: Version) -> None:
        if self.current is not None:
            self.current = version
        else:
            self.db.publish(self._start, version)

    def _write(self, c: Classification, args: Any) -> DataFrame:
        self._start = version = self.version
        sql = self._bind(c.sql, args)
        if c.op is Op.DDL:
            after = self._ddl(version, sql)
            self._validate(version, after)
            self._save(after)
            return self._one(0, "affected", "long")
        version, sql = self._sequences(version, sql)
        self._alias = ""
        handler = {Sub.INSERT: self._insert, Sub.UPDATE: self._update, Sub.DELETE: self._delete, Sub.TRUNCATE: self._truncate, Sub.MERGE: self._merge}[c.sub]
        version, rows, n, returning, state = handler(version, sql)
        self._save(version)
        self.affected = n
        if not returning:
            return self._one(n, "affected", "long")
        name = f"__ret_{uuid.uuid4().hex[:8]}"
        rows.select(*[f"`{x}`" for x in state.diff.names]).createOrReplaceTempView(name)
        return self.spark.sql(f"SELECT {rewrite(returning)} FROM {name} AS {self._alias or state.name}")

    def _validate(self, before: Version, after: Version) -> None:
        """Rows there already must fit constraints that a schema change adds."""
        for name in after.changed_since(before):
            old, new = before.get(name), after.get(name)
            if old is None or new is None:
                continue
            added = {k: tuple(x for x in getattr(new.meta, k) if x not in getattr(old.meta, k)) for k in ("not_null", "uniques", "checks")}
            if any(added.values()) and not new.diff.renamed[len(old.diff.renamed) :]:
                only = replace(new, meta=replace(new.meta, fks=(), **added))
                self.writer.check(after, only, merged(self.spark, self.db.catalog, new))

    def _sequences(self, version: Version, sql: str) -> tuple[Version, str]:
        """nextval('table_column_seq') as the next numbers of that table's key, from left to right."""
        out, at = [], 0
        for m in re.finditer(r"\bnextval\s*\(\s*'([\w.\"]+)'(?:\s*::\s*regclass)?\s*\)", sql, re.I):
            name = m.group(1).rpartition(".")[2].strip('"').lower()
            state = next((s for s in version.tables.values() if not s.dropped and s.meta.pk and name in (f"{s.name}_{s.meta.pk[0]}_seq".lower(), f"{s.name}_seq".lower())), None)
            if state is None:
                raise UnknownTable(f"sequence {name} does not exist")
            state = self.writer.with_next_id(state)
            out += [sql[at : m.start()], str(state.next_id)]
            at = m.end()
            version = version.put(replace(state, next_id=state.next_id + 1))
        return version, "".join(out) + sql[at:]

    def _bind(self, sql: str, args: Any) -> str:
        """Parameters of a write as literals."""
        if not args:
            return sql
        named = dict(args) if isinstance(args, Mapping) else {str(i + 1): v for i, v in enumerate(args)}
        out, at, n = [], 0, 0
        for t in tokens(sql):
            key = None
            if t.kind == "param":
                key = t.text[1:]
            elif t.text == "?":
                n += 1
                key = str(n)
            if key is not None and key in named:
                out += [sql[at : t.start], literal(named[key])]
                at = t.end
        return "".join(out) + sql[at:]

    def _cut(self, sql: str) -> tuple[Cursor, str]:
        """A cursor over a statement, and its RETURNING list."""
        ts = tokens(sql)
        for i, t in enumerate(ts):
            if t.depth == 0 and t.upper == "RETURNING":
                return Cursor(sql[: t.start]), sql[t.end : ts[-1].end].rstrip("; ")
            if t.depth == 0 and t.upper == "OUTPUT":
                stop = next(x for x in ts[i + 1 :] if x.depth == 0 and x.upper in ("VALUES", "SELECT", "WHERE", "FROM", "DEFAULT"))
                text = re.sub(r"\b(?:inserted|deleted)\s*\.\s*", "", sql[t.end : stop.start], flags=re.I)
                return Cursor(sql[: t.start] + sql[stop.start :]), text
        return Cursor(sql), ""

    def _insert(self, version: Version, sql: str):
        c, returning = self._cut(sql)
        replacing = c.take("REPLACE")
        ignoring = False
        if not replacing:
            c.expect("INSERT")
            if c.take("OR"):
                word = c.next().upper
                replacing, ignoring = word == "REPLACE", word == "IGNORE"
            ignoring = c.take("IGNORE") or ignoring
        c.take("INTO") or c.take("OVERWRITE")
        c.take("TABLE")
        state = require(version, c.name())
        self._alias = alias = c.name() if c.take("AS") else ""
        columns = None
        if c.peek() == "(" and c.peek(1) not in ("SELECT", "WITH", "VALUES"):
            columns = [x.strip('"`[]') for x in split_top(c.group())]
        if c.take("DEFAULT", "VALUES"):
            columns, source = [state.diff.names[0]], "SELECT " + (state.meta.default_of(state.diff.names[0]) or "NULL")
        else:
            source = c.until([["ON", "CONFLICT"], ["ON", "DUPLICATE"]])
        if re.match(r"\s*VALUES\b", source, re.I):
            source = self._values(state, source, columns)
        rows = self._query(rewrite(source), version)
        if c.take("ON", "CONFLICT"):
            conflict = []
            if c.peek() == "(":
                conflict = [x.strip('"`') for x in split_top(c.group())]
            elif c.take("ON", "CONSTRAINT"):
                c.name()
            c.expect("DO")
            if c.take("NOTHING"):
                return (*self.writer.insert(version, state, rows, columns, "ignore", conflict), returning, state)
            c.expect("UPDATE", "SET")
            sets = _assignments(c.until([["WHERE"]]))
            where = c.rest() if c.take("WHERE") else ""
            if alias:
                where = re.sub(rf"\b{alias}\s*\.", f"{state.name}.", where)
            return (*self.writer.upsert(version, state, rows, columns, conflict, _rewritten(sets), rewrite(where) if where else ""), returning, state)
        if c.take("ON", "DUPLICATE", "KEY", "UPDATE"):
            sets = [(k, re.sub(r"\bVALUES\s*\(\s*([`\w]+)\s*\)", r"excluded.\1", e, flags=re.I)) for k, e in _assignments(c.rest())]
            sets = [(k, e if "." in e else e) for k, e in sets]
            return (*self.writer.upsert(version, state, rows, columns, [], _qualified(_rewritten(sets), state)), returning, state)
        mode = "replace" if replacing else "ignore" if ignoring else "error"
        return (*self.writer.insert(version, state, rows, columns, mode), returning, state)

    def _values(self, state: TableState, source: str, columns: Sequence[str] | None) -> str:
        """VALUES with DEFAULT replaced by the column's default."""
        if not re.search(r"\bDEFAULT\b", source, re.I):
            return source
        names = list(columns) if columns else state.diff.names
        c = Cursor(source)
        c.expect("VALUES")
        rows = []
        while not c.done:
            cells = split_top(c.group())
            rows.append("(" + ", ".join((state.meta.default_of(n) or "NULL") if x.upper() == "DEFAULT" else x for n, x in zip(names, cells)) + ")")
            c.take(",")
        return "VALUES " + ", ".join(rows)

    def _update(self, version: Version, sql: str):
        c, returning = self._cut(sql)
        c.expect("UPDATE")
        c.take("ONLY")
        state = require(version, c.name())
        c.take("AS")
        alias = c.name() if c.peek() != "SET" else ""
        c.expect("SET")
        self._alias = alias
        sets = _assignments(c.until([["FROM"], ["WHERE"]]), alias or state.name)
        tail = c.until([["WHERE"]]) if c.take("FROM") else ""
        where = c.rest() if c.take("WHERE") else ""
        return (*self.writer.update(version, state, _rewritten(sets), rewrite(where) if where else "", alias, rewrite(tail) if tail else ""), returning, state)

    def _delete(self, version: Version, sql: str):
        c, returning = self._cut(sql)
        c.expect("DELETE")
        c.take("FROM")
        c.take("ONLY")
        state = require(version, c.name())
        c.take("AS")
        self._alias = alias = c.name() if c.peek() not in ("USING", "WHERE", "") else ""
        tail = c.until([["WHERE"]]) if c.take("USING") else ""
        where = c.rest() if c.take("WHERE") else ""
        return (*self.writer.delete(version, state, rewrite(where) if where else "", alias, rewrite(tail) if tail else ""), returning, state)

    def _truncate(self, version: Version, sql: str):
        c = Cursor(sql)
        c.expect("TRUNCATE")
        c.take("TABLE")
        names = [c.name()]
        while c.take(","):
            names.append(c.name())
        cascade = c.take("RESTART", "IDENTITY") and c.take("CASCADE") or c.take("CASCADE")
        for name in names:
            state = require(version, name)
            version = self.writer.truncate(version, state, cascade, frozenset(n.lower() for n in names))
        return version, None, 0, "", None

    def _merge(self, version: Version, sql: str):
        c, returning = self._cut(sql)
        c.expect("MERGE")
        c.take("INTO")
        state = require(version, c.name())
        c.take("AS")
        self._alias = alias = c.name() if c.peek() != "USING" else state.name
        c.expect("USING")
        source = rewrite(c.until([["ON"]]))
        c.expect("ON")
        on = rewrite(c.until([["WHEN"]]))
        matched, unmatched = [], []
        while c.take("WHEN"):
            negative = c.take("NOT")
            c.expect("MATCHED")
            if c.take("BY"):
                c.next()
            extra = rewrite(c.until([["THEN"]])) if c.take("AND") else ""
            c.expect("THEN")
            action = c.until([["WHEN"]])
            (unmatched if negative else matched).append((extra, action))
        total, images, start = 0, None, version
        before = "FALSE"
        for extra, action in matched:
            where = f"({on}) AND NOT ({before})" + (f" AND ({extra})" if extra else "")
            a = Cursor(action)
            base = require(version, state.name)
            if a.take("DELETE"):
                rows = self._single(self.writer.candidates(start, require(start, state.name), alias, source, where), base)
                version, images, n = self.writer.delete(version, base, "", rows=rows)
            elif a.take("DO", "NOTHING"):
                n = 0
            else:
                a.expect("UPDATE", "SET")
                sets = _rewritten(_assignments(a.rest(), alias))
                exprs = ", ".join(f"({e}) AS __n{i}" for i, (_, e) in enumerate(sets))
                rows = self._single(self.writer.candidates(start, require(start, state.name), alias, source, where, exprs), base)
                version, images, n = self.writer.update(version, base, sets, "", rows=rows)
            total += n
            before = f"{before} OR ({extra or 'TRUE'})"
        before = "FALSE"
        for extra, action in unmatched:
            a = Cursor(action)
            a.expect("INSERT")
            columns = [x.strip('"`') for x in split_top(a.group())] if a.peek() == "(" else None
            a.expect("VALUES")
            exprs = rewrite(a.group())
            where = f"NOT EXISTS (SELECT 1 FROM __k_{state.name} AS {alias} WHERE {on}) AND NOT ({before})" + (f" AND ({extra})" if extra else "")
            rows = self._query(f"SELECT {exprs} FROM {source} WHERE {where}", start)
            version, images, n = self.writer.insert(version, require(version, state.name), rows, columns)
            total += n
            before = f"{before} OR ({extra or 'TRUE'})"
        return version, images, total, returning, state

    def _single(self, rows: DataFrame, state: TableState) -> DataFrame:
        """The rows, if no row of the table is among them twice."""
        if rows.groupBy(*state.key_columns).count().filter("count > 1").first() is not None:
            raise CardinalityViolation(f"MERGE: several source rows for one row of {state.name}")
        return rows

    def _ddl(self, version: Version, sql: str) -> Version:
        c = Cursor(sql)
        first = c.next().upper
        kinds = [c.peek(i) for i in range(3)]
        if "INDEX" in kinds[:2] and first in ("CREATE", "DROP"):
            return version  # nothing to read differently
        if first == "CREATE" and "TABLE" in kinds[:2]:
            version, name, select = ddl.create_table(version, sql)
            if select:
                rows = self._query(rewrite(select), version.without(name))
                state = version.get(name)
                if not state.diff.columns:
                    state = replace(state, diff=replace(state.diff, columns=tuple((f.name, f.dataType.simpleString(), None, None) for f in rows.schema.fields)))
                version, _, _ = self.writer.insert(version.put(state), state, rows, None)
            return version
        if first == "DROP" and kinds[0] == "TABLE":
            c.next()
            quiet = c.take("IF", "EXISTS")
            names = [c.name()]
            while c.take(","):
                names.append(c.name())
            for n in names:
                version = ddl.drop_table(version, n, quiet)
            return version
        if first == "ALTER" and kinds[0] == "TABLE":
            return ddl.alter(version, sql)
        if first in ("EXEC", "EXECUTE") and kinds[0] == "SP_RENAME":
            args = [t.text.strip("'") for t in c.all if t.kind == "string"]
            parts = [p.strip("[]") for p in args[0].split(".")]
            if len(args) > 2 and args[2].upper() == "COLUMN":
                return ddl.rename_column(version, require(version, parts[-2]), parts[-1], args[1])
            return ddl.rename_table(version, require(version, parts[-1]), args[1])
        if first == "RENAME":
            c.take("TABLE")
            old = require(version, c.name())
            c.expect("TO")
            return ddl.rename_table(version, old, c.name())
        raise NotSupported(f"{first} {kinds[0]}")

    # -- transactions --------------------------------------------------------------------------------

    def _transaction(self, c: Classification) -> DataFrame:
        done = lambda word: self._one(word, "status", "string")
        cur = Cursor(c.sql)
        if c.sub is Sub.BEGIN:
            if self.in_transaction:
                raise TransactionState("a transaction is open already")
            self.begun = self.current = self.db.version
            self.savepoints, self.failed = [], False
            return done("BEGIN")
        if not self.in_transaction:
            raise TransactionState("no transaction is open")
        words = [t.upper for t in cur.all]
        if c.sub is Sub.COMMIT:
            begun, ours, failed = self.begun, self.current, self.failed
            self.begun = self.current = None
            self.savepoints, self.failed = [], False
            if failed:
                return done("ROLLBACK")
            if ours is not begun:
                self.db.publish(begun, ours)
            return done("COMMIT")
        if c.sub is Sub.ROLLBACK and "TO" not in words:
            if len(words) > 2 and words[1] in ("TRAN", "TRANSACTION") and self._savepoint(cur.all[-1].text) is not None:
                return self._back(cur.all[-1].text)
            self.begun = self.current = None
            self.savepoints, self.failed = [], False
            return done("ROLLBACK")
        name = cur.all[-1].text.strip('"`').lower()
        if c.sub is Sub.SAVEPOINT:
            self.savepoints.append((name, self.current))
            return done("SAVEPOINT")
        if c.sub is Sub.RELEASE:
            i = self._savepoint(name)
            if i is None:
                raise TransactionState(f"savepoint {name} does not exist")
            del self.savepoints[i:]
            return done("RELEASE")
        return self._back(name)

    def _savepoint(self, name: str) -> int | None:
        return next((i for i in range(len(self.savepoints) - 1, -1, -1) if self.savepoints[i][0] == name.lower()), None)

    def _back(self, name: str) -> DataFrame:
        i = self._savepoint(name)
        if i is None:
            raise TransactionState(f"savepoint {name} does not exist")
        self.current = self.savepoints[i][1]
        del self.savepoints[i + 1 :]  # the savepoint itself stays
        self.failed = False
        return self._one("ROLLBACK", "status", "string")

    # -- cursors, prepared statements, settings ---------------------------------------------------------

    def _other(self, c: Classification, args: Any) -> DataFrame:
        cur = Cursor(c.sql)
        word = cur.next().upper
        if c.sub is Sub.EXPLAIN:
            mode = "formatted"
            plan = self._read(cur.rest())._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
            return self._one(plan, "plan", "string")
        if c.sub is Sub.SET:
            cur.take("SESSION") or cur.take("LOCAL")
            key = cur.until([["="], ["TO"]]) if not cur.done else ""
            cur.take("=") or cur.take("TO")
            if word == "RESET":
                self.settings.pop(key.lower(), None)
            else:
                self.settings[key.lower()] = cur.rest().strip("'")
            return self._one("SET", "status", "string")
        if c.sub is Sub.SHOW:
            if cur.peek() == "TABLES":
                return self.spark.createDataFrame([(s.name,) for s in self.version.tables.values() if not s.dropped], "table_name string")
            if word in ("DESCRIBE", "DESC"):
                state = require(self.version, cur.name())
                return self.spark.createDataFrame([(n, t) for n, t, _, _ in state.diff.columns], "column_name string, data_type string")
            if word == "PRAGMA" and cur.peek() == "TABLE_INFO":
                cur.next()
                state = require(self.version, cur.group())
                return self.spark.createDataFrame([(i, n, t, n in state.meta.pk) for i, (n, t, _, _) in enumerate(state.diff.columns)], "cid int, name string, type string, pk boolean")
            return self._one(self.settings.get(cur.rest().lower(), ""), "value", "string")
        if c.sub is Sub.PREPARE:
            name = cur.name().lower()
            if cur.peek() == "(":
                cur.group()
            cur.expect("AS")
            self.prepared[name] = cur.rest()
            return self._one("PREPARE", "status", "string")
        if c.sub is Sub.EXECUTE:
            name = cur.name().lower()
            if name not in self.prepared:
                raise UnknownTable(f"prepared statement {name} does not exist")
            values = split_top(cur.group()) if cur.peek() == "(" else []
            return self.sql(re.sub(r"\$(\d+)", lambda m: values[int(m.group(1)) - 1], self.prepared[name]))
        if c.sub is Sub.DEALLOCATE:
            cur.take("PREPARE")
            if cur.take("ALL"):
                self.prepared.clear()
            elif self.prepared.pop(cur.name().lower(), None) is None:
                raise UnknownTable("no such prepared statement")
            return self._one("DEALLOCATE", "status", "string")
        if c.sub is Sub.LISTEN:
            (self.listening.add if word == "LISTEN" else self.listening.discard)(cur.rest().lower())
            return self._one(word, "status", "string")
        if c.sub is Sub.CURSOR:
            return self._cursor(word, cur)
        raise NotSupported(word)

    def _cursor(self, word: str, cur: Cursor) -> DataFrame:
        if word == "DECLARE":
            name = cur.name().lower()
            while cur.peek() not in ("FOR", ""):
                cur.next()
            cur.expect("FOR")
            df = self._read(cur.rest())
            # Versions don't change, so rows fetched later are those of now; they come a partition at a time.
            self.cursors[name] = (df.schema, df.toLocalIterator())
            return self._one("DECLARE CURSOR", "status", "string")
        if word == "CLOSE":
            if cur.take("ALL"):
                self.cursors.clear()
            elif self.cursors.pop(cur.name().lower(), None) is None:
                raise UnknownTable("no such cursor")
            return self._one("CLOSE CURSOR", "status", "string")
        n: int | None = 1
        cur.take("FORWARD")
        cur.take("NEXT")
        if cur.take("ALL"):
            n = None
        elif cur.all[cur.at].kind == "number":
            n = int(cur.next().text)
        cur.take("FROM") or cur.take("IN")
        name = cur.name().lower()
        if name not in self.cursors:
            raise UnknownTable(f"cursor {name} does not exist")
        schema, rows = self.cursors[name]
        got = []
        while n is None or len(got) < n:
            row = next(rows, None)
            if row is None:
                break
            got.append(tuple(row))
        return self.spark.createDataFrame(got, schema)


def literal(value: Any) -> str:
    """A Python value as an SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int | float):
        return repr(value)
    if isinstance(value, bytes):
        return f"X'{value.hex()}'"
    return "'" + str(value).replace("'", "''") + "'"


def _assignments(text: str, alias: str = "") -> list[tuple[str, str]]:
    """(column, expression) of SET a = 1, b = 2 or (a, b) = (1, 2)."""
    out = []
    for part in split_top(text):
        c = Cursor(part)
        if c.peek() == "(":
            names = split_top(c.group())
            c.expect("=")
            c.take("ROW")
            out += list(zip([n.strip('"`') for n in names], split_top(c.group())))
        else:
            name = c.name()
            c.expect("=")
            out.append((name, c.rest()))
    return out


def _rewritten(sets: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [(k, rewrite(e)) for k, e in sets]


def _qualified(sets: list[tuple[str, str]], state: TableState) -> list[tuple[str, str]]:
    """Bare columns in ON DUPLICATE KEY UPDATE mean the table's own row."""
    names = {n.lower() for n in state.diff.names}
    out = []
    for k, e in sets:
        ts, cuts, at = tokens(e), [], 0
        for i, t in enumerate(ts):
            bare = t.kind == "word" and t.text.lower() in names and (i == 0 or ts[i - 1].text != ".") and (i + 1 == len(ts) or ts[i + 1].text not in (".", "("))
            if bare:
                cuts += [e[at : t.start], f"{state.name}.{t.text}"]
                at = t.end
        out.append((k, "".join(cuts) + e[at:]))
    return out


__all__ = ["Database", "OverlaySession", "ForeignKey", "OverlayError", "SyntaxProblem", "Callable", "literal"]
