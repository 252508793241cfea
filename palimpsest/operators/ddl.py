"""Schema changes: recorded in the table's diff, never made on the base."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import NotSupported, OverlayError, SyntaxProblem, UnknownColumn, UnknownTable
from ..plans.text import Cursor, name_of, split_top, tokens
from ..state import ForeignKey, TableDiff, TableMeta, TableState, Version

#: SQL type names and the Spark types they become; fixed values.
TYPES = {
    "SMALLINT": "smallint", "INT2": "smallint", "TINYINT": "tinyint", "INT": "int", "INTEGER": "int", "INT4": "int", "MEDIUMINT": "int", "SERIAL": "int", "SMALLSERIAL": "smallint",
    "BIGINT": "bigint", "INT8": "bigint", "BIGSERIAL": "bigint", "OID": "bigint", "UBIGINT": "decimal(20,0)", "UINTEGER": "bigint", "USMALLINT": "int", "UTINYINT": "smallint",
    "HUGEINT": "decimal(38,0)", "UHUGEINT": "decimal(38,0)", "REAL": "float", "FLOAT4": "float", "FLOAT": "double", "FLOAT8": "double", "DOUBLE": "double", "DOUBLE PRECISION": "double",
    "NUMERIC": "decimal(38,18)", "DECIMAL": "decimal(38,18)", "MONEY": "decimal(19,4)", "BOOLEAN": "boolean", "BOOL": "boolean", "BIT": "boolean", "TEXT": "string", "VARCHAR": "string",
    "NVARCHAR": "string", "CHAR": "string", "NCHAR": "string", "CHARACTER": "string", "CHARACTER VARYING": "string", "STRING": "string", "UUID": "string", "UNIQUEIDENTIFIER": "string",
    "JSON": "string", "JSONB": "string", "XML": "string", "INET": "string", "ENUM": "string", "TIME": "string", "BYTEA": "binary", "BLOB": "binary", "BINARY": "binary", "VARBINARY": "binary",
    "DATE": "date", "TIMESTAMP": "timestamp_ntz", "DATETIME": "timestamp_ntz", "DATETIME2": "timestamp_ntz", "TIMESTAMP_NTZ": "timestamp_ntz", "TIMESTAMPTZ": "timestamp", "DATETIMEOFFSET": "timestamp",
    "TIMESTAMP WITHOUT TIME ZONE": "timestamp_ntz", "TIMESTAMP WITH TIME ZONE": "timestamp", "INTERVAL": "interval day to second", "VARIANT": "variant",
}

_STOPS = [["DEFAULT"], ["NOT"], ["NULL"], ["PRIMARY"], ["UNIQUE"], ["REFERENCES"], ["CHECK"], ["COLLATE"], ["GENERATED"], ["CONSTRAINT"], ["AUTO_INCREMENT"], ["IDENTITY"], ["USING"], ["COMMENT"], ["FIRST"], ["AFTER"], [","]]


def spark_type(text: str) -> str:
    """The Spark type of an SQL type; ``[]`` after it makes arrays."""
    text = " ".join(text.upper().split())
    if text.endswith("[]"):
        return f"array<{spark_type(text[:-2])}>"
    name, _, rest = text.partition("(")
    name = name.strip()
    if name in ("NUMERIC", "DECIMAL") and rest:
        p, _, s = rest.rstrip(")").partition(",")
        return f"decimal({int(p)},{int(s or 0)})"
    if name in ("ARRAY<STRING>", "MAP", "STRUCT", "ARRAY") or "<" in text:
        return text.lower()
    if name in TYPES:
        return TYPES[name]
    raise NotSupported(f"type {text}")


def constant(expression: str) -> bool:
    ts = tokens(expression)
    return not any(t.kind == "word" and n.text == "(" for t, n in zip(ts, ts[1:])) and not any(t.upper.startswith("CURRENT_") for t in ts)


def references(c: Cursor, columns: tuple[str, ...], name: str = "") -> ForeignKey:
    """After REFERENCES: parent, its columns and the actions."""
    parent = c.name()
    cols = tuple(split_top(c.group())) if c.peek() == "(" else columns
    actions = {"DELETE": "NO ACTION", "UPDATE": "NO ACTION"}
    while not c.done:
        if c.take("ON"):
            event = c.next().upper
            if c.take("SET", "NULL"):
                actions[event] = "SET NULL"
            elif c.take("SET", "DEFAULT"):
                actions[event] = "SET DEFAULT"
            elif c.take("NO", "ACTION"):
                actions[event] = "NO ACTION"
            else:
                actions[event] = c.next().upper
        elif c.peek() in ("MATCH", "DEFERRABLE", "INITIALLY", "NOT"):
            c.next()
            c.next()
        else:
            break
    return ForeignKey(columns, parent.lower(), tuple(x.strip('"`') for x in cols), actions["DELETE"], actions["UPDATE"], name)


class _Column:
    """One column definition."""

    def __init__(self, text: str):
        c = Cursor(text)
        self.name = c.name()
        self.kind_text = c.until(_STOPS)
        self.serial = self.kind_text.upper().endswith("SERIAL")
        self.kind = spark_type(self.kind_text)
        self.default: str | None = None
        self.primary = self.generated = self.not_null = self.unique = False
        self.checks: list[tuple[str, str]] = []
        self.fk: ForeignKey | None = None
        label = ""
        while not c.done:
            if c.take("DEFAULT"):
                self.default = c.until(_STOPS[1:])
            elif c.take("PRIMARY", "KEY"):
                self.primary = True
            elif c.take("REFERENCES"):
                self.fk = references(c, (self.name,))
            elif c.take("GENERATED") or c.take("AUTO_INCREMENT") or c.take("IDENTITY"):
                self.serial = self.serial or "IDENTITY" in text.upper() or "AUTO_INCREMENT" in text.upper()
                self.generated = "STORED" in text.upper()
                c.until(_STOPS[1:6])
            elif c.take("CHECK"):
                self.checks.append((label, c.group()))
            elif c.take("NOT", "NULL"):
                self.not_null = True
            elif c.take("UNIQUE"):
                self.unique = True
            elif c.take("CONSTRAINT"):
                label = c.name()
            else:
                c.next()


def create_table(version: Version, sql: str) -> tuple[Version, str, str]:
    """(version, table, the SELECT of CREATE TABLE AS or '')."""
    c = Cursor(sql)
    c.expect("CREATE")
    c.take("TEMPORARY") or c.take("TEMP")
    c.expect("TABLE")
    quiet = c.take("IF", "NOT", "EXISTS")
    name = c.name()
    if version.get(name) is not None:
        if quiet:
            return version, "", ""
        raise OverlayError(f"table {name} exists already")
    columns: list[_Column] = []
    pk: tuple[str, ...] = ()
    fks: list[ForeignKey] = []
    uniques: list[tuple[str, tuple[str, ...]]] = []
    checks: list[tuple[str, str]] = []
    if c.peek() == "(" and c.peek(1) != "SELECT":
        for part in split_top(c.group()):
            p = Cursor(part)
            label = p.name() if p.take("CONSTRAINT") else ""
            if p.take("PRIMARY", "KEY"):
                pk = tuple(x.strip('"`') for x in split_top(p.group()))
            elif p.take("FOREIGN", "KEY"):
                own = tuple(x.strip('"`') for x in split_top(p.group()))
                p.expect("REFERENCES")
                fks.append(references(p, own, label))
            elif p.take("UNIQUE"):
                while p.peek() != "(":
                    p.next()
                uniques.append((label, tuple(x.strip('"`') for x in split_top(p.group()))))
            elif p.take("CHECK"):
                checks.append((label, p.group()))
            elif p.peek() in ("KEY", "INDEX", "EXCLUDE"):
                continue
            else:
                columns.append(_Column(part))
    select = ""
    if c.take("AS"):
        select = c.rest()
        if select.startswith("("):
            select = c.group()
    pk = pk or tuple(x.name for x in columns if x.primary)
    fks += [x.fk for x in columns if x.fk]
    meta = TableMeta(pk, tuple((x.name, x.default) for x in columns if x.default), tuple(x.name for x in columns if x.generated), any(x.serial and x.name in pk for x in columns), tuple(fks))
    uniques += [(f"{name}_{x.name}_key", (x.name,)) for x in columns if x.unique]
    checks += [check for x in columns for check in x.checks]
    meta = replace(meta, not_null=tuple(x.name for x in columns if x.not_null), uniques=tuple(uniques), checks=tuple(checks))
    diff = TableDiff(tuple((x.name, x.kind, None, None) for x in columns), new_table=True)
    state = TableState(name, None, meta, diff, next_id=1 if meta.auto_id else None, stamp=1)
    return version.put(state), name, select


def _find(state: TableState, column: str) -> int:
    for i, n in enumerate(state.diff.names):
        if n.lower() == column.lower():
            return i
    raise UnknownColumn(f"{state.name} has no column {column}")


def _segments(state: TableState, change) -> tuple:
    return tuple(change(s) for s in state.segments)


def add_column(state: TableState, definition: str) -> TableState:
    """Rows there already get the default if it is a constant, else null."""
    col = _Column(definition)
    if col.name.lower() in (n.lower() for n in state.diff.names):
        raise OverlayError(f"{state.name} has a column {col.name} already")
    shown = col.default if col.default is not None and constant(col.default) else None
    value: Column = (F.expr(shown) if shown is not None else F.lit(None)).cast(col.kind)
    diff = replace(state.diff, columns=(*state.diff.columns, (col.name, col.kind, None, shown)), added=(*state.diff.added, col.name))
    meta = state.meta
    if col.default is not None:
        meta = replace(meta, defaults=(*meta.defaults, (col.name, col.default)))
    if col.fk:
        meta = replace(meta, fks=(*meta.fks, col.fk))
    if col.not_null:
        meta = replace(meta, not_null=(*meta.not_null, col.name))
    if col.unique:
        meta = replace(meta, uniques=(*meta.uniques, (f"{state.name}_{col.name}_key", (col.name,))))
    meta = replace(meta, checks=(*meta.checks, *col.checks))
    return state.evolve(diff=diff, meta=meta, segments=_segments(state, lambda s: s.withColumn(col.name, value)))


def _names_column(condition: str, column: str) -> bool:
    return any(t.kind in ("word", "quoted") and name_of(t).lower() == column.lower() for t in tokens(condition))


def _renamed(condition: str, old: str, new: str) -> str:
    out, at = [], 0
    for t in tokens(condition):
        if t.kind in ("word", "quoted") and name_of(t).lower() == old.lower():
            out += [condition[at : t.start], new]
            at = t.end
    return "".join(out) + condition[at:]


def drop_column(state: TableState, column: str) -> TableState:
    i = _find(state, column)
    name = state.diff.names[i]
    if name in state.meta.pk:
        raise NotSupported(f"{name} is in the key of {state.name}")
    added = tuple(c for c in state.diff.added if c != name)
    dropped = state.diff.dropped if state.diff.columns[i][2] is None else (*state.diff.dropped, state.diff.columns[i][2])
    diff = replace(state.diff, columns=tuple(c for j, c in enumerate(state.diff.columns) if j != i), added=added, dropped=dropped)
    meta = replace(state.meta, fks=tuple(k for k in state.meta.fks if name not in k.columns), defaults=tuple(d for d in state.meta.defaults if d[0] != name))
    meta = replace(meta, not_null=tuple(c for c in meta.not_null if c != name), uniques=tuple(u for u in meta.uniques if name not in u[1]), checks=tuple(k for k in meta.checks if not _names_column(k[1], name)))
    return state.evolve(diff=diff, meta=meta, segments=_segments(state, lambda s: s.drop(name)))


def rename_column(version: Version, state: TableState, old: str, new: str) -> Version:
    i = _find(state, old)
    old = state.diff.names[i]
    if new.lower() != old.lower() and new.lower() in (n.lower() for n in state.diff.names):
        raise OverlayError(f"{state.name} has a column {new} already")
    sub = lambda cols: tuple(new if c == old else c for c in cols)
    cols = tuple((new, *c[1:]) if j == i else c for j, c in enumerate(state.diff.columns))
    diff = replace(state.diff, columns=cols, added=sub(state.diff.added), renamed=(*state.diff.renamed, (old, new)))
    meta = replace(state.meta, pk=sub(state.meta.pk), fks=tuple(replace(k, columns=sub(k.columns)) for k in state.meta.fks), defaults=tuple((new if c == old else c, e) for c, e in state.meta.defaults))
    meta = replace(meta, not_null=sub(meta.not_null), uniques=tuple((n, sub(cols)) for n, cols in meta.uniques), checks=tuple((n, _renamed(k, old, new)) for n, k in meta.checks))
    version = version.put(state.evolve(diff=diff, meta=meta, segments=_segments(state, lambda s: s.withColumnRenamed(old, new))))
    for child in list(version.tables.values()):
        if any(k.parent.lower() == state.name.lower() and old in k.parent_columns for k in child.meta.fks):
            fks = tuple(replace(k, parent_columns=sub(k.parent_columns)) if k.parent.lower() == state.name.lower() else k for k in child.meta.fks)
            version = version.put(replace(child, meta=replace(child.meta, fks=fks)))
    return version


def retype_column(state: TableState, column: str, kind: str) -> TableState:
    i = _find(state, column)
    name, old, source, default = state.diff.columns[i]
    cols = tuple((name, kind, source, default) if j == i else c for j, c in enumerate(state.diff.columns))
    diff = replace(state.diff, columns=cols, retyped=(*state.diff.retyped, (name, old, kind)))
    return state.evolve(diff=diff, segments=_segments(state, lambda s: s.withColumn(name, F.col(f"`{name}`").cast(kind))))


def rename_table(version: Version, state: TableState, new: str) -> Version:
    """The base rows follow the new name."""
    if version.get(new) is not None:
        raise OverlayError(f"table {new} exists already")
    # The old name is kept as dropped, so nothing takes it for a clean base table again.
    version = version.put(state.evolve(name=state.name, dropped=True, segments=(), sizes=(), rows=0, tombstones=0)).put(state.evolve(name=new, diff=replace(state.diff, renamed=(*state.diff.renamed, (state.name + ".*", new + ".*")))))
    for child in list(version.tables.values()):
        if not child.dropped and any(k.parent.lower() == state.name.lower() for k in child.meta.fks):
            version = version.put(replace(child, meta=replace(child.meta, fks=tuple(replace(k, parent=new.lower()) if k.parent.lower() == state.name.lower() else k for k in child.meta.fks))))
    return version


def drop_table(version: Version, name: str, quiet: bool = False) -> Version:
    state = version.get(name)
    if state is None:
        if quiet:
            return version
        raise UnknownTable(f"table {name} does not exist")
    return version.put(state.evolve(dropped=True, segments=(), paths=(), sizes=(), rows=0, tombstones=0, inserts=0))


def alter(version: Version, sql: str) -> Version:
    c = Cursor(sql)
    c.expect("ALTER", "TABLE")
    quiet = c.take("IF", "EXISTS")
    c.take("ONLY")
    name = c.name()
    state = version.get(name)
    if state is None:
        if quiet:
            return version
        raise UnknownTable(f"table {name} does not exist")
    for part in split_top(c.rest()):
        state = version.get(name)
        p = Cursor(part)
        if p.take("ADD", "CONSTRAINT") or (p.peek() == "ADD" and p.peek(1) in ("FOREIGN", "PRIMARY", "UNIQUE", "CHECK")):
            label = p.name() if p.at == 2 else (p.take("ADD"), "")[1]
            if p.take("FOREIGN", "KEY"):
                own = tuple(x.strip('"`') for x in split_top(p.group()))
                p.expect("REFERENCES")
                version = version.put(state.evolve(meta=replace(state.meta, fks=(*state.meta.fks, references(p, own, label)))))
            elif p.take("UNIQUE"):
                version = version.put(state.evolve(meta=replace(state.meta, uniques=(*state.meta.uniques, (label, tuple(x.strip('"`') for x in split_top(p.group())))))))
            elif p.take("CHECK"):
                version = version.put(state.evolve(meta=replace(state.meta, checks=(*state.meta.checks, (label, p.group())))))
        elif p.take("ADD"):
            p.take("COLUMN")
            p.take("IF", "NOT", "EXISTS")
            version = version.put(add_column(state, p.rest()))
        elif p.take("DROP", "CONSTRAINT"):
            label = p.name()
            kept = {"fks": tuple(k for k in state.meta.fks if k.name != label), "uniques": tuple(u for u in state.meta.uniques if u[0] != label), "checks": tuple(k for k in state.meta.checks if k[0] != label)}
            version = version.put(state.evolve(meta=replace(state.meta, **kept)))
        elif p.take("DROP"):
            p.take("COLUMN")
            p.take("IF", "EXISTS")
            version = version.put(drop_column(state, p.name()))
        elif p.take("RENAME", "TO") or p.take("RENAME", "AS"):
            version = rename_table(version, state, p.name())
        elif p.take("RENAME"):
            p.take("COLUMN")
            old = p.name()
            p.expect("TO")
            version = rename_column(version, state, old, p.name())
        elif p.take("CHANGE"):
            p.take("COLUMN")
            old = p.name()
            col = _Column(p.rest())
            version = rename_column(version, state, old, col.name)
            version = version.put(retype_column(version.get(name), col.name, col.kind))
        elif p.take("MODIFY"):
            p.take("COLUMN")
            col = _Column(p.rest())
            version = version.put(retype_column(state, col.name, col.kind))
        elif p.take("ALTER"):
            p.take("COLUMN")
            column = p.name()
            if p.take("SET", "DEFAULT"):
                rest = tuple(d for d in state.meta.defaults if d[0].lower() != column.lower())
                version = version.put(state.evolve(meta=replace(state.meta, defaults=(*rest, (state.diff.names[_find(state, column)], p.rest())))))
            elif p.take("DROP", "DEFAULT"):
                version = version.put(state.evolve(meta=replace(state.meta, defaults=tuple(d for d in state.meta.defaults if d[0].lower() != column.lower()))))
            elif p.take("SET", "NOT", "NULL"):
                own = state.diff.names[_find(state, column)]
                version = version.put(state.evolve(meta=replace(state.meta, not_null=tuple(dict.fromkeys((*state.meta.not_null, own))))))
            elif p.take("DROP", "NOT", "NULL"):
                version = version.put(state.evolve(meta=replace(state.meta, not_null=tuple(c for c in state.meta.not_null if c.lower() != column.lower()))))
            else:
                p.take("SET", "DATA")
                p.take("TYPE")
                version = version.put(retype_column(state, column, spark_type(p.until([["USING"], ["NOT"], ["NULL"]]))))
        else:
            raise SyntaxProblem(f"ALTER TABLE: {part[:40]!r}")
    return version
