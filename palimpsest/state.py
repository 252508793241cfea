"""The state of an overlay as immutable values.

A ``Version`` maps table names to ``TableState``. A write makes a new version;
a transaction, a savepoint or a rollback only keeps or drops a reference.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class ForeignKey:
    """``columns`` of the table refer to ``parent_columns`` of ``parent``."""

    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"
    name: str = ""


@dataclass(frozen=True)
class TableMeta:
    """What a table's key, defaults, generated columns and references are. Without ``pk`` rows are told apart by their place in the base files."""

    pk: tuple[str, ...] = ()
    defaults: tuple[tuple[str, str], ...] = ()
    generated: tuple[str, ...] = ()
    auto_id: bool = False
    fks: tuple[ForeignKey, ...] = ()
    not_null: tuple[str, ...] = ()
    #: (name, columns) of unique constraints, and (name, condition) of checks.
    uniques: tuple[tuple[str, tuple[str, ...]], ...] = ()
    checks: tuple[tuple[str, str], ...] = ()

    def default_of(self, column: str) -> str | None:
        return dict(self.defaults).get(column)


@dataclass(frozen=True)
class TableDiff:
    """How the current schema differs from the base's. ``columns`` are the current
    ones: (name, type, base column or None, default expression for base rows)."""

    columns: tuple[tuple[str, str, str | None, str | None], ...] = ()
    added: tuple[str, ...] = ()
    dropped: tuple[str, ...] = ()
    renamed: tuple[tuple[str, str], ...] = ()
    retyped: tuple[tuple[str, str, str], ...] = ()
    new_table: bool = False
    fully_shadowed: bool = False

    @property
    def changed(self) -> bool:
        return bool(self.added or self.dropped or self.renamed or self.retyped or self.new_table or self.fully_shadowed)

    @property
    def names(self) -> list[str]:
        return [c[0] for c in self.columns]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.DataType.fromDDL(t)) for n, t, _, _ in self.columns])


#: Names of the columns of an overlay segment beside the table's own.
KEY, DEAD = "__k", "__dead"


@dataclass(frozen=True)
class TableState:
    """One table. ``segments`` are row images and tombstones, the newest last; each
    is a materialized frame of key columns, a dead mark and the current columns."""

    name: str
    base: str | None
    meta: TableMeta
    diff: TableDiff
    segments: tuple[DataFrame, ...] = ()
    paths: tuple[str, ...] = ()
    #: (rows, tombstones) of each segment.
    sizes: tuple[tuple[int, int], ...] = ()
    #: Rows in the segments, of these tombstones, and rows inserted.
    rows: int = 0
    tombstones: int = 0
    inserts: int = 0
    dropped: bool = False
    #: Whether a key in the segments has a null.
    null_keys: bool = False
    next_id: int | None = None
    #: Grows with every change; two sessions compare it.
    stamp: int = 0

    @property
    def n_keys(self) -> int:
        return max(1, len(self.meta.pk)) if self.meta.pk else 2

    @property
    def key_columns(self) -> list[str]:
        return [f"{KEY}{i}" for i in range(self.n_keys)]

    @property
    def affected(self) -> bool:
        """Whether reads must merge: any row, tombstone or schema change."""
        return bool(self.segments) or self.diff.changed

    def evolve(self, **changes: Any) -> TableState:
        return replace(self, stamp=self.stamp + 1, **changes)


@dataclass(frozen=True)
class Version:
    tables: Mapping[str, TableState] = field(default_factory=dict)

    def get(self, name: str) -> TableState | None:
        state = self.tables.get(name.lower())
        return None if state is None or state.dropped else state

    def put(self, state: TableState) -> Version:
        return Version({**self.tables, state.name.lower(): state})

    def without(self, name: str) -> Version:
        return Version({k: v for k, v in self.tables.items() if k != name.lower()})

    def changed_since(self, other: Version) -> set[str]:
        names = set(self.tables) | set(other.tables)
        return {n for n in names if self.tables.get(n) is not other.tables.get(n)}


def serialize_key(columns: Iterable[str], row: Mapping[str, Any]) -> str:
    """A key as text: the value itself, or a JSON object in key order for several columns."""
    columns = list(columns)
    if len(columns) == 1:
        return str(row[columns[0]])
    return json.dumps({c: row[c] for c in columns}, default=str, separators=(",", ":"))


def deserialize_key(columns: Iterable[str], text: str) -> dict[str, Any]:
    columns = list(columns)
    if len(columns) == 1:
        return {columns[0]: text}
    found = json.loads(text)
    return {c: found[c] for c in columns}
