"""Foreign keys, checked against merged relations and followed on delete."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ForeignKeyViolation
from ..state import ForeignKey, TableState, Version

if TYPE_CHECKING:
    from .dml import Writer


def _match(left: DataFrame, lcols, right: DataFrame, rcols, how: str) -> DataFrame:
    keys = right.select(*[F.col(f"`{c}`").alias(f"__f{i}") for i, c in enumerate(rcols)])
    return left.join(keys, reduce(lambda a, b: a & b, [F.col(f"`{c}`") == F.col(f"__f{i}") for i, c in enumerate(lcols)]), how)


def check_rows(writer: Writer, version: Version, state: TableState, rows: DataFrame, columns: set[str] | None = None) -> None:
    """Every non-null reference of ``rows`` must exist in the merged parent (or among the rows themselves)."""
    for fk in state.meta.fks:
        if columns is not None and not columns & set(fk.columns):
            continue
        parent = version.get(fk.parent)
        if parent is None:
            raise ForeignKeyViolation(f"{state.name}: referenced table {fk.parent} does not exist")
        wanted = rows.select(*[f"`{c}`" for c in fk.columns]).dropna().distinct()
        there = writer.merged(parent)
        if parent.name.lower() == state.name.lower():
            there = there.select(*fk.parent_columns).union(rows.select(*fk.parent_columns))
        bad = _match(wanted, fk.columns, there, fk.parent_columns, "left_anti").first()
        if bad is not None:
            raise ForeignKeyViolation(f"{state.name}({', '.join(fk.columns)}) = {tuple(bad)} is not in {fk.parent}")


def children_of(version: Version, name: str) -> list[tuple[TableState, ForeignKey]]:
    return [(s, fk) for s in version.tables.values() if not s.dropped for fk in s.meta.fks if fk.parent.lower() == name.lower()]


def follow_delete(writer: Writer, version: Version, state: TableState, dead: DataFrame) -> Version:
    """Apply RESTRICT, CASCADE, SET NULL and SET DEFAULT of what refers to deleted rows. The parent is deleted in ``version`` already."""
    for child, fk in children_of(version, state.name):
        child = version.get(child.name)
        if child is None:
            continue
        gone = dead.select(*[f"`{c}`" for c in fk.parent_columns]).dropna().distinct()
        # A key that is still in the parent (deleted and put back) is not gone.
        still = writer.merged(version.get(state.name))
        gone = _match(gone, fk.parent_columns, still, fk.parent_columns, "left_anti")
        hit = _match(writer.merged(child, keys=True), fk.columns, gone, fk.parent_columns, "left_semi")
        action = fk.on_delete.upper()
        if action in ("NO ACTION", "RESTRICT"):
            if hit.first() is not None:
                raise ForeignKeyViolation(f"{state.name} is still referred to by {child.name}({', '.join(fk.columns)})")
        elif action == "CASCADE":
            after, removed, n = writer.apply(child, hit.withColumn("__dead", F.lit(True)))
            if n:
                version = follow_delete(writer, version.put(after), after, removed)
        elif action in ("SET NULL", "SET DEFAULT"):
            kinds = {c[0]: c[1] for c in child.diff.columns}
            for c in fk.columns:
                value = child.meta.default_of(c) if action == "SET DEFAULT" else None
                hit = hit.withColumn(c, (F.expr(value) if value is not None else F.lit(None)).cast(kinds[c]))
            after, changed, n = writer.apply(child, hit.withColumn("__dead", F.lit(False)))
            if n:
                version = version.put(after)
                check_rows(writer, version, after, changed, set(fk.columns))
    return version


def check_update(writer: Writer, version: Version, state: TableState, columns: set[str], before: DataFrame) -> None:
    """Old values of referenced columns must not leave references behind."""
    for child, fk in children_of(version, state.name):
        if not columns & set(fk.parent_columns):
            continue
        gone = before.select(*[f"`{c}`" for c in fk.parent_columns]).dropna().distinct()
        gone = _match(gone, fk.parent_columns, writer.merged(version.get(state.name)), fk.parent_columns, "left_anti")
        if _match(writer.merged(version.get(child.name)), fk.columns, gone, fk.parent_columns, "left_semi").first() is not None:
            raise ForeignKeyViolation(f"{state.name} is still referred to by {child.name}({', '.join(fk.columns)})")
