"""Writes as functions from one version to the next.

Every write evaluates its rows once over the merged relation and stores them as
one more segment: full row images, or tombstones that keep the last image.
Base files are never touched. When the newest segments are as many rows as the
one before them, they are made one with it, so there are few segments and each
row is rewritten as often as the logarithm of their number.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import CheckViolation, NotNullViolation, NotSupported, UniqueViolation, UnknownColumn, UnknownTable
from ..plans.dialect import rewrite
from ..sources.catalog import Catalog
from ..sources.store import Store
from ..state import DEAD, TableState, Version
from . import fk
from .merge import key_expressions, merged, overlay_rows, without_keys

#: Segments of a table before the newest are made one.
MAX_SEGMENTS = 4


class Writer:
    """Evaluates and stores rows. ``query`` runs SQL in the session that owns the views."""

    def __init__(self, spark: SparkSession, catalog: Catalog, store: Store, query: Callable[[str, Version], DataFrame]):
        self.spark, self.catalog, self.store, self.query = spark, catalog, store, query

    def merged(self, state: TableState, keys: bool = False) -> DataFrame:
        return merged(self.spark, self.catalog, state, keys)

    def apply(self, state: TableState, rows: DataFrame, inserts: bool = False) -> tuple[TableState, DataFrame, int]:
        """Store ``rows`` (key columns, dead mark, table columns): (state, the rows stored, how many)."""
        rows = rows.select(*state.key_columns, DEAD, *[F.col(f"`{n}`").cast(t).alias(n) for n, t, _, _ in state.diff.columns])
        some_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in state.key_columns])
        frame, path, n = self.store.write(rows, state.name, dead=F.sum(F.col(DEAD).cast("long")), nulls=F.sum(some_null.cast("long")))
        if not n["n"]:
            return state, frame, 0
        after = state.evolve(
            null_keys=state.null_keys or n["nulls"] > 0,
            segments=(*state.segments, frame), paths=(*state.paths, path), rows=state.rows + n["n"], tombstones=state.tombstones + n["dead"], inserts=state.inserts + (n["n"] if inserts else 0)
        )
        after = replace(after, sizes=(*after.sizes, (n["n"], n["dead"])))
        if len(after.segments) > MAX_SEGMENTS:
            # From the newest back, as long as what is older isn't larger than what is put to it.
            first, held = len(after.sizes) - 1, after.sizes[-1][0]
            while first and after.sizes[first - 1][0] <= 2 * held:
                first -= 1
                held += after.sizes[first][0]
            first = min(first, len(after.sizes) - 2)
            after = self.compact(after, first)
        return after, frame, n["n"]

    def compact(self, state: TableState, first: int = 0) -> TableState:
        """Make the segments from ``first`` on one."""
        newest = replace(state, segments=state.segments[first:], rows=sum(n for n, _ in state.sizes[first:]))
        frame, path, n = self.store.write(overlay_rows(newest), state.name, dead=F.sum(F.col(DEAD).cast("long")))
        sizes = (*state.sizes[:first], (n["n"], n["dead"]))
        return replace(state, segments=(*state.segments[:first], frame), paths=(*state.paths[:first], path), sizes=sizes, rows=sum(n for n, _ in sizes), tombstones=sum(d for _, d in sizes))

    def check(self, version: Version, state: TableState, rows: DataFrame, columns: set[str] | None = None) -> None:
        """NOT NULL, CHECK, UNIQUE and foreign keys of rows just written; ``columns`` are those that changed, None for all."""
        meta = state.meta
        tests = [(NotNullViolation, f"{state.name}.{c} is null", F.col(f"`{c}`").isNull()) for c in dict.fromkeys((*meta.pk, *meta.not_null)) if columns is None or c in columns]
        tests += [(CheckViolation, f"{state.name}: {n or k} does not hold", ~F.coalesce(F.expr(rewrite(k)).cast("boolean"), F.lit(True))) for n, k in meta.checks]
        if tests:
            found = rows.select(F.array(*[t for _, _, t in tests]).alias("t")).filter(F.exists("t", lambda x: x)).first()
            if found is not None:
                kind, text, _ = tests[found["t"].index(True)]
                raise kind(text)
        for name, on in meta.uniques:
            if columns is None or columns & set(on):
                cols = [f"`{c}`" for c in on]
                new = rows.select(*cols).dropna().distinct()
                twice = self.merged(state).select(*cols).join(new, list(on), "left_semi").groupBy(*cols).count().filter("count > 1").first()
                if twice is not None:
                    raise UniqueViolation(f"{state.name}: {name} {dict(zip(on, twice))} exists already")
        fk.check_rows(self, version, state, rows, columns)

    # -- insert ---------------------------------------------------------------------------

    def prepare(self, state: TableState, source: DataFrame, columns: Sequence[str] | None) -> tuple[TableState, DataFrame]:
        """Source rows as full rows of the table: named columns, defaults, new ids, key columns."""
        names = list(columns) if columns else state.diff.names[: len(source.columns)]
        if len(names) != len(source.columns):
            raise UnknownColumn(f"{len(names)} columns but {len(source.columns)} values")
        lower = {n.lower(): n for n in state.diff.names}
        unknown = [n for n in names if n.lower() not in lower]
        if unknown:
            raise UnknownColumn(f"{state.name} has no column {unknown[0]}")
        rows = source.toDF(*[f"__v{i}" for i in range(len(names))])
        given = {lower[n.lower()]: F.col(f"__v{i}") for i, n in enumerate(names)}
        if state.meta.auto_id and len(state.meta.pk) == 1 and state.meta.pk[0] not in given:
            state, rows, given[state.meta.pk[0]] = self._number(state, rows)
        out = []
        for n, t, _, _ in state.diff.columns:
            default = state.meta.default_of(n)
            value = given.get(n)
            if value is None:
                value = F.expr(default) if default is not None else F.lit(None)
            out.append(value.cast(t).alias(n))
        return state, self._keyed(state, rows.select(*out))

    def _keyed(self, state: TableState, rows: DataFrame) -> DataFrame:
        if state.meta.pk:
            return rows.select(*key_expressions(state), "*")
        return rows.select(F.lit(f"+{uuid.uuid4().hex}").alias("__k0"), F.monotonically_increasing_id().alias("__k1"), "*")

    def with_next_id(self, state: TableState) -> TableState:
        """New ids start far above the base's."""
        if state.next_id is None:
            top = self.merged(state).agg(F.max(state.meta.pk[0]).cast("long")).first()[0] or 0
            state = replace(state, next_id=max(10 * top, top + 10_000_000))
        return state

    def _number(self, state: TableState, rows: DataFrame):
        """New ids go on without gaps, whatever partition a row is in."""
        state = self.with_next_id(state)
        frame, _, n = self.store.write(rows.withColumn("__m", F.monotonically_increasing_id()), f"{state.name}-new")
        per = frame.groupBy(F.shiftright("__m", 33).alias("__p")).count().orderBy("__p").collect()
        base, offsets = state.next_id, []
        for r in per:
            offsets.append((r["__p"], base))
            base += r["count"]
        state = replace(state, next_id=base)
        if not offsets:
            return state, frame, F.lit(None)
        at = self.spark.createDataFrame(offsets, "__p long, __b long")  # a row for each partition
        rows = frame.join(F.broadcast(at), F.shiftright("__m", 33) == F.col("__p"))
        return state, rows, F.col("__b") + F.col("__m").bitwiseAND((1 << 33) - 1)

    def insert(self, version: Version, state: TableState, source: DataFrame, columns: Sequence[str] | None, on_conflict: str = "error", conflict: Sequence[str] = ()) -> tuple[Version, DataFrame, int]:
        """``on_conflict``: error, ignore (keep what is there) or replace (delete it first)."""
        state, rows = self.prepare(state, source, columns)
        on = list(conflict) or list(state.meta.pk)
        if on_conflict == "ignore" and not conflict:
            # Without a target every unique constraint counts.
            for _, more in state.meta.uniques:
                rows, _, _ = self.store.write(rows.withColumn("__order", F.monotonically_increasing_id()), f"{state.name}-rows")
                taken = self.merged(state).select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(more)])
                rows = self._one_of(rows, more, False).join(taken, [F.col(f"`{c}`") == F.col(f"__c{i}") for i, c in enumerate(more)], "left_anti")
        if on:
            rows, _, _ = self.store.write(rows.withColumn("__order", F.monotonically_increasing_id()), f"{state.name}-rows")
            there = self.merged(state, keys=True)
            same = [F.col(f"`{c}`") == F.col(f"__c{i}") for i, c in enumerate(on)]
            keys = rows.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(on)])
            condition = same[0]
            for s in same[1:]:
                condition = condition & s
            if on_conflict == "error":
                twice = rows.dropna(subset=on).groupBy(*[f"`{c}`" for c in on]).count().filter("count > 1").first()
                taken = there.join(keys, condition, "left_semi").select(*on).first() if twice is None else twice
                if taken is not None:
                    raise UniqueViolation(f"{state.name}: {dict(zip(on, taken))} exists already")
            elif on_conflict == "ignore":
                rows = self._one_of(rows, on, False).join(there.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(on)]), condition, "left_anti")
            else:
                rows = self._one_of(rows, on, True)
                gone = there.join(keys, condition, "left_semi")
                fresh = without_keys(gone, rows.select(*state.key_columns), state.key_columns, None).withColumn(DEAD, F.lit(True))
                after, images, n = self.apply(state, rows.withColumn(DEAD, F.lit(False)).unionByName(fresh))
                version = version.put(after)
                alive = images.filter(~F.col(DEAD))
                self.check(version, after, alive)
                return version, alive, alive.count()
            rows = rows.drop("__order")
        after, images, n = self.apply(state, rows.withColumn(DEAD, F.lit(False)), inserts=True)
        version = version.put(after)
        if n:
            self.check(version, after, images)
        return version, images, n

    def _one_of(self, rows: DataFrame, on: Sequence[str], last: bool) -> DataFrame:
        """Of new rows with equal values in ``on``, the first or the last given; a null equals nothing."""
        order = F.col("__order").desc() if last else F.col("__order").asc()
        rank = F.row_number().over(Window.partitionBy(*[F.col(f"`{c}`") for c in on]).orderBy(order))
        some_null = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in on])
        return rows.withColumn("__rank", rank).filter((F.col("__rank") == 1) | some_null).drop("__rank", "__order")

    # -- update and delete ------------------------------------------------------------------

    def candidates(self, version: Version, state: TableState, alias: str, tail: str, where: str, extra: str = "") -> DataFrame:
        """Key and table columns of the rows that a statement changes, with ``extra`` expressions."""
        alias = alias or state.name
        cols = ", ".join([f"{alias}.{k}" for k in state.key_columns] + [f"{alias}.`{n}`" for n in state.diff.names])
        sql = f"SELECT {cols}{', ' + extra if extra else ''} FROM __k_{state.name} AS {alias}"
        if tail:
            sql += f", {tail}"
        if where:
            sql += f" WHERE {where}"
        return self.query(sql, version)

    def update(self, version: Version, state: TableState, assignments: Sequence[tuple[str, str]], where: str, alias: str = "", tail: str = "", rows: DataFrame | None = None) -> tuple[Version, DataFrame, int]:
        lower = {n.lower(): n for n in state.diff.names}
        for c, _ in assignments:
            if c.lower() not in lower:
                raise UnknownColumn(f"{state.name} has no column {c}")
        named = [(lower[c.lower()], e if e.upper() != "DEFAULT" else (state.meta.default_of(lower[c.lower()]) or "NULL")) for c, e in assignments]
        if rows is None:
            rows = self.candidates(version, state, alias, tail, where, ", ".join(f"({e}) AS __n{i}" for i, (_, e) in enumerate(named)))
        if tail:
            rows = rows.dropDuplicates(state.key_columns)
        changed = {c for c, _ in named}
        new = {c: F.col(f"__n{i}") for i, (c, _) in enumerate(named)}
        images = rows.select(
            *state.key_columns, *[(new[n] if n in new else F.col(f"`{n}`")).cast(t).alias(n) for n, t, _, _ in state.diff.columns], *[F.col(f"`{n}`").alias(f"__o_{n}") for n in sorted(changed)]
        )
        before = state
        if changed & set(state.meta.pk):
            # A row that moves to another key leaves a tombstone at the old one.
            images, _, _ = self.store.write(images, f"{state.name}-moved")
            moved = images.select(*[e.alias(f"__m{i}") for i, e in enumerate(key_expressions(state))], "*")
            target = moved.select(*[F.col(f"__m{i}").alias(k) for i, k in enumerate(state.key_columns)], *[f"`{n}`" for n in state.diff.names])
            if target.groupBy(*state.key_columns).count().filter("count > 1").first() is not None:
                raise UniqueViolation(f"{state.name}: the update gives one key to several rows")
            others = without_keys(self.merged(state, keys=True), images.select(*state.key_columns), state.key_columns, None)
            clash = others.join(target.select(*[F.col(k).alias(f"{k}_y") for k in state.key_columns]), [F.col(k) == F.col(f"{k}_y") for k in state.key_columns], "left_semi").first()
            if clash is not None:
                raise UniqueViolation(f"{state.name}: the update moves a row to a key that exists")
            old = without_keys(images.select(*state.key_columns, *[f"`{n}`" for n in state.diff.names]), target.select(*state.key_columns), state.key_columns, None)
            stored = target.withColumn(DEAD, F.lit(False)).unionByName(old.withColumn(DEAD, F.lit(True)))
        else:
            stored = images.withColumn(DEAD, F.lit(False))
        after, frame, n = self.apply(state, stored)
        if not n:
            return version, frame, 0
        version = version.put(after)
        alive = frame.filter(~F.col(DEAD))
        self.check(version, after, alive, changed)
        if any(changed & set(k.parent_columns) for _, k in fk.children_of(version, state.name)):
            # Old values of the changed rows alone: no other key can be gone.
            fk.check_update(self, version, after, changed, rows.select(*[f"`{n}`" for n in state.diff.names]))
        return version, alive, n if after is not before and not (changed & set(state.meta.pk)) else alive.count()

    def delete(self, version: Version, state: TableState, where: str, alias: str = "", tail: str = "", rows: DataFrame | None = None) -> tuple[Version, DataFrame, int]:
        if rows is None:
            rows = self.candidates(version, state, alias, tail, where)
        if tail:
            rows = rows.dropDuplicates(state.key_columns)
        after, dead, n = self.apply(state, rows.withColumn(DEAD, F.lit(True)))
        if n:
            version = fk.follow_delete(self, version.put(after), after, dead)
        return version, dead, n

    def upsert(self, version: Version, state: TableState, source: DataFrame, columns: Sequence[str] | None, conflict: Sequence[str], assignments: Sequence[tuple[str, str]], where: str = "") -> tuple[Version, DataFrame, int]:
        """INSERT ... ON CONFLICT DO UPDATE: ``assignments`` may use ``excluded``."""
        state, rows = self.prepare(state, source, columns)
        on = list(conflict) or list(state.meta.pk)
        if not on:
            raise NotSupported(f"{state.name} has no key to conflict on")
        rows, _, _ = self.store.write(rows, f"{state.name}-excluded")
        if rows.groupBy(*[f"`{c}`" for c in on]).count().filter("count > 1").first() is not None:
            raise UniqueViolation("ON CONFLICT can't change a row twice")
        # A name of its own: other sessions may upsert at the same time. The frame that uses it is resolved before it goes.
        view = f"__excluded_{uuid.uuid4().hex}"
        rows.select(*[f"`{n}`" for n in state.diff.names]).createOrReplaceTempView(view)
        match = " AND ".join(f"{state.name}.`{c}` = excluded.`{c}`" for c in on)
        lower = {n.lower(): n for n in state.diff.names}
        named = [(lower[c.lower()], e) for c, e in assignments]
        extra = ", ".join(f"({e}) AS __n{i}" for i, (_, e) in enumerate(named))
        try:
            hit = self.candidates(version.put(state), state, state.name, f"{view} AS excluded", match + (f" AND ({where})" if where else ""), extra)
        finally:
            self.spark.catalog.dropTempView(view)
        new = {c: F.col(f"__n{i}") for i, (c, _) in enumerate(named)}
        images = hit.select(*state.key_columns, *[(new[n] if n in new else F.col(f"`{n}`")).cast(t).alias(n) for n, t, _, _ in state.diff.columns])
        there = self.merged(state).select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(on)])
        condition = [F.col(f"`{c}`") == F.col(f"__c{i}") for i, c in enumerate(on)]
        fresh = rows.join(there, condition, "left_anti")
        after, frame, n = self.apply(state, images.unionByName(fresh).withColumn(DEAD, F.lit(False)), inserts=True)
        version = version.put(after)
        if n:
            self.check(version, after, frame)
        return version, frame, n

    def truncate(self, version: Version, state: TableState, cascade: bool = False, seen: frozenset[str] = frozenset()) -> Version:
        seen = seen | {state.name.lower()}
        empty = state.evolve(segments=(), paths=(), sizes=(), rows=0, tombstones=0, inserts=0, diff=replace(state.diff, fully_shadowed=True))
        version = version.put(empty)
        for child, key in fk.children_of(version, state.name):
            if child.name.lower() in seen:
                continue
            if cascade:
                version = self.truncate(version, version.get(child.name), True, seen)
            elif self.merged(child).select(*key.columns).dropna().first() is not None:
                from ..errors import ForeignKeyViolation

                raise ForeignKeyViolation(f"{child.name} refers to {state.name}; truncate both or use CASCADE")
        return version


def require(version: Version, name: str) -> TableState:
    state = version.get(name)
    if state is None:
        raise UnknownTable(f"table {name} does not exist")
    return state
