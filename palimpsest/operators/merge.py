"""The merged relation of a table: changed rows beside the base rows that no change covers.

    merged(T) = images(T)  UNION ALL BY NAME  adapt(base(T) LEFT ANTI JOIN keys(T))

All reads run over it, so Catalyst pushes filters and pruned columns through
the union and the anti join into the base scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import Catalog
from ..state import DEAD, TableState

#: Keys beyond this many are joined as Spark sees fit, not broadcast.
BROADCAST_KEYS = 500_000


def without_keys(df: DataFrame, keys: DataFrame, columns: list[str], n: int | None, nulls: bool = True) -> DataFrame:
    """Rows of ``df`` whose key isn't among ``keys``. The key side is broadcast only if ``n`` is known to be small.
    Without ``nulls`` among the keys, plain equality is enough, which joins faster."""
    hinted = F.broadcast(keys) if n is not None and n <= BROADCAST_KEYS else keys
    renamed = hinted.toDF(*[f"{c}_x" for c in columns])
    same = (lambda a, b: a.eqNullSafe(b)) if nulls else (lambda a, b: a == b)
    return df.join(renamed, reduce(lambda a, b: a & b, [same(F.col(c), F.col(f"{c}_x")) for c in columns]), "left_anti")


def overlay_keys(state: TableState) -> DataFrame:
    """Keys of all segments; a key may come several times."""
    return reduce(DataFrame.union, [s.select(*state.key_columns) for s in state.segments])


def overlay_rows(state: TableState) -> DataFrame | None:
    """Images and tombstones of all segments, the newest of each key."""
    out = None
    for segment in state.segments:
        if out is None:
            out = segment
        else:
            out = without_keys(out, segment.select(*state.key_columns), state.key_columns, state.rows, state.null_keys).unionByName(segment)
    return out


def adapt(base: DataFrame, state: TableState, keys: bool) -> DataFrame:
    """Base rows in the current schema: renamed, dropped, retyped and added columns."""
    columns = []
    for name, kind, source, default in state.diff.columns:
        if source is None:
            columns.append((F.expr(default) if default is not None else F.lit(None)).cast(kind).alias(name))
        elif base.schema[source].dataType.simpleString() == kind:
            columns.append(F.col(f"`{source}`").alias(name))
        else:
            columns.append(F.col(f"`{source}`").cast(kind).alias(name))
    return base.select(*(state.key_columns if keys else []), *columns)


def merged(spark: SparkSession, catalog: Catalog, state: TableState, keys: bool = False) -> DataFrame:
    """The table as its user sees it; with ``keys``, its overlay key columns first."""
    names = [*(state.key_columns if keys else []), *[f"`{c}`" for c in state.diff.names]]
    rows = overlay_rows(state)
    images = None
    if rows is not None and state.rows > state.tombstones:
        images = rows.filter(~F.col(DEAD)).select(*names)
    if state.base is None or state.diff.fully_shadowed or state.diff.new_table:
        if images is not None:
            return images
        empty = spark.createDataFrame([], state.diff.schema())
        if keys:
            empty = empty.select(*[F.lit(None).cast(t).alias(k) for k, t in zip(state.key_columns, key_types(state))], "*")
        return empty
    if not state.segments:
        return adapt(catalog.base(state.base).read(spark, keys), state, keys)
    base = catalog.base(state.base).read(spark, True)
    changed, on = overlay_keys(state), state.key_columns
    if not state.meta.pk and catalog.one_file(state.base):
        # In one file a row's place is its number: no file name is read, and the join is on one long.
        changed, on = changed.filter(~F.col(on[0]).startswith("+")).select(on[1]), on[1:]
    clean = without_keys(base, changed, on, state.rows, state.null_keys)
    out = adapt(clean, state, keys)
    return out if images is None else images.unionByName(out)


def key_types(state: TableState) -> list[str]:
    if not state.meta.pk:
        return ["string", "bigint"]
    kinds = {c[0]: c[1] for c in state.diff.columns}
    return [kinds[c] for c in state.meta.pk]


def key_expressions(state: TableState) -> list[Column]:
    """Overlay key columns from a row's own columns; only for tables with a key."""
    return [F.col(f"`{c}`").cast(t).alias(k) for c, k, t in zip(state.meta.pk, state.key_columns, key_types(state))]
