"""Functions of other SQL dialects as column expressions, for the DataFrame API.

The SQL front door rewrites the same names in text (``plans/dialect.py``).
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_get(column: Column | str, *path: str | int, text: bool = True) -> Column:
    """``->`` and ``->>`` along a path of names and positions; null where there is nothing."""
    where = "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path)
    found = F.get_json_object(column, where)
    return found if text else F.when(found.isNotNull(), found)


def json_contains(column: Column | str, wanted: dict[str, Any]) -> Column:
    """``@>``: the object has all of these fields with these values, nested objects likewise."""
    out = F.lit(True)
    for k, v in wanted.items():
        if isinstance(v, dict):
            out = out & json_contains(F.get_json_object(column, f"$['{k}']"), v)
        else:
            text = "true" if v is True else "false" if v is False else v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))
            out = out & (F.get_json_object(column, f"$['{k}']") == F.lit(text))
    return F.coalesce(out, F.lit(False))


def json_build_object(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def equals_any(value: Column | Any, array: Column) -> Column:
    """``value = ANY(array)``."""
    return F.array_contains(array, value)


def epoch(ts: Column | str) -> Column:
    """Seconds since 1970 with fractions."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")) / 1e6


def total(column: Column | str) -> Column:
    """A sum as double that is 0 without rows."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.sum(c.cast("double")), F.lit(0.0))


def checksum_agg(*columns: Column | str) -> Column:
    return F.bit_xor(F.hash(*columns))


def group_concat(column: Column | str, separator: str = ",") -> Column:
    """Texts of a group in order of text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.array_join(F.array_sort(F.collect_list(c.cast("string"))), separator)


def json_agg(column: Column | str) -> Column:
    return F.to_json(F.array_sort(F.collect_list(column)))


def json_object_agg(key: Column, value: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v"))))))


def generate_series(start: Column | Any, stop: Column | Any, step: Column | Any = 1) -> Column:
    """A row for each value from start to stop."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.explode(F.sequence(as_column(start), as_column(stop), as_column(step)))
