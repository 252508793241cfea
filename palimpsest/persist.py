"""A version as JSON beside its parquet segments, and back."""

from __future__ import annotations

import json
from dataclasses import asdict
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from .state import ForeignKey, TableDiff, TableMeta, TableState, Version


def manifest(version: Version) -> dict[str, Any]:
    out = {}
    for name, s in version.tables.items():
        out[name] = {
            "name": s.name, "base": s.base, "meta": asdict(s.meta), "diff": asdict(s.diff), "paths": list(s.paths), "sizes": [list(x) for x in s.sizes], "schemas": [f.schema.json() for f in s.segments],
            "rows": s.rows, "tombstones": s.tombstones, "inserts": s.inserts, "dropped": s.dropped, "null_keys": s.null_keys, "next_id": s.next_id, "stamp": s.stamp,
            # How a segment's stored columns become the current ones, if the schema changed after it was written.
            "current": s.diff.names,
        }
    return {"format": 1, "tables": out}


def _tuples(value: Any) -> Any:
    return tuple(_tuples(v) for v in value) if isinstance(value, list | tuple) else value


def restore(spark: SparkSession, saved: dict[str, Any], bases: Version) -> Version:
    """Unknown fields are ignored and missing ones have their defaults, so older manifests load."""
    version = bases
    for t in saved["tables"].values():
        meta = dict(t["meta"])
        fks = tuple(ForeignKey(**{**k, "columns": tuple(k["columns"]), "parent_columns": tuple(k["parent_columns"])}) for k in meta.pop("fks", []))
        meta = TableMeta(**{k: _tuples(v) for k, v in meta.items()}, fks=fks)
        diff = TableDiff(**{k: _tuples(v) for k, v in t["diff"].items()})
        segments = []
        for path, schema in zip(t.get("paths", []), t.get("schemas", [])):
            segments.append(spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(path))
        rows, tombstones = t.get("rows", 0), t.get("tombstones", 0)
        sizes = t.get("sizes") or [[rows, tombstones], *[[0, 0]] * (len(segments) - 1)][: len(segments)]
        version = version.put(
            TableState(
                t["name"], t["base"], meta, diff, tuple(segments), tuple(t.get("paths", [])), tuple(map(tuple, sizes)), rows, tombstones, t.get("inserts", 0),
                dropped=t.get("dropped", False), null_keys=t.get("null_keys", True), next_id=t.get("next_id"), stamp=t.get("stamp", 0),
            )
        )
    return version
