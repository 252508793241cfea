"""Calls for agents and scripts: JSON in, JSON out."""

from __future__ import annotations

import json
from typing import Any

from .errors import NotFound, OverlayError
from .operators.documents import Documents, decode, encode
from .operators.kv import KeyValue
from .session import OverlaySession


def db_query(session: OverlaySession, sql: str, limit: int = 1000) -> str:
    """Any statement: rows of a read (``limit`` of them are shown), or how many rows a write changed; errors as JSON."""
    try:
        df = session.sql(sql)
        rows = [json.loads(r) for r in df.limit(limit).toJSON().collect()]
        return json.dumps({"columns": df.columns, "rows": rows})
    except OverlayError as e:
        return json.dumps({"error": str(e), "sqlstate": e.sqlstate})


def _plain(value: Any) -> Any:
    if isinstance(value, list | tuple):
        return [v.asDict(True) if hasattr(v, "asDict") else _plain(v) for v in value]
    return value


def kv_command(store: KeyValue, text: str) -> str:
    """One command as text, quoted as in a shell."""
    import shlex

    return json.dumps(_plain(store.execute(*shlex.split(text))), default=str)


def kv_get(store: KeyValue, key: str) -> str:
    return json.dumps(store.execute("GET", key))


def kv_hgetall(store: KeyValue, key: str) -> str:
    return json.dumps(store.execute("HGETALL", key))


def kv_keys(store: KeyValue, pattern: str = "*") -> str:
    return json.dumps(store.execute("KEYS", pattern))


def doc_get(store: Documents, path: str) -> str:
    try:
        return encode(store.get(path))
    except NotFound:
        return "null"


def doc_list(store: Documents, collection: str, page_size: int = 100, token: str | None = None) -> str:
    page, more = store.list(collection, page_size, token)
    return encode({"documents": [{"path": p, "fields": d} for p, d in page], "next": more})


def doc_query(store: Documents, collection: str, filter: Any = None, order: Any = (), limit: int = 100) -> str:
    rows = store.query(collection, filter, [tuple(o) for o in order], limit).select("path", "fields").collect()
    return encode([{"path": r["path"], "fields": decode(r["fields"])} for r in rows])
