"""Procedure calls that run, prepare and page statements: sp_executesql, sp_prepare, sp_cursoropen and their kin."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING, Any

from .errors import SyntaxProblem, UnknownTable
from .plans.text import split_top, tokens

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

    from .session import OverlaySession

#: The calls, without their sp_; fixed values.
CALLS = frozenset("executesql prepare prepexec execute unprepare cursoropen cursorfetch cursorclose".split())


def _value(text: str) -> Any:
    """An argument: text, a number or NULL; anything else as it stands."""
    text = text.strip()
    if m := re.fullmatch(r"[Nn]?'((?:[^']|'')*)'", text, re.S):
        return m.group(1).replace("''", "'")
    if text.upper() == "NULL":
        return None
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    return float(text) if re.fullmatch(r"-?\d*\.\d+(?:[eE][+-]?\d+)?", text) else text


def _arguments(text: str) -> tuple[list[Any], dict[str, Any]]:
    """(by place, by name) of ``a, @b = c``; OUTPUT is left out."""
    places, names = [], {}
    for part in split_top(text.rstrip("; ")):
        part = re.sub(r"\s+OUT(?:PUT)?$", "", part, flags=re.I)
        if m := re.match(r"@(\w+)\s*=\s*(.*)$", part, re.S):
            names[m.group(1)] = _value(m.group(2))
        else:
            places.append(_value(part))
    return places, names


def _declared(text: str | None) -> list[str]:
    return re.findall(r"@(\w+)", text or "")


def _bound(sql: str, values: dict[str, Any]) -> str:
    from .session import literal

    out, at = [], 0
    for t in tokens(sql):
        if t.kind == "param" and t.text[0] == "@" and t.text[1:] in values:
            out += [sql[at : t.start], literal(values[t.text[1:]])]
            at = t.end
    return "".join(out) + sql[at:]


def _keep(session: OverlaySession, value: Any) -> int:
    handle = max(session.handles, default=0) + 1
    session.handles[handle] = value
    return handle


def _held(session: OverlaySession, handle: Any) -> Any:
    if handle not in session.handles:
        raise UnknownTable(f"handle {handle} does not exist")
    return session.handles[handle]


def run(session: OverlaySession, call: str, text: str) -> DataFrame:
    """Run one call. Handles come back as a row ``handle``; a handle variable among the arguments is left out."""
    places, names = _arguments(text)
    if call in ("cursoropen", "prepare", "prepexec") and places and str(places[0]).startswith("@"):
        places = places[1:]
    if call == "executesql":
        declared = _declared(places[1] if len(places) > 1 else "")
        values = dict(zip(declared, places[2:])) | names
        return session.sql(_bound(places[0], values))
    if call == "prepare":
        return session._one(_keep(session, (_declared(places[0]), places[1])), "handle", "int")
    if call == "prepexec":
        declared, sql = _declared(places[0]), places[1]
        _keep(session, (declared, sql))
        return session.sql(_bound(sql, dict(zip(declared, places[2:])) | names))
    if call == "execute":
        declared, sql = _held(session, places[0])
        return session.sql(_bound(sql, dict(zip(declared, places[1:])) | names))
    if call == "cursoropen":
        rows = session.sql(places[0])
        return session._one(_keep(session, (rows.schema, rows.toLocalIterator())), "handle", "int")
    if call == "cursorfetch":
        schema, rows = _held(session, places[0])
        n = next((p for p in reversed(places[1:]) if isinstance(p, int)), 1)
        return session.spark.createDataFrame([tuple(r) for _, r in zip(range(n), rows)], schema)
    if call in ("cursorclose", "unprepare"):
        _held(session, places[0])
        del session.handles[places[0]]
        return session._one("CLOSED", "status", "string")
    raise SyntaxProblem(call)
