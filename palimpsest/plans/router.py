"""Which way a classified statement goes, given what the overlay holds."""

from __future__ import annotations

import enum
from collections.abc import Callable

from ..errors import WriteGuard
from .classify import Classification, Op, Sub


class Strategy(enum.Enum):
    BASE_DIRECT = "BASE_DIRECT"
    MERGED_READ = "MERGED_READ"
    JOIN_MERGED = "JOIN_MERGED"
    OVERLAY_WRITE = "OVERLAY_WRITE"
    HYDRATE_AND_WRITE = "HYDRATE_AND_WRITE"
    OVERLAY_DELETE = "OVERLAY_DELETE"
    TRUNCATE = "TRUNCATE"
    OVERLAY_DDL = "OVERLAY_DDL"
    TRANSACTION = "TRANSACTION"
    SESSION = "SESSION"
    LISTEN_ONLY = "LISTEN_ONLY"
    NOT_SUPPORTED = "NOT_SUPPORTED"


def route(c: Classification, affected: Callable[[str], bool]) -> Strategy:
    """``affected`` says whether a table has local rows, deletions or a changed schema."""
    strategy = _route(c, affected)
    if c.op in (Op.WRITE, Op.DDL) and strategy is Strategy.BASE_DIRECT:
        raise WriteGuard("a write was about to go to the base")
    return strategy


def _route(c: Classification, affected: Callable[[str], bool]) -> Strategy:
    if c.sub in (Sub.NOT_SUPPORTED, Sub.NOTIFY):
        return Strategy.NOT_SUPPORTED
    touched = any(affected(t) for t in c.tables)
    if c.op is Op.READ:
        if not touched:
            return Strategy.BASE_DIRECT
        if c.has_set_op or c.is_complex or c.has_aggregate or not c.is_join:
            return Strategy.MERGED_READ
        return Strategy.JOIN_MERGED
    if c.op is Op.WRITE:
        return {
            Sub.INSERT: Strategy.HYDRATE_AND_WRITE if c.has_on_conflict else Strategy.OVERLAY_WRITE,
            Sub.UPDATE: Strategy.HYDRATE_AND_WRITE,
            Sub.MERGE: Strategy.HYDRATE_AND_WRITE,
            Sub.DELETE: Strategy.OVERLAY_DELETE,
            Sub.TRUNCATE: Strategy.TRUNCATE,
        }.get(c.sub, Strategy.OVERLAY_WRITE)
    if c.op is Op.DDL:
        return Strategy.OVERLAY_DDL
    if c.op is Op.TRANSACTION:
        return Strategy.TRANSACTION
    if c.sub is Sub.EXPLAIN:
        return Strategy.NOT_SUPPORTED if touched else Strategy.BASE_DIRECT
    if c.sub is Sub.CURSOR:
        return Strategy.MERGED_READ
    if c.sub is Sub.LISTEN:
        return Strategy.LISTEN_ONLY
    if c.sub in (Sub.SET, Sub.DEALLOCATE):
        return Strategy.SESSION
    if c.sub is Sub.PREPARE:
        return Strategy.OVERLAY_WRITE
    return Strategy.BASE_DIRECT
