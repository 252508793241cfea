"""Errors of the overlay engine, each with an SQLSTATE where SQL has one."""

from __future__ import annotations


class OverlayError(Exception):
    sqlstate = "XX000"


class NotSupported(OverlayError):
    sqlstate = "0A000"


class SyntaxProblem(OverlayError):
    sqlstate = "42601"


class UnknownTable(OverlayError):
    sqlstate = "42P01"


class UnknownColumn(OverlayError):
    sqlstate = "42703"


class UniqueViolation(OverlayError):
    sqlstate = "23505"


class NotNullViolation(OverlayError):
    sqlstate = "23502"


class CheckViolation(OverlayError):
    sqlstate = "23514"


class CardinalityViolation(OverlayError):
    """Several source rows for one row that a MERGE changes."""

    sqlstate = "21000"


class ForeignKeyViolation(OverlayError):
    sqlstate = "23503"


class TransactionState(OverlayError):
    sqlstate = "25P02"


class Conflict(OverlayError):
    """Another session changed the same table since this transaction began."""

    sqlstate = "40001"


class WriteGuard(OverlayError):
    """Something tried to write to a base table."""

    sqlstate = "25006"


class PreconditionFailed(OverlayError):
    sqlstate = "P0412"


class NotFound(OverlayError):
    sqlstate = "P0404"
