"""Errors with SQLSTATE codes."""

from __future__ import annotations

import re


class QueryError(Exception):
    """A statement that cannot be run; ``code`` is its SQLSTATE."""

    code = "XX000"

    def __init__(self, message: str, code: str | None = None, **data: object) -> None:
        super().__init__(message)
        self.code = code or self.code
        self.data = data


class SyntaxProblem(QueryError):
    code = "42601"


class NotSupported(QueryError):
    code = "0A000"


class RelationNotFound(QueryError):
    code = "42P01"


class ColumnNotFound(QueryError):
    code = "42703"


class AmbiguousColumn(QueryError):
    code = "42702"


class AlreadyExists(QueryError):
    code = "42P07"


class TypeMismatch(QueryError):
    code = "42804"


class CastProblem(QueryError):
    code = "42846"


class NoFunction(QueryError):
    code = "42883"


class BadInput(QueryError):
    code = "22P02"


class Violation(QueryError):
    """A constraint does not hold; the code says which kind."""

    code = "23000"


#: Spark's error classes and the SQLSTATE that a client expects for them
SPARK_CODES = {
    "CAST_INVALID_INPUT": "22P02",
    "CAST_OVERFLOW": "22003",
    "ARITHMETIC_OVERFLOW": "22003",
    "DIVIDE_BY_ZERO": "22012",
    "SCALAR_SUBQUERY_TOO_MANY_ROWS": "21000",
    "AMBIGUOUS_REFERENCE": "42702",
    "UNRESOLVED_COLUMN": "42703",
    "UNRESOLVED_ROUTINE": "42883",
    "TABLE_OR_VIEW_NOT_FOUND": "42P01",
    "MISSING_AGGREGATION": "42803",
    "MISSING_GROUP_BY": "42803",
    "INVALID_WHERE_CONDITION": "42803",
    "DATATYPE_MISMATCH": "42883",
    "MALFORMED_RECORD_IN_PARSING": "22P02",
    "PARSE_SYNTAX_ERROR": "42601",
    "NUM_COLUMNS_MISMATCH": "42601",
}


def from_spark(e: Exception) -> QueryError:
    """The engine's error for one that Spark raised."""
    name = e.getCondition() if hasattr(e, "getCondition") else None
    whole = str(e)
    marked = re.search(r"\[[A-Z][A-Z_.]+\][^\n]*", whole)
    text = marked[0] if marked else whole.split("\n")[0]
    if name == "USER_RAISED_EXCEPTION" or "[USER_RAISED_EXCEPTION]" in text:
        code, _, message = text.partition("] ")[2].partition("|")
        if message:
            return QueryError(message.split(" SQLSTATE")[0], code)
    for k, code in SPARK_CODES.items():
        if (name or "").startswith(k) or f"[{k}" in text:
            return QueryError(text, code)
    return QueryError(text)
