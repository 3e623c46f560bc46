"""Errors as values (for tool-like callers) and as rows (for batch work)."""

from __future__ import annotations

from enum import Enum
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ErrorCode(str, Enum):
    """What went wrong, for callers that switch on it."""

    INVALID_INPUT = "INVALID_INPUT"
    NOT_FOUND = "NOT_FOUND"
    DUPLICATE = "DUPLICATE"
    TIMEOUT = "TIMEOUT"
    INTERNAL = "INTERNAL"


def error_response(code: ErrorCode, message: str, **details: Any) -> dict[str, Any]:
    """The error as a plain dictionary."""
    return {"error": True, "code": code.value, "message": message} | ({"details": details} if details else {})


def is_error_response(value: Any) -> bool:
    return isinstance(value, dict) and value.get("error") is True


def errors_by_category(errors: DataFrame, category: str = "category") -> DataFrame:
    """(category, errors): how many error rows each category has."""
    return errors.groupBy(category).agg(F.count(F.lit(1)).alias("errors"))
