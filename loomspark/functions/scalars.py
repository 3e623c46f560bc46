"""Dates, limits and validation."""

from __future__ import annotations

import os
from typing import Any
from uuid import UUID

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.errors import ErrorCode, error_response

UUID_FORM = r"^\s*$|^(?:urn:)?(?:uuid:)?\{?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\}?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_iso(value: Column | str, default: Column | None = None) -> Column:
    """An ISO 8601 text as a timestamp; without zone it is UTC; what can't be read gives the default (1970)."""
    default = F.timestamp_seconds(F.lit(0)) if default is None else default
    v = F.replace(_col(value), F.lit("Z"), F.lit("+00:00"))
    day = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    zoned = F.when(v.rlike(day + "$"), F.concat(v, F.lit("T00:00:00+00:00"))).when(v.rlike(day + ".*[+-][0-9]{2}:?[0-9]{2}$"), v).when(v.rlike(day), F.concat(v, F.lit("+00:00")))
    return F.coalesce(F.try_to_timestamp(zoned), default)


def payload_times(created: Column | str, modified: Column | str) -> tuple[Column, Column]:
    """(created, modified) as timestamps; a missing or unreadable modified time is the created one."""
    made = parse_iso(created)
    return made, parse_iso(modified, made)


def clamp_limit(limit: Column | str, default: int = 10, minimum: int = 1, maximum: int = 100_000) -> Column:
    """A usable limit: the default for null and for 0 or less, else within the bounds."""
    limit = _col(limit)
    return F.when(limit.isNull() | (limit <= 0), F.lit(default)).otherwise(F.greatest(F.lit(minimum), F.least(F.lit(maximum), limit)))


def is_uuid(value: Column | str) -> Column:
    """Whether a text is a UUID, with or without dashes, braces or urn prefix; null is none."""
    return F.coalesce(_col(value).rlike(UUID_FORM) & (F.length(F.trim(_col(value))) > 0), F.lit(False))


def parse_uuid(value: str) -> UUID | None:
    """The UUID of a text, or None."""
    try:
        return UUID(value)
    except (ValueError, TypeError, AttributeError):
        return None


def checked_path(path: str, directory: bool = False) -> str | dict[str, Any]:
    """The absolute path if there is such a file (or directory), else an error value."""
    own = os.path.abspath(os.path.expanduser(path or ""))
    if not path or not (os.path.isdir(own) if directory else os.path.isfile(own)):
        return error_response(ErrorCode.NOT_FOUND, f"no {'directory' if directory else 'file'} at {path!r}")
    return own


class _Unset:
    """The value of an argument that wasn't given, where None has a meaning of its own."""

    def __repr__(self) -> str:
        return "UNSET"

    def __bool__(self) -> bool:
        return False


UNSET = _Unset()


def is_set(value: Any) -> bool:
    return value is not UNSET
