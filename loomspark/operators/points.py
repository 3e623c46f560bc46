"""Rows of a collection: constructors, typed payloads, and changes by id or by filter."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.ids import point_id
from loomspark.sources.tables import upsert

#: Whole numbers that may not be negative, by payload type (fixed values).
NOT_NEGATIVE = {"note_chunk": ("chunk_index", "char_start", "char_end"), "code_file": ("line_count", "size"), "code_chunk": ("start_line", "end_line")}


# The fields of each kind of payload: name, type, whether it must be there, default.
_CHUNK = (("start_line", "int", True, None), ("end_line", "int", True, None), ("content", "string", True, None))
PAYLOADS = {
    "note": (
        ("note_id", "string", True, None), ("title", "string", True, None), ("tags", "array<string>", False, "array()"), ("category", "string", False, None),
        ("created", "string", True, None), ("modified", "string", True, None), ("note_hash", "string", True, None),
    ),
    "note_chunk": (
        *_CHUNK, ("note_id", "string", True, None), ("title", "string", True, None), ("chunk_index", "int", True, None), ("section_title", "string", False, None),
        ("tags", "array<string>", False, "array()"), ("category", "string", False, None),
    ),
    "code_file": (
        ("path", "string", True, None), ("abs_path", "string", True, None), ("language", "string", True, None), ("file_hash", "string", True, None), ("summary", "string", False, "''"),
        ("line_count", "int", True, None), ("size_bytes", "int", True, None), ("mtime", "double", True, None),
    ),
    "code_chunk": (
        *_CHUNK, ("path", "string", True, None), ("abs_path", "string", True, None), ("language", "string", True, None), ("file_hash", "string", True, None),
        ("chunk_type", "string", True, None), ("name", "string", True, None), ("context", "string", False, None),
    ),
}
# What `type` says of each kind.
PAYLOAD_TYPES = {"note": "note", "note_chunk": "chunk", "code_file": "file", "code_chunk": "chunk"}


def typed_payloads(df: DataFrame, kind: str) -> DataFrame:
    """`df` with `type`, the fields of a kind of payload in their types (defaults where null or not there), its other columns, and `problem`.

    problem is null for a payload that can be stored; otherwise it names the first field that is missing,
    isn't of its type or is a negative whole number.
    """
    fields = PAYLOADS[kind]
    shown, checks = [F.lit(PAYLOAD_TYPES[kind]).alias("type")], []
    for name, kind_of, needed, default in fields:
        raw = F.col(name) if name in df.columns else F.lit(None)
        value = raw.cast(kind_of) if kind_of.startswith("array") or name not in df.columns or dict(df.dtypes)[name] == kind_of else raw.try_cast(kind_of)
        if default:
            value = F.coalesce(value, F.expr(default).cast(kind_of))
        shown.append(value.alias(name))
        if needed:
            checks.append(F.when(raw.isNull(), F.lit(f"{name} is missing")))
        if not kind_of.startswith("array"):
            checks.append(F.when(raw.isNotNull() & value.isNull(), F.lit(f"{name} is not of its type")))
        if kind_of == "int":
            checks.append(F.when(value < 0, F.lit(f"{name} is negative")))
    names = {"type", "problem", *(f[0] for f in fields)}
    return df.select(*shown, *[c for c in df.columns if c not in names], F.coalesce(*checks).alias("problem"))


def sparse_struct(indices: Column | str, values: Column | str) -> Column:
    return F.struct(F.col(indices).alias("indices") if isinstance(indices, str) else indices.alias("indices"), F.col(values).alias("values") if isinstance(values, str) else values.alias("values"))


def point(key: Column | str, dense: Column | str | None = None, sparse: Column | None = None, payload: Column | None = None) -> Column:
    """A point whose id follows from a key."""
    key = F.col(key) if isinstance(key, str) else key
    dense = F.lit(None).cast("array<float>") if dense is None else F.col(dense) if isinstance(dense, str) else dense
    none = F.lit(None).cast("struct<indices:array<int>,values:array<double>>")
    return F.struct(point_id(key).alias("id"), dense.alias("dense"), (none if sparse is None else sparse).alias("sparse"), (F.lit(None).cast("string") if payload is None else payload).alias("payload"))


def invalid_payloads(points: DataFrame) -> DataFrame:
    """The rows whose type forbids a negative number that they have."""
    bad = F.lit(False)
    for kind, fields in NOT_NEGATIVE.items():
        for f in fields:
            if f in points.columns:
                bad = bad | ((F.col("type") == kind) & (F.col(f) < 0))
    return points.filter(bad)


def upsert_points(points: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """The last write of an id wins."""
    return upsert(points, new, ["id"], order)


def delete_by_filter(points: DataFrame, field: str, value: Any) -> DataFrame:
    return points.filter(~F.col(field).eqNullSafe(F.lit(value)))


def delete_points(points: DataFrame, ids: DataFrame) -> DataFrame:
    return points.join(ids.select("id"), "id", "left_anti")


def update_payload(points: DataFrame, where: Column, values: dict[str, Any]) -> DataFrame:
    """The points with the given columns set where the condition holds; new columns are null elsewhere."""
    hit = F.coalesce(where, F.lit(False))
    return points.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k) if k in points.columns else F.lit(None)) for k, v in values.items()})


def scroll(points: DataFrame, where: Column | None = None, fields: list[str] | None = None, most: int | None = None, cap: int = 100_000) -> DataFrame:
    """A filtered scan of some columns in order of id; `most` None means `cap`, 0 no limit. Rows without any value are dropped."""
    own = points if where is None else points.filter(where)
    if fields:
        own = own.select("id", *fields).filter(F.coalesce(*[F.col(f).isNotNull() & F.lit(True) for f in fields]) if len(fields) == 1 else F.greatest(*[F.col(f).isNotNull() for f in fields]))
    limit = cap if most is None else most
    return own.orderBy("id").limit(limit) if limit else own


def retrieve(points: DataFrame, ids: DataFrame, vectors: bool = False) -> DataFrame:
    """The points of `ids` (id), without their vectors unless asked for."""
    own = points.join(ids.select("id").distinct(), "id", "left_semi")
    return own if vectors else own.drop("dense", "sparse")
