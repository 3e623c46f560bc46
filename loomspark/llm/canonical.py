"""Duplicates hidden by formatting: canonical form, 128-bit hash, counted groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators.skew import HOT_ROWS, attach_by_key


def canonical_value(value: Column | str) -> Column:
    """The letters and digits of a value in lower case; spaces, punctuation and all else are dropped."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{Nd}]", "")


def with_canonical_hash(df: DataFrame, fields: list[str], digest_hex: int = 32) -> DataFrame:
    """`df` with __key (128-bit digest) and __check (an independent 64-bit hash) of its canonical record.

    The canonical record is the sorted list of canonical field values, so the order of the fields does
    not matter. Rows where a field is null or has no letter or digit are left out. `digest_hex` shortens
    the digest, for tests of collisions.
    """
    parts = F.array(*[canonical_value(f) for f in fields])
    text = F.array_join(F.array_sort(parts), "\u0001")
    return (
        df.withColumn("__parts", parts)
        .filter(F.forall("__parts", lambda p: p.isNotNull() & (p != "")))
        .withColumn("__text", text)
        .withColumn("__key", F.unhex(F.substring(F.md5("__text"), 1, digest_hex)))
        .withColumn("__check", F.xxhash64(F.lit(7919), "__text"))
        .drop("__parts", "__text")
    )


def collapse_variants(df: DataFrame, id_col: str, fields: list[str], digest_hex: int = 32) -> DataFrame:
    """One row per distinct canonical record: its smallest id, the fields as that row has them, copies.

    Counting is partial on each input partition first, so a group that holds a third of all rows sends
    one row per partition. Two different records with the same digest differ in the check hash, which is
    part of the grouping key, so a collision never merges them. Repeated rows count as copies; an empty
    table gives an empty result; a null id counts as the largest id; columns named like the helper
    columns (leading double underscore) are not supported, any others are ignored.
    """
    own = with_canonical_hash(df.select(id_col, *fields), fields, digest_hex)
    first = F.min(F.struct(F.col(id_col).isNull(), *[F.col(c) for c in (id_col, *fields)])).alias("__first")
    return (
        own.groupBy("__key", "__check")
        .agg(first, F.count(F.lit(1)).alias("copies"))
        .select(*[F.col(f"__first.{c}").alias(c) for c in (id_col, *fields)], "copies")
    )


def variant_members(df: DataFrame, id_col: str, fields: list[str], digest_hex: int = 32, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(first_id, id) for every row of a group with two or more ids, but the row with the smallest id.

    The groups' smallest ids come from a counted aggregate; only groups with copies go back to the rows,
    the largest of them by broadcast of at most a thousand keys (see attach_by_key).
    """
    own = with_canonical_hash(df.select(id_col, *fields).filter(F.col(id_col).isNotNull()), fields, digest_hex).select(id_col, "__key", "__check")
    groups = own.groupBy("__key", "__check").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    joined = attach_by_key(own, groups, ["__key", "__check"], "copies", [id_col], hot_rows=hot_rows)
    return joined.filter(F.col(id_col) != F.col("first_id")).select("first_id", id_col)
