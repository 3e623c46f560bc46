"""A registry of content hashes: (content_hash, uuid, path, doc_type, status, registered_at, last_verified)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def register(registry: DataFrame, new: DataFrame, order: str = "registered_at") -> DataFrame:
    """The registry after the rows of `new`, one by one in their `order`; each evicts those with its hash or its uuid.

    Among the new rows, one survives if no later one has its hash or its uuid, since an evicting row leaves
    nothing behind that it replaced, evicted later or not.
    """
    at = F.struct(order, "content_hash", "uuid")
    own = new.withColumn("__at", at)
    by_hash = own.groupBy("content_hash").agg(F.max("__at").alias("__h"))
    by_uuid = own.groupBy("uuid").agg(F.max("__at").alias("__u"))
    last = own.join(by_hash, "content_hash").join(by_uuid, "uuid").filter((F.col("__at") == F.col("__h")) & (F.col("__at") == F.col("__u")))
    kept = registry.join(new.select("content_hash"), "content_hash", "left_anti").join(new.select("uuid"), "uuid", "left_anti")
    return kept.unionByName(last.dropDuplicates(["content_hash", "uuid"]).select(*new.columns), allowMissingColumns=True)


def lookup(registry: DataFrame, wanted: DataFrame, by: str = "content_hash") -> DataFrame:
    """The entries of `wanted`, a table with the column `by` (content_hash or uuid)."""
    return registry.join(wanted.select(by).distinct(), by, "left_semi")


def update_entries(registry: DataFrame, changes: DataFrame, by: str = "content_hash") -> DataFrame:
    """The registry with the other columns of `changes` (path, status) on its entries; null leaves a value."""
    values = [c for c in changes.columns if c != by]
    own = changes.select(by, *[F.col(c).alias(f"__{c}") for c in values])
    joined = registry.join(own, by, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in values else F.col(c) for c in registry.columns])


def mark_verified(registry: DataFrame, wanted: DataFrame, now: dt.datetime | None = None, by: str = "content_hash") -> DataFrame:
    own = wanted.select(by).distinct().withColumn("__v", F.lit(True))
    stamp = (F.lit(now) if now else F.current_timestamp()).cast(registry.schema["last_verified"].dataType)
    return registry.join(own, by, "left").withColumn("last_verified", F.when(F.col("__v"), stamp).otherwise(F.col("last_verified"))).select(*registry.columns)


def delete(registry: DataFrame, gone: DataFrame, by: str = "content_hash") -> DataFrame:
    return registry.join(gone.select(by), by, "left_anti")


def by_status(registry: DataFrame, status: str, limit: int | None = None) -> DataFrame:
    """The entries of a status; a limit of 0 gives none, None all."""
    own = registry.filter(F.col("status") == status)
    return own if limit is None else own.orderBy("content_hash").limit(max(0, limit))


def count(registry: DataFrame, status: str | None = None) -> int:
    return (registry if status is None else registry.filter(F.col("status") == status)).count()
