"""Attaching per-key values to rows when one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with this many rows is hot.
HOT_ROWS = 200_000
#: At most so many hot keys are broadcast. Keys come by falling count, so the next one holds less than a
#: ten-thousandth of all rows and is no larger than an ordinary task's share; it goes through the shuffle.
MAX_HOT = 10_000


def attach_by_key(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    count: str,
    spread: list[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    max_hot: int = MAX_HOT,
) -> DataFrame:
    """`rows` with the other columns of `per_key` (one row per key), in one pass over `rows`.

    `count` is a column of `per_key` with the number of rows of the key. The at most `max_hot` keys with
    `hot_rows` or more rows are broadcast, which is bounded by construction; their rows already have
    their values and are only spread by a hash of the `spread` columns instead of meeting in one task.
    Everything else joins on the key. Null keys match nothing (inner: left out; left: null values).
    """
    values = [c for c in per_key.columns if c not in keys]
    hot = (
        per_key.filter(F.col(count) >= hot_rows)
        .orderBy(F.desc(count), *keys)
        .limit(max_hot)
        .select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.struct(*values).alias("__hot"))
    )
    on_hot = [rows[k] == hot[f"__h_{k}"] for k in keys]
    marked = rows.join(F.broadcast(hot), on_hot, "left").drop(*[f"__h_{k}" for k in keys])
    salt = F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*spread), F.lit(1 << 20)).cast("int")).otherwise(F.lit(-1))
    marked = marked.withColumn("__salt", salt)
    cold = per_key.select(*keys, F.struct(*values).alias("__cold"), F.lit(-1).alias("__salt"))
    joined = marked.join(cold, [*keys, "__salt"], "left")
    value = F.coalesce("__hot", "__cold")
    if how == "inner":
        joined = joined.filter(value.isNotNull())
    return joined.withColumn("__v", value).select(*[joined[c] for c in rows.columns], *[F.col(f"__v.{c}").alias(c) for c in values])


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT) -> DataFrame:
    """The inner join of two tables on `keys`, where one key may hold a large part of the rows of `left`.

    `right` may have several rows per key. The at most `max_hot` keys with `hot_rows` or more rows on the
    left are known by a broadcast of that bound; a left row of such a key goes to one of as many shares
    as the key has parts of that size, by a hash of the `spread` columns, and the right rows of the key to
    each of them. All other rows are joined on the key alone. Null keys match nothing.
    """
    known = left.dropna(subset=keys)
    hot = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= hot_rows).orderBy(F.desc("__n"), *keys).limit(max_hot)
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col("__n") / F.lit(hot_rows)).cast("int").alias("__shares")))
    shares = F.coalesce("__shares", F.lit(1))
    own = known.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*spread), shares).cast("int")).drop("__shares")
    other = right.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), shares - 1))).drop("__shares")
    return own.join(other, [*keys, "__salt"]).drop("__salt")
