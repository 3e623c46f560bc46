"""Fusing ranked lists: weighted reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def reciprocal_rank_fusion(ranked: DataFrame, k: int = 60, weights: list[float] | None = None, limit: int | None = 10, item: str | None = None, lists: int | None = None) -> DataFrame:
    """(query_id, key, score, best_rank, ranks, rank[, item]) of `ranked` (query_id, list_id, rank, key).

    score = sum over lists of weight / (k + first rank of the key in the list). A list of weight 0 is
    skipped, a negative k reads as 0, a limit below 1 as 1 (None: no limit). Order: score, then best rank,
    then the key as text. `item` is the column kept from the key's first appearance. Lists are numbered
    from 0; with `weights`, there must be one for each of the `lists`.
    """
    if weights is not None and lists is not None and len(weights) != lists:
        raise ValueError("one weight per list is needed")
    k = max(0, k)
    if weights is None:
        weighted = ranked.withColumn("w", F.lit(1.0))
    else:
        table = F.array(*[F.lit(float(w)) for w in weights])
        weighted = ranked.withColumn("w", F.element_at(table, F.col("list_id") + 1)).filter("w <> 0")
    extra = [F.min_by(item, "rank").alias("item")] if item else []
    first = weighted.groupBy("query_id", "key", "list_id").agg(F.min("rank").alias("rank"), F.first("w").alias("w"), *extra)
    # The lists of a key are few; adding them in their order keeps the sum the same in every run.
    parts = F.array_sort(F.collect_list(F.struct("list_id", "rank", "w")))
    more = [F.min_by("item", "list_id").alias("item")] if item else []
    fused = first.groupBy("query_id", "key").agg(parts.alias("p"), F.min("rank").alias("best_rank"), *more)
    score = F.aggregate("p", F.lit(0.0), lambda s, x: s + x["w"] / (x["rank"] + F.lit(float(k))))
    ranks = F.map_from_entries(F.transform("p", lambda x: F.struct(x["list_id"].cast("int"), x["rank"])))
    fused = fused.select("query_id", "key", score.alias("score"), "best_rank", ranks.alias("ranks"), *(["item"] if item else []))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "best_rank", F.col("key").cast("string"))
    placed = fused.withColumn("rank", F.row_number().over(order))
    return placed if limit is None else placed.filter(F.col("rank") <= max(1, limit))


def fuse_full_outer(dense: DataFrame, sparse: DataFrame, k: int = 60, dense_weight: float = 1.0, sparse_weight: float = 0.8, limit: int | None = 10) -> DataFrame:
    """(query_id, id, score, payload, rank) of two lists (query_id, id, rank, payload), merged by id.

    Of repeated ids in a list the last rank counts; the payload of the dense list goes first; weights of
    0 still give rows, and k isn't clamped. Ties are ordered by id.
    """
    last = lambda d, name: d.groupBy("query_id", "id").agg(F.max("rank").alias(f"{name}_rank"), F.max_by("payload", "rank").alias(f"{name}_payload"))
    both = last(dense, "d").join(last(sparse, "s"), ["query_id", "id"], "full")
    share = lambda w, c: F.coalesce(F.lit(float(w)) / (F.col(c) + F.lit(float(k))), F.lit(0.0))
    fused = both.select("query_id", "id", (share(dense_weight, "d_rank") + share(sparse_weight, "s_rank")).alias("score"), F.coalesce("d_payload", "s_payload").alias("payload"))
    placed = fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return placed if limit is None else placed.filter(F.col("rank") <= max(1, limit))
