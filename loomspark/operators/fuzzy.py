"""Nearest vocabulary token for unknown tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import LENGTH_WINDOW, similarity


def _edits(size: Column, threshold: float) -> Column:
    """The most edits that a token of this length can be away from one that is up to two characters longer."""
    longest = size + LENGTH_WINDOW
    return F.least(F.floor(longest * F.lit(1 - threshold) + F.lit(1e-9)), size).cast("int")


def _segment(size: Column, edits: Column, at: Column) -> tuple[Column, Column]:
    """(offset, length) of one of edits + 1 even segments of a token."""
    begin = F.floor(at * size / (edits + 1)).cast("int")
    return begin, F.floor((at + 1) * size / (edits + 1)).cast("int") - begin


def nearest_tokens(unknown: DataFrame, vocabulary: DataFrame, threshold: float = 0.75, live_only: bool = True) -> DataFrame:
    """(token, match, idx, similarity): for each distinct token the most similar vocabulary token.

    `vocabulary` is (token, idx, doc_freq). Candidates differ in length by at most two characters. Cut
    into one segment more than there may be edits, a vocabulary token keeps at least one segment
    unharmed, which the unknown token then holds near the same place: an equi-join on (length, segment
    number, segment) finds all candidates, and only these are compared. The best similarity wins, then the
    lowest idx. `live_only` leaves out candidates that no document has. Tokens without a match give no row.
    """
    threshold = max(0.0, threshold)
    wanted = unknown.select("token").filter(F.length("token") > 0).distinct()
    lengths = F.sequence(F.greatest(F.lit(1), F.length("token") - LENGTH_WINDOW), F.length("token") + LENGTH_WINDOW)
    probe = wanted.select("token", F.explode(lengths).alias("size")).withColumn("edits", _edits(F.col("size"), threshold))
    probe = probe.select("*", F.explode(F.sequence(F.lit(0), F.col("edits"))).alias("at"))
    begin, width = _segment(F.col("size"), F.col("edits"), F.col("at"))
    probe = probe.select("token", "size", "at", begin.alias("begin"), width.alias("width"), F.explode(F.sequence(-F.col("edits"), F.col("edits"))).alias("shift"))
    start = F.col("begin") + F.col("shift")
    probe = probe.filter((start >= 0) & (start + F.col("width") <= F.length("token")))
    probe = probe.select("token", "size", "at", F.substr("token", start + 1, F.col("width")).alias("segment")).distinct()

    pool = vocabulary.filter("doc_freq > 0") if live_only else vocabulary
    pool = pool.filter(F.length("token") > 0).select(F.col("token").alias("match"), "idx", F.length("token").alias("size")).withColumn("edits", _edits(F.col("size"), threshold))
    pool = pool.select("match", "idx", "size", "edits", F.explode(F.sequence(F.lit(0), F.col("edits"))).alias("at"))
    begin, width = _segment(F.col("size"), F.col("edits"), F.col("at"))
    pool = pool.select("match", "idx", "size", "at", F.substr("match", begin + 1, width).alias("segment"))

    pairs = probe.join(pool, ["size", "at", "segment"])
    near = pairs.filter(F.levenshtein("token", "match") <= F.ceil(F.greatest(F.length("token"), F.length("match")) * F.lit(1 - threshold) + F.lit(1e-9)))
    scored = near.withColumn("similarity", similarity("token", "match")).filter((F.col("similarity") >= threshold) & (F.col("similarity") > 0))
    best = F.max_by(F.struct("match", "idx", "similarity"), F.struct("similarity", -F.col("idx"))).alias("best")
    return scored.groupBy("token").agg(best).select("token", "best.match", "best.idx", "best.similarity")
