"""Indexing pipelines: from facts or glossary entries to points and a vocabulary that describes them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import ids
from loomspark.functions.text import tokens
from loomspark.operators import vocabulary as voc
from loomspark.operators.embedding import Embedder, embed
from loomspark.operators.fragments import is_derived
from loomspark.operators.points import delete_points, upsert_points
from loomspark.operators.tfidf import packed

#: How much of a definition is kept for display (fixed value).
SHOWN_DEFINITION = 2000


@dataclass
class Indexed:
    points: DataFrame
    state: voc.State
    total: int
    indexed: int


def fact_payloads(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts with their searchable text, normalized names, source types and flags of their sources' states."""
    flag = lambda s: F.max((F.col("status") == s).cast("int")).cast("boolean").alias(f"has_{s}_source")
    of = sources.groupBy(F.col("fact_id").alias("id")).agg(F.sort_array(F.collect_set("source_type")).alias("source_types"), F.count(F.lit(1)).alias("source_count"), flag("deleted"), flag("modified"), flag("relocated"))
    own = facts.filter("predicate IS NOT NULL AND object IS NOT NULL").join(of, "id", "left")
    no = F.lit(False)
    return own.select(
        ids.point_id(F.concat(F.lit("fact:"), "id")).alias("point_id"), F.lit("fact").alias("type"), F.col("id").alias("fact_id"), "subject", "subject_type", "predicate", "object", "object_type",
        F.lower("subject").alias("subject_normalized"), F.lower("object").alias("object_normalized"), "context", "confidence", "valid_from", "valid_to",
        F.coalesce("source_types", F.array().cast("array<string>")).alias("source_types"), F.coalesce("source_count", F.lit(0)).alias("source_count"),
        *[F.coalesce(f"has_{s}_source", no).alias(f"has_{s}_source") for s in ("deleted", "modified", "relocated")], "created", "modified",
        ids.fact_text("subject", "predicate", "object", "subject_type", "object_type", "context").alias("content"), F.lit("content").alias("embedding_text_field"),
    )


def glossary_payloads(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entries as points: the definition cut for display, the whole text kept to embed from."""
    listed = aliases.groupBy(F.col("entry_id").alias("id")).agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    own = entries.join(listed, "id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    return own.select(
        ids.point_id(F.concat(F.lit("glossary:"), "id")).alias("point_id"), F.lit("glossary").alias("type"), F.col("id").alias("glossary_id"), "term", F.lower("term").alias("term_normalized"), "expansion",
        F.substring("definition", 1, SHOWN_DEFINITION).alias("definition"), "domain", "aliases", ids.glossary_text("term", "expansion", "definition", "domain", "aliases").alias("embedding_text"),
        "created", "modified", ids.payload_hash("term", "expansion", "definition").alias("entry_hash"),
    )


def text_frequencies(payloads: DataFrame, codebase_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(frequencies, sizes) of the payload texts as one corpus."""
    each = payloads.select("point_id", F.explode(F.array_distinct(tokens(text))).alias("token"))
    frequencies = each.groupBy("token").agg(F.count(F.lit(1)).alias("doc_freq")).select(F.lit(codebase_id).alias("codebase_id"), "token", "doc_freq")
    sizes = payloads.agg(F.count(F.lit(1)).alias("doc_count")).select(F.lit(codebase_id).alias("codebase_id"), "doc_count")
    return frequencies, sizes


def index_all(payloads: DataFrame, state: voc.State, codebase_id: str, text: str, make: Callable[[], Embedder], existing: DataFrame | None = None, force: bool = False) -> Indexed:
    """Points (payload columns, dense, sparse) for all payloads, after their tokens are in the vocabulary.

    The whole corpus is registered first, so a text never meets a vocabulary without its tokens, and the
    contribution then describes exactly the points. Points that exist are kept unless `force`; only the
    missing texts are embedded, each distinct one once.
    """
    frequencies, sizes = text_frequencies(payloads, codebase_id, text)
    after = voc.register(state, frequencies, sizes, check=False)
    todo = payloads
    kept = None
    if existing is not None and not force:
        kept = existing.join(payloads.select("point_id"), "point_id", "left_semi")
        todo = payloads.join(existing.select("point_id"), "point_id", "left_anti")
    tf = voc.document_vectors(after, todo, "point_id", text)
    sparse = packed(tf.withColumnRenamed("doc_id", "point_id"), "point_id", "tf")
    dense = embed(todo, text, make).withColumnRenamed("embedding", "dense").withColumnRenamed("text", "__text")
    made = todo.join(sparse, "point_id", "left").join(dense, todo[text] == dense["__text"], "left").drop("__text")
    points = made if kept is None else kept.unionByName(made, allowMissingColumns=True)
    return Indexed(points, after, payloads.count(), todo.count())


def stored_tokens(points: DataFrame, text: str = "content") -> DataFrame:
    """(point_id, tokens) read back from stored texts; derived fragments and rows without text are skipped."""
    own = points.filter(~is_derived()) if "fragment" in points.columns else points
    return own.filter(F.col(text).isNotNull()).select("point_id", F.array_distinct(tokens(text)).alias("tokens"))


def change_index(state: voc.State, codebase_id: str, added: DataFrame, removed: DataFrame, text: str) -> voc.State:
    """The vocabulary after payloads `added` and `removed` (point_id and the text), by one delta."""
    up, n = text_frequencies(added, codebase_id, text)
    down, m = text_frequencies(removed, codebase_id, text)
    net = n.select("codebase_id", F.col("doc_count").alias("change")).unionByName(m.select("codebase_id", (-F.col("doc_count")).alias("change"))).groupBy("codebase_id").agg(F.sum("change").alias("change"))
    return voc.incremental(state, up, down, net)


def index_rows(state: voc.State, points: DataFrame, payloads: DataFrame, codebase_id: str, text: str, make: Callable[[], Embedder]) -> Indexed:
    """The index after single entries were added or changed: points (id, payload columns, dense, sparse) by `payloads`.

    The vocabulary moves first, by one delta of what the entries have now against what their stored points
    had, so no text meets a vocabulary without its tokens; then the points are made and replace the old
    ones. Nothing is written here: a failure leaves the tables as they were.
    """
    own = payloads.withColumn("id", F.col("point_id"))
    before = points.join(own.select("id"), "id", "left_semi").select(F.col("id").alias("point_id"), text)
    after = change_index(state, codebase_id, payloads, before, text)
    tf = voc.document_vectors(after, payloads, "point_id", text)
    sparse = packed(tf.withColumnRenamed("doc_id", "id"), "id", "tf")
    dense = embed(payloads, text, make).select(F.col("text").alias("__text"), F.col("embedding").alias("dense"))
    made = own.join(sparse, "id", "left").join(dense, own[text] == dense["__text"], "left").drop("__text", "point_id")
    return Indexed(upsert_points(points, made), after, points.count(), payloads.count())


def retire_rows(state: voc.State, points: DataFrame, ids: DataFrame, codebase_id: str, text: str) -> tuple[voc.State, DataFrame]:
    """(state, points) without the points of `ids` (id); their tokens leave the vocabulary's counts with them."""
    gone = points.join(ids.select("id"), "id", "left_semi").select(F.col("id").alias("point_id"), text)
    return change_index(state, codebase_id, gone.limit(0), gone, text), delete_points(points, ids)
