"""Hybrid search: a dense and a sparse branch, fused by rank, with or without grouping."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.config import DEFAULTS
from loomspark.functions.text import tokens
from loomspark.operators import vocabulary as voc
from loomspark.operators.fusion import reciprocal_rank_fusion
from loomspark.operators.scoring import dense_scores, dense_top_k_many, sparse_scores, sparse_top_k, sparse_top_k_many, top_k
from loomspark.operators.tfidf import packed
from loomspark.session import cut_lineage, shared_dir
from loomspark.sources.tables import Store

#: Weights closer than this count as equal (fixed value).
EQUAL = 0.001
#: A vocabulary of at most so many tokens goes to the tasks that write the vectors of an index; a larger one is joined.
SENT_TOKENS = 1_000_000


def _positions(lists: pa.ListArray) -> np.ndarray:
    """The row of each element of a column of arrays."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def _arrays(rows: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    """A column of `n` arrays from values and their rows, in order of the rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), values)


def counted(each: DataFrame, column: str = "tokens") -> DataFrame:
    """`each` with the distinct tokens of an array column, and `counts`; nothing is moved."""
    others = [c for c in each.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(others))
            found = lists.flatten().dictionary_encode()
            if not batch.num_rows or not len(found):
                continue
            n = len(found.dictionary)
            both, counts = np.unique(_positions(lists) * n + found.indices.to_numpy(zero_copy_only=False), return_counts=True)
            rows = both // n
            tokens = _arrays(rows, found.dictionary.take(pa.array(both % n)), batch.num_rows)
            out = [*batch.columns[: len(others)], tokens, _arrays(rows, pa.array(counts.astype(np.int64)), batch.num_rows)]
            yield pa.RecordBatch.from_arrays(out, [*others, column, "counts"])

    own = each.select(*others, column)
    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("counts", T.ArrayType(T.LongType()))])).filter(F.size(column) > 0)


def indexed(each: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, sparse struct<indices, values>) of (id, tokens, counts): indexes ascending, values 1 + ln(count)."""
    if vocabulary.count() > SENT_TOKENS:
        pairs = each.select("id", F.explode(F.arrays_zip("tokens", "counts")).alias("p")).select("id", F.col("p.tokens").alias("token"), F.col("p.counts").alias("count"))
        return packed(pairs.join(vocabulary.select("token", "idx"), "token").select("id", "idx", (1 + F.log("count")).alias("tf")), "id", "tf")
    known = vocabulary.select("token", "idx").toArrow().combine_chunks()
    shared = each.sparkSession.sparkContext.broadcast([known.column(c).combine_chunks() for c in ("token", "idx")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, idx = shared.value
        idx = idx.to_numpy(zero_copy_only=False)
        for batch in batches:
            at = pc.index_in(batch.column(1).flatten(), value_set=tokens).fill_null(-1).to_numpy(zero_copy_only=False)
            rows, own = _positions(batch.column(1)), np.where(at >= 0, idx[at], -1)
            order = np.lexsort((own, rows))
            order = order[own[order] >= 0]
            rows, n = rows[order], batch.num_rows
            counts = pa.array(batch.column(2).flatten().to_numpy(zero_copy_only=False)[order])
            yield pa.RecordBatch.from_arrays([batch.column(0), _arrays(rows, pa.array(own[order]), n), _arrays(rows, counts, n)], ["id", "indices", "counts"])

    own = each.select("id", "tokens", "counts")
    out = own.mapInArrow(run, T.StructType([own.schema["id"], T.StructField("indices", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))]))
    return out.select("id", F.struct("indices", F.transform("counts", lambda c: 1 + F.log(c)).alias("values")).alias("sparse"))


@dataclass
class SearchIndex:
    """A vocabulary and the sparse vectors of a table of documents, written once and read by every search.

    A vector is one row (id, sparse), so many queries are scored in one pass that moves nothing but results.
    """

    state: voc.State
    vectors: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(doc_id, idx, tf): the vectors, one row an index."""
        each = self.vectors.select(F.col("id").alias("doc_id"), F.explode(F.arrays_zip("sparse.indices", "sparse.values")).alias("p"))
        return each.select("doc_id", F.col("p.indices").alias("idx"), F.col("p.values").alias("tf"))

    @property
    def vocabulary(self) -> DataFrame:
        return self.state.vocabulary

    @classmethod
    def build(cls, store: Store, name: str, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", codebase: str = "source") -> SearchIndex:
        """Writes the index of `docs` as a version of a collection. Each text is tokenized once.

        A text is one row throughout; only its counts are written in between, and the numbers of texts per token
        are all that is moved. Rows of the same corpus and id count as one text.
        """
        each = docs.select(F.col(codebase).alias("codebase_id"), F.col(doc_id).alias("id"), tokens(text).alias("tokens"))
        repeated = docs.groupBy(F.col(doc_id).alias("id")).count().filter("count > 1").limit(1).count() > 0
        if repeated:
            each = each.groupBy("codebase_id", "id").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
        version = store.stage(name, counted(each))
        counts = store.staged(name, version)
        frequencies = counts.select("codebase_id", F.explode("tokens").alias("token")).groupBy("codebase_id", "token").agg(F.count(F.lit(1)).alias("doc_freq"))
        state = voc.register(voc.empty(docs.sparkSession), cut_lineage(frequencies), voc.corpus_sizes(docs, codebase), check=False)
        vocabulary = cut_lineage(state.vocabulary)
        vectors = indexed(counts, vocabulary)
        if repeated:
            pairs = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("sparse.indices", "sparse.values"))))
            vectors = vectors.groupBy("id").agg(pairs.alias("p")).select("id", F.struct(F.col("p.indices").alias("indices"), F.col("p.values").alias("values")).alias("sparse"))
        store.publish_parts(name, {"vocabulary": vocabulary, "contributions": state.contributions, "doc_counts": state.doc_counts, "vectors": vectors})
        store.unstage(name, version)
        return cls.open(store, name)

    @classmethod
    def open(cls, store: Store, name: str) -> SearchIndex:
        return cls(voc.State(*[store.read(name, part) for part in ("vocabulary", "contributions", "doc_counts")]), store.read(name, "vectors"))

    @classmethod
    def of(cls, spark: SparkSession, source: str, docs: Callable[[], DataFrame]) -> SearchIndex:
        """The index of `source`, in the shared folder; made on the first call of an application."""
        store = Store(spark, f"{shared_dir(spark)}/indexes-{spark.sparkContext.applicationId}")
        name = hashlib.sha256(source.encode()).hexdigest()[:16]
        return cls.open(store, name) if store.exists(name) else cls.build(store, name, docs())

    def query_vectors(self, queries: DataFrame, **options) -> DataFrame:
        return voc.query_vectors(self.state, queries, **options)


def _sparse_best(postings: DataFrame, queries: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
    """The `k` best points per query, over postings (doc_id, idx, tf) or over vectors (id, sparse)."""
    if "sparse" not in postings.columns:
        return sparse_top_k(postings, queries, k, allowed=allowed)
    return sparse_top_k_many(postings if allowed is None else postings.join(allowed, "id", "left_semi"), queries, k)


def _dense_scores(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return dense_top_k_many(points, queries, k).select("query_id", "id", "score", "rank")


def hybrid_search(
    points: DataFrame,
    postings: DataFrame,
    dense_queries: DataFrame,
    sparse_queries: DataFrame,
    limit: int = 10,
    dense_weight: float = DEFAULTS.dense_weight,
    sparse_weight: float = DEFAULTS.sparse_weight,
    rrf_k: int = DEFAULTS.rrf_k,
    prefetch: int = DEFAULTS.prefetch_limit,
    where: Column | None = None,
) -> DataFrame:
    """(query_id, id, score, rank) for tables of dense (query_id, dense) and sparse (query_id, idx, weight) queries.

    `points` is (id, dense, ...), `postings` (doc_id, idx, tf), or the vectors (id, sparse) of an index, over
    which many queries are faster. A branch without weight isn't run, and the
    other one's raw scores are the result. Otherwise each branch gives its `prefetch` best, and reciprocal
    ranks with the weights decide; nearly equal weights count as 1 each. `where` filters the points of
    both branches before anything is chosen. A prefetch of 0 means the default; two weights of 0 are an error.
    """
    prefetch = prefetch or DEFAULTS.prefetch_limit
    if dense_weight == 0 and sparse_weight == 0:
        raise ValueError("dense_weight or sparse_weight must be above 0")
    own = points if where is None else points.filter(where)
    allowed = None if where is None else own.select("id")
    if dense_weight <= 0 < sparse_weight:
        return _sparse_best(postings, sparse_queries, limit, allowed)
    if sparse_weight <= 0 < dense_weight:
        return _dense_scores(own, dense_queries, limit)
    weights = [1.0, 1.0] if abs(dense_weight - sparse_weight) < EQUAL else [dense_weight, sparse_weight]
    dense = _dense_scores(own, dense_queries, prefetch).select("query_id", F.lit(0).alias("list_id"), "rank", F.col("id").alias("key"))
    sparse = _sparse_best(postings, sparse_queries, prefetch, allowed).select("query_id", F.lit(1).alias("list_id"), "rank", F.col("id").alias("key"))
    fused = reciprocal_rank_fusion(dense.unionByName(sparse), rrf_k, weights, limit, lists=2)
    return fused.select("query_id", F.col("key").alias("id"), "score", "rank")


def best_per_group(scored: DataFrame, n: int) -> DataFrame:
    """(query_id, group, id, score, rank): of (query_id, group, id, score) the best hit of each group, and of these the `n` best.

    The best hit is an aggregate, so a group of any size combines before the shuffle.
    """
    best = F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("best")
    firsts = scored.groupBy("query_id", "group").agg(best).select("query_id", "group", "best.id", "best.score")
    return top_k(firsts, n)


def grouped_search(
    points: DataFrame,
    postings: DataFrame,
    dense_queries: DataFrame,
    sparse_queries: DataFrame,
    group: str,
    limit: int = 10,
    dense_weight: float = DEFAULTS.dense_weight,
    sparse_weight: float = DEFAULTS.sparse_weight,
    rrf_k: int = DEFAULTS.rrf_k,
    prefetch: int = DEFAULTS.prefetch_limit,
    where: Column | None = None,
) -> DataFrame:
    """(query_id, group, id, score, rank): one result per value of the column `group`.

    Each branch with a weight above 0 gives the best hit of each of its max(prefetch, limit) best groups;
    groups are fused by rank, and the hit of the branch that adds more (of equal ones the dense one)
    stands for the group. Without any weight the result is empty.
    """
    n = max(prefetch or DEFAULTS.prefetch_limit, limit)
    own = (points if where is None else points.filter(where)).filter(F.col(group).isNotNull())
    groups = own.select("id", F.col(group).cast("string").alias("group"))
    parts = []
    if dense_weight > 0:
        # The best hits alone may all be of one group, so the best groups are looked for.
        scored = dense_scores(own, dense_queries, n, carry=group).withColumnRenamed("carry", "group")
        parts.append((0, dense_weight, best_per_group(scored, n)))
    if sparse_weight > 0:
        if "sparse" in postings.columns:
            scored = sparse_top_k_many(postings.join(groups, "id"), sparse_queries, n, carry="group").withColumnRenamed("carry", "group")
        else:
            scored = sparse_scores(postings, sparse_queries).join(groups, "id")
        parts.append((1, sparse_weight, best_per_group(scored, n)))
    if not parts:
        return points.sparkSession.createDataFrame([], "query_id long, group string, id long, score double, rank int")
    hits = None
    for list_id, weight, best in parts:
        part = best.withColumn("list_id", F.lit(list_id)).withColumn("share", F.lit(float(weight)) / (F.col("rank") + F.lit(float(max(0, rrf_k)))))
        hits = part if hits is None else hits.unionByName(part)
    weights = [max(0.0, dense_weight), max(0.0, sparse_weight)]
    ranked = hits.select("query_id", "list_id", "rank", F.col("group").alias("key"))
    fused = reciprocal_rank_fusion(ranked, rrf_k, weights, limit, lists=2)
    stands = hits.groupBy("query_id", "group").agg(F.max_by("id", F.struct("share", -F.col("list_id"))).alias("id"))
    return fused.join(stands, (fused["query_id"] == stands["query_id"]) & (fused["key"] == stands["group"])).select(fused["query_id"], "group", "id", "score", "rank")


def hydrated(hits: DataFrame, canonical: DataFrame, key: str, columns: list[str], check: str | None = None, sent: bool = False) -> DataFrame:
    """`hits` with columns of the canonical rows, joined for the winners only.

    A hit without a canonical row, or whose `check` column differs from the row's, is an error: the index
    and the table it was made from disagree. With `sent` the keys of the hits, which must be few, are sent to the
    canonical rows, and only the rows of hits are moved.
    """
    own = canonical.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in {*columns, *([check] if check else [])}])
    if sent:
        own = own.join(F.broadcast(hits.select(F.col(key).alias("__hit")).distinct()), F.col("__key") == F.col("__hit"), "left_semi")
    joined = hits.join(own, F.col(key) == F.col("__key"), "left")
    wrong = F.col("__key").isNull() | ((F.col(check) != F.col(f"__{check}")) if check else F.lit(False))
    error = F.raise_error(F.concat(F.lit("no valid parent for "), F.col(key).cast("string")))
    return joined.withColumn("__ok", F.when(wrong, error).otherwise(F.lit(None))).select(*hits.columns, *[F.col(f"__{c}").alias(c) for c in columns], "__ok").filter("__ok IS NULL").drop("__ok")
