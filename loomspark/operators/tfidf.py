"""A TF-IDF model of one corpus: fitting, growing, and sparse vectors as postings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import tokens
from loomspark.operators.fuzzy import nearest_tokens
from loomspark.sources.tables import numbered


def tokenized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, token): one row per occurrence."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokens(text, **options)).alias("token"))


def term_counts(occurrences: DataFrame) -> DataFrame:
    """(doc_id, token, count)."""
    return occurrences.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("count"))


def doc_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, doc_freq): in how many documents (rows) each token occurs; counts combine before the only shuffle."""
    return docs.select(F.explode(F.array_distinct(tokens(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("doc_freq"))


def _idf(docs: int):
    return F.log((F.lit(float(docs)) + 1) / (F.col("doc_freq") + 1)) + 1


@dataclass
class TfidfModel:
    """vocabulary (token, idx, doc_freq, idf), the number of documents, and the size when it was fitted."""

    vocabulary: DataFrame
    docs: int
    initial: int

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text") -> TfidfModel:
        """Tokens numbered by falling document frequency, ties by token; idf = ln((N + 1) / (df + 1)) + 1."""
        n = docs.count()
        found = doc_frequencies(docs, text)
        vocabulary = numbered(found, [F.desc("doc_freq"), F.asc("token")], "idx").withColumn("idf", _idf(n))
        return cls(vocabulary, n, -1)

    def extend(self, docs: DataFrame, text: str = "text") -> TfidfModel:
        """The model with more documents: new tokens after the old ones, counts added, every idf anew."""
        more = docs.count()
        if not more:
            return self
        n = self.docs + more
        new = doc_frequencies(docs, text).withColumnRenamed("doc_freq", "more")
        both = self.vocabulary.select("token", "idx", "doc_freq").join(new, "token", "full")
        old = both.filter("idx IS NOT NULL").select("token", "idx", (F.col("doc_freq") + F.coalesce("more", F.lit(0))).alias("doc_freq"))
        last = self.vocabulary.agg(F.max("idx")).first()[0]
        fresh = numbered(both.filter("idx IS NULL").select("token", F.col("more").alias("doc_freq")), [F.asc("token")], "idx", 0 if last is None else last + 1)
        vocabulary = old.unionByName(fresh.select("token", F.col("idx").cast(old.schema["idx"].dataType).alias("idx"), "doc_freq"))
        return TfidfModel(vocabulary.withColumn("idf", _idf(n)), n, self.size_at_fit())

    def size_at_fit(self) -> int:
        if self.initial < 0:
            self.initial = self.vocabulary.count()
        return self.initial

    def growth_ratio(self) -> float:
        """Tokens added since the fit, over the tokens of the fit."""
        first = self.size_at_fit()
        return (self.vocabulary.count() - first) / first if first else 0.0

    def needs_reindex(self, threshold: float = 0.10) -> bool:
        return self.growth_ratio() > threshold

    def vectors(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, idx, weight) with weight = (1 + ln(count)) * idf, for known tokens."""
        counts = term_counts(tokenized(docs, doc_id, text))
        return counts.join(self.vocabulary, "token").select("doc_id", "idx", ((1 + F.log("count")) * F.col("idf")).alias("weight"))

    def query_vectors(self, queries: DataFrame, query_id: str = "query_id", text: str = "text", fuzzy: bool = True, threshold: float = 0.75) -> DataFrame:
        """(query_id, idx, weight): idf of each distinct token, or of the nearest token times the similarity."""
        return query_weights(queries, self.vocabulary, query_id, text, fuzzy, threshold, live_only=False)

    def save(self, path: str) -> None:
        """Writes the whole state below `path`."""
        spark = self.vocabulary.sparkSession
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        spark.createDataFrame([(self.docs, self.size_at_fit())], "docs long, initial long").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")

    @classmethod
    def load(cls, spark, path: str) -> TfidfModel:
        state = spark.read.parquet(f"{path}/state").first()
        return cls(spark.read.parquet(f"{path}/vocabulary"), state["docs"], state["initial"])


def query_weights(queries: DataFrame, weights: DataFrame, query_id: str, text: str, fuzzy: bool, threshold: float, live_only: bool) -> DataFrame:
    """(query_id, idx, weight) of query texts over a vocabulary (token, idx, doc_freq, idf).

    Each distinct token counts once, at its first position; of several tokens that lead to the same idx
    the first one counts.
    """
    at = queries.select(F.col(query_id).alias("query_id"), F.posexplode(F.array_distinct(tokens(text))).alias("at", "token"))
    exact = at.join(weights, "token").select("query_id", "at", "idx", F.col("idf").alias("weight"))
    if fuzzy:
        missing = at.join(weights, "token", "left_anti")
        near = nearest_tokens(missing, weights, threshold, live_only).select("token", F.col("idx"), "similarity")
        idf = weights.select("idx", "idf")
        exact = exact.unionByName(missing.join(near, "token").join(idf, "idx").select("query_id", "at", "idx", (F.col("idf") * F.col("similarity")).alias("weight")))
    return exact.groupBy("query_id", "idx").agg(F.min_by("weight", "at").alias("weight"))


def packed(postings: DataFrame, key: str = "doc_id", weight: str = "weight") -> DataFrame:
    """(key, sparse struct<indices, values>): the vector of each key, by ascending index. A vector is bounded by its text."""
    pairs = F.array_sort(F.collect_list(F.struct("idx", weight)))
    own = postings.groupBy(key).agg(pairs.alias("p"))
    return own.select(key, F.struct(F.col("p.idx").alias("indices"), F.col(f"p.{weight}").alias("values")).alias("sparse"))
