"""A vocabulary shared by many corpora: state transitions from tables to tables.

State: vocabulary (token, idx, doc_freq), contributions (codebase_id, token, doc_freq) and doc_counts
(codebase_id, doc_count). Indexes are only ever appended. Every transition returns a new State.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import tokens
from loomspark.operators.tfidf import query_weights, term_counts, tokenized
from loomspark.sources.tables import numbered

#: Counts are signed 64-bit (fixed value).
MOST = 2**63 - 1


@dataclass
class State:
    vocabulary: DataFrame
    contributions: DataFrame
    doc_counts: DataFrame


def empty(spark) -> State:
    return State(
        spark.createDataFrame([], "token string, idx long, doc_freq long"),
        spark.createDataFrame([], "codebase_id string, token string, doc_freq long"),
        spark.createDataFrame([], "codebase_id string, doc_count long"),
    )


def corpus_frequencies(docs: DataFrame, codebase: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(codebase_id, token, doc_freq): in how many documents of each corpus a token occurs; a repeated row is a document of its own."""
    each = docs.select(F.col(codebase).alias("codebase_id"), F.explode(F.array_distinct(tokens(text))).alias("token"))
    return each.groupBy("codebase_id", "token").agg(F.count(F.lit(1)).alias("doc_freq"))


def corpus_sizes(docs: DataFrame, codebase: str = "source") -> DataFrame:
    """(codebase_id, doc_count)."""
    return docs.groupBy(F.col(codebase).alias("codebase_id")).agg(F.count(F.lit(1)).alias("doc_count"))


def invalid_frequencies(frequencies: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows that can't be registered: a count of 0 or less, above the corpus's documents, or above 64 bits."""
    joined = frequencies.join(sizes, "codebase_id", "left")
    return joined.filter((F.col("doc_freq") <= 0) | F.col("doc_count").isNull() | (F.col("doc_freq") > F.col("doc_count")) | (F.col("doc_count") > F.lit(MOST)))


def _apply(state: State, deltas: DataFrame) -> DataFrame:
    """The vocabulary after (token, delta): counts never below 0, new tokens appended in order of token."""
    both = state.vocabulary.join(deltas, "token", "full")
    floor = F.greatest(F.coalesce("doc_freq", F.lit(0)) + F.coalesce("delta", F.lit(0)), F.lit(0))
    old = both.filter("idx IS NOT NULL").select("token", "idx", floor.alias("doc_freq"))
    last = state.vocabulary.agg(F.max("idx")).first()[0]
    fresh = both.filter("idx IS NULL AND delta > 0").select("token", floor.alias("doc_freq"))
    added = numbered(fresh, [F.asc("token")], "idx", 0 if last is None else last + 1)
    return old.withColumn("idx", F.col("idx").cast("long")).unionByName(added.select("token", "idx", "doc_freq"))


def register(state: State, frequencies: DataFrame, sizes: DataFrame, check: bool = True) -> State:
    """Replaces the contributions of the given corpora; `frequencies` (codebase_id, token, doc_freq), `sizes` (codebase_id, doc_count)."""
    if check and (bad := invalid_frequencies(frequencies, sizes).limit(3).collect()):
        raise ValueError(f"invalid frequencies, such as {bad}")
    old = state.contributions.join(sizes.select("codebase_id"), "codebase_id", "left_semi")
    deltas = frequencies.select("token", F.col("doc_freq").alias("delta")).unionByName(old.select("token", (-F.col("doc_freq")).alias("delta")))
    vocabulary = _apply(state, deltas.groupBy("token").agg(F.sum("delta").alias("delta")))
    gone = sizes.select("codebase_id")
    return State(
        vocabulary,
        state.contributions.join(gone, "codebase_id", "left_anti").unionByName(frequencies.select("codebase_id", "token", "doc_freq")),
        state.doc_counts.join(gone, "codebase_id", "left_anti").unionByName(sizes.select("codebase_id", "doc_count")),
    )


def unregister(state: State, codebase_id: str) -> State:
    """Without the contributions and the count of a corpus; tokens and their indexes stay."""
    mine = F.col("codebase_id") == codebase_id
    deltas = state.contributions.filter(mine).groupBy("token").agg((-F.sum("doc_freq")).alias("delta"))
    return State(_apply(state, deltas), state.contributions.filter(~mine | F.col("codebase_id").isNull()), state.doc_counts.filter(~mine | F.col("codebase_id").isNull()))


def incremental(state: State, added: DataFrame, removed: DataFrame, net: DataFrame) -> State:
    """Per (codebase_id, token) counts `added` and `removed` and per codebase_id `net` (codebase_id, change).

    delta = greatest(current + added - removed, 0) - current, and the same delta goes to the contribution
    and to the vocabulary. Contributions of 0 go, document counts never fall below 0, new corpora appear.
    """
    key = ["codebase_id", "token"]
    moves = added.select(*key, F.col("doc_freq").alias("up"), F.lit(0).alias("down")).unionByName(removed.select(*key, F.lit(0).alias("up"), F.col("doc_freq").alias("down")))
    moves = moves.groupBy(*key).agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    touched = moves.join(state.contributions, key, "left").withColumn("now", F.coalesce("doc_freq", F.lit(0)))
    too_many = F.raise_error(F.concat(F.lit("the count of "), F.col("token"), F.lit(" leaves 64 bits"))).cast("long")
    up = F.when(F.col("up") > F.lit(MOST) - F.col("now"), too_many).otherwise(F.col("up"))
    after = touched.withColumn("after", F.greatest(F.col("now") + up - F.col("down"), F.lit(0)))
    vocabulary = _apply(state, after.groupBy("token").agg(F.sum(F.col("after") - F.col("now")).alias("delta")))
    contributions = state.contributions.join(moves, key, "left_anti").unionByName(after.filter("after > 0").select(*key, F.col("after").alias("doc_freq")))
    counts = state.doc_counts.join(net, "codebase_id", "full")
    counts = counts.select("codebase_id", F.greatest(F.coalesce("doc_count", F.lit(0)) + F.coalesce("change", F.lit(0)), F.lit(0)).alias("doc_count"))
    return State(vocabulary, contributions, counts)


def new_tokens(before: State, after: State) -> DataFrame:
    """(token, idx) that a transition appended."""
    return after.vocabulary.join(before.vocabulary.select("token"), "token", "left_anti").select("token", "idx")


def without_count(state: State) -> DataFrame:
    """(codebase_id) with contributions but no document count: a sign of a lost row."""
    return state.contributions.select("codebase_id").distinct().join(state.doc_counts, "codebase_id", "left_anti")


def rebuilt(state: State) -> DataFrame:
    """The vocabulary with document frequencies summed anew from the contributions; indexes untouched."""
    sums = state.contributions.groupBy("token").agg(F.sum("doc_freq").alias("sum"))
    return state.vocabulary.join(sums, "token", "left").select("token", "idx", F.coalesce("sum", F.lit(0)).alias("doc_freq"))


def codebase_ids(state: State) -> DataFrame:
    return state.contributions.select("codebase_id").union(state.doc_counts.select("codebase_id")).distinct()


def codebase_stats(state: State) -> DataFrame:
    """(codebase_id, doc_count, token_count), one row per corpus; a missing count is 0."""
    sizes = state.contributions.groupBy("codebase_id").agg(F.count(F.lit(1)).alias("token_count"))
    both = sizes.join(state.doc_counts, "codebase_id", "full")
    return both.select("codebase_id", F.coalesce("doc_count", F.lit(0)).alias("doc_count"), F.coalesce("token_count", F.lit(0)).alias("token_count"))


def totals(state: State) -> DataFrame:
    """One row: total_docs, vocab_size, codebases."""
    docs = state.doc_counts.agg(F.coalesce(F.sum("doc_count"), F.lit(0)).alias("total_docs"), F.count(F.lit(1)).alias("codebases"))
    size = state.vocabulary.agg(F.count(F.lit(1)).alias("vocab_size"))
    return docs.withColumn("k", F.lit(1)).join(size.withColumn("k", F.lit(1)), "k").drop("k")


def tokens_of(state: State, wanted: DataFrame) -> DataFrame:
    """(ordinal, idx, token) for `wanted` (ordinal, idx); an index that isn't there is an error."""
    found = wanted.join(state.vocabulary.select("idx", "token"), "idx", "left")
    missing = F.raise_error(F.concat(F.lit("no token has index "), F.col("idx").cast("string"))).cast("string")
    return found.select("ordinal", "idx", F.when(F.col("token").isNotNull(), F.col("token")).otherwise(missing).alias("token"))


def document_vectors(state: State, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, idx, tf) with tf = 1 + ln(count). Document frequencies take no part, so vectors stay valid."""
    counts = term_counts(tokenized(docs, doc_id, text))
    return counts.join(state.vocabulary.select("token", "idx"), "token").select("doc_id", "idx", (1 + F.log("count")).alias("tf"))


def with_idf(state: State) -> DataFrame:
    """The vocabulary with idf = ln((total documents + 1) / (doc_freq + 1)) + 1, as of now."""
    total = state.doc_counts.agg(F.coalesce(F.sum("doc_count"), F.lit(0))).first()[0]
    return state.vocabulary.withColumn("idf", F.log((F.lit(float(total)) + 1) / (F.col("doc_freq") + 1)) + 1)


def query_vectors(state: State, queries: DataFrame, query_id: str = "query_id", text: str = "text", fuzzy: bool = True, threshold: float = 0.75) -> DataFrame:
    """(query_id, idx, weight): idf now, times the similarity where the token is only similar."""
    return query_weights(queries, with_idf(state), query_id, text, fuzzy, threshold, live_only=True)
