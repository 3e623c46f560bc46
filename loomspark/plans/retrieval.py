"""Queries of tokenizing, vocabularies, scoring, fusion and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import ids, text
from loomspark.functions.scalars import clamp_limit, parse_iso
from loomspark.operators import vocabulary as voc
from loomspark.operators.fusion import fuse_full_outer, reciprocal_rank_fusion
from loomspark.operators.fuzzy import nearest_tokens
from loomspark.operators.lexical import lexical_rank
from loomspark.operators.scoring import dense_top_k_many, sparse_top_k, sparse_top_k_many
from loomspark.operators.search import SearchIndex, grouped_search, hybrid_search
from loomspark.operators.tfidf import TfidfModel
from loomspark.session import spread

def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_read(spark, sf, "documents").select("doc_id", "text", "lang", "source", "doc_type", "path"))


def _q6(c: str):
    return F.round(c, 6).alias(c)


def tokenize_terms(spark, sf):
    each = docs(spark, sf).select("doc_id", F.explode(text.tokens("text")).alias("token"))
    return each.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


def tokenize_stopped(spark, sf):
    each = docs(spark, sf).select(F.explode(text.tokens("text", 3, text.STOP_TOKENS)).alias("token"))
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def literal_terms(spark, sf):
    each = docs(spark, sf).select("doc_id", F.explode(text.literal_tokens("text")).alias("token"))
    return each.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


def camelcase_expand(spark, sf):
    c = _read(spark, sf, "code_chunks").select("chunk_id", text.expand_camel_case("name").alias("e"))
    return c.select("chunk_id", F.col("e.text").alias("expanded"), F.array_join("e.added", " ").alias("added"))


def levenshtein_similarity(spark, sf):
    c = _read(spark, sf, "code_chunks")
    return c.select("chunk_id", _rounded(text.similarity("name", "context")).alias("similarity"))


def _rounded(c):
    return F.round(c, 6)


def line_counts(spark, sf):
    return _read(spark, sf, "code_chunks").select("chunk_id", text.line_count("content").alias("lines")).filter("lines IS NOT NULL").withColumn("lines", F.col("lines").cast("long"))


def content_hashes(spark, sf):
    return docs(spark, sf).select("doc_id", ids.content_hash("text").alias("hash"), F.md5("text").alias("md5"))


def point_ids(spark, sf):
    return docs(spark, sf).select("doc_id", ids.point_id(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("point_id"))


def spo_hashes(spark, sf):
    f = _read(spark, sf, "facts").filter("predicate IS NOT NULL AND object IS NOT NULL")
    return f.select("id", ids.spo_hash("subject", "subject_type", "predicate", "object", "object_type").alias("hash"))


def fragment_ids(spark, sf):
    s = _read(spark, sf, "embedding_spans")
    return s.select("span_id", ids.fragment_id("doc_id", F.sha2("text", 256), "span_start", "span_end", "span_id", True).alias("of_number"), ids.fragment_id(F.concat(F.lit('d"\\'), "doc_id"), F.sha2("text", 256), "span_start", "span_end", "span_id").alias("of_text"))


def collection_names(spark, sf):
    d = docs(spark, sf).select("source").distinct()
    return d.select("source", ids.collection_name(F.concat("source", F.lit("//")), "notes").alias("name"))


def fact_texts(spark, sf):
    f = _read(spark, sf, "facts").filter("predicate IS NOT NULL AND object IS NOT NULL")
    return f.select("id", ids.fact_text("subject", "predicate", "object", "subject_type", "object_type", "context").alias("text"))


def parse_iso_times(spark, sf):
    e = _read(spark, sf, "events")
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("not a time")).when(F.col("event_id") % 5 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 5 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("event_id") % 5 == 3, F.lit(None))
    return e.select("event_id", F.unix_seconds(parse_iso(raw.otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")))).alias("seconds"))


def clamp_limits(spark, sf):
    o = _read(spark, sf, "orders")
    raw = F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_orderkey") % 300 - 50)
    return o.select("o_orderkey", clamp_limit(raw, 10, 5, 200).alias("allowed"))


def doc_freq_fit(spark, sf):
    m = TfidfModel.fit(docs(spark, sf))
    return m.vocabulary.select("token", "idx", "doc_freq", _q6("idf"))


def vocab_extend(spark, sf):
    d = docs(spark, sf)
    m = TfidfModel.fit(d.filter("doc_id % 3 <> 0")).extend(d.filter("doc_id % 3 = 0"))
    return m.vocabulary.select("token", "idx", "doc_freq", _q6("idf"))


def tfidf_vectors(spark, sf):
    d = docs(spark, sf)
    return TfidfModel.fit(d).vectors(d).select("doc_id", "idx", _q6("weight"))


def state(spark, sf, where: str = "true") -> voc.State:
    d = docs(spark, sf).filter(where)
    return voc.register(voc.empty(spark), voc.corpus_frequencies(d), voc.corpus_sizes(d), check=False)


def codebase_frequencies(spark, sf):
    return voc.corpus_frequencies(docs(spark, sf))


def vocab_register(spark, sf):
    """Even documents, then all others."""
    first = state(spark, sf, "doc_id % 2 = 0")
    some = docs(spark, sf).filter("doc_id % 2 <> 0")
    return voc.register(first, voc.corpus_frequencies(some), voc.corpus_sizes(some), check=True).vocabulary


def vocab_unregister(spark, sf):
    return voc.unregister(state(spark, sf), "granary-monorepo").vocabulary


def vocab_incremental(spark, sf):
    """Even documents, then all others added, of which some are taken away."""
    d = docs(spark, sf)
    up, down = d.filter("doc_id % 2 <> 0"), d.filter("doc_id % 4 = 1")
    net = voc.corpus_sizes(up).select("codebase_id", F.col("doc_count").alias("change")).unionByName(voc.corpus_sizes(down).select("codebase_id", (-F.col("doc_count")).alias("change"))).groupBy("codebase_id").agg(F.sum("change").alias("change"))
    after = voc.incremental(state(spark, sf, "doc_id % 2 = 0"), voc.corpus_frequencies(up), voc.corpus_frequencies(down), net)
    return after.contributions.join(after.vocabulary.select("token", "idx", F.col("doc_freq").alias("total")), "token").select("codebase_id", "token", "doc_freq", "idx", "total")


def _given_state(spark, sf) -> voc.State:
    """The vocabulary tables as they are given; of repeated rows one, of a corpus's counts the latest."""
    c = _read(spark, sf, "codebase_contributions").filter("token IS NOT NULL AND doc_freq > 0").dropDuplicates(["codebase_id", "token"])
    n = _read(spark, sf, "codebase_doc_counts").groupBy("codebase_id").agg(F.max_by("doc_count", F.struct("last_updated", "doc_count")).alias("doc_count"))
    return voc.State(_read(spark, sf, "vocabulary").select("token", "idx", "doc_freq"), c, n)


def vocab_rebuild(spark, sf):
    return voc.rebuilt(_given_state(spark, sf))


def vocab_codebase_ids(spark, sf):
    return voc.codebase_ids(_given_state(spark, sf))


def vocab_lost_counts(spark, sf):
    return voc.without_count(_given_state(spark, sf))


def vocab_stats(spark, sf):
    return voc.codebase_stats(_given_state(spark, sf))


def vocab_totals(spark, sf):
    return voc.totals(_given_state(spark, sf))


def index_to_token(spark, sf):
    """The token of every index."""
    s = _given_state(spark, sf)
    return voc.tokens_of(s, s.vocabulary.select((F.col("idx") * 2).alias("ordinal"), "idx"))


def tf_vectors(spark, sf):
    return voc.document_vectors(state(spark, sf), docs(spark, sf)).select("doc_id", "idx", _q6("tf"))


def query_texts(spark, sf):
    """Every hundredth document with all of its text."""
    return docs(spark, sf).filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")


def search_index(spark, sf) -> SearchIndex:
    """The index of the documents, made once per session and folder."""
    return SearchIndex.of(spark, sf, lambda: docs(spark, sf))


def idf_query(spark, sf):
    return search_index(spark, sf).query_vectors(query_texts(spark, sf), fuzzy=False).select("query_id", "idx", _q6("weight"))


def idf_query_fuzzy(spark, sf):
    """Every hundredth token of the documents with a letter changed, as queries."""
    index = search_index(spark, sf)
    asked = index.vocabulary.filter("idx % 100 = 0").select(F.col("idx").alias("query_id"), F.concat(F.expr("substr(token, 1, length(token) - 1)"), F.lit("q")).alias("text"))
    return index.query_vectors(asked).select("query_id", "idx", _q6("weight"))


def fuzzy_tokens(spark, sf):
    """For every hundredth token, of any length."""
    s = _given_state(spark, sf)
    asked = s.vocabulary.filter("idx % 100 = 0").select(F.concat(F.expr("substr(token, 1, length(token) - 1)"), F.lit("z")).alias("token"))
    unknown = asked.join(s.vocabulary, "token", "left_anti")
    return nearest_tokens(unknown, s.vocabulary, 0.75).withColumn("similarity", F.round("similarity", 6))


def points(spark, sf):
    d = docs(spark, sf).select(F.col("doc_id").alias("id"), "lang", "source", "doc_type")
    e = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"), "label")
    return d.join(e, "id")


def dense_queries(spark, sf):
    """Every hundredth vector."""
    e = _read(spark, sf, "embeddings").filter("vec_id % 100 = 0")
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("dense"))


def dense_topk(spark, sf):
    return dense_top_k_many(points(spark, sf), dense_queries(spark, sf), 10).select("query_id", "id", "rank", _q6("score"))


def dense_topk_filtered(spark, sf):
    return dense_top_k_many(points(spark, sf).filter("lang = 'en' AND label > 3"), dense_queries(spark, sf), 10).select("query_id", "id", "rank", _q6("score"))


def dense_topk_all_queries(spark, sf):
    """The five nearest points of every hundredth point."""
    e = _read(spark, sf, "embeddings")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("dense"))
    own = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))
    return dense_top_k_many(own, asked, 5).select("query_id", "id", "rank", _q6("score"))


def _sparse(spark, sf):
    index = search_index(spark, sf)
    return index.vectors, index.query_vectors(query_texts(spark, sf), fuzzy=False)


def sparse_topk(spark, sf):
    return sparse_top_k_many(*_sparse(spark, sf), 10).select("query_id", "id", "rank", _q6("score"))


def sparse_topk_join(spark, sf):
    """As sparse_topk, by one pass over the vectors for thousands of queries at once."""
    index = search_index(spark, sf)
    return sparse_top_k(index.vectors, index.query_vectors(query_texts(spark, sf), fuzzy=False), 10).select("query_id", "id", "rank", _q6("score"))


def sparse_topk_filtered(spark, sf):
    allowed = docs(spark, sf).filter("lang = 'en'").select(F.col("doc_id").alias("id"))
    vectors, asked = _sparse(spark, sf)
    return sparse_top_k_many(vectors.join(allowed, "id", "left_semi"), asked, 10).select("query_id", "id", "rank", _q6("score"))


def _hybrid(spark, sf, **options):
    vectors, asked = _sparse(spark, sf)
    own = points(spark, sf)
    return hybrid_search(own, vectors.join(own.select("id"), "id", "left_semi"), dense_queries(spark, sf), asked, **options).select("query_id", "id", "rank", _q6("score"))


def hybrid_weighted(spark, sf):
    return _hybrid(spark, sf)


def hybrid_equal(spark, sf):
    return _hybrid(spark, sf, dense_weight=0.5, sparse_weight=0.5)


def hybrid_sparse_only(spark, sf):
    return _hybrid(spark, sf, dense_weight=0.0, sparse_weight=1.0)


def hybrid_dense_only(spark, sf):
    return _hybrid(spark, sf, dense_weight=1.0, sparse_weight=0.0)


def hybrid_filtered(spark, sf):
    return _hybrid(spark, sf, where=F.col("lang") == "de")


def hybrid_grouped(spark, sf):
    vectors, asked = _sparse(spark, sf)
    return grouped_search(points(spark, sf), vectors, dense_queries(spark, sf), asked, "source").select("query_id", "group", "id", "rank", _q6("score"))


def _ranked_results(spark, sf):
    """search_results as ranked lists: scorers are lists, the latest finite score of a point counts."""
    r = _read(spark, sf, "search_results").filter((F.abs("score") < float("inf")) & ~F.isnan("score"))
    last = r.groupBy("query_id", "scorer", "point_id").agg(F.max_by("score", F.struct("scored_at", "score")).alias("score"))
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("query_id", "scorer").orderBy(F.desc("score"), "point_id"))
    number = F.when(F.col("scorer") == "dense", 0).when(F.col("scorer") == "sparse", 1).when(F.col("scorer") == "lexical", 2).otherwise(3)
    return last.select("query_id", number.alias("list_id"), rank.alias("rank"), F.col("point_id").alias("key"))


def rrf_three_lists(spark, sf):
    fused = reciprocal_rank_fusion(_ranked_results(spark, sf), 60, [1.0, 0.8, 0.5, 0.0], 10, lists=4)
    return fused.select("query_id", "key", "best_rank", "rank", F.round("score", 9).alias("score"))


def fuse_two_lists(spark, sf):
    r = _ranked_results(spark, sf)
    side = lambda n: r.filter(F.col("list_id") == n).select("query_id", F.col("key").alias("id"), "rank", F.concat(F.lit(f"{n}:"), F.col("rank").cast("string")).alias("payload"))
    return fuse_full_outer(side(0), side(1)).withColumn("score", F.round("score", 9))


def lexical_topk(spark, sf):
    asked = query_texts(spark, sf).select("query_id", F.col("text").alias("query"))
    return lexical_rank(docs(spark, sf), asked, "doc_id", "text", title="doc_type", path="path").select("query_id", F.col("key").alias("id"), "rank", _q6("score"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_terms, tokenize_stopped, literal_terms, camelcase_expand, levenshtein_similarity, line_counts, content_hashes, point_ids, spo_hashes, fragment_ids,
        collection_names, fact_texts, parse_iso_times, clamp_limits, doc_freq_fit, vocab_extend, tfidf_vectors, codebase_frequencies, vocab_register, vocab_unregister,
        vocab_incremental, vocab_rebuild, vocab_codebase_ids, vocab_lost_counts, vocab_stats, vocab_totals, index_to_token, tf_vectors, idf_query, fuzzy_tokens,
        dense_topk, dense_topk_filtered, dense_topk_all_queries, sparse_topk, sparse_topk_filtered, hybrid_weighted, hybrid_equal, hybrid_grouped, rrf_three_lists, fuse_two_lists, lexical_topk,
        idf_query_fuzzy, hybrid_sparse_only, hybrid_dense_only, hybrid_filtered, sparse_topk_join,
    )
}

# The tokenizer without look-ahead, which the SQL engine's patterns don't have.
_PARTS = r"regexp_extract_all(regexp_replace(regexp_replace(w, '[A-Z]([0-9_])', '\1', 'g'), '([A-Z][a-z])', ' \1', 'g'), '[A-Z]?[a-z]+|[A-Z]+')"
_TOKENS = rf"""
words AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*')) AS w FROM documents),
raw AS (SELECT doc_id, source, lower(unnest(CASE WHEN len({_PARTS}) > 0 THEN {_PARTS} ELSE string_split(w, '_') END)) AS token FROM words),
occ AS (SELECT doc_id, source, token FROM raw WHERE length(token) >= 2 AND NOT regexp_full_match(token, '[0-9]+'))
"""
_SETS = _TOKENS + ", sets AS (SELECT DISTINCT doc_id, source, token FROM occ)"
_CONTRIB = "SELECT source AS codebase_id, token, count(*) AS doc_freq FROM sets {where} GROUP BY 1, 2"
_STATE = f"""{_SETS},
contrib AS ({_CONTRIB.format(where='')}),
vocab AS (SELECT token, CAST(sum(doc_freq) AS BIGINT) AS doc_freq, row_number() OVER (ORDER BY token) - 1 AS idx FROM contrib GROUP BY token),
tf AS (SELECT doc_id, v.idx, 1 + ln(count(*)) AS tf FROM occ o JOIN vocab v ON o.token = v.token GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM documents)
"""
_QTOKENS = rf"""
qwords AS (SELECT doc_id AS query_id, unnest(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*')) AS w FROM documents WHERE doc_id % 100 = 0),
qraw AS (SELECT query_id, lower(unnest(CASE WHEN len({_PARTS}) > 0 THEN {_PARTS} ELSE string_split(w, '_') END)) AS token FROM qwords),
qset AS (SELECT DISTINCT query_id, token FROM qraw WHERE length(token) >= 2 AND NOT regexp_full_match(token, '[0-9]+')),
qw AS (SELECT query_id, idx, ln((n + 1.0) / (doc_freq + 1)) + 1 AS weight FROM qset q JOIN vocab v ON q.token = v.token, n)
"""
_SPARSE = _STATE + "," + _QTOKENS + ", sp AS (SELECT query_id, doc_id AS id, CAST(sum(CAST(floor(tf * weight * 1e9 + 0.5) AS BIGINT)) AS DOUBLE) / 1e9 AS score FROM tf JOIN qw ON tf.idx = qw.idx GROUP BY 1, 2)"
_POINTS = "points AS (SELECT doc_id AS id, lang, source, label, embedding FROM documents JOIN embeddings ON doc_id = vec_id)"
_DENSE = f"{_POINTS}, dq AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), de AS (SELECT query_id, id, lang, label, source, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 9) AS score FROM points, dq)"
_TOP = "SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {src}) WHERE rank <= {k}"


def _hybrid_sql(wd: float, ws: float, where: str = "true") -> str:
    return f"""WITH {_SPARSE}, {_DENSE}, chosen AS (SELECT id FROM points WHERE {where}),
a AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM de WHERE id IN (SELECT id FROM chosen)) WHERE r <= 50),
b AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM sp WHERE id IN (SELECT id FROM chosen)) WHERE r <= 50),
u AS (SELECT query_id, id, r, {wd} / (60.0 + r) AS s FROM a UNION ALL SELECT query_id, id, r, {ws} / (60.0 + r) FROM b),
f AS (SELECT query_id, id, sum(s) AS score, min(r) AS best FROM u GROUP BY 1, 2)
SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, best, CAST(id AS VARCHAR)) AS rank FROM f) WHERE rank <= 10"""


_UUID = "{h}[1:8] || '-' || {h}[9:12] || '-{v}' || {h}[14:16] || '-' || substr('89ab', CAST(('0x' || {h}[17:17])::INT % 4 + 1 AS INT), 1) || {h}[18:20] || '-' || {h}[21:32]"
_GIVEN = """
c AS (SELECT codebase_id, token, min(doc_freq) AS doc_freq FROM codebase_contributions WHERE token IS NOT NULL AND doc_freq > 0 GROUP BY 1, 2),
n AS (SELECT codebase_id, doc_count FROM (SELECT *, row_number() OVER (PARTITION BY codebase_id ORDER BY last_updated DESC, doc_count DESC) AS k FROM codebase_doc_counts) WHERE k = 1)
"""
_RESULTS = """
r0 AS (SELECT query_id, scorer, point_id, arg_max(score, (epoch_us(scored_at), score)) AS score FROM search_results WHERE score IS NOT NULL AND isfinite(score) GROUP BY 1, 2, 3),
r AS (SELECT query_id, CASE scorer WHEN 'dense' THEN 0 WHEN 'sparse' THEN 1 WHEN 'lexical' THEN 2 ELSE 3 END AS l, row_number() OVER (PARTITION BY query_id, scorer ORDER BY score DESC, point_id) AS rank, point_id AS key FROM r0)
"""
_FACTS = "FROM facts WHERE predicate IS NOT NULL AND object IS NOT NULL"

SQL = {
    "tokenize_terms": f"WITH {_TOKENS} SELECT doc_id, token, count(*) AS n FROM occ GROUP BY 1, 2",
    "tokenize_stopped": f"WITH {_TOKENS} SELECT token, count(*) AS n FROM occ WHERE length(token) >= 3 AND token NOT IN ({', '.join(repr(t) for t in sorted(text.STOP_TOKENS))}) GROUP BY 1",
    "literal_terms": "SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS token FROM documents) GROUP BY 1, 2",
    "camelcase_expand": r"""
WITH s AS (SELECT chunk_id, name, regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g') AS sp FROM code_chunks)
SELECT chunk_id, CASE WHEN sp <> name THEN name || ' ' || lower(sp) ELSE name END AS expanded,
  CASE WHEN sp <> name THEN array_to_string(list_filter(string_split(lower(sp), ' '), lambda x: x <> '' AND NOT list_contains(string_split(lower(name), ' '), x)), ' ') ELSE '' END AS added FROM s
""",
    "levenshtein_similarity": "SELECT chunk_id, round(CASE WHEN name IS NULL OR context IS NULL OR name = '' OR context = '' THEN 0.0 ELSE 1.0 - CAST(levenshtein(name, context) AS DOUBLE) / greatest(length(name), length(context)) END, 6) AS similarity FROM code_chunks",
    "line_counts": r"SELECT chunk_id, len(string_split(content, chr(10))) AS lines FROM code_chunks WHERE content IS NOT NULL",
    "content_hashes": "SELECT doc_id, sha256(text) AS hash, md5(text) AS md5 FROM documents",
    "point_ids": f"WITH h AS (SELECT doc_id, sha256('doc:' || doc_id) AS h FROM documents) SELECT doc_id, {_UUID.format(h='h', v=4)} AS point_id FROM h",
    "spo_hashes": f"SELECT id, sha256(concat_ws('|', lower(subject), lower(subject_type), lower(predicate), lower(object), lower(object_type))) AS hash {_FACTS}",
    "fragment_ids": rf"""WITH s AS (SELECT span_id, doc_id, sha256(text) AS d, span_start || ', ' || span_end || ', ' || span_id AS r FROM embedding_spans),
h AS (SELECT span_id, sha1(unhex('{ids.FRAGMENT_NAMESPACE}') || encode('[' || doc_id || ', "' || d || '", ' || r || ']')) AS a, sha1(unhex('{ids.FRAGMENT_NAMESPACE}') || encode('["d\"\\' || doc_id || '", "' || d || '", ' || r || ']')) AS b FROM s)
SELECT span_id, {_UUID.format(h='a', v=5)} AS of_number, {_UUID.format(h='b', v=5)} AS of_text FROM h""",
    "collection_names": "SELECT DISTINCT source, 'notes_' || substr(sha256(source), 1, 12) AS name FROM documents",
    "fact_texts": f"SELECT id, concat_ws(' ', subject, replace(predicate, '_', ' '), object, CASE WHEN subject_type <> '' THEN '(' || subject_type || ')' END, CASE WHEN object_type <> '' THEN '(' || object_type || ')' END, nullif(context, '')) AS text {_FACTS}",
    "parse_iso_times": "SELECT event_id, CASE WHEN event_id % 5 IN (0, 3) THEN 0 ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS seconds FROM events",
    "clamp_limits": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 300 - 50 <= 0 THEN 10 ELSE greatest(5, least(200, o_orderkey % 300 - 50)) END AS allowed FROM orders",
    "doc_freq_fit": f"WITH {_SETS}, d AS (SELECT token, count(*) AS doc_freq FROM sets GROUP BY 1) SELECT token, row_number() OVER (ORDER BY doc_freq DESC, token) - 1 AS idx, doc_freq, round(ln(((SELECT count(*) FROM documents) + 1.0) / (doc_freq + 1)) + 1, 6) AS idf FROM d",
    "vocab_extend": f"""WITH {_SETS},
a AS (SELECT token, count(*) AS df, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS idx FROM sets WHERE doc_id % 3 <> 0 GROUP BY 1),
b AS (SELECT token, count(*) AS df FROM sets WHERE doc_id % 3 = 0 GROUP BY 1),
m AS (SELECT coalesce(a.token, b.token) AS token, a.idx, coalesce(a.df, 0) + coalesce(b.df, 0) AS doc_freq FROM a FULL JOIN b ON a.token = b.token),
x AS (SELECT token, coalesce(idx, (SELECT max(idx) FROM a) + row_number() OVER (PARTITION BY idx IS NULL ORDER BY token)) AS idx, doc_freq FROM m)
SELECT token, idx, doc_freq, round(ln(((SELECT count(*) FROM documents) + 1.0) / (doc_freq + 1)) + 1, 6) AS idf FROM x""",
    "tfidf_vectors": f"""WITH {_SETS}, d AS (SELECT token, count(*) AS df, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS idx FROM sets GROUP BY 1),
c AS (SELECT doc_id, token, count(*) AS n FROM occ GROUP BY 1, 2)
SELECT doc_id, idx, round((1 + ln(n)) * (ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1)) + 1), 6) AS weight FROM c JOIN d ON c.token = d.token""",
    "codebase_frequencies": f"WITH {_SETS} {_CONTRIB.format(where='')}",
    "vocab_register": f"""WITH {_SETS},
a AS ({_CONTRIB.format(where='WHERE doc_id % 2 = 0')}), b AS ({_CONTRIB.format(where='WHERE doc_id % 2 <> 0')}),
v AS (SELECT token, sum(doc_freq) AS df, row_number() OVER (ORDER BY token) - 1 AS idx FROM a GROUP BY 1),
now AS (SELECT * FROM a WHERE codebase_id NOT IN (SELECT source FROM documents WHERE doc_id % 2 <> 0) UNION ALL SELECT * FROM b),
w AS (SELECT token, sum(doc_freq) AS df FROM now GROUP BY 1),
m AS (SELECT coalesce(v.token, w.token) AS token, idx, coalesce(w.df, 0) AS df FROM v FULL JOIN w ON v.token = w.token)
SELECT token, coalesce(idx, (SELECT max(idx) FROM v) + row_number() OVER (PARTITION BY idx IS NULL ORDER BY token)) AS idx, CAST(df AS BIGINT) AS doc_freq FROM m""",
    "vocab_unregister": f"WITH {_STATE} SELECT token, idx, doc_freq - coalesce((SELECT c.doc_freq FROM contrib c WHERE c.codebase_id = 'granary-monorepo' AND c.token = v.token), 0) AS doc_freq FROM vocab v",
    "vocab_incremental": f"""WITH {_SETS},
a AS ({_CONTRIB.format(where='WHERE doc_id % 2 = 0')}), u AS ({_CONTRIB.format(where='WHERE doc_id % 2 <> 0')}), w AS ({_CONTRIB.format(where='WHERE doc_id % 4 = 1')}),
v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx FROM a GROUP BY 1),
k AS (SELECT codebase_id, token FROM a UNION SELECT codebase_id, token FROM u UNION SELECT codebase_id, token FROM w),
x AS (SELECT k.codebase_id, k.token, greatest(coalesce(a.doc_freq, 0) + coalesce(u.doc_freq, 0) - coalesce(w.doc_freq, 0), 0) AS doc_freq
  FROM k LEFT JOIN a USING (codebase_id, token) LEFT JOIN u USING (codebase_id, token) LEFT JOIN w USING (codebase_id, token)),
t AS (SELECT token, sum(doc_freq) AS total FROM x GROUP BY 1),
m AS (SELECT t.token, total, idx FROM t LEFT JOIN v ON t.token = v.token WHERE idx IS NOT NULL OR total > 0),
y AS (SELECT token, CAST(total AS BIGINT) AS total, coalesce(idx, (SELECT max(idx) FROM v) + row_number() OVER (PARTITION BY idx IS NULL ORDER BY token)) AS idx FROM m)
SELECT codebase_id, x.token, doc_freq, idx, total FROM x JOIN y ON x.token = y.token WHERE doc_freq > 0""",
    "vocab_rebuild": f"WITH {_GIVEN} SELECT v.token, idx, CAST(coalesce(s, 0) AS BIGINT) AS doc_freq FROM vocabulary v LEFT JOIN (SELECT token, sum(doc_freq) AS s FROM c GROUP BY 1) t ON v.token = t.token",
    "vocab_codebase_ids": f"WITH {_GIVEN} SELECT codebase_id FROM c UNION SELECT codebase_id FROM n",
    "vocab_lost_counts": f"WITH {_GIVEN} SELECT DISTINCT codebase_id FROM c WHERE codebase_id NOT IN (SELECT codebase_id FROM n)",
    "vocab_stats": f"WITH {_GIVEN}, t AS (SELECT codebase_id, count(*) AS k FROM c GROUP BY 1) SELECT coalesce(t.codebase_id, n.codebase_id) AS codebase_id, coalesce(doc_count, 0) AS doc_count, coalesce(k, 0) AS token_count FROM t FULL JOIN n ON t.codebase_id = n.codebase_id",
    "vocab_totals": f"WITH {_GIVEN} SELECT CAST((SELECT sum(doc_count) FROM n) AS BIGINT) AS total_docs, (SELECT count(*) FROM n) AS codebases, (SELECT count(*) FROM vocabulary) AS vocab_size",
    "index_to_token": "SELECT idx * 2 AS ordinal, idx, token FROM vocabulary",
    "tf_vectors": f"WITH {_STATE} SELECT doc_id, idx, round(tf, 6) AS tf FROM tf",
    "idf_query": f"WITH {_STATE}, {_QTOKENS} SELECT query_id, idx, round(weight, 6) AS weight FROM qw",
    "fuzzy_tokens": """
WITH u AS (SELECT DISTINCT substr(token, 1, length(token) - 1) || 'z' AS token FROM vocabulary WHERE idx % 100 = 0),
p AS (SELECT u.token, v.token AS match, v.idx, 1.0 - CAST(levenshtein(u.token, v.token) AS DOUBLE) / greatest(length(u.token), length(v.token)) AS similarity
  FROM u JOIN vocabulary v ON abs(length(u.token) - length(v.token)) <= 2 WHERE v.doc_freq > 0 AND u.token NOT IN (SELECT token FROM vocabulary WHERE token IS NOT NULL))
SELECT token, match, idx, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY similarity DESC, idx) AS k FROM p WHERE similarity >= 0.75) WHERE k = 1""",
    "dense_topk": f"WITH {_DENSE} " + _TOP.format(src="de", k=10),
    "dense_topk_filtered": f"WITH {_DENSE} " + _TOP.format(src="de WHERE lang = 'en' AND label > 3", k=10),
    "dense_topk_all_queries": "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) " + _TOP.format(src="s", k=5),
    "sparse_topk": f"WITH {_SPARSE} " + _TOP.format(src="sp", k=10),
    "sparse_topk_filtered": f"WITH {_SPARSE} " + _TOP.format(src="sp WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'en')", k=10),
    "hybrid_weighted": _hybrid_sql(1.0, 0.8),
    "hybrid_equal": _hybrid_sql(1.0, 1.0),
    "hybrid_filtered": _hybrid_sql(1.0, 0.8, "lang = 'de'"),
    "hybrid_sparse_only": f"WITH {_SPARSE}, {_POINTS} " + _TOP.format(src="sp WHERE id IN (SELECT id FROM points)", k=10),
    "hybrid_dense_only": f"WITH {_DENSE} " + _TOP.format(src="de", k=10),
    "idf_query_fuzzy": f"""WITH {_STATE},
asked AS (SELECT idx AS query_id, substr(token, 1, length(token) - 1) || 'q' AS text FROM vocab WHERE idx % 100 = 0),
words_ AS (SELECT query_id, text AS w FROM asked),
raw_ AS (SELECT query_id, lower(unnest(CASE WHEN len({_PARTS}) > 0 THEN {_PARTS} ELSE string_split(w, '_') END)) AS token FROM words_),
q AS (SELECT DISTINCT query_id, token FROM raw_ WHERE length(token) >= 2),
p AS (SELECT q.query_id, q.token, v.idx, v.doc_freq, CASE WHEN q.token = v.token THEN 2.0 ELSE 1.0 - CAST(levenshtein(q.token, v.token) AS DOUBLE) / greatest(length(q.token), length(v.token)) END AS sim
  FROM q JOIN vocab v ON abs(length(q.token) - length(v.token)) <= 2 WHERE v.doc_freq > 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, token ORDER BY sim DESC, idx) AS k FROM p WHERE sim >= 0.75) WHERE k = 1)
SELECT query_id, idx, round((ln((n + 1.0) / (doc_freq + 1)) + 1) * least(sim, 1.0), 6) AS weight FROM best, n""",
    "hybrid_grouped": f"""WITH {_SPARSE}, {_DENSE},
sg AS (SELECT sp.query_id, sp.id, sp.score, p.source FROM sp JOIN points p ON sp.id = p.id),
a0 AS (SELECT * FROM (SELECT query_id, id, score, source, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) AS k FROM de) WHERE k = 1),
b0 AS (SELECT * FROM (SELECT query_id, id, score, source, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) AS k FROM sg) WHERE k = 1),
a AS (SELECT * FROM (SELECT query_id, id, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM a0) WHERE r <= 50),
b AS (SELECT * FROM (SELECT query_id, id, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM b0) WHERE r <= 50),
u AS (SELECT query_id, source, id, r, 0 AS l, 1.0 / (60.0 + r) AS s FROM a UNION ALL SELECT query_id, source, id, r, 1, 0.8 / (60.0 + r) FROM b),
f AS (SELECT query_id, source, sum(s) AS score, min(r) AS best FROM u GROUP BY 1, 2),
g AS (SELECT query_id, source, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY s DESC, l) AS k FROM u) WHERE k = 1)
SELECT query_id, "group", id, rank, round(score, 6) AS score FROM (
  SELECT f.query_id, f.source AS "group", g.id, f.score, row_number() OVER (PARTITION BY f.query_id ORDER BY round(f.score, 12) DESC, best, f.source) AS rank
  FROM f JOIN g ON f.query_id = g.query_id AND f.source = g.source) WHERE rank <= 10""",
    "rrf_three_lists": f"""WITH {_RESULTS}, w AS (SELECT query_id, key, rank, CASE l WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.5 END / (60.0 + rank) AS s FROM r WHERE l < 3),
f AS (SELECT query_id, key, sum(s) AS score, min(rank) AS best_rank FROM w GROUP BY 1, 2)
SELECT query_id, key, best_rank, rank, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 15) DESC, best_rank, CAST(key AS VARCHAR)) AS rank FROM f) WHERE rank <= 10""",
    "fuse_two_lists": f"""WITH {_RESULTS}, d AS (SELECT * FROM r WHERE l = 0), s AS (SELECT * FROM r WHERE l = 1),
f AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.key, s.key) AS id, coalesce(1.0 / (60.0 + d.rank), 0) + coalesce(0.8 / (60.0 + s.rank), 0) AS score, coalesce('0:' || d.rank, '1:' || s.rank) AS payload FROM d FULL JOIN s ON d.query_id = s.query_id AND d.key = s.key)
SELECT query_id, id, round(score, 9) AS score, payload, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10""",
    "lexical_topk": f"""
WITH q AS (SELECT doc_id AS query_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS term FROM documents WHERE doc_id % 100 = 0),
a AS (SELECT query_id, term, count(*) AS asked, sum(count(*)) OVER (PARTITION BY query_id) AS total FROM q GROUP BY 1, 2),
i AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+') || regexp_extract_all(coalesce(doc_type, ''), '[A-Za-z0-9_]+') || regexp_extract_all(coalesce(doc_type, ''), '[A-Za-z0-9_]+') || regexp_extract_all(coalesce(path, ''), '[A-Za-z0-9_]+')) AS term FROM documents),
c AS (SELECT doc_id, lower(term) AS term, count(*) AS n FROM i GROUP BY 1, 2),
s AS (SELECT query_id, doc_id AS id, sum(least(n, 5) * asked) / any_value(CAST(total AS DOUBLE)) AS score FROM c JOIN a ON c.term = a.term GROUP BY 1, 2)
SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(id AS VARCHAR)) AS rank FROM s) WHERE rank <= 10""",
}
SQL["sparse_topk_join"] = SQL["sparse_topk"]
