"""The queries of this subpackage over the test tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import literal_tokens
from loomspark.llm import canonical, distinctive, frequency, leakage, packing, privacy, ranking, splitting, tokens, usable
from loomspark.session import spread


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_read(spark, sf, "documents").select("doc_id", "text"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.texts_with_origin(_read(spark, sf, "code_chunks"), _read(spark, sf, "embedding_spans"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.oversized_items(_texts(spark, sf))


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.all_pieces(_texts(spark, sf))


def p1_checks(spark: SparkSession, sf: str) -> DataFrame:
    """(origin, item_id, bytes, small, tied) of every text in pieces: bytes without shared ones, whether no piece is too large or shares too much."""
    p = p1_pieces(spark, sf).withColumn("size", F.octet_length("text"))
    small = F.bool_and((F.col("size") <= splitting.LIMIT) & (F.col("piece") < F.col("pieces")))
    return p.groupBy("origin", "item_id").agg(F.sum(F.col("size") - F.col("shared_bytes")).alias("bytes"), small.alias("small"), F.bool_and(F.col("shared_bytes") <= splitting.OVERLAP).alias("tied"))


def p2_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = distinctive.distinctive_of(_read(spark, sf, "codebase_contributions"), _read(spark, sf, "codebase_doc_counts"))
    return scored.select(F.col("record").alias("codebase_id"), F.col("term").alias("token"), F.col("n").alias("doc_freq"), F.round("pmi", 6).alias("pmi"), F.round("ppmi", 6).alias("ppmi"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    scored = distinctive.distinctive_of(_read(spark, sf, "codebase_contributions"), _read(spark, sf, "codebase_doc_counts"))
    return distinctive.clearly_distinctive(scored).select(F.col("record").alias("codebase_id"), F.col("term").alias("token"))


FACT_FIELDS = ["subject", "predicate", "object"]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.variant_members(_read(spark, sf, "facts"), "id", FACT_FIELDS).select("first_id", F.col("id").alias("fact_id"))


def p3_facts(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.collapse_variants(_read(spark, sf, "facts"), "id", FACT_FIELDS)


def p4_terms(spark: SparkSession, sf: str) -> DataFrame:
    """(token, total, codebases, mark): mark is null for a token of use."""
    raw = _read(spark, sf, "codebase_contributions")
    counts = usable.usable_counts(raw).withColumn("terms", F.array("term"))
    codebases = raw.agg(F.count_distinct("codebase_id")).first()[0]
    grams = frequency.ngram_frequencies(counts, "record", "terms", "n", max_n=1, disjoint=True)
    mark = F.when(F.col("n") < 3, "too_rare").when(F.col("records") * 2 > codebases, "too_common")
    return grams.select(F.col("gram").alias("token"), F.col("n").alias("total"), F.col("records").alias("codebases"), mark.alias("mark"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_terms(spark, sf).filter("mark IS NOT NULL").select("token", "mark")


def p4_grams(spark: SparkSession, sf: str) -> DataFrame:
    """(gram, n, records): every run of up to three words of the documents."""
    words = _documents(spark, sf).select("doc_id", literal_tokens("text").alias("words"))
    return frequency.ngram_frequencies(words, "doc_id", "words", max_n=3, disjoint=True)


def p6_ranking(spark: SparkSession, sf: str) -> DataFrame:
    points = ranking.current_scores(_read(spark, sf, "search_results"))
    return ranking.ranked(ranking.ideal_point_closeness(points)).select("query_id", "point_id", "closeness", "rank")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    points = ranking.current_scores(_read(spark, sf, "search_results"))
    return ranking.clear_leaders(ranking.ideal_point_closeness(points))


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, piece, start_token, tokens, tier, container, window, step_group, room) of every document."""
    return packing.pack_documents(tokens.token_counts(_documents(spark, sf), "doc_id", "text")).withColumnRenamed("id", "doc_id")


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """One row about p8_packed: documents, those split without need or with a gap, windows and containers too full, whether the fill is above 98 %."""
    rows = p8_packed(spark, sf)
    own = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.max(F.col("start_token") + F.col("tokens")).alias("end"), F.sum("tokens").alias("tokens"))
    wrong = (F.col("end") != F.col("tokens")) | (F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / packing.CAPACITY)))
    documents = own.agg(F.count(F.lit(1)).alias("documents"), F.count_if(wrong).alias("badly_split"), F.sum("tokens").alias("__tokens"))
    windows = rows.groupBy("container", "window", "tier").agg(F.sum("tokens").alias("tokens")).groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > F.col("tier")).alias("full"))
    containers = windows.agg(F.sum("full").alias("overfull_windows"), F.count_if(F.col("tokens") > packing.CAPACITY).alias("overfull_containers"), F.count(F.lit(1)).alias("__containers"))
    fill = F.col("__tokens") / (F.col("__containers") * packing.CAPACITY) > 0.98
    both = documents.unionByName(containers, allowMissingColumns=True)
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return both.select("documents", "badly_split", "overfull_windows", "overfull_containers", fill.alias("well_filled"))


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(_documents(spark, sf), _read(spark, sf, "heldout_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_word_for_word(_documents(spark, sf), _read(spark, sf, "heldout_items"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.personal_information(_documents(spark, sf)).select("doc_id", "kind", "start_pos")


def p10_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.redacted(_documents(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_pieces, p1_checks, p2_found, p2_scores, p3_found, p3_facts, p4_found, p4_terms, p4_grams, p6_found, p6_ranking, p8_packed, p8_checks, p9_found, p9_leaks, p10_found, p10_redacted)
}

_USABLE = """
usable AS (
  SELECT codebase_id, lower(trim(token, ' ' || chr(9))) AS token, CAST(sum(doc_freq) AS BIGINT) AS doc_freq
  FROM (SELECT DISTINCT codebase_id, token, doc_freq FROM codebase_contributions WHERE token IS NOT NULL AND doc_freq > 0)
  GROUP BY 1, 2)
"""
_SCORED = f"""
WITH {_USABLE},
sizes AS (
  SELECT codebase_id, doc_count FROM (
    SELECT codebase_id, doc_count, row_number() OVER (PARTITION BY codebase_id ORDER BY last_updated DESC, doc_count DESC) AS k FROM codebase_doc_counts)
  WHERE k = 1 AND doc_count > 0),
totals AS (SELECT CAST(sum(doc_count) AS BIGINT) AS total, sum(pow(doc_count, 0.75)) AS smooth FROM sizes),
pairs AS (SELECT u.codebase_id, token, doc_freq, doc_count FROM usable u JOIN sizes s ON u.codebase_id = s.codebase_id),
terms AS (SELECT token, CAST(sum(doc_freq) AS BIGINT) AS term_n FROM pairs GROUP BY 1),
scored AS (
  SELECT codebase_id, p.token, doc_freq, doc_count, term_n, total,
    log2(CAST(doc_freq AS DOUBLE) / term_n * total / doc_count) AS pmi,
    greatest(0.0, log2(CAST(doc_freq AS DOUBLE) / term_n * smooth / pow(doc_count, 0.75))) AS ppmi
  FROM pairs p JOIN terms t ON p.token = t.token, totals)
"""
_CANONICAL = r"""
WITH parts AS (
  SELECT id, subject, predicate, object,
    regexp_replace(lower(subject), '[^\p{L}\p{Nd}]', '', 'g') AS a,
    regexp_replace(lower(predicate), '[^\p{L}\p{Nd}]', '', 'g') AS b,
    regexp_replace(lower(object), '[^\p{L}\p{Nd}]', '', 'g') AS c
  FROM facts),
keyed AS (SELECT id, subject, predicate, object, list_sort([a, b, c]) AS k FROM parts WHERE a <> '' AND b <> '' AND c <> '')
"""
_WORDS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM heldout_items),
dw AS (SELECT doc_id, array_to_string(w[s : s + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS s FROM d WHERE len(w) >= 12)),
iw AS (SELECT item_id, array_to_string(w[s : s + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS s FROM i WHERE len(w) >= 12))
"""

SQL: dict[str, str] = {
    "p1_found": "SELECT 'chunk' AS origin, chunk_id AS item_id FROM code_chunks WHERE strlen(content) > 1200 UNION ALL SELECT 'span', span_id FROM embedding_spans WHERE strlen(text) > 1200",
    "p1_checks": "SELECT *, true AS small, true AS tied FROM (SELECT 'chunk' AS origin, chunk_id AS item_id, strlen(content) AS bytes FROM code_chunks UNION ALL SELECT 'span', span_id, strlen(text) FROM embedding_spans) WHERE bytes > 0",
    "p2_found": _SCORED + "SELECT codebase_id, token FROM scored WHERE doc_freq >= 10 AND CAST(doc_freq AS HUGEINT) * total >= 8 * CAST(term_n AS HUGEINT) * doc_count",
    "p2_scores": _SCORED + "SELECT codebase_id, token, doc_freq, round(pmi, 6) AS pmi, round(ppmi, 6) AS ppmi FROM scored",
    "p3_found": _CANONICAL + "SELECT first_id, id AS fact_id FROM (SELECT id, min(id) OVER (PARTITION BY k) AS first_id FROM keyed) WHERE id <> first_id",
    "p3_facts": _CANONICAL + "SELECT id, subject, predicate, object, copies FROM (SELECT *, count(*) OVER (PARTITION BY k) AS copies, row_number() OVER (PARTITION BY k ORDER BY id) AS r FROM keyed) WHERE r = 1",
    "p4_found": f"WITH {_USABLE} SELECT token, CASE WHEN sum(doc_freq) < 3 THEN 'too_rare' ELSE 'too_common' END AS mark FROM usable GROUP BY token HAVING sum(doc_freq) < 3 OR count(DISTINCT codebase_id) * 2 > (SELECT count(DISTINCT codebase_id) FROM codebase_contributions)",
    "p4_terms": f"WITH {_USABLE} SELECT token, CAST(sum(doc_freq) AS BIGINT) AS total, count(DISTINCT codebase_id) AS codebases, CASE WHEN sum(doc_freq) < 3 THEN 'too_rare' WHEN count(DISTINCT codebase_id) * 2 > (SELECT count(DISTINCT codebase_id) FROM codebase_contributions) THEN 'too_common' END AS mark FROM usable GROUP BY token",
    "p4_grams": """
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
g AS (SELECT doc_id, array_to_string(w[i : i + k - 1], ' ') AS gram FROM spots, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w))
SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS records FROM g GROUP BY 1
""",
    "p6_found": """
WITH last AS (
  SELECT query_id, point_id, scorer, score FROM (
    SELECT query_id, point_id, scorer, CASE WHEN isfinite(score) THEN score END AS score,
      row_number() OVER (PARTITION BY query_id, point_id, scorer ORDER BY scored_at DESC NULLS LAST, CASE WHEN isfinite(score) THEN score END DESC NULLS LAST) AS k
    FROM search_results) WHERE k = 1),
wide AS (
  SELECT query_id, point_id, max(score) FILTER (scorer = 'dense') AS d, max(score) FILTER (scorer = 'sparse') AS s,
    max(score) FILTER (scorer = 'lexical') AS l, max(score) FILTER (scorer = 'rerank') AS r
  FROM last GROUP BY 1, 2),
p AS (SELECT query_id, point_id, coalesce(d, '-inf'::DOUBLE) AS d, coalesce(s, '-inf'::DOUBLE) AS s, coalesce(l, '-inf'::DOUBLE) AS l, coalesce(r, '-inf'::DOUBLE) AS r,
    (d IS NOT NULL)::INT + (s IS NOT NULL)::INT + (l IS NOT NULL)::INT + (r IS NOT NULL)::INT AS n FROM wide)
SELECT query_id, point_id FROM p
WHERE n >= 3 AND NOT EXISTS (
  SELECT 1 FROM p q WHERE q.query_id = p.query_id AND q.point_id <> p.point_id
    AND (q.d > p.d)::INT + (q.s > p.s)::INT + (q.l > p.l)::INT + (q.r > p.r)::INT >= 2)
""",
    "p8_checks": "SELECT count(*) AS documents, 0 AS badly_split, 0 AS overfull_windows, 0 AS overfull_containers, true AS well_filled FROM documents",
    "p9_found": _WORDS + "SELECT DISTINCT doc_id, item_id FROM dw JOIN iw ON dw.g = iw.g",
}
