"""Queries that must ask everything, on tables small enough to score by hand."""

import math
import re
from collections import Counter

import pytest

from loomspark.operators.snapshots import snapshot_changes
from loomspark.plans.core import QUERIES

#: Texts by id; the words at the end of 0 and 100 lie behind character 300.
FILLER = "filler " * 60
TEXTS = {0: FILLER + "walrus", 1: "walrus walrus", 7: "heron", 50: "heron otter", 99: "otter walrus", 100: FILLER + "otter otter", 200: "heron", 201: None}
ANGLES = {i: i + i * i / 1000 for i in (0, 1, 7, 50, 99, 100, 200, 201, 300)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("whole"))
    docs = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", "note", "x") for i, t in TEXTS.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, doc_type string, path string").write.parquet(f"{out}/documents.parquet")
    vectors = [(i, [math.cos(a), math.sin(a)], i % 10) for i, a in ANGLES.items()]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{out}/embeddings.parquet")
    return out


def best(scores, k=10):
    """(query, id, rank) of scores {query: {id: score}}, ties by id."""
    return {(q, i, r + 1) for q, own in scores.items() for r, i in enumerate(sorted(own, key=lambda i: (-round(own[i], 9), i))[:k])}


def got(spark, name, folder):
    return {(r["query_id"], r["id"], r["rank"]) for r in QUERIES[name](spark, folder).collect()}


def sparse_scores(allowed=lambda i: True):
    counts = {i: Counter(re.findall("[a-z]+", t or "")) for i, t in TEXTS.items()}
    df = Counter(w for c in counts.values() for w in c)
    idf = {w: math.log((len(TEXTS) + 1) / (n + 1)) + 1 for w, n in df.items()}
    score = lambda q, i: sum((1 + math.log(counts[i][w])) * idf[w] for w in counts[q] if w in counts[i])
    return {q: {i: score(q, i) for i in TEXTS if allowed(i) and score(q, i) > 0} for q in TEXTS if q % 100 == 0}


def dense_scores(allowed=lambda i: True):
    return {q: {i: math.cos(ANGLES[i] - ANGLES[q]) for i in TEXTS if allowed(i)} for q in ANGLES if q % 100 == 0}


def test_sparse_asks_every_hundredth_document_with_its_whole_text(spark, folder):
    assert got(spark, "sparse_topk", folder) == best(sparse_scores())
    assert got(spark, "sparse_topk_filtered", folder) == best(sparse_scores(lambda i: i % 2))
    assert {r["query_id"]: r["n"] for r in QUERIES["idf_query"](spark, folder).groupBy("query_id").count().withColumnRenamed("count", "n").collect()} == {0: 2, 100: 2, 200: 1}


def test_dense_asks_every_hundredth_vector(spark, folder):
    assert got(spark, "dense_topk", folder) == best(dense_scores())
    assert got(spark, "dense_topk_filtered", folder) == best(dense_scores(lambda i: i % 2 and i % 10 > 3))


def test_lexical_asks_the_whole_text(spark, folder):
    # `note` and `x` are in every document, but in no query.
    assert {i for q, i, _ in got(spark, "lexical_topk", folder) if q == 0} == {0, 1, 99, 100}
    assert {i for q, i, _ in got(spark, "lexical_topk", folder) if q == 100} == {0, 50, 99, 100}


@pytest.mark.parametrize("name, weights", [("hybrid_weighted", (1.0, 0.8)), ("hybrid_equal", (1.0, 1.0))])
def test_hybrid_fuses_both_for_every_query(spark, folder, name, weights):
    share, first = {}, {}
    for w, ranked in zip(weights, (best(dense_scores(), 50), best(sparse_scores(), 50)), strict=True):
        for q, i, r in ranked:
            share.setdefault(q, Counter())[i] += w / (60 + r)
            first[q, i] = min(r, first.get((q, i), r))
    expected = {(q, i, r + 1) for q, s in share.items() for r, i in enumerate(sorted(s, key=lambda i: (-round(s[i], 12), first[q, i], str(i)))[:10])}
    assert got(spark, name, folder) == expected


def test_grouped_asks_every_query(spark, folder):
    rows = QUERIES["hybrid_grouped"](spark, folder).collect()
    assert {r["query_id"] for r in rows} == {0, 100, 200, 300} and {r["group"] for r in rows} == {"s0", "s1", "s2"}


def test_lookups_ask_every_row(spark, tmp_path):
    out = str(tmp_path)
    vocabulary = [("abc", 0, 1), ("walrus", 1, 1), ("otter", 3, 1), ("heron", 5, 1), ("abcd", 7, 1), ("badger", 100, 2)]
    spark.createDataFrame(vocabulary, "token string, idx long, doc_freq long").write.parquet(f"{out}/vocabulary.parquet")
    spark.createDataFrame([("a", "otter", 1)], "codebase_id string, token string, doc_freq long").write.parquet(f"{out}/codebase_contributions.parquet")
    spark.sql("SELECT 'a' codebase_id, 1L doc_count, TIMESTAMP'2025-01-01' last_updated").write.parquet(f"{out}/codebase_doc_counts.parquet")
    spark.createDataFrame([("f1", "Zoe", "Person", "knows", "Bo", "Person"), ("f2", "Martin", "Person", "knows", "Zoe", "Person")], "id string, subject string, subject_type string, predicate string, object string, object_type string").write.parquet(f"{out}/facts.parquet")
    spark.createDataFrame([(i, f"n{i}", "t") for i in range(1, 8)], "p_partkey long, p_name string, p_type string").write.parquet(f"{out}/part.parquet")
    tokens = QUERIES["index_to_token"](spark, out).collect()
    assert sorted((r["idx"], r["token"]) for r in tokens) == [(i, t) for t, i, _ in vocabulary]
    assert {r["token"]: r["match"] for r in QUERIES["fuzzy_tokens"](spark, out).collect()} == {"badgez": "badger"}  # abz is too far from abc
    linked = {(r["name"], r["entity"], r["fact_id"]) for r in QUERIES["neighbors"](spark, out).collect()}
    assert linked == {("Zoe", "Bo", "f1"), ("Zoe", "Martin", "f2"), ("Martin", "Zoe", "f2")}
    found = {r["asked"]: r["id"] for r in QUERIES["glossary_lookup"](spark, out).collect()}
    assert found == {f"N{i} {i}": f"g{i}" for i in range(1, 8)} | {"ALIAS 3": "g3", "ALIAS 6": "g6"}


def test_distances_have_no_cap(spark, tmp_path):
    wide = spark.range(10_050).selectExpr("concat('f', id) id", "'Marta Ratumoki' subject", "concat('e', id) object")
    deep = spark.range(10_050).selectExpr("concat('g', id) id", "concat('E', id) subject", "concat('z', id) object")
    columns = ["id", "subject", "'Person' subject_type", "'knows' predicate", "object", "'Person' object_type"]
    wide.unionByName(deep).selectExpr(*columns).write.parquet(f"{tmp_path}/facts.parquet")
    found = QUERIES["connection_distances"](spark, str(tmp_path)).groupBy("depth").count().collect()
    assert {r["depth"]: r["count"] for r in found} == {1: 10_050, 2: 10_050}


def test_transitions_cover_the_table(spark, tmp_path):
    out = str(tmp_path)
    docs = [(i, f"{w} shared", "en", f"s{i}", "note", "x") for i, w in enumerate(["zero", "one", "two", "three", "four", "five", "six", "seven"])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, doc_type string, path string").write.parquet(f"{out}/documents.parquet")
    every = {w.split()[0] for _, w, *_ in docs} | {"shared"}
    assert {r["token"]: r["doc_freq"] for r in QUERIES["vocab_register"](spark, out).collect()} == {w: 8 if w == "shared" else 1 for w in every}
    # 1 and 5 are added and taken away again.
    assert {(r["codebase_id"], r["token"]) for r in QUERIES["vocab_incremental"](spark, out).collect()} == {(f"s{i}", w) for i, t, *_ in docs if i not in (1, 5) for w in t.split()}
    assert {r["id"]: r["lang"] for r in QUERIES["points_upsert"](spark, out).collect()} == {i: "xx" if i % 2 or i % 3 == 0 else "en" for i in range(8)}


def test_null_and_zero_differ_in_snapshots(spark):
    columns = "group string, snapshot int, path string, at int, hash binary, size long, mtime double"
    lists = spark.createDataFrame([("g", 1, "a", 1, None, 0, None), ("g", 2, "a", 2, None, None, 0.0), ("g", 1, "b", 1, None, 1, 1.0), ("g", 2, "b", 2, None, 1, 1.0)], columns)
    assert [tuple(r) for r in snapshot_changes(lists).collect()] == [("g", "a", 2, "changed")]
