"""Searches by blocks: what they find is what a loop over all pairs finds, and what they move doesn't grow with the pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from loomspark.operators import blocks, lexical, search
from loomspark.operators.blocks import distinct_queries
from loomspark.operators.lexical import lexical_rank
from loomspark.operators.scoring import sparse_top_k
from loomspark.operators.search import SearchIndex
from loomspark.operators.tfidf import packed
from loomspark.plans.core import QUERIES
from loomspark.sources.tables import Store

SMALL = "spark.sql.execution.arrow.maxRecordsPerBatch"


def moved(spark, run):
    """Rows that the stages of `run` write for shuffles."""

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        gateway = spark.sparkContext._gateway
        none = gateway.new_array(gateway.jvm.double, 0)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, gateway.jvm.java.util.ArrayList())
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = total()
    run()
    return sum(n for stage, n in total().items() if stage not in before)


@pytest.fixture
def small_batches(spark):
    before = spark.conf.get(SMALL)
    spark.conf.set(SMALL, "97")
    yield
    spark.conf.set(SMALL, before)


def words(draw, n):
    return " ".join(draw.choices([f"w{i}" for i in range(40)], [1 / (i + 1) for i in range(40)], k=n))


def expected_lexical(items, queries, limit):
    counts = {}
    for key, title, text in items:
        own = counts.setdefault(key, Counter())
        for w in re.findall("[a-z0-9_]+", text or ""):
            own[w] += 1
        for w in re.findall("[a-z0-9_]+", title or ""):
            own[w] += 2
    out = set()
    for q, text in queries:
        asked = Counter(text.split())
        score = {k: sum(min(c[w], 5) * n for w, n in asked.items()) / sum(asked.values()) for k, c in counts.items() if any(w in c for w in asked)}
        out |= {(q, k, s, r + 1) for r, (k, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], "" if x[0] is None else "1" + str(x[0])))[:limit])}
    return out


@pytest.mark.parametrize("common", [1 / 20, 2.0])
def test_lexical_against_a_loop(spark, small_batches, monkeypatch, common):
    """Many ties, repeated and null keys, equal queries; every term dense where it is common, and none."""
    monkeypatch.setattr(blocks, "COMMON", common)
    draw = random.Random(5)
    items = [(i if i % 50 else None, words(draw, draw.randrange(3)), words(draw, draw.randrange(12))) for i in range(700)] + [(3, "w1", "w2"), (900, None, None)]
    queries = [(i, words(draw, draw.choice([1, 2, 30]))) for i in range(60)] + [(i, "w0 w1 w1") for i in range(60, 70)]
    own = spark.createDataFrame(items, "id long, title string, text string").repartition(3)
    got = lexical_rank(own, spark.createDataFrame(queries, "query_id long, query string"), "id", title="title", limit=4)
    assert {tuple(r) for r in got.select("query_id", "key", "score", "rank").collect()} == expected_lexical(items, queries, 4)


def test_lexical_moves_only_the_best(spark):
    """Every item shares a word with every query; of 2,000 items and 50 different queries only the best ones are moved."""
    items = spark.createDataFrame([(i, f"all own{i}") for i in range(2000)], "key long, text string")
    queries = spark.range(50).selectExpr("id AS query_id", "concat('all own', id * 7) AS query")
    assert moved(spark, lambda: lexical_rank(items, queries, limit=3).collect()) < 20_000


def test_blocks_are_bounded():
    queries = [(i, [f"t{i % 5}"], [1]) for i in range(20)]
    parts = list(blocks.distinct_queries(iter(queries), most=2))
    assert all(len(p) <= 2 for p in parts) and sorted(i for p in parts for ids, _, _ in p for i in ids) == list(range(20))
    assert [len(p) for p in blocks.distinct_queries(iter([(0, ["a"] * 3, [1] * 3), (1, ["b"], [1])]), entries=3)] == [1, 1]


def test_sums_beyond_53_bits_are_whole():
    block = blocks.Block(np.array([0, 1]), np.array([0, 0]), np.array([1, 1]), 2, 1)
    assert block.scores(np.array([0, 0]), np.array([0, 1]), np.array([2**60, 2**60 + 2**10]), 1)[0, 0] == float(2**61 + 2**10)


def test_glossary_moves_only_the_best(spark, tmp_path):
    """3,000 parts of six names, each of the 30 queries shares a word with half of them; ties go by id."""
    names = [f"{a} {b}" for a in ("hot", "blue") for b in ("ring", "bolt", "wheel")]
    parts = [(i, names[i % 7 % 6], f"TYPE {i % 5}") for i in range(3000)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    out = []
    assert moved(spark, lambda: out.extend(QUERIES["glossary_search"](spark, str(tmp_path)).collect())) < 25_000
    score = lambda i, name: sum(min(5, 3 * (w in parts[i][1].split())) for w in name.split())
    best = {(q, f"g{i}", r + 1) for q, name, _ in parts[::100] for r, i in enumerate(sorted(range(3000), key=lambda i: (-score(i, name), f"g{i}"))[:5])}
    assert {(r["query_id"], r["id"], r["rank"]) for r in out} == best
    assert all(r["term"] == f"{parts[int(r['id'][1:])][1]} {r['id'][1:]}" and r["expansion"] == parts[int(r["id"][1:])][2] for r in out)


def expected_sparse(postings, queries, k):
    scores = {}
    for q, idx, w in queries:
        for d, i, tf in postings:
            if i == idx:
                scores.setdefault(q, Counter())[d] += math.floor(tf * w * 1e9 + 0.5)
    return {(q, d, s / 1e9, r + 1) for q, own in scores.items() for r, (d, s) in enumerate(sorted(own.items(), key=lambda x: (-x[1], x[0]))[:k])}


@pytest.mark.parametrize("common", [1 / 20, 2.0])
def test_sparse_against_a_loop(spark, small_batches, monkeypatch, common):
    """Several weights of an index, repeated rows, products of 0 and below, equal points, more blocks than one."""
    monkeypatch.setattr(blocks, "COMMON", common)
    monkeypatch.setattr(distinct_queries, "__defaults__", (7, 60))
    draw = random.Random(7)
    postings = [(d, draw.randrange(12), draw.choice([0.0, 0.5, 1 + math.log(3), -1.0])) for d in range(500) for _ in range(draw.randrange(6))]
    queries = [(q, draw.randrange(14), draw.choice([0.3, 2 / 3, -0.25])) for q in range(40) for _ in range(draw.randrange(1, 7))]
    own = spark.createDataFrame(postings, "doc_id long, idx long, tf double").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, idx long, weight double")
    found = lambda df: {tuple(r) for r in df.select("query_id", "id", "score", "rank").collect()}
    assert found(sparse_top_k(own, asked, 5)) == expected_sparse(postings, queries, 5)
    allowed = spark.createDataFrame([(i,) for i in range(0, 500, 3)], "id long")
    for table in (own, packed(own, "doc_id", "tf").withColumnRenamed("doc_id", "id")):
        assert found(sparse_top_k(table, asked, 5, allowed=allowed)) == expected_sparse([p for p in postings if p[0] % 3 == 0], queries, 5)


def test_sparse_moves_only_the_best(spark):
    """2,000 points share an index with each of 50 different queries."""
    points = spark.createDataFrame([(i, ([1, 2 + i], [1.0, 2.0])) for i in range(2000)], "id long, sparse struct<indices: array<long>, values: array<double>>")
    postings = points.selectExpr("id AS doc_id", "explode(arrays_zip(sparse.indices, sparse.values)) AS p").selectExpr("doc_id", "p.indices AS idx", "p.values AS tf")
    asked = spark.createDataFrame([(q, i, 1.5) for q in range(50) for i in (1, 2 + q)], "query_id long, idx long, weight double")
    assert moved(spark, lambda: sparse_top_k(postings, asked, 3).collect()) < 20_000
    assert moved(spark, lambda: sparse_top_k(points, asked, 3).collect()) < 2_000


def indexed_texts(index):
    names = dict(index.vocabulary.select("idx", "token").collect())
    vectors = [(r["id"], sorted((names[i], v) for i, v in zip(*r["sparse"]))) for r in index.vectors.collect()]
    assert all(list(r["sparse"]["indices"]) == sorted(r["sparse"]["indices"]) for r in index.vectors.collect())
    return sorted(vectors), {r["token"]: r["doc_freq"] for r in index.vocabulary.collect()}


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_index_of_repeated_ids(spark, tmp_path, monkeypatch, sent):
    """Rows of one id and corpus are one text; of two corpora two texts with one vector. A small vocabulary is sent, a large one joined."""
    monkeypatch.setattr(search, "SENT_TOKENS", sent)
    rows = [(1, "walrus otter", "a"), (1, "otter", "a"), (1, "otter heron", "b"), (2, "heron heron", "b"), (3, None, "b"), (4, "", "c")]
    index = SearchIndex.build(Store(spark, str(tmp_path)), "i", spark.createDataFrame(rows, "doc_id long, text string, source string"))
    two = 1 + math.log(2)
    assert indexed_texts(index) == ([(1, [("heron", 1.0), ("otter", 1.0), ("otter", two), ("walrus", 1.0)]), (2, [("heron", two)])], {"heron": 2, "otter": 2, "walrus": 1})


def test_index_moves_counts_of_tokens_and_no_texts(spark, tmp_path):
    """2,000 texts of 20 of 40 words in one corpus: a row per text and word is 40,000 rows each time."""
    texts = [(i, " ".join(f"{c}{d}" for c in "abcdefgh" for d in "vwxyz" if (ord(c) * 7 + ord(d) * 3 + i) % 2), "s") for i in range(2000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    assert moved(spark, lambda: SearchIndex.build(Store(spark, str(tmp_path)), "i", docs)) < 10_000


@pytest.fixture
def large_tables(spark):
    """Nothing counts as small enough to be sent on its own account."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_glossary_moves_keys_and_no_entries(spark, tmp_path, large_tables):
    """Of 6,000 parts the keys are moved once, to find repeated ones; of the entries only those that are hit."""
    parts = [(i, f"{('hot', 'blue', 'old')[i % 3]} ring", "T") for i in range(6000)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    out = []
    assert moved(spark, lambda: out.extend(QUERIES["glossary_search"](spark, str(tmp_path)).collect())) < 9_000
    assert len(out) == 300 and all((r["term"], r["expansion"]) == (f"{parts[int(r['id'][1:])][1]} {r['id'][1:]}", "T") for r in out)


@pytest.mark.parametrize("grouped", [10_000, 1])
def test_lexical_columns_of_repeated_keys(spark, small_batches, monkeypatch, grouped):
    """Each row of a hit's key with its own values, over several blocks and queries with the same words; few repeated keys and too many."""
    monkeypatch.setattr(lexical, "REPEATED", grouped)
    monkeypatch.setattr(lexical, "SPREAD", 3)
    monkeypatch.setattr(distinct_queries, "__defaults__", (7, 60))
    draw = random.Random(9)
    items = [(i, words(draw, 2), words(draw, 5), f"v{i}") for i in range(300)] + [(i, words(draw, 2), words(draw, 5), f"again{i}") for i in (3, 3, 8, 100, 299)]
    queries = [(i, words(draw, draw.choice([1, 2, 9]))) for i in range(30)] + [(i, "w0 w1 w1") for i in range(30, 40)]
    own = spark.createDataFrame(items, "id long, title string, text string, value string").repartition(3)
    got = lexical_rank(own, spark.createDataFrame(queries, "query_id long, query string"), "id", title="title", limit=4, columns=["value", "title"])
    expected = {(*hit, v, title) for hit in expected_lexical([x[:3] for x in items], queries, 4) for k, title, _, v in items if k == hit[1]}
    rows = [tuple(r) for r in got.select("query_id", "key", "score", "rank", "value", "title").collect()]
    assert set(rows) == expected and len(rows) == len(expected)


def test_lexical_groups_only_repeated_keys(spark):
    """Of 3,000 items two share a key; the keys are moved, the words of the others aren't."""
    items = spark.createDataFrame([(i, f"all own{i}") for i in range(3000)] + [(7, "all again")], "key long, text string")
    queries = spark.createDataFrame([(1, "all again")], "query_id long, query string")
    out = []
    assert moved(spark, lambda: out.extend(lexical_rank(items, queries, limit=3).collect())) < 4_000
    assert [(r["key"], r["score"]) for r in sorted(out, key=lambda r: r["rank"])] == [(7, 1.5), (0, 0.5), (1, 0.5)]
