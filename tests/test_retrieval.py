import math

import pytest
from helpers import rows

from loomspark.operators import vocabulary as voc
from loomspark.operators.fusion import fuse_full_outer, reciprocal_rank_fusion
from loomspark.operators.fuzzy import nearest_tokens
from loomspark.operators.lexical import lexical_rank
from loomspark.operators.search import grouped_search, hybrid_search, hydrated
from loomspark.operators.tfidf import TfidfModel, packed


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")  # no values: an empty table


def freqs(spark, data):
    return spark.createDataFrame([(c, t, n) for c, ts in data.items() for t, n in ts.items()], "codebase_id string, token string, doc_freq long")


def sizes(spark, data):
    return spark.createDataFrame(list(data.items()), "codebase_id string, doc_count long")


def vocab(state):
    return {r["token"]: r["doc_freq"] for r in state.vocabulary.collect()}


def test_tfidf(spark, tmp_path):
    m = TfidfModel.fit(texts(spark, "hello world", "hello again", "goodbye world"))
    idf = {r["token"]: r["idf"] for r in m.vocabulary.collect()}
    assert idf["hello"] < idf["goodbye"]
    assert m.vectors(texts(spark, "completely unknown words")).count() == 0
    two = TfidfModel.fit(texts(spark, "alpha beta", "beta gamma")).extend(texts(spark, "delta epsilon", "epsilon zeta"))
    idf = {r["token"]: r["idf"] for r in two.vocabulary.collect()}
    assert two.docs == 4 and abs(idf["alpha"] - (math.log(5 / 2) + 1)) < 1e-12
    assert two.growth_ratio() == 1.0 and two.needs_reindex()
    small = TfidfModel.fit(texts(spark, "alpha")).extend(texts(spark, "beta"))
    assert {r["token"]: r["idx"] for r in small.vocabulary.collect()} == {"alpha": 0, "beta": 1}
    assert TfidfModel.fit(texts(spark)).extend(texts(spark, "beta")).vocabulary.first()["idx"] == 0
    two.save(str(tmp_path / "m"))
    assert TfidfModel.load(spark, str(tmp_path / "m")).docs == 4
    sparse = packed(two.vectors(texts(spark, "beta beta alpha"))).first()["sparse"]
    assert list(sparse["indices"]) == sorted(sparse["indices"])
    asked = spark.createDataFrame([(1, "alphq beta")], "query_id long, text string")
    assert two.query_vectors(asked).count() == 2 and two.query_vectors(asked, fuzzy=False).count() == 1


def test_vocabulary_transitions(spark):
    s = voc.register(voc.empty(spark), freqs(spark, {"test": {"hello": 1, "world": 1, "foo": 1, "bar": 1}}), sizes(spark, {"test": 2}))
    assert sorted(r["idx"] for r in s.vocabulary.collect()) == [0, 1, 2, 3]
    assert tuple(voc.totals(s).select("total_docs", "vocab_size").first()) == (2, 4)
    with pytest.raises(Exception, match="99"):
        voc.tokens_of(s, spark.createDataFrame([(0, 0), (1, 99)], "ordinal int, idx long")).collect()
    with pytest.raises(ValueError):
        voc.register(s, freqs(spark, {"x": {"a": 3}}), sizes(spark, {"x": 2}))

    both = voc.register(voc.empty(spark), freqs(spark, {"a": {"shared": 1}, "b": {"shared": 1}}), sizes(spark, {"a": 1, "b": 1}))
    after = voc.incremental(both, freqs(spark, {}), freqs(spark, {"a": {"shared": 3}}), spark.createDataFrame([("a", -3)], "codebase_id string, change long"))
    assert vocab(after) == {"shared": 1} and after.contributions.agg({"doc_freq": "sum"}).first()[0] == 1
    one = voc.register(voc.empty(spark), freqs(spark, {"a": {"shared": 1}}), sizes(spark, {"a": 1}))
    gone = voc.incremental(one, freqs(spark, {"a": {"shared": 1}}), freqs(spark, {"a": {"shared": 2}}), spark.createDataFrame([("a", -1)], "codebase_id string, change long"))
    assert vocab(gone) == {"shared": 0} and gone.contributions.count() == 0
    assert vocab(voc.unregister(both, "a")) == {"shared": 1}
    replaced = voc.register(both, freqs(spark, {"a": {"other": 1}}), sizes(spark, {"a": 1}))
    assert vocab(replaced) == {"shared": 1, "other": 1} and voc.new_tokens(both, replaced).count() == 1


def test_vocabulary_vectors(spark):
    s = voc.register(voc.empty(spark), freqs(spark, {"t": {"common": 3, "rare": 1}}), sizes(spark, {"t": 3}))
    got = rows(voc.document_vectors(s, texts(spark, "rare rare rare")).select("tf"))
    assert abs(got[0][0] - (1 + math.log(3))) < 1e-9
    asked = spark.createDataFrame([(1, "common rare rarr")], "query_id long, text string")
    w = {r["idx"]: r["weight"] for r in voc.query_vectors(s, asked).collect()}
    idx = {r["token"]: r["idx"] for r in s.vocabulary.collect()}
    assert w[idx["rare"]] > w[idx["common"]]


@pytest.mark.parametrize(
    ("token", "vocabulary", "threshold", "expected"),
    [
        ("abcdefgh", [("abcdefxy", 0, 1)], 0.75, ("abcdefxy", 0.75)),
        ("abcdefgh", [("abcdefxy", 0, 1)], 0.7500001, None),
        ("abcz", [("abcx", 0, 1), ("abcy", 1, 1)], 0.7, ("abcx", 0.75)),
        ("abcz", [("abcy", 0, 1), ("abcx", 1, 1)], 0.7, ("abcy", 0.75)),
        ("abcdefgh", [("abcdefgx", 0, 1), ("abcdefg", 1, 1)], 0.75, ("abcdefgx", 0.875)),
        ("abcdefghijkl", [("abcdefghi", 0, 1)], 0.7, None),
        ("parsr", [("parser", 0, 0), ("parsers", 2, 1)], 0.7, ("parsers", 1 - 2 / 7)),
    ],
)
def test_fuzzy(spark, token, vocabulary, threshold, expected):
    got = rows(nearest_tokens(spark.createDataFrame([(token,), (None,), ("",)], "token string"), spark.createDataFrame(vocabulary, "token string, idx long, doc_freq long"), threshold).select("match", "similarity"))
    assert (got == []) if expected is None else (got[0][0] == expected[0] and abs(got[0][1] - expected[1]) < 1e-9)


def lists(spark, *ranked):
    return spark.createDataFrame([(1, i, r + 1, k, f"{i}:{k}") for i, keys in enumerate(ranked) for r, k in enumerate(keys)], "query_id long, list_id int, rank int, key string, item string")


def fused(df):
    return [r["key"] for r in df.orderBy("rank").collect()]


def test_rank_fusion(spark):
    df = reciprocal_rank_fusion(lists(spark, ["dense-only", "shared"], ["shared", "sparse-only"]), item="item")
    assert fused(df) == ["shared", "dense-only", "sparse-only"]
    first = df.filter("rank = 1").first()
    assert first["ranks"] == {0: 2, 1: 1} and first["item"] == "0:shared"
    assert fused(reciprocal_rank_fusion(lists(spark, ["dense-top", "shared"], ["sparse-top", "shared"]), weights=[0.01, 1.0])) == ["sparse-top", "shared", "dense-top"]
    assert fused(reciprocal_rank_fusion(lists(spark, ["b", "a"], ["c"]))) == ["b", "c", "a"]
    assert fused(reciprocal_rank_fusion(lists(spark, ["a", "b"]), limit=0)) == ["a"]
    assert fused(reciprocal_rank_fusion(lists(spark, ["a"], ["b"]), weights=[0.0, 1.0])) == ["b"]
    with pytest.raises(ValueError):
        reciprocal_rank_fusion(lists(spark, ["a"], ["b"]), weights=[1.0], lists=2)
    again = reciprocal_rank_fusion(lists(spark, ["duplicate", "duplicate", "unique"])).orderBy("rank").collect()
    assert [r["key"] for r in again] == ["duplicate", "unique"] and abs(again[0]["score"] - 1 / 61) < 1e-12
    side = lambda *keys: spark.createDataFrame([(1, k, i + 1, k) for i, k in enumerate(keys)], "query_id long, id string, rank int, payload string")
    assert [r["id"] for r in fuse_full_outer(side("shared", "dense_only"), side("shared", "sparse_only")).orderBy("rank").collect()][0] == "shared"


def test_hybrid_and_grouped(spark):
    data = [(i, [100.0 - i, 1.0], "large") for i in range(20)] + [(20, [2.0, 1.0], "small"), (21, [1.0, 1.0], "tiny"), (22, None, "none")]
    points = spark.createDataFrame(data, "id long, dense array<float>, file string")
    postings = spark.createDataFrame([(20, 1, 2.0), (21, 1, 1.0)], "doc_id long, idx long, tf double")
    dense = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, dense array<float>")
    sparse = spark.createDataFrame([(1, 1, 1.0)], "query_id long, idx long, weight double")
    got = grouped_search(points, postings, dense, sparse, "file", limit=3, sparse_weight=0.0).orderBy("rank").collect()
    assert [(r["group"], r["id"]) for r in got] == [("large", 0), ("small", 20), ("tiny", 21)]
    assert grouped_search(points, postings, dense, sparse, "file", dense_weight=0, sparse_weight=0).count() == 0
    assert hybrid_search(points, postings, dense, sparse, limit=5).count() == 5
    only = hybrid_search(points, postings, dense, sparse, dense_weight=0.0).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in only] == [(20, 2.0), (21, 1.0)]
    assert [r["id"] for r in hybrid_search(points, postings, dense, sparse, sparse_weight=0.0, limit=2).orderBy("rank").collect()] == [0, 1]
    with pytest.raises(ValueError):
        hybrid_search(points, postings, dense, sparse, dense_weight=0, sparse_weight=0)
    hits = spark.createDataFrame([(1, "a")], "k long, h string")
    rows_ = spark.createDataFrame([(1, "a", "full")], "k long, h string, definition string")
    assert hydrated(hits, rows_, "k", ["definition"], "h").first()["definition"] == "full"
    with pytest.raises(Exception, match="parent"):
        hydrated(spark.createDataFrame([(2, "a")], "k long, h string"), rows_, "k", ["definition"], "h").collect()


def test_lexical(spark):
    items = spark.createDataFrame([("a", "parser", "", [], "x"), ("b", "", "", ["parser"], "x"), ("c", "", "", [], "parser " * 100), ("d", None, None, None, None)], "key string, title string, path string, tags array<string>, text string")
    q = lambda t: spark.createDataFrame([(1, t)], "query_id long, query string")
    got = lexical_rank(items, q("parser"), title="title", path="path", tags="tags").orderBy("rank").collect()
    assert [(r["key"], r["score"]) for r in got] == [("c", 5.0), ("a", 2.0), ("b", 2.0)]
    assert lexical_rank(items, q("nothing")).count() == 0 and lexical_rank(items, q("")).count() == 0
