import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from loomspark.operators import embedding as em
from loomspark.operators import fragments as fr
from loomspark.operators import indexing as ix
from loomspark.operators import points as po
from loomspark.operators import vocabulary as voc
from loomspark.operators.skew import attach_by_key
from loomspark.sources.generations import EmbeddingIdentity, current, ensure_generation, verified
from loomspark.sources.tables import Store, numbered, upsert
from loomspark.streaming.deltas import event_windows, upsert_stream, vocabulary_stream


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.names() == [] and not store.exists("c")
    with pytest.raises(ValueError):
        store.create("c", "id long", 0)
    assert store.create("c", "id long, v string", 8) and not store.create("c", "id long, v string")
    before = store.read("c")
    store.upsert("c", spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), ["id"])
    store.upsert("c", spark.createDataFrame([(2, "c")], "id long, v string"), ["id"])
    assert sorted(rows(store.read("c"))) == [(1, "a"), (2, "c")] and before.count() == 0
    assert store.metadata("c") == {"dimension": 8} and store.names("c") == ["c"]
    store.set_metadata("c", identity={"model": "m"})
    with pytest.raises(ValueError):
        store.set_metadata("c", identity={"model": "n"})
    assert store.vacuum("c") == 2 and store.read("c").count() == 2
    assert store.drop("c") and not store.exists("c")


def test_upsert_and_numbers(spark):
    old = spark.createDataFrame([(None, "x"), (1, "y")], "id long, v string")
    new = spark.createDataFrame([(None, "z", 1), (None, "w", 2), (3, "q", 1)], "id long, v string, at int")
    assert sorted(rows(upsert(old, new, ["id"], "at").select("id", "v")), key=str) == [(1, "y"), (3, "q"), (None, "w")]
    df = spark.range(1000).withColumn("v", (F.col("id") * 37) % 101)
    got = numbered(df, [F.desc("v"), F.asc("id")], "n", 5).orderBy("n").collect()
    expected = sorted(((i * 37) % 101, i) for i in range(1000))
    assert [(r["v"], r["id"]) for r in got] == sorted(expected, key=lambda x: (-x[0], x[1])) and [r["n"] for r in got] == list(range(5, 1005))
    assert numbered(df.limit(0), [F.asc("id")], "n").count() == 0


def test_points(spark):
    p = spark.createDataFrame([(1, "note", "en", [1.0]), (2, "code_chunk", None, [2.0])], "id long, type string, lang string, dense array<float>")
    assert [r["id"] for r in po.delete_by_filter(p, "lang", "en").collect()] == [2]
    assert po.delete_points(p, p.filter("id = 1")).count() == 1
    assert [r["lang"] for r in po.update_payload(p, F.col("lang") == "en", {"lang": "de"}).orderBy("id").collect()] == ["de", None]
    assert "dense" not in po.retrieve(p, p).columns and "dense" in po.retrieve(p, p, True).columns
    assert po.scroll(p, None, ["lang"]).count() == 1 and po.scroll(p, None, ["lang", "type"], most=1).count() == 1
    assert po.invalid_payloads(p.withColumn("start_line", F.lit(-1))).count() == 1
    made = p.select(po.point(F.lit("k"), "dense", po.sparse_struct(F.array(F.lit(1)), F.array(F.lit(0.5)))).alias("p")).select("p.*")
    assert made.first()["sparse"]["indices"] == [1]


TEXT = "  alpha 🦊\n" * 12 + "TAILNEEDLE " + " omega " * 8


def test_spans(spark):
    cuts = fr.span_cuts(TEXT, most_bytes=40)
    assert "".join(TEXT[a:b] for a, b in cuts) == TEXT and all(len(TEXT[a:b].encode()) <= 40 for a, b in cuts)
    words = lambda t: len(t.split())
    cuts = fr.span_cuts(TEXT, prefix="p ", most_tokens=5, most_chars=50, count=words)
    assert "".join(TEXT[a:b] for a, b in cuts) == TEXT and all(words("p " + TEXT[a:b]) <= 5 and len(TEXT[a:b]) + 2 <= 50 for a, b in cuts)
    for bad in (dict(most_bytes=3), dict(most_chars=1, prefix="ab")):
        with pytest.raises(ValueError):
            fr.span_cuts("🦊", **bad)
    df = spark.createDataFrame([(7, TEXT), (8, ""), (9, None)], "id long, text string")
    got = fr.spans(df, "id", "text", most_bytes=40).orderBy("index").collect()
    assert "".join(r["text"] for r in got) == TEXT and got[0]["count"] == len(got)
    assert "".join(r["text"] for r in fr.char_spans(df, "id", "text", 10).orderBy("index").collect()) == TEXT


def fragments(spark):
    parents = spark.createDataFrame([("a", TEXT, "note", "secret"), ("b", "short", "note", "s")], "id string, text string, type string, extra string")
    return parents, fr.fragment_rows(parents, fr.spans(parents, "id", "text", most_bytes=40))


def test_lineage(spark):
    parents, made = fragments(spark)
    first = made.filter("id = 'a'").first()
    assert first["extra"] == "secret" and made.filter("fragment.index > 0 AND extra IS NOT NULL").count() == 0
    assert made.filter(~fr.valid_marker()).count() == 0 and made.filter("fragment.index > 0 AND type = 'note'").count() > 0
    verified(made)
    for damage in ("fragment.index <> 1", "fragment.index > 0 OR id = 'b'", "NOT (fragment.parent_id = 'a' AND fragment.index = fragment.count - 1)"):
        with pytest.raises(ValueError):
            verified(made.filter(damage))
    again = fr.fragment_rows(parents.withColumn("text", F.lit("now short")), fr.spans(parents.withColumn("text", F.lit("now short")), "id", "text", most_bytes=40))
    assert fr.replace_groups(made, again).count() == 2
    t = spark.createDataFrame([("x", None, "c"), (None, "content", "c")], "embedding_text string, embedding_text_field string, content string")
    assert [r[0] for r in t.select(fr.embedding_text(["content"])).collect()] == ["x", "c"]


def test_generations(spark, tmp_path):
    store = Store(spark, str(tmp_path / "g"))
    parents, made = fragments(spark)
    store.publish("c", made)
    one = EmbeddingIdentity("m", "http://user:secret@host/v1/", 8)
    assert "secret" not in one.endpoint and one.endpoint_auth_fingerprint and EmbeddingIdentity.from_dict(one.to_dict()) == one
    for bad in (dict(dimension=0), dict(profile="x"), dict(input_encoding="token_ids"), dict(max_input_bytes=-1)):
        with pytest.raises(ValueError):
            EmbeddingIdentity(**{"model": "m", "endpoint": "e", "dimension": 3} | bad)
    calls = []

    def rebuild(canonical):
        calls.append(1)
        p = canonical.select("id", "type", "extra").join(parents.select("id", "text"), "id")
        return fr.fragment_rows(p, fr.spans(p, "id", "text", most_bytes=60))

    ensure_generation(store, "c", one, rebuild)
    ensure_generation(store, "c", one, rebuild)
    assert len(calls) == 1 and current(store, "c").identity.fingerprint == one.fingerprint
    version = current(store, "c").version
    with pytest.raises(ValueError):
        ensure_generation(store, "c", EmbeddingIdentity("other", "e", 8), lambda c: made.filter("id = 'b'"))
    assert current(store, "c").version == version


def test_embedding(spark):
    df = spark.createDataFrame([("a b",), ("a b",), ("c",), ("",), (None,)], "t string")
    got = em.embed(df, "t", lambda: em.HashingEmbedder(8), 8).collect()
    assert len(got) == 2 and all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-5 for r in got)
    with pytest.raises(Exception, match="numbers"):
        em.embed(df, "t", lambda: em.HashingEmbedder(8), 9).collect()
    cache = spark.createDataFrame([("c", [1.0] * 8)], "cache_key string, embedding array<float>")
    every, fresh = em.embed_cached(df, "t", lambda c: c, cache, lambda: em.HashingEmbedder(8), 8)
    assert every.count() == 2 and [r["cache_key"] for r in fresh.collect()] == ["a b"]
    assert [len(b) for b in em.requests(["x"] * 5, 2, 100)] == [2, 2, 1] and [len(b) for b in em.requests(["xx", "yyyyy", "z"], 9, 4)] == [1, 1, 1]
    assert em.prefix("qwen3", "query", "do") == "Instruct: do\nQuery:"
    for wrong in (np.zeros((1, 3)), np.full((2, 3), np.nan)):
        with pytest.raises(ValueError):
            em.checked(wrong, 2, 3)


def test_indexing(spark):
    import datetime as dt

    at = dt.datetime(2025, 1, 1)
    f = spark.createDataFrame([(f"f{i}", f"Sub{i}", "Person", "works_at", "Acme", "Company", None, 1.0, None, None, at, at) for i in range(3)], "id string, subject string, subject_type string, predicate string, object string, object_type string, context string, confidence double, valid_from date, valid_to date, created timestamp, modified timestamp")
    s = spark.createDataFrame([("f0", "note", "deleted")], "fact_id string, source_type string, status string")
    p = ix.fact_payloads(f, s)
    assert p.filter("fact_id = 'f0'").first()["has_deleted_source"] is True and p.filter("fact_id = 'f1'").first()["source_count"] == 0
    done = ix.index_all(p, voc.empty(spark), "facts", "content", lambda: em.HashingEmbedder(8))
    assert (done.total, done.indexed) == (3, 3) and done.points.filter("dense IS NULL OR sparse IS NULL").count() == 0
    tokens = {t for r in ix.stored_tokens(done.points).collect() for t in r["tokens"]}
    assert tokens == {r["token"] for r in done.state.vocabulary.filter("doc_freq > 0").collect()}
    again = ix.index_all(p, done.state, "facts", "content", lambda: em.HashingEmbedder(8), done.points.filter("fact_id <> 'f2'"))
    assert again.indexed == 1 and again.points.count() == 3
    less = ix.change_index(done.state, "facts", p.limit(0), p.filter("fact_id = 'f0'"), "content")
    assert {r["token"]: r["doc_freq"] for r in less.vocabulary.collect()}["acme"] == 2


def test_streams(spark, tmp_path):
    store = Store(spark, str(tmp_path / "st"))
    store.create("p", "id long, v string, at int")
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "id long, v string, at int").write.parquet(src)
    stream = spark.readStream.schema("id long, v string, at int").parquet(src)
    for _ in range(2):
        upsert_stream(stream, store, "p", ["id"], "at", str(tmp_path / "cp")).awaitTermination()
    assert sorted(rows(store.read("p").select("id", "v"))) == [(1, "b"), (2, "c")]
    empty = voc.empty(spark)
    store.publish_parts("v", {"vocabulary": empty.vocabulary, "contributions": empty.contributions, "doc_counts": empty.doc_counts})
    src = str(tmp_path / "in2")
    deltas = "codebase_id string, token string, added long, removed long, docs long"
    spark.createDataFrame([("a", "x", 2, 0, 2), ("a", "x", 0, 1, -1)], deltas).coalesce(1).write.parquet(src)
    vocabulary_stream(spark.readStream.schema(deltas).parquet(src), store, "v", str(tmp_path / "cp2")).awaitTermination()
    assert rows(store.read("v", "vocabulary").select("token", "doc_freq")) == [("x", 1)] and rows(store.read("v", "doc_counts")) == [("a", 1)]
    ev = spark.createDataFrame([("2024-01-01 10:10:00", "click", 1.0), ("2024-01-01 10:50:00", "click", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows(event_windows(ev).select("events", "value")) == [(2, 3.0)]


def test_attach_by_key(spark):
    data = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 0).when(F.col("id") == 7, None).otherwise(F.col("id") % 50).alias("k"))
    per = data.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k IS NULL OR k <> 3").withColumn("v", F.col("k") * 10)
    for hot in (10**9, 500, 1):
        got = attach_by_key(data, per, ["k"], "n", ["id"], hot_rows=hot, max_hot=2)
        assert got.count() == data.filter("k IS NOT NULL AND k <> 3").count() and got.filter("v <> k * 10").count() == 0
        assert attach_by_key(data, per, ["k"], "n", ["id"], how="left", hot_rows=hot).count() == 4000
