"""Changes of state and storage beyond what the queries show: errors, bounds, splits."""

import itertools
import time

import pytest
from helpers import rows
from pyspark.sql import functions as F

from loomspark.functions.preprocess import Preprocessor
from loomspark.functions import text
from loomspark.operators import fragments as fr
from loomspark.operators import glossary as gl
from loomspark.operators import points as po
from loomspark.operators import vocabulary as voc
from loomspark.operators.graph import connections
from loomspark.operators.scoring import dense_scores, sparse_top_k
from loomspark.operators.search import SearchIndex, grouped_search
from loomspark.operators.skew import salted_join
from loomspark.operators.snapshots import snapshot_changes
from loomspark.session import in_time
from loomspark.sources.tables import Store


def test_equal_texts_have_equal_scores(spark):
    words = [f"w{i}" for i in range(40)]
    postings = spark.createDataFrame([(d, i, 1.0 + (i * 37 % 11) / 7) for d in range(30) for i in range(40)], "doc_id long, idx long, tf double").repartition(13)
    asked = spark.createDataFrame([(1, i, 0.1 + i / 3) for i in range(len(words))], "query_id long, idx long, weight double")
    got = sparse_top_k(postings, asked, 10).orderBy("rank").collect()
    assert [r["id"] for r in got] == list(range(10)) and len({r["score"] for r in got}) == 1


def test_salted_join_is_the_join(spark):
    left = spark.createDataFrame([(i % 3 if i % 2 else 0, i) for i in range(200)] + [(None, 999)], "k int, v int")
    right = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (7, "d"), (None, "e")], "k int, w string")
    plain = sorted(rows(left.join(right, "k").select("k", "v", "w")))
    for hot in (5, 50, 10_000):
        assert sorted(rows(salted_join(left, right, ["k"], ["v"], hot).select("k", "v", "w"))) == plain
    assert salted_join(left.limit(0), right, ["k"], ["v"]).count() == 0


def test_snapshots_tell_every_null_from_every_value(spark):
    """All states of a file against all others, alone in its range and beside a change."""
    states = list(itertools.product((None, b"\x00", b"\x01"), (None, 0, 1), (None, 0.0, 1.0)))
    data, expected = [], set()
    for k, (a, b) in enumerate(itertools.product(states, states)):
        for snapshot, s in ((1, a), (2, b)):
            data.append((f"g{k}", snapshot, "p", snapshot, *s))
        known = a[0] is not None and b[0] is not None
        if (a[0] != b[0]) if known else (a[1:] != b[1:]):
            expected.add(f"g{k}")
    lists = spark.createDataFrame(data, "group string, snapshot int, path string, at int, hash binary, size long, mtime double")
    assert {r["group"] for r in snapshot_changes(lists).collect()} == expected


def test_time_limit_names_the_operation(spark):
    assert in_time(spark, "counting", 60, lambda: spark.range(5).count()) == 5
    slow = spark.range(0, 8, 1, 4).mapInArrow(lambda batches: (time.sleep(20) or b for b in batches), "id long")
    with pytest.raises(TimeoutError, match="slow search"):
        in_time(spark, "slow search", 1.5, lambda: slow.count())
    assert spark.range(5).count() == 5


def test_upsert_writes_only_the_buckets_it_touches(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    df = spark.range(400).selectExpr("id", "concat('v', id) AS v")
    store.publish_buckets("t", df, ["id"], 8)
    before = store._manifest("t")["buckets"]
    old = store.read("t")
    store.upsert("t", spark.createDataFrame([(7, "new"), (1000, "more")], "id long, v string"), ["id"])
    after = store._manifest("t")["buckets"]
    assert len(before) == 8 and 1 <= sum(before[b] != after[b] for b in after) <= 2
    got = dict(rows(store.read("t")))
    assert len(got) == 401 and got[7] == "new" and got[8] == "v8" and got[1000] == "more"
    assert old.filter("id = 7").first()["v"] == "v7"
    store.vacuum("t")
    assert store.read("t").count() == 401
    store.publish_buckets("e", df.limit(0), ["id"], 4)
    assert store.read("e").count() == 0 and store.upsert("e", df, ["id"]) and store.read("e").count() == 400


def test_broken_groups_are_not_written(spark):
    parents = spark.createDataFrame([("a", "x" * 30), ("b", "y" * 10)], "id string, text string")
    own = fr.fragment_rows(parents, fr.char_spans(parents, "id", "text", 8))
    assert fr.replace_groups(own.limit(0), own).count() == 6
    with pytest.raises(ValueError, match="broken"):
        fr.replace_groups(own.limit(0), own.filter("fragment.index <> 1"))
    sized = own.withColumn("n", F.lit(31)).filter("fragment.parent_id = 'a'")
    with pytest.raises(ValueError, match="coverage"):
        fr.replace_groups(own.limit(0), sized, "n")


def test_texts_that_do_not_resolve(spark):
    entries = spark.createDataFrame([("g1", "T", "E", "D", None)], "id string, term string, expansion string, definition string, domain string")
    aliases = spark.createDataFrame([], "entry_id string, alias string")
    hashed = entries.select(F.sha2(F.concat_ws("|", "term", "expansion", "definition"), 256)).first()[0]
    ddl = "id string, type string, glossary_id string, entry_hash string, content string, embedding_text string"
    good = [("1", "glossary", "g1", hashed, None, None), ("2", "fact", None, None, "f", None), ("3", "note", None, None, "c", "e"), ("4", "note", None, None, "c", "")]
    assert dict(rows(fr.resolved_texts(spark.createDataFrame(good, ddl), entries, aliases))) == {"1": "T E D", "2": "f", "3": "e", "4": "c"}
    for bad in (("1", "glossary", "g1", "old", "c", "e"), ("1", "glossary", "gone", hashed, None, None), ("1", "fact", None, None, "", "e"), ("1", "note", None, None, None, None)):
        with pytest.raises(Exception, match="no valid embedding text"):
            fr.resolved_texts(spark.createDataFrame([bad], ddl), entries, aliases).collect()


def test_counts_do_not_overflow(spark):
    state = voc.State(spark.createDataFrame([("t", 0, 5)], "token string, idx long, doc_freq long"), spark.createDataFrame([("c", "t", voc.MOST - 1)], "codebase_id string, token string, doc_freq long"), spark.createDataFrame([("c", 1)], "codebase_id string, doc_count long"))
    none = spark.createDataFrame([], "codebase_id string, token string, doc_freq long")
    net = spark.createDataFrame([("c", 1)], "codebase_id string, change long")
    with pytest.raises(Exception, match="64 bits"):
        voc.incremental(state, spark.createDataFrame([("c", "t", 2)], none.schema), none, net).contributions.collect()


def test_connections_without_a_cap(spark):
    links = [("s", f"m{i}", f"a{i}") for i in range(30)] + [(f"m{i}", f"t{i}", f"b{i}") for i in range(30)]
    adjacent = spark.createDataFrame([(n, "x", f, r) for a, b, f in links for n, r in ((a, "subject"), (b, "object"))], "entity_name string, entity_type string, fact_id string, role string")
    assert connections(adjacent, "s", max_depth=2, limit=1000, visited_cap=10).count() < 60
    assert connections(adjacent, "s", max_depth=2, limit=1000, visited_cap=None).count() == 60 == connections(adjacent, "s", max_depth=2, limit=1000).count()


def test_best_point_of_each_value(spark):
    points = spark.createDataFrame([(i, [1.0, i % 7 / 10], f"g{i % 3}" if i % 5 else None) for i in range(60)], "id long, dense array<double>, g string")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, dense array<double>")
    every = {}
    for q, i, s in rows(dense_scores(points.filter("g IS NOT NULL"), asked).select("query_id", "id", "score")):
        g = f"g{i % 3}"
        every[q, g] = min(every.get((q, g), (9, 9)), (-s, i))
    none = spark.createDataFrame([], "doc_id long, idx long, tf double"), spark.createDataFrame([], "query_id long, idx long, weight double")
    got = {(r["query_id"], r["group"]): r["id"] for r in grouped_search(points, none[0], asked, none[1], "g", sparse_weight=0.0).collect()}
    assert got == {k: i for k, (_, i) in every.items()}


def test_index_is_written_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "walrus otter", "a"), (2, "otter otter", "b"), (3, None, "b")], "doc_id long, text string, source string")
    index = SearchIndex.build(Store(spark, str(tmp_path)), "i", docs)
    again = SearchIndex.open(Store(spark, str(tmp_path)), "i")
    assert sorted(rows(index.vocabulary)) == sorted(rows(again.vocabulary)) == [("otter", 0, 2), ("walrus", 1, 1)]
    assert sorted((d, i) for d, i, _ in rows(again.postings)) == [(1, 0), (1, 1), (2, 0)]


def test_camel_case_of_a_string_is_that_of_the_column(spark):
    values = ["getUserName", "HTTPServerError x", "plain words", "aB aB", "XMLParser2Go", "", "ÀbC", "A"]
    column = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", text.expand_camel_case("v").alias("e")).orderBy("i").collect()
    assert [(r["e"]["text"], r["e"]["added"]) for r in column] == [Preprocessor().camel(v) for v in values]


def test_payload_problems(spark):
    df = spark.createDataFrame([(1, "p", "x"), (2, None, "7"), (3, "p", "-1"), (4, "p", "12")], "i int, path string, size_bytes string")
    full = df.selectExpr("*", "'a' abs_path", "'l' language", "'h' file_hash", "3 line_count", "1.5D mtime")
    got = {r["i"]: (r["size_bytes"], r["summary"], r["problem"]) for r in po.typed_payloads(full, "code_file").collect()}
    assert got == {1: (None, "", "size_bytes is not of its type"), 2: (7, "", "path is missing"), 3: (-1, "", "size_bytes is negative"), 4: (12, "", None)}


def test_tools_update(spark):
    entries = spark.createDataFrame([("g1", "T", "E", "D", None)], "id string, term string, expansion string, definition string, domain string").selectExpr("*", "now() created", "now() modified")
    t = gl.Tools(entries.withColumn("entry_hash", F.lit("")), spark.createDataFrame([("g1", "A")], "entry_id string, alias string"))
    assert t.update("a", definition="  new ", domain="d")["id"] == "g1" and t.get("T")["definition"] == "new" and t.domains() == ["d"]
    assert t.update("T", term=" ")["code"] == "INVALID_INPUT" and t.update("T", colour="x")["code"] == "INVALID_INPUT" and t.update("none", term="x")["code"] == "NOT_FOUND"
    assert t.stats() == {"entries": 1, "aliases": 1, "domains": 1}
