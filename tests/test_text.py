import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from helpers import rows
from pyspark.sql import functions as F

from loomspark.functions import ids, scalars, text
from loomspark.functions.preprocess import CODE_SYNONYMS, COMMON_SYNONYMS, Preprocessor, default_preprocessor


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(expr("v")).collect()]


def model(t, least=2, stop=()):
    out = []
    for w in re.findall(r"[a-zA-Z_][a-zA-Z0-9_]*", t or ""):
        parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)", w) or w.split("_")
        out += [p.lower() for p in parts if len(p) >= least and p.lower() not in stop and not p.isdigit()]
    return out


GOLDEN = {
    "getUserData": ["get", "user", "data"], "UserDataService": ["user", "data", "service"], "get_user_data": ["get", "user", "data"],
    "UPPER_CASE": ["uppe", "case"], "HTTP2Server": ["htt", "server"], "X1": ["x1"], "abc123def456": ["abc", "def"], "XMLParser": ["xml", "parser"],
    "café": ["caf"], "A_B": [], "": [], "   ": [], "123": [], "🦊": [], "中文": [], "a" * 10_000: ["a" * 10_000],
    "12X1 3_Y2": ["x1", "y2"], "a" + "1" * 150 + "_B2": [], "a" + "1" * 9000 + "_B2": [], "1" * 9000 + "B2": ["b2"],
}


def test_tokens_golden(spark):
    assert column(spark, list(GOLDEN), text.tokens) == list(GOLDEN.values())
    assert column(spark, [None], text.tokens) == [[]]
    assert column(spark, ["the a is for with parser"], lambda c: text.tokens(c, stop=text.STOP_TOKENS)) == [["parser"]]
    assert column(spark, ["a ab abc abcd"], lambda c: text.tokens(c, 3)) == [["abc", "abcd"]]
    assert len(text.STOP_TOKENS) == 78


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="aBcXYZ_019 .-é中\n", max_size=40), min_size=50, max_size=50))
def test_tokens_model(spark, texts):
    assert column(spark, texts, text.tokens) == [model(t) for t in texts]


def test_literal_tokens(spark):
    got = column(spark, ["model.context_length /foo/bar gpt-5.5 HERMES_HOME snake_case", None], text.literal_tokens)
    assert got == [["model", "context_length", "foo", "bar", "gpt", "5", "5", "hermes_home", "snake_case"], []]


def test_similarity(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", "a"), ("same", "same"), (None, "x")], "a string, b string")
    assert [round(r[0], 6) for r in df.select(text.similarity("a", "b")).collect()] == [round(1 - 3 / 7, 6), 0.0, 1.0, 0.0]
    assert text.most_edits(8, 0.75) == 2 and text.most_edits(8, 0.7500001) == 1 and text.most_edits(3, 2.0) == -1


def test_camel_case(spark):
    got = column(spark, ["getUserData", "simple words", "XMLParser x"], text.expand_camel_case)
    assert [tuple(g) for g in got] == [("getUserData get user data", ["get", "user", "data"]), ("simple words", []), ("XMLParser x xml parser x", ["xml", "parser"])]


def test_ids(spark):
    import hashlib
    import json
    import uuid

    assert column(spark, ["fact:1"], ids.point_id)[0] == (lambda h: f"{h[:8]}-{h[8:12]}-4{h[13:16]}-{'89ab'[int(h[16], 16) & 3]}{h[17:20]}-{h[20:32]}")(hashlib.sha256(b"fact:1").hexdigest())
    df = spark.createDataFrame([("p\"é/", "ab" * 32, 0, 5, 1)], "p string, d string, s int, e int, i int")
    expected = str(uuid.uuid5(uuid.UUID("f5c375ee-5ff4-47b4-a383-56c4cf3a5c4c"), json.dumps(["p\"é/", "ab" * 32, 0, 5, 1], ensure_ascii=False)))
    assert df.select(ids.fragment_id("p", "d", "s", "e", "i")).first()[0] == expected
    df = spark.createDataFrame([(7, "ab" * 32, 0, 5, 1)], "p long, d string, s int, e int, i int")
    expected = str(uuid.uuid5(uuid.UUID("f5c375ee-5ff4-47b4-a383-56c4cf3a5c4c"), json.dumps([7, "ab" * 32, 0, 5, 1])))
    assert df.select(ids.fragment_id("p", "d", "s", "e", "i", True)).first()[0] == expected
    notes = spark.createDataFrame([("T", ["a", "b"], "c"), ("T", [], None)], "t string, g array<string>, c string")
    assert rows(notes.select(ids.note_text("t", "g", "c"))) == [("T\nTags: a, b\nCategory: c",), ("T",)]
    with pytest.raises(Exception, match="title"):
        spark.createDataFrame([(" ", [], None)], "t string, g array<string>, c string").select(ids.note_text("t", "g", "c")).collect()


def test_scalars(spark):
    df = spark.createDataFrame([("2024-01-15T10:30:00Z",), ("2024-01-15T10:30:00",), ("2024-01-15T12:30:00+02:00",), ("no",), (None,), ("",), ("2024-01-15",)], "v string")
    assert [r[0] for r in df.select(F.unix_seconds(scalars.parse_iso("v"))).collect()] == [1705314600] * 3 + [0] * 3 + [1705276800]
    assert column(spark, [None, 0, -3, 5, 10**9], lambda c: scalars.clamp_limit(c), "long") == [10, 10, 10, 5, 100_000]
    uuids = ["a5fecfb3-6489-4eec-a090-03234f11ae4f", "{a5fecfb364894eeca09003234f11ae4f}", "x", "", None]
    assert column(spark, uuids, scalars.is_uuid) == [True, True, False, False, False]
    assert scalars.parse_uuid("x") is None and not scalars.is_set(scalars.UNSET) and scalars.is_set(None)
    assert scalars.checked_path("/nowhere/at/all")["error"] is True


def test_preprocess(spark):
    p = Preprocessor({"fn": ["function"], "cls": ["class"]}, ["tag:", "category:", "path:", "-path:"])
    assert p.take_fields("tag:important find error") == ("find error", {"tag": "important"})
    assert p.take_fields("tag:urgent category:bugs search query") == ("search query", {"tag": "urgent", "category": "bugs"})
    assert p.take_fields("-path:tests find error") == ("find error", {"-path": "tests"})
    assert p.camel("simple words") == ("simple words", [])
    q = p("define fn in cls")
    assert q.text == "define fn function in cls class" and q.expanded_terms == ["function", "class"]
    assert len(COMMON_SYNONYMS) == 43 and len(CODE_SYNONYMS) == 41
    assert "websocket" in default_preprocessor(code=True)("ws").text
    one = default_preprocessor().over(spark.createDataFrame([("path:a getUser",)], "query string")).first()["processed"]
    assert one["fields"] == {"path": "a"} and one["text"] == "getuser get user" and one["expanded_terms"] == ["get", "user"]
