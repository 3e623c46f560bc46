import random

import numpy as np
import pytest

from loomspark.llm.leakage import _Hashes, edit_distances, leaked_items, leaked_word_for_word, walks, words_of

ITEMS = [(1, " ".join(f"alpha{i}" for i in range(30))), (2, "Der Größe nach, " + " ".join(f"w{i}" for i in range(20))), (3, "too short"), (4, None), (5, "")]


def tables(spark, docs, items=ITEMS):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item_id string, edits int")
    return d, spark.createDataFrame([(*r, "s", None) for r in items], "item_id long, text string, suite string, split string")


def found(spark, docs, items=ITEMS, **options):
    return sorted(tuple(r) for r in leaked_items(*tables(spark, docs, items), **options).select("doc_id", "item_id", "edits", "windows", "first_word").collect())


def w(a, b):
    return " ".join(f"alpha{i}" for i in range(a, b))


def test_word_for_word(spark):
    docs = [(1, "Before: " + w(3, 15).upper().replace(" ", ",\n-- ") + " after"), (2, w(3, 14)), (3, w(0, 8) + " other " + w(8, 30)), (4, "größe NACH " + " ".join(f"W{i}" for i in range(12))), (5, None), (6, ""), (7, w(0, 30))]
    got = sorted(tuple(r) for r in leaked_word_for_word(*tables(spark, docs)).collect())
    assert got == [(1, 1), (3, 1), (4, 2), (7, 1)]
    full = [r for r in found(spark, docs) if r[2] == 0]
    assert (1, 1, 0, 1, 1) in full and (7, 1, 0, 19, 0) in full and (3, 1, 0, 11, 9) in full


def test_edits(spark):
    one = w(0, 5) + " changed " + w(6, 12)
    gone = w(0, 5) + " " + w(6, 13)
    assert [r[:3] for r in found(spark, [(1, one), (2, gone), (3, w(0, 3) + " x y z q " + w(7, 12))])] == [(1, 1, 1), (2, 1, 2)]


def test_no_match_across_documents(spark):
    assert found(spark, [(1, w(0, 6)), (2, w(6, 12))]) == []
    assert found(spark, []) == [] and found(spark, [(1, w(0, 20))], [(4, None)]) == [] and found(spark, [(1, "a b")], []) == []


def test_small_filters_and_split_passages(spark):
    docs = [(1, w(0, 14)), (2, " ".join(f"w{i}" for i in range(15))), (3, w(1, 14)), (None, w(0, 13))]
    whole = found(spark, docs[:3])
    assert found(spark, docs[:3], most_bits=6) == whole == found(spark, docs[:3], hot_rows=2)
    assert [r[:3] for r in whole if r[2] == 0] == [(1, 1, 0), (2, 2, 0), (3, 1, 0)]
    assert {r[:3] for r in found(spark, docs[:3] * 2)} == {r[:3] for r in whole}
    assert leaked_items(*tables(spark, docs)).filter("doc_id IS NULL").count() == 1


def matrix(windows):
    hashes = _Hashes()
    return np.array([[hashes[x] for x in own] for own in windows], np.uint64)


@pytest.mark.parametrize("kind", ["unknown", "known", "insert", "delete", "both"])
def test_recall_of_two_edits(kind):
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"u{rng.randrange(500)}"
    own, other = [], []
    for _ in range(3000):
        text = [word() for _ in range(14)]
        part = text[:12]
        if kind in ("unknown", "known"):
            for at in rng.sample(range(12), 2):
                part[at] = "unknown" if kind == "unknown" else word()
        elif kind == "insert":  # one word more, so the last one falls out of the window
            part.insert(rng.randrange(12), word())
        elif kind == "delete":
            part = text[:13]
            del part[rng.randrange(12)]
        else:
            at, to = rng.sample(range(12), 2)
            part.insert(to, part.pop(at))
        own.append(text[:12])
        other.append(part[:12])
    a, b = matrix(own), matrix(other)
    near = edit_distances(a, b, 2) <= 2
    assert near.mean() > 0.95
    met = (walks(a) == walks(b)).any(1)
    assert met[near].mean() >= 0.9


def test_exact_distance():
    rng = random.Random(3)
    pairs = [([rng.choice("abc") for _ in range(12)], [rng.choice("abc") for _ in range(12)]) for _ in range(50)]
    pairs += [(x, [*x[1:3], "z", *x[3:12]]) for x, _ in pairs]

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x):
            new = [i + 1]
            for j, d in enumerate(y):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (c != d)))
            row = new
        return row[-1]

    got = edit_distances(matrix([x for x, _ in pairs]), matrix([y for _, y in pairs]), 2)
    for g, (x, y) in zip(got, pairs):
        assert (g > 2) == (distance(x, y) > 2) and (g > 2 or g == distance(x, y))


def test_against_brute_force(spark):
    rng = random.Random(10)
    vocabulary = [f"v{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(25))) for i in range(8)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(50)]
    for _ in range(30):
        t = words_of(rng.choice(items)[1])
        a = rng.randrange(14)
        texts.append("v1 v2 " + " ".join(t[a : a + 12]) + " v0")
    grams = {}
    for i, t in items:
        for a in range(len(words_of(t)) - 11):
            grams.setdefault(tuple(words_of(t)[a : a + 12]), set()).add(i)
    expected = {(d, i) for d, t in enumerate(texts) for a in range(len(words_of(t)) - 11) for i in grams.get(tuple(words_of(t)[a : a + 12]), ())}
    assert {r[:2] for r in found(spark, list(enumerate(texts)), items) if r[2] == 0} == expected


def test_items_stay_on_the_executors(spark):
    """Whatever the number of items, the plan is one pass over the documents and joins."""

    def shape(n):
        items = [(i, " ".join(f"q{i} r{j}" for j in range(8))) for i in range(n)]
        plan = leaked_items(*tables(spark, [(1, w(0, 20))], items))._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("MapInArrow"), plan.count("Join")

    assert shape(3) == shape(300)
