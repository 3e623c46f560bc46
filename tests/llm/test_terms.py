"""Distinctiveness and frequencies against brute force."""

import math
import random
from collections import Counter, defaultdict

from loomspark.llm.distinctive import clearly_distinctive, distinctive_of, distinctive_terms, latest_sizes
from loomspark.llm.frequency import ngram_frequencies
from loomspark.llm.usable import usable_counts

CONTRIB = "codebase_id string, token string, doc_freq long, n int, record string"


def contributions(spark, data):
    return spark.createDataFrame([(*r, 1, "x") for r in data], CONTRIB)


def test_usable(spark):
    got = usable_counts(contributions(spark, [("a", " Foo\t", 2), ("a", " Foo\t", 2), ("a", "foo", 3), ("a", None, 3), ("a", "z", 0), ("a", "z", -1), ("a", "y", None), (None, "q", 1)]))
    assert sorted((str(r["record"]), r["term"], r["n"]) for r in got.collect()) == [("None", "q", 1), ("a", "foo", 5)]
    assert usable_counts(contributions(spark, [])).count() == 0


def test_sizes(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 5, 2.0), ("a", 7, 2.0), ("b", None, 3.0), ("b", 4, 1.0), ("c", 0, 1.0), (None, 9, 1.0)], "codebase_id string, doc_count long, last_updated double")
    assert [tuple(r) for r in latest_sizes(df).collect()] == [("a", 7)]


def test_scores(spark):
    rng = random.Random(1)
    data = list({(c, t): (c, t, rng.randrange(1, 60)) for c in "abcdefgh" for t in (f"t{rng.randrange(30)}" for _ in range(20))}.values())
    sizes = {c: rng.randrange(60, 500) for c in "abcdefg"}
    counts = spark.createDataFrame([(c, 1 if False else n, 1.0) for c, n in sizes.items()], "codebase_id string, doc_count long, last_updated double")
    scored = distinctive_of(contributions(spark, data), counts)
    got = {(r["record"], r["term"]): r for r in scored.collect()}
    own = [r for r in data if r[0] in sizes]
    total, term, smooth = sum(sizes.values()), Counter(), sum(v**0.75 for v in sizes.values())
    for _, t, n in own:
        term[t] += n
    assert set(got) == {(c, t) for c, t, _ in own}
    for c, t, n in own:
        assert math.isclose(got[c, t]["pmi"], math.log2(n / term[t] * total / sizes[c]), abs_tol=1e-9)
        assert math.isclose(got[c, t]["ppmi"], max(0, math.log2(n / term[t] * smooth / sizes[c] ** 0.75)), abs_tol=1e-9)
    expected = {(c, t) for c, t, n in own if n >= 10 and n * total >= 2 * term[t] * sizes[c]}
    assert {(r["record"], r["term"]) for r in clearly_distinctive(scored, 10, 2).collect()} == expected


def test_scores_of_nothing(spark):
    counts = spark.createDataFrame([], "codebase_id string, doc_count long, last_updated double")
    assert distinctive_of(contributions(spark, []), counts).count() == 0
    assert distinctive_of(contributions(spark, [("a", "t", 3)]), counts).count() == 0
    big = 2**62
    huge = distinctive_terms(spark.createDataFrame([("a", "t", big)], "record string, term string, n long"), spark.createDataFrame([("a", big)], "record string, size long"))
    assert clearly_distinctive(huge, 10, 1).count() == 1


def brute(rows, most):
    counts, records = Counter(), defaultdict(set)
    for record, terms, w in rows:
        terms = [t for t in terms or [] if t is not None]
        for i in range(len(terms)):
            for n in range(1, most + 1):
                if i + n <= len(terms):
                    g = " ".join(terms[i : i + n])
                    counts[g] += w or 0
                    if record is not None:
                        records[g].add(record)
    return {g: (c, len(records[g])) for g, c in counts.items()}


def test_ngrams(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["r1", "r2", "r3", None]), [rng.choice(["a", "b", "ab", "a-b", "é", None, ""]) for _ in range(rng.randrange(12))], rng.choice([1, 2, None])) for _ in range(60)]
    rows += [("r9", None, 1), ("r9", [], 1)]
    df = spark.createDataFrame([(*r, "z", 5) for r in rows], "record string, terms array<string>, w long, gram string, n int")
    for most in (1, 2, 3):
        for salts in (1, 4):  # a first term is spread over several tasks, or not
            got = {r["gram"]: (r["n"], r["records"]) for r in ngram_frequencies(df, "record", "terms", "w", most, hot_rows=40 // salts).collect()}
            assert got == brute(rows, most)
    assert ngram_frequencies(df.limit(0), "record", "terms").count() == 0
    hot = spark.range(3000).selectExpr("cast(id as string) AS record", "array('hot', if(id % 3 = 0, 'x', 'y')) AS terms")
    got = {r["gram"]: (r["n"], r["records"]) for r in ngram_frequencies(hot, "record", "terms", None, 2).collect()}
    assert got == {"hot": (3000, 3000), "x": (1000, 1000), "y": (2000, 2000), "hot x": (1000, 1000), "hot y": (2000, 2000)}


def test_ngrams_of_whole_records(spark):
    rng = random.Random(4)
    rows = [(None if i == 7 else i, [rng.choice(["a", "b", "ab", "é", None, ""]) for _ in range(rng.randrange(14))], rng.choice([1, 2, None])) for i in range(60)]
    df = spark.createDataFrame([*rows, (90, None, 1), (91, [], 1)], "record long, terms array<string>, w long")
    for most in (1, 2, 3):
        for hot in (10, 10_000):
            each = df if most > 1 else df.selectExpr("record", "w", "explode(terms) t").groupBy("record", "t").agg({"w": "sum"}).selectExpr("record", "array(t) terms", "`sum(w)` w")
            got = {r["gram"]: (r["n"], r["records"]) for r in ngram_frequencies(each, "record", "terms", "w", most, hot_rows=hot, disjoint=True).collect()}
            assert got == brute(rows, most)
    assert ngram_frequencies(df.limit(0), "record", "terms", max_n=3, disjoint=True).count() == 0


def test_scores_with_sizes_that_are_not_broadcast(spark):
    counts = spark.createDataFrame([(f"r{i}", f"t{i % 7}", i + 1) for i in range(40)], "record string, term string, n long")
    sizes = spark.createDataFrame([(f"r{i}", 50 + i) for i in range(30)], "record string, size long")
    rows = lambda small: sorted(tuple(r) for r in distinctive_terms(counts, sizes, small=small).select("record", "term", "pmi", "ppmi").collect())
    assert rows(0) == rows(100) and len(rows(0)) == 30
