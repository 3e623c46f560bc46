import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from loomspark.llm.canonical import collapse_variants, variant_members
from loomspark.llm.ranking import clear_leaders, current_scores, ideal_point_closeness, ranked

FIELDS = ["a", "b", "c"]


def facts(spark, data):
    return spark.createDataFrame([(*r, "x", 1) for r in data], "id string, a string, b string, c string, copies string, first_id int")


def canonical(v):
    return "".join(ch for ch in v.lower() if ch.isalnum())


def test_variants(spark):
    rng = random.Random(5)
    words = ["Foo Bar", "foo-bar", "FOO  bar!", "baz", " Baz", "qux", "É t", "ét", "«x1»", "X 1", None, "", "--", "foo​bar"]
    data = [(f"id{i:04d}", rng.choice(words), rng.choice(words), rng.choice(words)) for i in range(700)]
    groups = defaultdict(list)
    for i, *v in data:
        parts = [canonical(x) if x else "" for x in v]
        if all(parts):
            groups[tuple(sorted(parts))].append(i)
    df = facts(spark, data)
    expected = sorted((min(g), x) for g in groups.values() for x in g if x != min(g))
    for hot in (1, 5, 10**9):
        assert sorted(tuple(r) for r in variant_members(df, "id", FIELDS, hot_rows=hot).collect()) == expected
    got = {r["id"]: r["copies"] for r in collapse_variants(df, "id", FIELDS).collect()}
    assert got == {min(g): len(g) for g in groups.values()}


def test_collisions_never_merge(spark):
    df = facts(spark, [(str(i), f"v{i}", "p", "o") for i in range(300)] + [("x", "V 0", "o", "p")])
    got = collapse_variants(df, "id", FIELDS, digest_hex=2)
    assert got.count() == 300 and got.filter("copies = 2").first()["id"] == "0"
    assert [tuple(r) for r in variant_members(df, "id", FIELDS, digest_hex=2).collect()] == [("0", "x")]


def test_variants_edges(spark):
    assert variant_members(facts(spark, []), "id", FIELDS).count() == 0 and collapse_variants(facts(spark, []), "id", FIELDS).count() == 0
    same = facts(spark, [("1", "s", "p", "o"), ("2", "s", "p", "o"), ("3", "x" * 50_000, "p", "o"), ("4", "X " * 50_000, "P", "O"), (None, "s", "p", "o")])
    assert sorted(tuple(r) for r in variant_members(same, "id", FIELDS).collect()) == [("1", "2"), ("3", "4")]
    assert {r["id"]: r["copies"] for r in collapse_variants(same, "id", FIELDS).collect()} == {"1": 3, "3": 2}
    # The border between fields counts, their order doesn't.
    assert collapse_variants(facts(spark, [("1", "ab", "c", "d"), ("2", "a", "bc", "d"), ("3", "d", "c", "ab")]), "id", FIELDS).count() == 2


S = ("dense", "sparse", "lexical", "rerank")


def scores(spark, data):
    return spark.createDataFrame([(*r, "{}", 1) for r in data], "query_id long, scorer string, point_id long, score double, scored_at int, payload string, rank int")


def ranking(spark, data, **options):
    return ranked(ideal_point_closeness(current_scores(scores(spark, data)), **options))


def closeness(spark, data):
    return ideal_point_closeness(current_scores(scores(spark, data)))


def test_current_scores(spark):
    nan, inf = float("nan"), float("inf")
    got = current_scores(scores(spark, [(1, "dense", 1, 0.5, 1), (1, "dense", 1, nan, 2), (1, "sparse", 1, 2.0, 1), (1, "sparse", 1, 3.0, 1), (1, "rerank", 1, inf, 1), (1, "other", 2, 1.0, 1), (1, "lexical", 3, None, 1)]))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, None, 3.0, None, None), (1, 3, None, None, None, None)]


def quantile(values, q):
    return sorted(values)[max(0, math.ceil(q * len(values)) - 1)]


def test_closeness(spark):
    rng = random.Random(6)
    data = [(q, s, p, rng.gauss(0, 1) * 10**k, 1) for q in (1, 2) for p in range(60) for k, s in enumerate(S) if rng.random() < 0.9]
    got = {(r["query_id"], r["point_id"]): r for r in ranking(spark, data).collect()}
    for q in (1, 2):
        own = {p: {s: v for qq, s, pp, v, _ in data if qq == q and pp == p} for p in range(60)}
        own = {p: v for p, v in own.items() if v}
        best, worst = dict.fromkeys(own, 0.0), dict.fromkeys(own, 0.0)
        for s in S:
            values = [v[s] for v in own.values() if s in v]
            lo, hi = quantile(values, 0.05), quantile(values, 0.95)
            w = {p: min(hi, max(lo, v.get(s, lo))) for p, v in own.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            for p in own:
                best[p] += ((hi - w[p]) / norm) ** 2
                worst[p] += ((w[p] - lo) / norm) ** 2
        close = {p: math.sqrt(worst[p]) / (math.sqrt(worst[p]) + math.sqrt(best[p])) for p in own}
        for p in own:
            assert abs(got[q, p]["closeness"] - close[p]) < 1e-6
            assert got[q, p]["rank"] == 1 + sum(c > close[p] + 1e-9 for c in close.values())
    for hot in (1, 20):
        again = {(r["query_id"], r["point_id"]): r["closeness"] for r in ranking(spark, data, hot_rows=hot).collect()}
        assert again == {k: r["closeness"] for k, r in got.items()}


def test_ties_and_nothing(spark):
    assert ranking(spark, []).count() == 0 and clear_leaders(closeness(spark, [])).count() == 0
    same = ranking(spark, [(1, s, p, 1.0, 1) for p in range(5) for s in S] * 2).collect()
    assert {(r["closeness"], r["rank"]) for r in same} == {(0.5, 1)}
    zero = ranking(spark, [(1, "dense", 1, 0.0, 1), (1, "dense", 2, 0.0, 1)])
    assert {r["closeness"] for r in zero.collect()} == {0.5}


def test_leaders(spark):
    rng = random.Random(7)
    data = [(q, s, p, float(rng.randrange(6 if q % 2 else 1000)), 1) for q in range(12) for p in range(80 if q else 300) for s in S if rng.random() < 0.8]
    for q in range(12):
        data += [(q, s, 999, 2000.0, 1) for s in S[: 2 + q % 3]]
    own = defaultdict(dict)
    for q, s, p, v, _ in data:
        own[q, p][s] = v
    expected = set()
    for (q, p), v in own.items():
        if len(v) >= 3 and all(sum(o.get(s, -math.inf) > v.get(s, -math.inf) for s in S) <= 1 for (qq, pp), o in own.items() if qq == q and pp != p):
            expected.add((q, p))
    assert expected
    table = closeness(spark, data)
    for hot in (7, 50_000):
        assert {tuple(r) for r in clear_leaders(table, hot_rows=hot).collect()} == expected


def test_leaders_come_from_the_ranking(spark):
    data = [(1, s, p, float(p * 10**k + k), 1) for p in range(50) for k, s in enumerate(S)]
    table = closeness(spark, data)
    assert clear_leaders(table).count() == 1
    assert clear_leaders(table.withColumn("closeness", F.lit(0.0))).count() == 0


def test_leaders_of_opposed_scorers(spark):
    # Nobody is ahead of anybody in two scorers but for the third, in which all are alike.
    data = [(1, s, p, float(v), 1) for p in range(300) for s, v in (("dense", p), ("sparse", -p), ("lexical", 5))]
    assert clear_leaders(closeness(spark, data)).count() == 300
