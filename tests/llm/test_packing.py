import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm.packing import _slots, pack_documents, plan_containers
from loomspark.llm.tokens import VOCABULARY, count_tokens, encoding, token_counts


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=30), st.sets(st.sampled_from([1, 2, 5, 10, 25]), max_size=4))
def test_plan_holds_everything(histogram, tiers):
    plan = plan_containers(histogram, 50, tuple(tiers))
    got = {}
    for p in plan:
        assert p.count > 0 and p.tier in {*tiers, 50} and sum(n for n, _ in p.windows) == 50 // p.tier
        for n, items in p.windows:
            assert sum(x * k for x, k in items) <= p.tier and (p.tier == 50 or sum(x * k for x, k in items) * 64 >= p.tier * 63)
            for x, k in items:
                got[x] = got.get(x, 0) + p.count * n * k
    assert got == histogram
    for length, rows in _slots(plan).items():
        assert rows[0][0] == 0 and (rows[1:, 0] > rows[:-1, 0]).all()


def test_tiers_make_the_plan():
    h = {x: 4000 if x <= 10 else 40 for x in range(1, 51)}
    whole, tiered = plan_containers(h, 50, (50,)), plan_containers(h, 50, (10, 25, 50))
    assert {p.tier for p in whole} == {50} and {p.tier for p in tiered} == {10, 25, 50}
    # Documents above 25 have windows of their own, whose gaps the shorter tiers fill.
    assert all(p.tokens == 50 for p in tiered if any(x > 25 for _, items in p.windows for x, _ in items))
    with pytest.raises(ValueError):
        plan_containers(h, 50, (20, 50))


def test_plan_is_tight():
    rng = random.Random(1)
    h = {}
    for _ in range(50_000):
        x = min(2048, max(1, int(rng.lognormvariate(5.5, 1))))
        h[x] = h.get(x, 0) + 1
    used = sum(p.count for p in plan_containers(h))
    assert sum(x * n for x, n in h.items()) / 2048 / used > 0.995


def packed(spark, lengths, **options):
    return pack_documents(spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "id long, tokens long, room string"), **options).collect()


def test_documents(spark):
    rng = random.Random(2)
    lengths = [rng.choice([0, None, 5, 30, 50, 51, 120, 49, 7]) if rng.random() < 0.5 else rng.randrange(1, 130) for _ in range(900)] + [7] * 500
    for block in (20, 10**6):
        rows = packed(spark, lengths, capacity=50, tiers=(10, 25, 50), group=4, block=block)
        fill, per = {}, {}
        for r in rows:
            fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
            per.setdefault(r["id"], []).append((r["piece"], r["start_token"], r["tokens"]))
        assert max(fill.values()) <= 50 and all(fill[r["container"]] == 50 - r["room"] for r in rows)
        assert sum(fill.values()) == sum(n or 0 for n in lengths)
        for i, n in enumerate(lengths):
            own = sorted(per[i])
            assert sum(x[2] for x in own) == (n or 0)
            assert len(own) == max(1, -(-(n or 0) // 50))
            assert [x[1] for x in own] == [50 * k for k in range(len(own))]
        assert sum(fill.values()) / 50 / len([c for c in fill if fill[c]]) > 0.97
        groups = {}
        for c, g, t in {(r["container"], r["step_group"], r["tier"]) for r in rows}:
            groups.setdefault((t, g), []).append(fill[c])
        assert len({g for _, g in groups}) == len(groups)
        for tier in (10, 25, 50):
            sums = [sum(g) for (t, _), g in groups.items() if t == tier]
            assert not sums or max(sums) - min(sums) <= 2 * 50
        windows = {}
        for r in rows:
            windows[r["container"], r["window"], r["tier"]] = windows.get((r["container"], r["window"], r["tier"]), 0) + r["tokens"]
        assert all(n <= t and 0 <= w < 50 // t for (_, w, t), n in windows.items())
        assert len({t for _, _, t in windows}) == 3


def test_edges(spark):
    assert packed(spark, []) == []
    assert {(r["id"], r["tokens"], r["container"]) for r in packed(spark, [0, None])} == {(0, 0, 0), (1, 0, 0)}
    rows = packed(spark, [2048, 4096, 1])
    assert len({r["container"] for r in rows}) == 4 and all(r["room"] in (0, 2047) for r in rows)
    again = spark.createDataFrame([(1, 3), (1, 3)], "id long, tokens long")
    assert pack_documents(again).count() == 2


def test_tokens(spark):
    e = encoding(VOCABULARY)
    for t in ("hello world", "é🦊\n\n  x", "<|endoftext|>"):
        assert e.decode(e.encode_ordinary(t)) == t and count_tokens(t) == len(e.encode_ordinary(t))
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x")], "doc_id long, text string, tokens string")
    assert sorted(tuple(r) for r in token_counts(df, "doc_id", "text").collect()) == [(1, 2), (2, 0), (3, 0), (3, 0)]
    long = "line of words\n" * 90_000
    assert count_tokens(long) == len(e.encode_ordinary(long))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab1 \n\t'.\u00a0é"), max_size=80), st.integers(1, 9))
def test_parts_count_exactly(text, part):
    assert count_tokens(text, slice_=part) == len(encoding(VOCABULARY).encode_ordinary(text))
