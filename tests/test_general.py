"""Snapshot changes and interval periods against brute force, and their edge cases."""

import datetime as dt
import random

from helpers import rows

from loomspark.operators.intervals import periods_and_gaps
from loomspark.operators.snapshots import file_lists, snapshot_changes

COLUMNS = "snapshot_no int, codebase_id string, relative_path string, size long, mtime double, content_hash string, delivered_at int, extra string, path string"


def listed(spark, data):
    return spark.createDataFrame([(*r, "x", "y") for r in data], COLUMNS)


def changes(spark, data, **options):
    got = snapshot_changes(file_lists(listed(spark, data)), **options)
    return sorted(tuple(r) for r in got.select("group", "path", "snapshot", "change").collect())


def clean(p):
    p = p.replace("\\", "/")
    while "//" in p:
        p = p.replace("//", "/")
    while p.startswith("./"):
        p = p[2:]
    return p


def brute(data):
    states = {}
    for no, group, path, size, mtime, digest, at in data:
        if group is None or no is None or path is None:
            continue
        files = states.setdefault(group, {}).setdefault(no, {})
        own = (at, (digest or "").strip().lower() or None, size, mtime)
        key = clean(path)
        if key not in files or at > files[key][0]:
            files[key] = own
    out = []
    for group, by in states.items():
        order = sorted(by)
        for a, b in zip(order, order[1:]):
            for p in by[a].keys() | by[b].keys():
                old, new = by[a].get(p), by[b].get(p)
                if old is None or new is None:
                    out.append((group, p, b, "added" if old is None else "removed"))
                elif (old[1] != new[1]) if old[1] and new[1] else old[2:] != new[2:]:
                    out.append((group, p, b, "changed"))
    return sorted(out)


def test_snapshots_random(spark):
    rng = random.Random(4)
    data = []
    for group in ("hot", "b", "c"):
        for no in (1, 2, 4, 5):
            if group == "c" and no == 2:
                continue
            for i in range(400 if group == "hot" else 12):
                if rng.random() < 0.1:
                    continue
                path = rng.choice(["src/f{}", "./src/f{}", "src\\f{}", "src//f{}", "SRC/f{}"]).format(i)
                digest = rng.choice([f"{i:02x}{no // (3 if rng.random() < 0.9 else 1):02x}", None, f"AB{i:02X}", "zz-not-hex", " "])
                row = (no, group, path, rng.choice([i, None]), rng.choice([0.0, 1.5]), digest, len(data))
                data += [row] * rng.choice([1, 1, 2])
    data += [(1, None, "p", 1, 1.0, "aa", 1), (1, "b", None, 1, 1.0, "aa", 1), (None, "b", "p", 1, 1.0, "aa", 1)]
    expected = brute(data)
    assert len(expected) > 200
    for leaf_rows in (1, 16, 10**6):
        assert changes(spark, data, leaf_rows=leaf_rows) == expected


def test_snapshots_edges(spark):
    assert changes(spark, []) == []
    assert changes(spark, [(1, "a", "f", 1, 1.0, "aa", 1)]) == []
    assert changes(spark, [(1, "a", "f", 1, 1.0, "AA", 1), (3, "a", "./f", 2, 9.0, "aa", 1)]) == []
    assert changes(spark, [(1, "a", "f", 1, 1.0, None, 1), (2, "a", "f", 1, 2.0, "aa", 1)]) == [("a", "f", 2, "changed")]
    assert changes(spark, [(1, "a", "f", None, 1.0, None, 1), (2, "a", "f", None, 1.0, None, 1)]) == []


def test_merkle_compares_only_differing_ranges(spark):
    data = [(no, "a", f"f{i}", 1, 1.0, "aa" if (no, i) != (2, 7) else "bb", 1) for no in (1, 2) for i in range(2000)]
    assert changes(spark, data, leaf_rows=8) == [("a", "f7", 2, "changed")]


def d(text):
    return dt.date.fromisoformat(text) if text else None


def spans(spark, data, **options):
    df = spark.createDataFrame([(s, d(a), d(b), "x", 1) for s, a, b in data], "subject string, valid_from date, valid_to date, day string, delta int")
    return sorted(rows(periods_and_gaps(df, **options)), key=str)


def test_intervals_edges(spark):
    assert spans(spark, []) == []
    got = spans(spark, [("s", "2020-01-01", "2020-01-05"), ("s", "2020-01-06", "2020-01-06"), ("s", "2020-01-03", "2020-01-04"), ("s", "2020-02-01", "2020-01-01"), ("s", None, None), ("s", "2020-01-10", "9999-12-31")])
    assert got == [("s", "gap", "2020-01-07", "2020-01-09"), ("s", "period", "2020-01-01", "2020-01-06"), ("s", "period", "2020-01-10", "open")]
    assert spans(spark, [("t", None, "2020-01-05"), ("t", "2019-01-01", None)]) == [("t", "period", "open", "open")]
    assert spans(spark, [(None, "2020-01-01", "2020-01-01")] * 3) == [(None, "period", "2020-01-01", "2020-01-01")]
    assert spans(spark, [("u", "2020-01-01", "2020-01-01"), ("u", "2020-01-03", "2020-01-03")]) == [("u", "gap", "2020-01-02", "2020-01-02"), ("u", "period", "2020-01-01", "2020-01-01"), ("u", "period", "2020-01-03", "2020-01-03")]


def test_intervals_random(spark):
    rng = random.Random(2)
    base = dt.date(2020, 1, 1)
    data = []
    for s in "abcdef":
        for _ in range(rng.randrange(1, 9)):
            a = rng.randrange(60)
            data.append((s, str(base + dt.timedelta(a)), str(base + dt.timedelta(a + rng.randrange(8)))))
    expected = []
    for s in "abcdef":
        days = sorted({d(a) + dt.timedelta(k) for t, a, b in data if t == s for k in range((d(b) - d(a)).days + 1)})
        runs = []
        for day in days:
            if runs and (day - runs[-1][1]).days == 1:
                runs[-1][1] = day
            else:
                runs.append([day, day])
        expected += [(s, "period", str(a), str(b)) for a, b in runs]
        expected += [(s, "gap", str(x[1] + dt.timedelta(1)), str(y[0] - dt.timedelta(1))) for x, y in zip(runs, runs[1:])]
    assert spans(spark, data) == sorted(expected, key=str)
