import datetime as dt
import os

import pytest
from helpers import rows
from pyspark.sql import functions as F

from loomspark.functions.scalars import UNSET
from loomspark.operators import cache as ca
from loomspark.operators import facts as fa
from loomspark.operators import glossary as gl
from loomspark.operators import registry as rg
from loomspark.operators.graph import connections
from loomspark.sources.files import Discovery, IgnoreRules, change_counts, change_set, changes_of_tree

SCHEMA = "id string, subject string, subject_type string, predicate string, object string, object_type string, context string, confidence double, valid_from date, valid_to date, created timestamp, modified timestamp"
NOW = dt.datetime(2025, 1, 1)


def facts(spark, *triples, **more):
    out = []
    for i, (s, p, o) in enumerate(triples):
        row = dict(id=f"f{i}", subject=s, subject_type="Person", predicate=p, object=o, object_type="Company" if o and o[0] == "A" and s != o and p.startswith("works") else "Person", context=None, confidence=1.0, valid_from=None, valid_to=None, created=NOW, modified=NOW)
        out.append(tuple((row | more)[c.split()[0]] for c in SCHEMA.split(", ")))
    return spark.createDataFrame(out, SCHEMA)


def paths(df):
    return [(tuple(r["path"]), r["entity"]) for r in df.orderBy("path_no").collect()]


def test_facts(spark):
    f = facts(spark, ("Alice", "works_at", "Acme"), ("Bob", "works_at", "Acme"), ("alice", "WORKS_AT", "acme"))
    f = f.withColumn("object_type", f["subject_type"])
    stored = fa.insert(f.limit(0).withColumn("spo_hash", F.lit(None).cast("string")), f)
    assert sorted(r["id"] for r in stored.collect()) == ["f0", "f1"]
    assert fa.insert(stored, f).count() == 2
    bad = facts(spark, ("", "p", "o"), ("s", None, "o"), ("s", "p", " "))
    assert fa.invalid(bad).count() == 3
    for confidence in (-0.1, 1.1, float("nan"), float("inf")):
        assert fa.invalid(facts(spark, ("s", "p", "o"), confidence=confidence)).count() == 1
    assert fa.invalid(facts(spark, ("s", "p", "o"), valid_from=dt.date(2025, 1, 1), valid_to=dt.date(2024, 1, 1))).count() == 1
    changed = fa.update(f, "f0", context="c", confidence=UNSET, now=dt.datetime(2026, 1, 1))
    assert changed.filter("id = 'f0'").first()["context"] == "c" and [r["id"] for r in fa.select_facts(changed).collect()][0] == "f0"
    with pytest.raises(ValueError):
        fa.update(f, "f0", confidence=2.0)
    assert fa.select_facts(f, subject="ALICE").count() == 2 and fa.select_facts(f, subject="").count() == 3


def test_sources(spark):
    f = facts(spark, ("Alice", "knows", "Bob"), ("Bob", "knows", "Carol"))
    s = spark.createDataFrame([("f0", "note", "n1", "h", "active", None), ("f0", "note", "n2", "h", "deleted", None)], "fact_id string, source_type string, source_id string, content_hash string, status string, verified_at timestamp")
    assert rows(fa.set_source_status(s).select("status")) == rows(s.select("status"))
    assert [r["status"] for r in fa.mark_note(s, "n1", now=NOW).orderBy("source_id").collect()] == ["deleted", "deleted"]
    assert fa.mark_glossary(s, "n1").filter("status = 'active'").count() == 1 and fa.mark_document(s, "h").filter("status = 'modified'").count() == 0
    assert fa.revalidate(s, "note", "n2").filter("status = 'active'").count() == 2
    with pytest.raises(ValueError):
        fa.set_source_status(s, "lost", "note")
    assert '"subject":"Alice"' in fa.documents(f).filter("id = 'f0'").first()["json"]
    got = {r["id"]: (r["total"], r["score"]) for r in fa.integrity(f, s).collect()}
    assert got == {"f0": (2, 0.5), "f1": (0, 1.0)}
    batch = fa.read_batch(f, s, spark.createDataFrame([(0, "f1"), (1, "f0"), (2, "none")], "ordinal int, id string")).orderBy("ordinal").collect()
    assert [(r["id"], len(r["sources"])) for r in batch] == [("f1", 0), ("f0", 2)]
    after, more = fa.add_sources(f, s, s.limit(1).withColumn("fact_id", s["fact_id"]), now=dt.datetime(2026, 1, 1))
    assert more.count() == 3 and after.filter("id = 'f0'").first()["modified"].year == 2026


def test_graph(spark):
    adj = fa.adjacency(facts(spark, ("Alice", "works_at", "Acme"), ("Bob", "works_at", "Acme")))
    assert paths(connections(adj, "alice", "BOB")) == [(("f0", "f1"), "bob")]
    assert paths(connections(adj, "alice", "bob", source_type="company")) == []
    assert paths(connections(fa.adjacency(facts(spark, ("Alice", "knows", "Alice"))), "Alice", "Alice")) == [(("f0",), "alice")]
    assert len(paths(connections(fa.adjacency(facts(spark, ("Alice", "likes", "Bob"), ("Alice", "knows", "Bob"))), "alice", "bob"))) == 2
    some = fa.adjacency(facts(spark, ("Alice", "likes", "Bob"), ("Alice", "knows", "Bob"), ("Alice", "likes", "Carol")))
    assert [e for _, e in paths(connections(some, "alice", max_depth=1))] == ["bob", "carol"]
    assert paths(connections(adj, "nobody")) == []


def test_graph_like_a_queue(spark):
    import random

    for seed in range(3):
        rng = random.Random(seed)
        triples = [(f"E{rng.randrange(7)}", "p", f"E{rng.randrange(7)}") for _ in range(12)]
        f = facts(spark, *triples)
        adj = [(r["entity_name"], r["entity_type"], r["fact_id"], r["role"]) for r in fa.adjacency(f).collect()]
        for target in (None, "e3"):
            got = paths(connections(fa.adjacency(f), "E0", target, max_depth=3, limit=6))
            queue = [("e0", t, ()) for t in sorted({t for n, t, _, _ in adj if n == "e0"})]
            visited = {(n, t) for n, t, _ in queue}
            seen, out = set(visited), []
            while queue and len(out) < 6:
                name, kind, path = queue.pop(0)
                if len(path) >= 3:
                    continue
                for fact in sorted({x[2] for x in adj if x[:2] == (name, kind)}):
                    if fact in path:
                        continue
                    role = min(x[3] for x in adj if x[:3] == (name, kind, fact))
                    for other in [x for x in adj if x[2] == fact and x[3] != role]:
                        key = other[:2]
                        if (target and other[0] == target) or (not target and key not in seen):
                            seen.add(key)
                            out.append((path + (fact,), other[0]))
                        if len(path) + 1 < 3 and key not in visited:
                            visited.add(key)
                            queue.append((*key, path + (fact,)))
            assert got == out[:6]


ENTRY = "id string, term string, expansion string, definition string, domain string, created timestamp, modified timestamp, entry_hash string"


def test_glossary(spark):
    entries, aliases = spark.createDataFrame([], ENTRY), spark.createDataFrame([], "entry_id string, alias string")
    row = lambda i, t: spark.createDataFrame([(i, t, "x", "d", None, NOW, NOW)], ENTRY.rsplit(",", 1)[0])
    alias = lambda i, *a: spark.createDataFrame([(i, x) for x in a], "entry_id string, alias string")
    entries, aliases = gl.create(entries, aliases, row("1", "USAF"), alias("1", "Air Force", "US Air Force"))
    for term, names in (("usaf", []), ("air force", []), ("New", ["USAF"]), ("New", ["a", "A"])):
        with pytest.raises(ValueError):
            gl.create(entries, aliases, row("2", term), alias("2", *names))
    asked = lambda *a: spark.createDataFrame([(x,) for x in a], "asked string")
    assert sorted(rows(gl.lookup(entries, aliases, asked("usaf", "AIR FORCE", "nope")))) == [("AIR FORCE", "1"), ("usaf", "1")]
    assert dict(rows(gl.exists(entries, aliases, asked("usaf", "nope")))) == {"usaf": True, "nope": False}
    changed, names = gl.update(entries, aliases, "1", domain="military", new_aliases=["Air Force"], now=NOW)
    assert changed.first()["domain"] == "military" and names.count() == 1
    assert gl.read(changed, names, spark.createDataFrame([("1",)], "id string")).first()["aliases"] == ["Air Force"]
    assert gl.list_entries(entries, limit=0).count() == 0
    tools = gl.Tools(entries, aliases)
    assert tools.create(id="2", term="")["error"] and tools.create(id="2", term="usaf", expansion="e", definition="d")["code"] == "DUPLICATE"
    assert tools.create(id="2", term="API", expansion="e", definition="d", aliases=["iface"])["id"] == "2"
    assert tools.get("IFACE")["term"] == "API" and tools.get("zz")["code"] == "NOT_FOUND" and len(tools.list(limit=500)) == 2
    hits = spark.createDataFrame([("2", 0.9, 1), ("1", 0.5, 2)], "id string, score double, rank int")
    assert [e["term"] for e in tools.search(hits)] == ["API", "USAF"] and len(tools.search(hits, 0)) == 1
    assert tools.delete("api")["id"] == "2" and len(tools.list()) == 1


def test_registry(spark):
    cols = "content_hash string, uuid string, path string, doc_type string, status string, registered_at int, last_verified timestamp"
    df = spark.createDataFrame([("h1", "u1", "p", "t", "active", 1, None), ("h2", "u1", "p", "t", "active", 2, None), ("h2", "u2", "p", "t", "active", 3, None)], cols)
    after = rg.register(df.limit(0), df)
    assert [(r["content_hash"], r["uuid"]) for r in after.collect()] == [("h2", "u2")]
    assert rg.by_status(after, "active", 0).count() == 0 and rg.count(after, "active") == 1
    assert rg.mark_verified(after, after, NOW).first()["last_verified"] == NOW
    assert rg.delete(after, after).count() == 0


def test_cache(spark):
    import hashlib
    import json

    key = json.dumps({"cache_schema": 2, "content_hash": hashlib.sha256(b"t").hexdigest(), "dim": 3, "model": 'm"', "namespace": "n", "preprocessing": "1", "role": "document", "profile": "raw"}, sort_keys=True, separators=(",", ":"))
    df = spark.createDataFrame([("t",)], "t string")
    assert df.select(ca.make_key("t", "n", 'm"', 3)).first()[0] == hashlib.sha256(key.encode()).hexdigest()
    cols = "cache_key string, embedding array<float>, dim int, created_at int, accessed_at int, legacy boolean"
    c = spark.createDataFrame([("a", [1.0, 2.0], 2, 0, 5, False), ("b", [float("nan"), 1.0], 2, 0, 1, False), ("c", [1.0], 2, 0, 9, True), ("d", None, 2, 0, 2, False)], cols)
    hits, misses = ca.get_many(c, spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "cache_key string"), 2)
    assert [r[0] for r in hits.collect()] == ["a"] and sorted(r[0] for r in misses.collect()) == ["b", "c", "d", "e"]
    assert sorted(r["cache_key"] for r in ca.evict(c, 2).collect()) == ["a", "d"]
    assert ca.evict(c, 4).count() == 4
    now = [0.0]
    t = ca.TtlCache(2, 10, lambda: now[0])
    for k in ("x1", "x2", "y"):
        t.set(k, k)
    assert t.get("x1") is None and t.get("x2") == "x2" and t.invalidate_prefix("x") == 1
    now[0] = 11
    assert "y" not in t and t.cleanup() == 1


def test_ignore_rules():
    r = IgnoreRules(["# c", "*.log", "!keep.log", "build/", "/root.txt", "a/**/z", "doc/*.md", "x?z", "[ab].c"])
    for path, verdict in {"x.log": True, "d/x.log": True, "keep.log": False, "build/x": True, "s/build/y/z": True, "build": None, "root.txt": True, "d/root.txt": None, "a/z": True, "a/b/c/z": True, "doc/r.md": True, "doc/s/r.md": None, "xyz": True, "a.c": True, "c.c": None}.items():
        assert r.check(path) == verdict, path


def test_discovery_and_changes(spark, tmp_path):
    def put(name, text="x"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    for n in ("a.py", "B.PY", "sub/c.py", "sub/skip.py", "sub/deep/kept.py", "node_modules/n.py", ".hidden.py", ".dot/x.py", "t.txt", "gen.py"):
        put(n)
    put("empty.py", "")
    put("large.py", "y" * 3000)
    put(".gitignore", "gen.py\n*kept.py\n")
    put("sub/.gitignore", "skip.py\n!deep/kept.py\n")
    os.symlink(tmp_path / "a.py", tmp_path / "link.py")
    d = Discovery({".py"}, max_size_kb=2)
    assert sorted(r["relative_path"] for r in d.metadata(spark, str(tmp_path)).collect()) == ["B.PY", "a.py", "sub/c.py", "sub/deep/kept.py"]
    assert sorted(b for _, b, _ in Discovery({".py"}, 2, exclude=["sub/"]).walk(str(tmp_path))) == ["B.PY", "a.py"]
    assert "gen.py" in [b for _, b, _ in Discovery({".py"}, 2, respect_ignore=False).walk(str(tmp_path))]
    full = d.discover(spark, str(tmp_path))
    indexed = full.selectExpr("relative_path AS path", "content_hash", "mtime", "size")
    old = spark.createDataFrame(indexed.collect(), indexed.schema)
    assert changes_of_tree(old, str(tmp_path), d).count() == 0
    put("new.py")
    put("a.py", "changed")
    os.utime(tmp_path / "B.PY", (1, 1))
    os.remove(tmp_path / "sub/c.py")
    got = dict(rows(changes_of_tree(old, str(tmp_path), d)))
    assert got == {"new.py": "added", "a.py": "modified", "sub/c.py": "deleted"}
    assert dict(rows(change_counts(changes_of_tree(old, str(tmp_path), d)))) == {"added": 1, "modified": 1, "deleted": 1}
    legacy = spark.createDataFrame([("p", "h1", 0.0, 1)], "path string, content_hash string, mtime double, size long")
    assert rows(change_set(legacy, spark.createDataFrame([("p", "h2", 0.0, 1)], legacy.schema))) == [("p", "modified")]
