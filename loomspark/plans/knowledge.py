"""Queries of facts, glossary, registry, cache, points, files and fragments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import cache as ca
from loomspark.operators import facts as fa
from loomspark.operators import fragments as fr
from loomspark.operators import glossary as gl
from loomspark.operators import points as po
from loomspark.operators import registry as re_
from loomspark.operators.graph import connections, distances
from loomspark.operators.indexing import fact_payloads, glossary_payloads
from loomspark.sources.files import change_counts, change_set
from loomspark.streaming.deltas import event_windows


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _facts(spark, sf):
    return _read(spark, sf, "facts")


def _sources(spark, sf):
    """None to two sources a fact, by the digits of its id."""
    k = F.conv(F.substring("id", 1, 4), 16, 10).cast("int")
    own = _facts(spark, sf).select("id", k.alias("k")).filter("k % 3 > 0")
    each = own.select("id", "k", F.explode(F.sequence(F.lit(0), F.col("k") % 3 - 1)).alias("j"))
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), at % len(names) + 1)
    return each.select(
        F.col("id").alias("fact_id"), pick(("note", "document", "glossary"), F.col("k") + F.col("j")).alias("source_type"), F.concat(F.lit("src-"), ((F.col("k") * 7 + F.col("j")) % 50).cast("string")).alias("source_id"),
        F.md5(F.concat("id", F.lit("-"), F.col("j").cast("string"))).alias("content_hash"), pick(fa.STATUSES, F.col("k") + F.col("j") * 3).alias("status"), F.lit(None).cast("timestamp").alias("verified_at"),
    )


def fact_query(spark, sf):
    return fa.select_facts(_facts(spark, sf), subject_type="PERSON", min_confidence=0.8).select("id", "subject", "predicate")


def fact_valid_at(spark, sf):
    return fa.select_facts(_facts(spark, sf), at=dt.date(2020, 6, 1), limit=None).select("id")


def fact_summaries(spark, sf):
    return fa.summaries(_facts(spark, sf), _sources(spark, sf), subject_type="Component", limit=None)


def fact_by_source(spark, sf):
    return fa.facts_of_source(_facts(spark, sf), _sources(spark, sf), "note", "src-7").select("id")


def fact_by_status(spark, sf):
    return fa.facts_by_source_status(_facts(spark, sf), _sources(spark, sf), "deleted", 100).select("id")


def entity_facts(spark, sf):
    f = _facts(spark, sf)
    return fa.entity_facts(f, fa.adjacency(f), "GRANARY index service").select("id")


def neighbors(spark, sf):
    """The neighbours of every subject."""
    f = _facts(spark, sf)
    asked = f.select(F.col("subject").alias("name")).filter("subject IS NOT NULL").distinct()
    asked = asked.groupBy(F.lower("name").alias("k")).agg(F.min("name").alias("name")).select("name")
    return fa.neighbors(f, fa.adjacency(f), asked)


def source_statistics(spark, sf):
    return fa.source_statistics(_sources(spark, sf))


def fact_integrity(spark, sf):
    return fa.integrity(_facts(spark, sf), _sources(spark, sf)).withColumn("score", F.round("score", 6))


def fact_dedup(spark, sf):
    f = _facts(spark, sf)
    return fa.insert(f.limit(0), f).select("id", "spo_hash", "confidence")


def fact_problems(spark, sf):
    return fa.invalid(_facts(spark, sf)).select("id", "problem")


def source_status_update(spark, sf):
    now = dt.datetime(2025, 1, 1, tzinfo=dt.UTC)
    s = fa.set_source_status(_sources(spark, sf), "relocated", source_type="document", source_id="src-8", now=now)
    return s.select("fact_id", "content_hash", "status", F.col("verified_at").isNotNull().alias("checked"))


def fact_delete_cascade(spark, sf):
    f = _facts(spark, sf)
    left, sources, adjacent = fa.delete(f, _sources(spark, sf), f.filter("confidence < 0.6").select("id"))
    per = lambda d, c, name: d.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias(name))
    return per(left, "id", "facts").join(per(sources, "fact_id", "sources"), "id", "full").join(per(adjacent, "fact_id", "ends"), "id", "full").fillna(0, ["sources"])


def fact_points(spark, sf):
    p = fact_payloads(_facts(spark, sf), _sources(spark, sf))
    return p.select("point_id", "fact_id", "subject_normalized", F.array_join("source_types", ",").alias("types"), "source_count", "has_deleted_source", "has_modified_source", "has_relocated_source", "content")


def _clean_facts(spark, sf):
    return _facts(spark, sf).filter("predicate IS NOT NULL AND object IS NOT NULL")


def connections_all(spark, sf):
    found = connections(fa.adjacency(_clean_facts(spark, sf)), "Marta Ratumoki", max_depth=2, limit=5000)
    return found.select("path_no", "depth", F.array_join("path", ">").alias("path"), "entity", "type")


def connections_target(spark, sf):
    found = connections(fa.adjacency(_clean_facts(spark, sf)), "Marta Ratumoki", target="Granary Index Service", max_depth=4, limit=25)
    return found.select("path_no", "depth", F.array_join("path", ">").alias("path"), "entity", "type")


def connection_distances(spark, sf):
    return distances(fa.adjacency(_clean_facts(spark, sf)), "Marta Ratumoki", max_depth=3)


def _glossary(spark, sf):
    p = _read(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    at = F.lit(dt.datetime(2025, 1, 1)).cast("timestamp")
    entries = p.select(F.concat(F.lit("g"), key).alias("id"), F.concat_ws(" ", "p_name", key).alias("term"), F.col("p_type").alias("expansion"), F.concat_ws(" ", "p_name", "p_type").alias("definition"), F.col("p_type").alias("domain"), at.alias("created"), at.alias("modified"))
    aliases = p.filter("p_partkey % 3 = 0").select(F.concat(F.lit("g"), key).alias("entry_id"), F.concat(F.lit("Alias "), key).alias("alias"))
    return entries, aliases


def glossary_lookup(spark, sf):
    """The entry of every term and alias."""
    entries, aliases = _glossary(spark, sf)
    asked = entries.select(F.upper("term").alias("asked")).unionByName(aliases.select(F.upper("alias").alias("asked"))).unionByName(spark.createDataFrame([("nothing",)], "asked string"))
    return gl.lookup(entries, aliases, asked)


def glossary_exists(spark, sf):
    entries, aliases = _glossary(spark, sf)
    asked = _read(spark, sf, "part").select(F.concat(F.lit("ALIAS "), F.col("p_partkey").cast("string")).alias("asked"))
    return gl.exists(entries, aliases, asked)


def glossary_domains(spark, sf):
    return gl.domains(_glossary(spark, sf)[0])


def glossary_list(spark, sf):
    return gl.list_entries(_glossary(spark, sf)[0], limit=None)


def glossary_collisions(spark, sf):
    p = _read(spark, sf, "part")
    entries = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("term"))
    aliases = p.select(F.col("p_partkey").cast("string").alias("entry_id"), F.upper("p_type").alias("alias"))
    return gl.collisions(entries, aliases)


def glossary_hashes(spark, sf):
    entries, aliases = _glossary(spark, sf)
    return gl.with_hash(entries, aliases).select("id", "entry_hash")


def glossary_points(spark, sf):
    return glossary_payloads(*_glossary(spark, sf)).select("point_id", "term_normalized", "definition", "embedding_text", "entry_hash")


def _registry_rows(spark, sf):
    d = _read(spark, sf, "documents").filter("text IS NOT NULL")
    status = F.when(F.col("doc_id") % 4 == 0, "missing").otherwise("active")
    at = F.timestamp_seconds(F.col("doc_id"))
    return d.select("doc_id", F.sha2("text", 256).alias("content_hash"), F.concat(F.lit("u"), (F.col("doc_id") % 900).cast("string")).alias("uuid"), F.concat(F.lit("p/"), F.col("doc_id").cast("string")).alias("path"), "doc_type", status.alias("status"), at.alias("registered_at"), at.alias("last_verified"))


def _registry(spark, sf):
    rows = _registry_rows(spark, sf)
    even, odd = rows.filter("doc_id % 2 = 0").drop("doc_id"), rows.filter("doc_id % 2 = 1").drop("doc_id")
    return re_.register(re_.register(even.limit(0), even), odd)


def registry_replace(spark, sf):
    return _registry(spark, sf).select("content_hash", "uuid", "path", "status")


def registry_by_status(spark, sf):
    return re_.by_status(_registry(spark, sf), "missing").select("content_hash", "path")


def registry_update(spark, sf):
    changes = _registry_rows(spark, sf).filter("doc_id % 3 = 0").groupBy("content_hash").agg(F.max("path").alias("path"), F.lit("moved").alias("status"))
    return re_.update_entries(_registry(spark, sf), changes).select("content_hash", "path", "status")


def _cache(spark, sf):
    e = _read(spark, sf, "embeddings")
    at = F.timestamp_seconds(F.col("vec_id") * 37 % 1000)
    broken = F.when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))
    return e.select(F.concat(F.lit("k"), F.col("vec_id").cast("string")).alias("cache_key"), broken.alias("embedding"), F.lit(64).alias("dim"), at.alias("created_at"), at.alias("accessed_at"), (F.col("vec_id") % 5 == 0).alias("legacy"))


def cache_evict(spark, sf):
    return ca.evict(_cache(spark, sf), 440).select("cache_key", "legacy")


def cache_hits(spark, sf):
    keys = _read(spark, sf, "documents").select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("cache_key"))
    hits, misses = ca.get_many(_cache(spark, sf), keys, 64)
    return hits.select("cache_key", F.lit(True).alias("hit")).unionByName(misses.select("cache_key", F.lit(False).alias("hit")))


def cache_stats(spark, sf):
    return ca.stats(_cache(spark, sf), 3, 1)


def _points(spark, sf):
    return _read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "doc_type", "path")


def points_upsert(spark, sf):
    """Even points, then all others and some of the even ones."""
    old = _points(spark, sf).filter("id % 2 = 0")
    new = _points(spark, sf).filter("id % 2 <> 0 OR id % 3 = 0").withColumn("lang", F.lit("xx"))
    return po.upsert_points(old, new)


def points_delete_by_filter(spark, sf):
    return po.delete_by_filter(_points(spark, sf), "lang", "en")


def points_update_payload(spark, sf):
    return po.update_payload(_points(spark, sf), F.col("lang") == "de", {"doc_type": "translated"})


def points_scroll(spark, sf):
    return po.scroll(_points(spark, sf), F.col("doc_type") == "note", ["path", "lang"], most=0)


def points_retrieve(spark, sf):
    wanted = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return po.retrieve(_points(spark, sf), wanted)


def _index_and_tree(spark, sf):
    d = _read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"))
    size = F.length("text").cast("long")
    indexed = d.filter("doc_id % 7 <> 0").select("path", F.sha2("text", 256).alias("content_hash"), F.when(F.col("doc_id") % 13 == 0, 0.0).otherwise(F.col("doc_id").cast("double")).alias("mtime"), size.alias("size"))
    text = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    seen = d.filter("doc_id % 11 <> 0").select("path", F.sha2(text, 256).alias("content_hash"), F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") + 0.5).otherwise(F.col("doc_id").cast("double")).alias("mtime"), F.length(text).cast("long").alias("size"))
    return indexed, seen


def file_changes(spark, sf):
    return change_set(*_index_and_tree(spark, sf))


def file_change_counts(spark, sf):
    return change_counts(file_changes(spark, sf))


def char_spans(spark, sf):
    s = fr.char_spans(_read(spark, sf, "documents"), "doc_id", "text", 500)
    return s.select("doc_id", "index", "start", "end", "count", F.md5("text").alias("hash"))


def byte_spans(spark, sf):
    s = fr.spans(_read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", most_bytes=700)
    return s.select("doc_id", "index", "start", "end", "count", F.md5("text").alias("hash"))


def _damaged(spark, sf):
    s = fr.char_spans(_read(spark, sf, "documents"), "doc_id", "text", 300)
    h = F.lit("0" * 64)
    rows = s.filter("(doc_id * 31 + index) % 97 <> 0").select(F.col("doc_id").alias("parent_id"), "index", (F.col("start") + F.when((F.col("doc_id") + F.col("index")) % 89 == 0, 1).otherwise(0)).alias("start"), "end", "count", h.alias("source_hash"))
    return rows


def fragment_lineage_gaps(spark, sf):
    return fr.lineage_gaps(_damaged(spark, sf))


def fragment_orphans(spark, sf):
    rows = _damaged(spark, sf).withColumn("parent_id", F.col("parent_id").cast("string"))
    own = rows.select(F.when(F.col("index") == 0, F.col("parent_id")).otherwise(F.concat_ws("/", "parent_id", F.col("index").cast("string"))).alias("id"), fr.marker(F.col("parent_id"), F.col("source_hash"), F.col("start"), F.col("end"), F.col("index"), F.col("count")).alias("fragment"))
    return fr.orphans(own)


def hourly_events(spark, sf):
    own = event_windows(_read(spark, sf, "events")).withColumn("value", F.round("value", 4))
    return own.withColumn("start", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', start)"))


QUERIES = {
    f.__name__: f
    for f in (
        fact_query, fact_valid_at, fact_summaries, fact_by_source, fact_by_status, entity_facts, neighbors, source_statistics, fact_integrity, fact_dedup, fact_problems, source_status_update,
        fact_delete_cascade, fact_points, connections_all, connections_target, connection_distances, glossary_lookup, glossary_exists, glossary_domains, glossary_list, glossary_collisions, glossary_hashes, glossary_points,
        registry_replace, registry_by_status, registry_update, cache_evict, cache_hits, cache_stats, points_upsert, points_delete_by_filter, points_update_payload, points_scroll, points_retrieve,
        file_changes, file_change_counts, char_spans, byte_spans, fragment_lineage_gaps, fragment_orphans, hourly_events,
    )
}

_SOURCES = """
k0 AS (SELECT id, ('0x' || id[1:4])::INT AS k FROM facts),
j0 AS (SELECT id, k, unnest(range(0, k % 3)) AS j FROM k0),
sources AS (SELECT id AS fact_id, ['note', 'document', 'glossary'][(k + j) % 3 + 1] AS source_type, 'src-' || ((k * 7 + j) % 50) AS source_id, md5(id || '-' || j) AS content_hash,
  ['active', 'deleted', 'modified', 'relocated'][(k + j * 3) % 4 + 1] AS status FROM j0)
"""
_ADJ = "adj AS (SELECT lower(subject) AS entity_name, lower(subject_type) AS entity_type, id AS fact_id, 'subject' AS role FROM facts UNION ALL SELECT lower(object), lower(object_type), id, 'object' FROM facts)"
_PROBLEM = """CASE WHEN subject IS NULL OR trim(subject) = '' THEN 'subject is blank' WHEN predicate IS NULL OR trim(predicate) = '' THEN 'predicate is blank' WHEN object IS NULL OR trim(object) = '' THEN 'object is blank'
  WHEN isnan(confidence) OR confidence < 0 OR confidence > 1 THEN 'confidence is not between 0 and 1' WHEN valid_from > valid_to THEN 'valid_from is after valid_to' END"""
_UUID4 = "{h}[1:8] || '-' || {h}[9:12] || '-4' || {h}[14:16] || '-' || substr('89ab', CAST(('0x' || {h}[17:17])::INT % 4 + 1 AS INT), 1) || {h}[18:20] || '-' || {h}[21:32]"
_GLOSSARY = """
entries AS (SELECT 'g' || p_partkey AS id, p_partkey AS k, p_name || ' ' || p_partkey AS term, p_type AS expansion, p_name || ' ' || p_type AS definition, p_type AS domain FROM part),
aliases AS (SELECT 'g' || p_partkey AS entry_id, 'Alias ' || p_partkey AS alias FROM part WHERE p_partkey % 3 = 0)
"""
_REGISTRY = """
rows0 AS (SELECT doc_id, sha256(text) AS content_hash, 'u' || (doc_id % 900) AS uuid, 'p/' || doc_id AS path, doc_type, CASE WHEN doc_id % 4 = 0 THEN 'missing' ELSE 'active' END AS status, row_number() OVER (ORDER BY doc_id % 2, doc_id) AS o FROM documents WHERE text IS NOT NULL),
registry AS (SELECT * FROM (SELECT *, max(o) OVER (PARTITION BY content_hash) AS h, max(o) OVER (PARTITION BY uuid) AS u FROM rows0) WHERE o = h AND o = u)
"""
_CACHE = "cache AS (SELECT 'k' || vec_id AS cache_key, CASE WHEN vec_id % 11 = 0 THEN embedding[1:8] ELSE embedding END AS embedding, vec_id * 37 % 1000 AS used, vec_id % 5 = 0 AS legacy FROM embeddings)"
_POINTS = "points AS (SELECT doc_id AS id, lang, source, doc_type, path FROM documents)"
_TREE = """
d AS (SELECT doc_id, coalesce(text, '') AS text, 'd/' || doc_id AS path FROM documents),
a AS (SELECT path, sha256(text) AS h, CASE WHEN doc_id % 13 = 0 THEN 0.0 ELSE CAST(doc_id AS DOUBLE) END AS mtime, length(text) AS size FROM d WHERE doc_id % 7 <> 0),
b0 AS (SELECT doc_id, path, CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END AS text FROM d WHERE doc_id % 11 <> 0),
b AS (SELECT path, sha256(text) AS h, CASE WHEN doc_id % 5 = 0 THEN doc_id + 0.5 ELSE CAST(doc_id AS DOUBLE) END AS mtime, length(text) AS size FROM b0),
changes AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN (a.mtime <> b.mtime OR a.size <> b.size OR a.mtime = 0) AND a.h <> b.h THEN 'modified' END AS change FROM a FULL JOIN b ON a.path = b.path)
"""
_SPANS = "s0 AS (SELECT doc_id, text, length(text) AS n, CAST(ceil(length(text) / {m}.0) AS INTEGER) AS c FROM documents WHERE length(text) > 0), spans AS (SELECT doc_id, i AS \"index\", i * {m} AS \"start\", least(i * {m} + {m}, n) AS \"end\", c AS \"count\", text FROM (SELECT *, unnest(range(0, c)) AS i FROM s0))"
_DAMAGED = _SPANS.format(m=300) + ', damaged AS (SELECT doc_id AS parent_id, "index", "start" + CASE WHEN (doc_id + "index") % 89 = 0 THEN 1 ELSE 0 END AS "start", "end", "count" FROM spans WHERE (doc_id * 31 + "index") % 97 <> 0)'

SQL = {
    "fact_query": "SELECT id, subject, predicate FROM facts WHERE lower(subject_type) = 'person' AND confidence >= 0.8 ORDER BY modified DESC, id LIMIT 50",
    "fact_valid_at": "SELECT id FROM facts WHERE (valid_from IS NULL OR valid_from <= DATE '2020-06-01') AND (valid_to IS NULL OR valid_to >= DATE '2020-06-01')",
    "fact_summaries": f"WITH {_SOURCES} SELECT id, subject, subject_type, predicate, object, object_type, confidence, (SELECT count(*) FROM sources WHERE fact_id = f.id) AS source_count FROM facts f WHERE lower(subject_type) = 'component'",
    "fact_by_source": f"WITH {_SOURCES} SELECT DISTINCT f.id FROM facts f JOIN sources s ON f.id = s.fact_id WHERE source_type = 'note' AND source_id = 'src-7'",
    "fact_by_status": f"WITH {_SOURCES} SELECT id FROM facts WHERE id IN (SELECT fact_id FROM sources WHERE status = 'deleted') ORDER BY modified DESC, id LIMIT 100",
    "entity_facts": f"WITH {_ADJ} SELECT DISTINCT fact_id AS id FROM adj WHERE entity_name = 'granary index service'",
    "neighbors": f"""WITH {_ADJ}, asked AS (SELECT lower(subject) AS k, min(subject) AS name FROM facts WHERE subject IS NOT NULL GROUP BY 1)
SELECT name, CASE role WHEN 'subject' THEN object ELSE subject END AS entity, CASE role WHEN 'subject' THEN object_type ELSE subject_type END AS type, predicate,
  CASE role WHEN 'subject' THEN 'outgoing' ELSE 'incoming' END AS direction, fact_id FROM asked JOIN adj ON k = entity_name JOIN facts ON facts.id = fact_id""",
    "source_statistics": f"WITH {_SOURCES} SELECT 'status' AS kind, status AS value, count(*) AS sources FROM sources GROUP BY 2 UNION ALL SELECT 'type', source_type, count(*) FROM sources GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*) FROM sources",
    "fact_integrity": f"""WITH {_SOURCES}, c AS (SELECT f.id, count(fact_id) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'relocated') AS relocated
  FROM facts f LEFT JOIN sources ON f.id = fact_id GROUP BY 1)
SELECT *, CASE WHEN total = 0 THEN 1.0::DOUBLE ELSE round(CAST(active AS DOUBLE) / total, 6) END AS score FROM c""",
    "fact_dedup": f"""WITH h AS (SELECT *, sha256(concat_ws('|', lower(subject), lower(subject_type), lower(predicate), lower(object), lower(object_type))) AS hash FROM facts WHERE {_PROBLEM} IS NULL)
SELECT id, hash AS spo_hash, coalesce(confidence, 1.0) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY created, id) AS k FROM h) WHERE k = 1""",
    "fact_problems": f"SELECT id, problem FROM (SELECT id, {_PROBLEM} AS problem FROM facts) WHERE problem IS NOT NULL",
    "source_status_update": f"WITH {_SOURCES} SELECT fact_id, content_hash, CASE WHEN source_type = 'document' AND source_id = 'src-8' THEN 'relocated' ELSE status END AS status, source_type = 'document' AND source_id = 'src-8' AS checked FROM sources",
    "fact_delete_cascade": f"WITH {_SOURCES}, l AS (SELECT id FROM facts WHERE confidence >= 0.6 OR confidence IS NULL) SELECT id, 1 AS facts, (SELECT count(*) FROM sources WHERE fact_id = l.id) AS sources, 2 AS ends FROM l",
    "fact_points": f"""WITH {_SOURCES}, g AS (SELECT fact_id, array_to_string(list_sort(list(DISTINCT source_type)), ',') AS types, count(*) AS n, bool_or(status = 'deleted') AS d, bool_or(status = 'modified') AS m, bool_or(status = 'relocated') AS r FROM sources GROUP BY 1),
f AS (SELECT *, sha256('fact:' || id) AS h FROM facts WHERE predicate IS NOT NULL AND object IS NOT NULL)
SELECT {_UUID4.format(h='h')} AS point_id, id AS fact_id, lower(subject) AS subject_normalized, coalesce(types, '') AS types, coalesce(n, 0) AS source_count, coalesce(d, false) AS has_deleted_source, coalesce(m, false) AS has_modified_source, coalesce(r, false) AS has_relocated_source,
  concat_ws(' ', subject, replace(predicate, '_', ' '), object, CASE WHEN subject_type <> '' THEN '(' || subject_type || ')' END, CASE WHEN object_type <> '' THEN '(' || object_type || ')' END, nullif(context, '')) AS content FROM f LEFT JOIN g ON id = fact_id""",
    "connection_distances": f"""WITH RECURSIVE clean AS (SELECT * FROM facts WHERE predicate IS NOT NULL AND object IS NOT NULL),
e AS (SELECT lower(subject) AS a, lower(subject_type) AS at_, lower(object) AS b, lower(object_type) AS bt FROM clean UNION SELECT lower(object), lower(object_type), lower(subject), lower(subject_type) FROM clean),
r(entity, type, depth) AS (SELECT DISTINCT a, at_, 0 FROM e WHERE a = 'marta ratumoki' UNION SELECT b, bt, depth + 1 FROM r JOIN e ON entity = a AND type = at_ WHERE depth < 3)
SELECT entity, type, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY 1, 2 HAVING min(depth) > 0""",
    "glossary_lookup": f"""WITH {_GLOSSARY}, names AS (SELECT lower(term) AS name, id, 0 AS p FROM entries UNION ALL SELECT lower(alias), entry_id, 1 FROM aliases),
asked AS (SELECT upper(term) AS asked FROM entries UNION SELECT upper(alias) FROM aliases)
SELECT asked, arg_min(id, (p, id)) AS id FROM asked JOIN names ON lower(asked) = name GROUP BY 1""",
    "glossary_exists": "SELECT 'ALIAS ' || p_partkey AS asked, p_partkey % 3 = 0 AS there FROM part",
    "glossary_domains": "SELECT DISTINCT p_type AS domain FROM part WHERE p_type IS NOT NULL",
    "glossary_list": f"WITH {_GLOSSARY} SELECT id, term, expansion, domain FROM entries",
    "glossary_collisions": "SELECT name, count(*) AS uses FROM (SELECT lower(p_name) AS name FROM part UNION ALL SELECT lower(p_type) FROM part) GROUP BY 1 HAVING count(*) > 1",
    "glossary_hashes": f"WITH {_GLOSSARY} SELECT id, sha256(concat_ws('|', term, expansion, definition, coalesce(domain, ''), coalesce((SELECT alias FROM aliases WHERE entry_id = id), ''))) AS entry_hash FROM entries",
    "glossary_points": f"WITH {_GLOSSARY}, e AS (SELECT *, sha256('glossary:' || id) AS h FROM entries) SELECT {_UUID4.format(h='h')} AS point_id, lower(term) AS term_normalized, definition[1:2000] AS definition, concat_ws(' ', term, expansion, definition, nullif(domain, ''), (SELECT alias FROM aliases WHERE entry_id = id)) AS embedding_text, sha256(term || '|' || expansion || '|' || definition) AS entry_hash FROM e",
    "registry_replace": f"WITH {_REGISTRY} SELECT content_hash, uuid, path, status FROM registry",
    "registry_by_status": f"WITH {_REGISTRY} SELECT content_hash, path FROM registry WHERE status = 'missing'",
    "registry_update": f"WITH {_REGISTRY}, c AS (SELECT content_hash, max(path) AS p FROM rows0 WHERE doc_id % 3 = 0 GROUP BY 1) SELECT r.content_hash, coalesce(p, path) AS path, CASE WHEN p IS NULL THEN status ELSE 'moved' END AS status FROM registry r LEFT JOIN c ON r.content_hash = c.content_hash",
    "cache_evict": f"WITH {_CACHE}, r AS (SELECT *, row_number() OVER (ORDER BY legacy DESC, used, cache_key) AS k, count(*) OVER () AS n FROM cache) SELECT cache_key, legacy FROM r WHERE n <= 440 OR k > greatest(n - 440, 44, 1)",
    "cache_hits": f"WITH {_CACHE} SELECT DISTINCT 'k' || doc_id AS cache_key, EXISTS (SELECT 1 FROM cache WHERE cache_key = 'k' || doc_id AND len(embedding) = 64) AS hit FROM documents",
    "cache_stats": f"WITH {_CACHE} SELECT count(*) AS entries, round(sum(len(embedding) * 4) / 1048576.0, 2) AS size_mb, 0.75::DOUBLE AS hit_rate FROM cache",
    "points_upsert": f"WITH {_POINTS} SELECT * FROM points WHERE id % 2 = 0 AND id % 3 <> 0 UNION ALL SELECT id, 'xx', source, doc_type, path FROM points WHERE id % 2 <> 0 OR id % 3 = 0",
    "points_delete_by_filter": f"WITH {_POINTS} SELECT * FROM points WHERE lang IS DISTINCT FROM 'en'",
    "points_update_payload": f"WITH {_POINTS} SELECT id, lang, source, CASE WHEN lang = 'de' THEN 'translated' ELSE doc_type END AS doc_type, path FROM points",
    "points_scroll": f"WITH {_POINTS} SELECT id, path, lang FROM points WHERE doc_type = 'note' AND (path IS NOT NULL OR lang IS NOT NULL)",
    "points_retrieve": f"WITH {_POINTS} SELECT * FROM points WHERE id IN (SELECT vec_id FROM embeddings)",
    "file_changes": f"WITH {_TREE} SELECT path, change FROM changes WHERE change IS NOT NULL",
    "file_change_counts": f"WITH {_TREE} SELECT change, count(*) AS files FROM changes WHERE change IS NOT NULL GROUP BY 1",
    "char_spans": f'WITH {_SPANS.format(m=500)} SELECT doc_id, "index", "start", "end", "count", md5(substr(text, CAST("start" + 1 AS BIGINT), 500)) AS hash FROM spans',
    "fragment_lineage_gaps": f"""WITH {_DAMAGED},
m AS (SELECT *, "start" - coalesce(lag("end") OVER w, 0) AS gap, "index" - coalesce(lag("index") OVER w, -1) AS step FROM damaged WINDOW w AS (PARTITION BY parent_id ORDER BY "index", "start")),
g AS (SELECT parent_id, max((gap > 0)::INT) AS gap, max((gap < 0)::INT) AS lap, max((step <> 1)::INT) AS ord, count(*) AS n, min("count") AS a, max("count") AS b FROM m GROUP BY 1)
SELECT parent_id, problem FROM (SELECT parent_id, CASE WHEN a <> n OR b <> n THEN 'count' WHEN ord = 1 THEN 'order' WHEN lap = 1 THEN 'overlap' WHEN gap = 1 THEN 'gap' END AS problem FROM g) WHERE problem IS NOT NULL""",
    "fragment_orphans": f"""WITH {_DAMAGED} SELECT parent_id || '/' || "index" AS id, CAST(parent_id AS VARCHAR) AS parent_id FROM damaged WHERE "index" > 0 AND parent_id NOT IN (SELECT parent_id FROM damaged WHERE "index" = 0)""",
    "hourly_events": "SELECT CAST(floor(epoch(date_trunc('hour', ts))) AS BIGINT) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
}
