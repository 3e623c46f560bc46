"""Queries of state transitions and storage: preprocessing, models on disk, facts, glossary, fragments, indexing, embedding, caches."""

from __future__ import annotations

import datetime as dt
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import ids, scalars, text
from loomspark.functions.preprocess import CODE_SYNONYMS, COMMON_SYNONYMS, default_preprocessor
from loomspark.operators import cache as ca
from loomspark.operators import embedding as em
from loomspark.operators import facts as fa
from loomspark.operators import fragments as fr
from loomspark.operators import glossary as gl
from loomspark.operators import indexing as ix
from loomspark.operators import points as po
from loomspark.operators import registry as re_
from loomspark.operators import vocabulary as voc
from loomspark.operators.lexical import lexical_rank
from loomspark.operators.tfidf import TfidfModel
from loomspark.plans import knowledge, retrieval
from loomspark.session import cut_lineage, in_time, shared_dir
from loomspark.sources.files import Discovery, IgnoreRules
from loomspark.sources.generations import EmbeddingIdentity, current, ensure_generation
from loomspark.sources.tables import Store

#: A fixed time for changes, and the size of the vectors that the test embedder makes.
NOW, DIM = dt.datetime(2025, 1, 1, tzinfo=dt.UTC), 16
RULES = ("*.md", "core/", "!keep_*.md")
MODELS = ("alpha", "beta", "gamma")


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _store(spark: SparkSession) -> Store:
    """A fresh folder of collections on the shared storage."""
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


def _embedder() -> em.HashingEmbedder:
    return em.HashingEmbedder(DIM)


# Text and preprocessing.


def qualifying_edits(spark, sf):
    v = _read(spark, sf, "vocabulary").select(F.length("token").alias("size")).filter("size IS NOT NULL").distinct()
    return v.select("size", text.qualifying_edits("size", 0.75).alias("edits"))


def _queries(spark, sf, table):
    word = F.element_at(F.array(*[F.lit(w) for w in sorted(table)]), (F.col("p_partkey") % len(table) + 1).cast("int"))
    return _read(spark, sf, "part").select("p_partkey", F.concat(F.lit("path:src/"), F.col("p_partkey").cast("string"), F.lit(" getUserName "), word).alias("query"))


def _processed(spark, sf, code):
    done = default_preprocessor(code=code).over(_queries(spark, sf, CODE_SYNONYMS if code else COMMON_SYNONYMS))
    return done.select("p_partkey", F.col("processed.text").alias("text"), F.element_at("processed.fields", "path").alias("path"), F.array_join("processed.expanded_terms", "|").alias("terms"))


def query_preprocess(spark, sf):
    """Fields, camel case and synonyms of a table of queries."""
    return _processed(spark, sf, False)


def query_preprocess_code(spark, sf):
    return _processed(spark, sf, True)


def file_hashes(spark, sf):
    raw = retrieval.docs(spark, sf).select("doc_id", F.encode("text", "UTF-8").alias("c"))
    return raw.select("doc_id", *[ids.file_hash("c", a).alias(a) for a in ("sha256", "sha1", "md5")])


def note_texts(spark, sf):
    d = retrieval.docs(spark, sf)
    title = F.coalesce(F.nullif(F.trim("path"), F.lit("")), F.lit("untitled"))
    return d.select("doc_id", ids.note_text(title, F.array_compact(F.array("lang", "doc_type")), "source").alias("text"))


def payload_times(spark, sf):
    f = _read(spark, sf, "facts")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    created, modified = scalars.payload_times(iso("created"), F.when(F.length("subject") % 3 > 0, iso("modified")))
    return f.select("id", F.unix_seconds(created).alias("created"), F.unix_seconds(modified).alias("modified"))


def time_of_query(spark, sf):
    """One row: whether now is after everything that was modified, and in UTC."""
    f = _read(spark, sf, "facts").agg(F.max("modified").alias("last"))
    return f.select((F.current_timestamp() > F.col("last").cast("timestamp")).alias("later"))


def uuid_checks(spark, sf):
    c = _read(spark, sf, "customer")
    raw = F.md5(F.col("c_custkey").cast("string"))
    dashed = F.concat_ws("-", *[F.substring(raw, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    shown = F.element_at(F.array(raw, dashed, F.concat(F.lit("{"), dashed, F.lit("}")), F.concat(F.lit("urn:uuid:"), dashed), F.substring(raw, 1, 31), F.lit("")), (F.col("c_custkey") % 6 + 1).cast("int"))
    return c.select("c_custkey", scalars.is_uuid(shown).alias("valid"))


def path_checks(spark, sf):
    """Paths that are a directory, a file or neither."""
    rows = [("folder", not isinstance(scalars.checked_path(sf, directory=True), dict)), ("missing", isinstance(scalars.checked_path(f"{sf}/none"), dict)), ("empty", isinstance(scalars.checked_path(""), dict))]
    return spark.createDataFrame(rows, "what string, as_expected boolean")


# Models and vocabularies.


def vocab_growth(spark, sf):
    d = retrieval.docs(spark, sf)
    m = TfidfModel.fit(d.filter("doc_id % 3 <> 0")).extend(d.filter("doc_id % 3 = 0"))
    return spark.createDataFrame([(round(m.growth_ratio(), 6), m.needs_reindex())], "growth double, reindex boolean")


def tfidf_query(spark, sf):
    m = TfidfModel.fit(retrieval.docs(spark, sf))
    return m.query_vectors(retrieval.query_texts(spark, sf), fuzzy=False).select("query_id", "idx", F.round("weight", 6).alias("weight"))


def tfidf_saved(spark, sf):
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    TfidfModel.fit(retrieval.docs(spark, sf)).save(path)
    return TfidfModel.load(spark, path).vocabulary.select("token", "idx", "doc_freq", F.round("idf", 6).alias("idf"))


def invalid_counts(spark, sf):
    own = _read(spark, sf, "codebase_contributions").filter("token IS NOT NULL").distinct()
    return voc.invalid_frequencies(own, retrieval._given_state(spark, sf).doc_counts).select("codebase_id", "token", "doc_freq")


def vocab_snapshot(spark, sf):
    """A version that was read stays as it is while the next one is written."""
    store = _store(spark)
    store.publish("v", retrieval._given_state(spark, sf).vocabulary)
    before = store.read("v")
    store.publish("v", before.filter("doc_freq > 1"))
    count = lambda df, name: df.agg(F.lit(name).alias("version"), F.count(F.lit(1)).alias("tokens"))
    return count(before, "before").unionByName(count(store.read("v"), "after"))


def search_in_time(spark, sf):
    """The sparse search, or an error that names it."""
    return in_time(spark, "sparse search", 900, lambda: cut_lineage(retrieval.sparse_topk(spark, sf)))


# Collections and files.


def collections(spark, sf):
    store = _store(spark)
    made = [store.create(n, "id long, lang string") for n in ("notes_a", "notes_b", "code_a", "notes_a")]
    gone = store.drop("notes_b")
    rows = [(n, store.exists(n)) for n in ("notes_a", "notes_b", "code_a")] + [("created", made == [True, True, True, False]), ("dropped", gone), ("prefix", store.names("notes_") == ["notes_a"])]
    return spark.createDataFrame(rows, "what string, holds boolean")


def points_by_index(spark, sf):
    """Points written by language; a filter on it reads only its folder."""
    store = _store(spark)
    store.publish("points", knowledge._points(spark, sf), partition_by=["lang"])
    return store.read("points").filter("lang = 'de'").select("id", "source", "doc_type", "path")


def points_bucketed(spark, sf):
    """An upsert that writes only the buckets its keys are in."""
    store = _store(spark)
    p = knowledge._points(spark, sf)
    store.publish_buckets("points", p.filter("id % 2 = 0"), ["id"], 16)
    store.upsert("points", p.filter("id % 2 <> 0 OR id % 3 = 0").withColumn("lang", F.lit("xx")), ["id"])
    return store.read("points")


def points_delete(spark, sf):
    p = knowledge._points(spark, sf)
    return po.delete_points(p, p.filter("id % 3 = 0").select("id")).select("id", "lang")


def collection_metadata(spark, sf):
    store = _store(spark)
    store.create("points", "id long", dimension=64)
    store.set_metadata("points", model="alpha", rows=_read(spark, sf, "documents").count())
    own = store.metadata("points")
    return spark.createDataFrame([(own["dimension"], own["model"], own["rows"])], "dimension long, model string, rows long")


def point_rows(spark, sf):
    e = _read(spark, sf, "embeddings")
    p = e.select("vec_id", po.point(F.concat(F.lit("vec:"), F.col("vec_id").cast("string")), "embedding", payload=F.concat(F.lit("label "), F.col("label").cast("string"))).alias("p"))
    return p.select("vec_id", F.col("p.id").alias("id"), F.size("p.dense").alias("size"), F.col("p.payload").alias("payload"))


def invalid_payloads(spark, sf):
    c = _read(spark, sf, "code_chunks").select("chunk_id", F.lit("code_chunk").alias("type"), (F.col("start_line") - 20).alias("start_line"), "end_line")
    return po.invalid_payloads(c).select("chunk_id")


def payload_problems(spark, sf):
    """The first thing that keeps a chunk of code from being stored."""
    return po.typed_payloads(_read(spark, sf, "code_chunks"), "code_chunk").select("chunk_id", "type", "start_line", "problem")


def ignored_paths(spark, sf):
    """Which paths the lines of an ignore file are about: the last line that matches decides."""
    rules = IgnoreRules(RULES)

    @F.pandas_udf("boolean")
    def ignored(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: bool(rules.check(p)))

    paths = _read(spark, sf, "file_snapshots").select(F.regexp_replace("relative_path", r"\\", "/").alias("path")).filter("path IS NOT NULL").distinct()
    return paths.select("path", ignored("path").alias("ignored"))


def discovered_files(spark, sf):
    """Texts written as files of a tree and found again, with hash, size and lines."""
    root = f"{shared_dir(spark).removeprefix('file:')}/tree-{uuid.uuid4().hex}"
    d = _read(spark, sf, "documents").filter("text IS NOT NULL AND octet_length(text) < 1000000").select("text", F.col("doc_id").alias("doc"))
    d.repartition(8).write.partitionBy("doc").text(f"file://{root}")
    found = Discovery(extensions={".txt"}).discover(spark, root)
    doc = F.regexp_extract("relative_path", "doc=([0-9]+)", 1).cast("long")
    return found.select(doc.alias("doc_id"), "size", "content_hash", F.col("lines").cast("long").alias("lines"))


# Facts.


def fact_batch(spark, sf):
    f = _read(spark, sf, "facts")
    wanted = f.select(F.length("subject").alias("ordinal"), "id")
    return fa.read_batch(f, knowledge._sources(spark, sf), wanted).select("ordinal", "id", "subject", F.size("sources").alias("sources"))


def _first_id(f: DataFrame) -> str:
    return f.agg(F.min("id")).first()[0]


def fact_update(spark, sf):
    """One fact gets a context and loses its confidence; what isn't given stays."""
    f = _read(spark, sf, "facts")
    g = fa.update(f, _first_id(f), context="changed", confidence=None, now=NOW)
    return g.select("id", "context", "confidence", "valid_from", (F.col("modified") == F.lit(NOW).cast("timestamp_ntz")).alias("now"))


def fact_add_sources(spark, sf):
    f = _read(spark, sf, "facts")
    new = f.filter("confidence < 0.7").select(F.col("id").alias("fact_id"), F.lit("note").alias("source_type"), F.lit("added").alias("source_id"), F.md5("id").alias("content_hash"), F.lit("active").alias("status"))
    after, sources = fa.add_sources(f, knowledge._sources(spark, sf), new, now=NOW)
    n = sources.groupBy(F.col("fact_id").alias("id")).agg(F.count(F.lit(1)).alias("sources"))
    return after.join(n, "id", "left").select("id", F.coalesce("sources", F.lit(0)).alias("sources"), (F.col("modified") == F.lit(NOW).cast("timestamp_ntz")).alias("now"))


def fact_by_hash(spark, sf):
    f = _read(spark, sf, "facts")
    return fa.by_hash(f, f.filter("confidence > 0.9").select("spo_hash")).select("id")


def fact_count(spark, sf):
    return fa.counted(_read(spark, sf, "facts"))


def fact_iter(spark, sf):
    return fa.all_facts(_read(spark, sf, "facts")).select("id", "subject", "modified")


def fact_documents(spark, sf):
    each = fa.documents(_read(spark, sf, "facts"))
    return each.select("id", *[F.get_json_object("json", f"$.{c}").alias(c) for c in ("subject", "predicate", "context")])


def source_marks(spark, sf):
    """Notes deleted, glossary entries modified, documents relocated, and one source valid again."""
    s = fa.mark_note(knowledge._sources(spark, sf), "src-3", now=NOW)
    s = fa.mark_glossary(s, "src-4", "modified", now=NOW)
    s = fa.revalidate(s, "document", "src-5", now=NOW)
    return s.select("fact_id", "content_hash", "status")


# Glossary.


def _split_glossary(spark, sf):
    entries, aliases = knowledge._glossary(spark, sf)
    old, new = "substr(id, 2) % 2 = 0", "substr(id, 2) % 2 <> 0"
    mine = lambda c: c.replace("(id", "(entry_id")
    return (gl.with_hash(entries.filter(old), aliases.filter(mine(old))), aliases.filter(mine(old))), (entries.filter(new), aliases.filter(mine(new)))


def glossary_create(spark, sf):
    """Even entries, then the odd ones."""
    entries, aliases = gl.create(*(t for pair in _split_glossary(spark, sf) for t in pair))
    n = aliases.groupBy(F.col("entry_id").alias("id")).agg(F.count(F.lit(1)).alias("aliases"))
    return entries.join(n, "id", "left").select("id", "term", "entry_hash", F.coalesce("aliases", F.lit(0)).alias("aliases"))


def glossary_read(spark, sf):
    entries, aliases = knowledge._glossary(spark, sf)
    return gl.read(entries, aliases, entries.filter("length(term) % 2 = 0").select("id")).select("id", "term", F.array_join("aliases", "|").alias("aliases"))


def glossary_update(spark, sf):
    """One entry gets another term and alias and loses its domain."""
    entries, aliases = knowledge._glossary(spark, sf)
    after, names = gl.update(gl.with_hash(entries, aliases), aliases, "g3", term="Renamed", domain=None, new_aliases=["Other"], now=NOW)
    n = names.groupBy(F.col("entry_id").alias("id")).agg(F.max("alias").alias("alias"))
    return after.join(n, "id", "left").select("id", "term", "domain", "alias", "entry_hash")


def glossary_delete(spark, sf):
    entries, aliases = gl.delete(*knowledge._glossary(spark, sf), "g3")
    return entries.select("id", F.lit("entry").alias("what")).unionByName(aliases.select(F.col("entry_id").alias("id"), F.lit("alias").alias("what")))


def glossary_find(spark, sf):
    """By id, term or alias."""
    entries, aliases = knowledge._glossary(spark, sf)
    asked = entries.select(F.when(F.length("term") % 2 == 0, F.col("id")).otherwise(F.upper("term")).alias("asked")).unionByName(aliases.select(F.col("alias").alias("asked")))
    return gl.find(entries, aliases, asked)


def glossary_stats(spark, sf):
    return gl.stats(*knowledge._glossary(spark, sf))


def glossary_tools(spark, sf):
    """What the checked access answers."""
    t = gl.Tools(*knowledge._glossary(spark, sf))
    made = t.create(id="new", term=" Fresh ", expansion="E", definition="D", aliases=[" F1 ", ""])
    rows = [("created", made.get("term")), ("twice", t.create(id="x", term="fresh", expansion="E", definition="D").get("code")), ("missing", t.create(id="y", term=" ").get("code"))]
    rows += [("by alias", t.get("f1").get("id")), ("updated", t.update("Fresh", term="Fresher").get("term")), ("unknown", t.get("nothing at all").get("code"))]
    rows += [("deleted", t.delete("fresher").get("id")), ("gone", t.get("new").get("code")), ("listed", str(len(t.list(limit=7))))]
    return spark.createDataFrame(rows, "what string, answer string")


def glossary_search(spark, sf):
    """The five best entries for the name of every hundredth part, with values of the entries."""
    entries, _ = knowledge._glossary(spark, sf)
    asked = _read(spark, sf, "part").filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))
    hits = lexical_rank(entries, asked, "id", "definition", title="term", limit=5, columns=["term", "expansion"])
    return hits.select("query_id", F.col("key").alias("id"), "rank", "term", "expansion")


# Fragments.


def _joined(spans: DataFrame, spark, sf) -> DataFrame:
    """(doc_id, pieces, whole, small): whether the spans of a text are the text, and within their limits."""
    own = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda x: x["text"]), "").alias("__all"), F.max(F.octet_length("text")).alias("__most"), F.max("count").alias("__count"))
    return own.join(_read(spark, sf, "documents").select("doc_id", F.col("text").alias("__text")), "doc_id").select("doc_id", (F.col("__all") == F.col("__text")).alias("whole"), (F.col("pieces") == F.col("__count")).alias("counted"), "__most")


def byte_spans_checks(spark, sf):
    s = fr.spans(_read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", most_bytes=700)
    return _joined(s, spark, sf).select("doc_id", "whole", "counted", (F.col("__most") <= 700).alias("small"))


def word_counter():
    return lambda t: len(t.split())


def token_spans_checks(spark, sf):
    """Spans of at most 50 words; those without a word join a neighbour."""
    s = fr.spans(_read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", most_tokens=50, counter=word_counter)
    empty = s.groupBy("doc_id").agg(F.max(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).alias("words"))
    return _joined(s, spark, sf).join(empty, "doc_id").select("doc_id", "whole", "counted", (F.col("words") <= 50).alias("small"))


def _parents(spark, sf):
    d = _read(spark, sf, "documents").filter("length(text) > 0")
    return d.select(F.col("doc_id").cast("string").alias("id"), "text", "doc_type", "path", F.lit("note").alias("type"), "n_chars")


def _fragments(spark, sf, most=400):
    p = _parents(spark, sf)
    return fr.fragment_rows(p, fr.char_spans(p, "id", "text", most))


def fragment_points(spark, sf):
    """The first span keeps the id and all of the payload, the others what describes their parent."""
    f = _fragments(spark, sf)
    return f.select(F.col("fragment.parent_id").alias("parent_id"), F.col("fragment.index").alias("index"), (F.col("id") == F.col("fragment.parent_id")).alias("own_id"), "path", F.col("n_chars").isNotNull().alias("has_size"), F.length("fragment_text").alias("length"))


def fragment_markers(spark, sf):
    f = _fragments(spark, sf)
    return f.select("fragment.parent_id", "fragment.index", "fragment.source_hash", fr.valid_marker().alias("valid"), fr.is_derived().alias("derived"))


def fragment_replace(spark, sf):
    """Groups of long spans in the place of groups of short ones."""
    after = fr.replace_groups(_fragments(spark, sf, 200), _fragments(spark, sf, 900))
    return after.groupBy(F.col("fragment.parent_id").alias("parent_id")).agg(F.count(F.lit(1)).alias("pieces"))


def embedding_texts(spark, sf):
    d = _read(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("t:"), F.col("path"))).alias("embedding_text"), F.when(F.col("doc_id") % 2 == 1, F.lit("doc_type")).alias("embedding_text_field"), "doc_type", "path")
    return d.filter("path IS NOT NULL AND doc_type IS NOT NULL").select("doc_id", fr.embedding_text(["doc_type", "path"]).alias("text"))


def shared_texts(spark, sf):
    """The embedding texts of fact, glossary and note points together."""
    entries, aliases = knowledge._glossary(spark, sf)
    columns = ["id", "type", "glossary_id", "entry_hash", "content", "embedding_text"]
    g = ix.glossary_payloads(entries, aliases).withColumn("id", F.concat(F.lit("p-"), "glossary_id")).withColumn("content", F.lit(None).cast("string"))
    f = ix.fact_payloads(_read(spark, sf, "facts"), knowledge._sources(spark, sf)).select(F.col("fact_id").alias("id"), "type", F.lit(None).cast("string").alias("glossary_id"), F.lit(None).cast("string").alias("entry_hash"), "content", F.lit(None).cast("string").alias("embedding_text"))
    n = _parents(spark, sf).select(F.concat(F.lit("n-"), "id").alias("id"), "type", F.lit(None).cast("string").alias("glossary_id"), F.lit(None).cast("string").alias("entry_hash"), F.col("text").alias("content"), F.lit(None).cast("string").alias("embedding_text"))
    return fr.resolved_texts(g.select(*columns).unionByName(f.select(*columns)).unionByName(n.select(*columns)), entries, aliases).select("id", F.md5("embedding_text").alias("hash"))


# Indexing and generations.


def _fact_payloads(spark, sf):
    return ix.fact_payloads(_read(spark, sf, "facts"), knowledge._sources(spark, sf))


def index_facts(spark, sf):
    """All facts as points with both vectors."""
    done = ix.index_all(_fact_payloads(spark, sf), voc.empty(spark), "facts", "content", _embedder)
    return done.points.select("fact_id", F.coalesce(F.size("sparse.indices"), F.lit(0)).alias("terms"), F.size("dense").alias("size"))


def index_glossary(spark, sf):
    """What the vocabulary counts after a glossary was indexed whole."""
    done = ix.index_all(ix.glossary_payloads(*knowledge._glossary(spark, sf)), voc.empty(spark), "glossary", "embedding_text", _embedder)
    return done.state.vocabulary.select("token", "doc_freq")


def index_entries(spark, sf):
    """Half of the facts indexed whole, the others one change later, and some retired: what is left in the vocabulary."""
    p = _fact_payloads(spark, sf)
    first = ix.index_all(p.filter("conv(substr(md5(fact_id), 1, 2), 16, 10) % 2 = 0"), voc.empty(spark), "facts", "content", _embedder)
    points = first.points.withColumnRenamed("point_id", "id")
    second = ix.index_rows(first.state, points, p.filter("conv(substr(md5(fact_id), 1, 2), 16, 10) % 2 = 1"), "facts", "content", _embedder)
    state, left = ix.retire_rows(second.state, second.points, second.points.filter("conv(substr(md5(fact_id), 1, 2), 16, 10) % 5 = 0").select("id"), "facts", "content")
    n = left.agg(F.lit(None).cast("string").alias("token"), F.count(F.lit(1)).alias("doc_freq"))
    return state.vocabulary.filter("doc_freq > 0").select("token", "doc_freq").unionByName(n)


def stored_tokens(spark, sf):
    return ix.stored_tokens(_fact_payloads(spark, sf)).select("point_id", F.size("tokens").alias("tokens"))


def generation_publish(spark, sf):
    """A collection in one embedding space and then in another; the second time nothing is done for the same one."""
    store = _store(spark)
    store.publish("points", knowledge._points(spark, sf))
    identity = EmbeddingIdentity("alpha", "http://host/v1", DIM)
    first = ensure_generation(store, "points", identity, lambda p: p.withColumn("dense", F.array(F.lit(1.0))))
    again = ensure_generation(store, "points", identity, lambda p: p.limit(0))
    other = ensure_generation(store, "points", EmbeddingIdentity("beta", "http://host/v1", DIM), lambda p: p.withColumn("dense", F.array(F.lit(2.0))))
    own = store.read("points").agg(F.count(F.lit(1)).alias("points"), F.max(F.element_at("dense", 1)).alias("value"))
    return own.withColumns({"same": F.lit(first == again or first.version == again.version), "moved": F.lit(other.version != first.version), "model": F.lit(current(store, "points").identity.model)})


def identity_fingerprints(spark, sf):
    return spark.createDataFrame([(m, EmbeddingIdentity(m, "http://user:secret@host/v1/", DIM).fingerprint) for m in MODELS], "model string, fingerprint string")


# Embedding and caches.


def request_checks(spark, sf):
    """Requests of at most 8 texts and 4,000 bytes, a larger text alone."""
    d = _read(spark, sf, "documents").filter("length(text) > 0").select("doc_id", "text").coalesce(1)
    r = em.request_numbers(d, "doc_id", "text", 8, 4000).join(d.select("doc_id", F.octet_length("text").alias("size")), "doc_id")
    each = r.groupBy("request").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    return each.agg(F.sum("n").alias("texts"), F.bool_and((F.col("n") <= 8) & ((F.col("size") <= 4000) | (F.col("n") == 1))).alias("bounded"))


def embedded_texts(spark, sf):
    e = em.embed(_read(spark, sf, "documents"), "text", _embedder, DIM)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return e.select(F.md5("text").alias("hash"), F.size("embedding").alias("size"), (F.abs(norm - 1) < 1e-5).alias("unit"))


def _key(c):
    return ca.make_key(c, "space", "alpha", DIM)


def _cached(spark, sf):
    d = _read(spark, sf, "documents").filter("length(text) > 0 AND doc_id % 3 = 0").select("text").distinct()
    return em.embed(d, "text", _embedder, DIM).select(_key(F.col("text")).alias("cache_key"), "embedding")


def embed_all(spark, sf):
    """A vector for every document; repeats share one."""
    every, _, _ = em.embed_all(_read(spark, sf, "documents"), "text", "doc_id", _key, _cached(spark, sf), _embedder, DIM)
    return every.select(F.col("ordinal").alias("doc_id"), F.size("embedding").alias("size"))


def embed_progress(spark, sf):
    return em.embed_all(_read(spark, sf, "documents"), "text", "doc_id", _key, _cached(spark, sf), _embedder, DIM)[2]


def embedding_prefixes(spark, sf):
    rows = [(p, r, em.prefix(p, r, "find it")) for p in ("raw", "qwen3", "nemotron3") for r in ("query", "document")]
    return spark.createDataFrame(rows, "profile string, role string, prefix string")


def cache_keys(spark, sf):
    return _read(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", ca.make_key("text", "space", "alpha", 64, role="query").alias("cache_key"))


def cache_set(spark, sf):
    c = knowledge._cache(spark, sf)
    new = c.filter("length(cache_key) % 2 = 0").withColumn("embedding", F.array_repeat(F.lit(0.5).cast("float"), 64)).withColumn("legacy", F.lit(False))
    return ca.set_many(c, new, 64).select("cache_key", F.size("embedding").alias("size"), "legacy")


def cache_touch(spark, sf):
    """Which entries a lookup leaves, and which it marks."""
    c = knowledge._cache(spark, sf)
    after = ca.touch(c, c.filter("length(cache_key) % 2 = 0").select("cache_key"), 64, F.timestamp_seconds(F.lit(5000)))
    return after.select("cache_key", (F.unix_seconds("accessed_at") == 5000).alias("touched"))


def cache_legacy(spark, sf):
    """Vectors kept as JSON, some of them broken."""
    e = _read(spark, sf, "embeddings")
    rows = e.select(F.col("vec_id").cast("string").alias("cache_key"), F.when(F.col("vec_id") % 7 == 0, F.lit("[1.0, oops")).when(F.col("vec_id") % 5 == 0, F.lit("[1.0, 2.0]")).otherwise(F.to_json("embedding")).alias("vector"))
    return ca.legacy_rows(rows, 64).select("cache_key", F.size("embedding").alias("size"))


def cache_cleared(spark, sf):
    return ca.stats(ca.clear(knowledge._cache(spark, sf)))


def cache_ttl(spark, sf):
    """A cache of two entries whose clock is set by hand."""
    now = [0.0]
    t = ca.TtlCache(2, 10.0, lambda: now[0])
    t.set("a1", 1), t.set("a2", 2), t.set("b1", 3)
    rows = [("oldest went", t.get("a1") is None), ("others stay", (t.get("a2"), t.get("b1")) == (2, 3))]
    now[0] = 11.0
    rows += [("expired", t.get("a2") is None), ("cleaned", t.cleanup() == 1), ("empty", "b1" not in t)]
    return spark.createDataFrame(rows, "what string, holds boolean")


def registry_lookup(spark, sf):
    r = knowledge._registry(spark, sf)
    by_uuid = re_.lookup(r, r.filter("length(path) % 2 = 0").select("uuid"), "uuid").select("content_hash", F.lit("uuid").alias("by"))
    return by_uuid.unionByName(re_.lookup(r, r.filter("length(path) % 2 = 1").select("content_hash")).select("content_hash", F.lit("hash").alias("by")))


def registry_verify(spark, sf):
    r = knowledge._registry(spark, sf)
    after = re_.mark_verified(r, r.filter("status = 'missing'").select("content_hash"), NOW)
    gone = re_.delete(after, r.filter("length(path) % 3 = 0").select("content_hash"))
    return gone.select("content_hash", (F.col("last_verified") == F.lit(NOW)).alias("verified"))


QUERIES = {
    f.__name__: f
    for f in (
        qualifying_edits, query_preprocess, query_preprocess_code, file_hashes, note_texts, payload_times, time_of_query, uuid_checks, path_checks,
        vocab_growth, tfidf_query, tfidf_saved, invalid_counts, vocab_snapshot, search_in_time, collections, points_by_index, points_bucketed, points_delete, collection_metadata, point_rows, invalid_payloads, payload_problems,
        ignored_paths, discovered_files, fact_batch, fact_update, fact_add_sources, fact_by_hash, fact_count, fact_iter, fact_documents, source_marks,
        glossary_create, glossary_read, glossary_update, glossary_delete, glossary_find, glossary_stats, glossary_tools, glossary_search,
        byte_spans_checks, token_spans_checks, fragment_points, fragment_markers, fragment_replace, embedding_texts, shared_texts, index_facts, index_glossary, index_entries, stored_tokens, generation_publish, identity_fingerprints,
        request_checks, embedded_texts, embed_all, embed_progress, embedding_prefixes, cache_keys, cache_set, cache_touch, cache_legacy, cache_cleared, cache_ttl, registry_lookup, registry_verify,
    )
}


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names})"


def _preprocess_sql(table: dict[str, list[str]]) -> str:
    rows = [(i, w, " ".join([w, *table[w]]), "|".join(table[w])) for i, w in enumerate(sorted(table))]
    return f"""SELECT p_partkey, 'getusername ' || x || ' get user name ' || x AS text, 'src/' || p_partkey AS path, 'get|user|name|' || s || '|' || s AS terms
FROM part JOIN (SELECT * FROM {_values(rows, "i, w, x, s")}) ON i = p_partkey % {len(rows)}"""


def _tokens_of(source: str, key: str, column: str) -> str:
    """(key, token): the distinct tokens of a column."""
    parts = retrieval._PARTS
    return f"""tw AS (SELECT {key} AS k, unnest(regexp_extract_all({column}, '[a-zA-Z_][a-zA-Z0-9_]*')) AS w FROM {source}),
tr AS (SELECT k, lower(unnest(CASE WHEN len({parts}) > 0 THEN {parts} ELSE string_split(w, '_') END)) AS token FROM tw),
tk AS (SELECT DISTINCT k, token FROM tr WHERE length(token) >= 2 AND NOT regexp_full_match(token, '[0-9]+'))"""


_FACT_TEXT = "concat_ws(' ', subject, replace(predicate, '_', ' '), object, CASE WHEN subject_type <> '' THEN '(' || subject_type || ')' END, CASE WHEN object_type <> '' THEN '(' || object_type || ')' END, nullif(context, ''))"
_CLEAN = f"clean AS (SELECT *, {_FACT_TEXT} AS content FROM facts WHERE predicate IS NOT NULL AND object IS NOT NULL)"
_G, _S, _R = knowledge._GLOSSARY, knowledge._SOURCES, knowledge._REGISTRY
_HASH = "sha256(concat_ws('|', term, expansion, definition, coalesce(domain, ''), coalesce((SELECT alias FROM aliases WHERE entry_id = id), '')))"
_GTEXT = "concat_ws(' ', term, expansion, definition, nullif(domain, ''), (SELECT alias FROM aliases WHERE entry_id = id))"
_FULL = "documents WHERE length(text) > 0"
_IDENTITY = EmbeddingIdentity("\x00", "http://user:secret@host/v1/", DIM)


def _identity_sql() -> str:
    import json

    before, after = json.dumps(_IDENTITY.to_dict(), sort_keys=True, separators=(",", ":")).split("\\u0000")
    return f"SELECT model, sha256('{before}' || model || '{after}') AS fingerprint FROM {_values([(m,) for m in MODELS], 'model')}"


SQL = {
    "qualifying_edits": "SELECT size, coalesce((SELECT max(d) FROM range(0, 200) r(d) WHERE d < size AND 1.0 - CAST(d AS DOUBLE) / size >= 0.75), -1) AS edits FROM (SELECT DISTINCT length(token) AS size FROM vocabulary WHERE token IS NOT NULL)",
    "query_preprocess": _preprocess_sql(COMMON_SYNONYMS),
    "query_preprocess_code": _preprocess_sql(CODE_SYNONYMS),
    "file_hashes": "SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5 FROM documents",
    "note_texts": "SELECT doc_id, concat_ws(chr(10), coalesce(nullif(trim(path), ''), 'untitled'), CASE WHEN lang IS NOT NULL OR doc_type IS NOT NULL THEN 'Tags: ' || concat_ws(', ', lang, doc_type) END, CASE WHEN length(source) > 0 THEN 'Category: ' || source END) AS text FROM documents",
    "payload_times": "SELECT id, coalesce(CAST(floor(epoch(created)) AS BIGINT), 0) AS created, coalesce(CASE WHEN length(subject) % 3 > 0 THEN CAST(floor(epoch(modified)) AS BIGINT) END, CAST(floor(epoch(created)) AS BIGINT), 0) AS modified FROM facts",
    "time_of_query": "SELECT true AS later",
    "uuid_checks": "SELECT c_custkey, c_custkey % 6 < 4 AS valid FROM customer",
    "path_checks": f"SELECT * FROM {_values([('folder', True), ('missing', True), ('empty', True)], 'what, as_expected')}",
    "vocab_growth": f"WITH {retrieval._SETS}, a AS (SELECT count(DISTINCT token) AS n FROM sets WHERE doc_id % 3 <> 0), b AS (SELECT count(DISTINCT token) AS n FROM sets) SELECT round((b.n - a.n) / CAST(a.n AS DOUBLE), 6) AS growth, (b.n - a.n) / CAST(a.n AS DOUBLE) > 0.1 AS reindex FROM a, b",
    "tfidf_query": f"""WITH {retrieval._SETS}, d AS (SELECT token, count(*) AS df, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS idx FROM sets GROUP BY 1)
SELECT doc_id AS query_id, idx, round(ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1)) + 1, 6) AS weight FROM sets s JOIN d ON s.token = d.token WHERE doc_id % 100 = 0""",
    "tfidf_saved": retrieval.SQL["doc_freq_fit"],
    "invalid_counts": f"WITH {retrieval._GIVEN}, raw AS (SELECT DISTINCT codebase_id, token, doc_freq FROM codebase_contributions WHERE token IS NOT NULL) SELECT r.codebase_id, token, doc_freq FROM raw r LEFT JOIN n ON r.codebase_id = n.codebase_id WHERE doc_freq <= 0 OR doc_count IS NULL OR doc_freq > doc_count",
    "vocab_snapshot": "SELECT 'before' AS version, count(*) AS tokens FROM vocabulary UNION ALL SELECT 'after', count(*) FROM vocabulary WHERE doc_freq > 1",
    "search_in_time": retrieval.SQL["sparse_topk"],
    "collections": f"SELECT * FROM {_values([('notes_a', True), ('notes_b', False), ('code_a', True), ('created', True), ('dropped', True), ('prefix', True)], 'what, holds')}",
    "points_by_index": "SELECT doc_id AS id, source, doc_type, path FROM documents WHERE lang = 'de'",
    "points_bucketed": knowledge.SQL["points_upsert"],
    "points_delete": "SELECT doc_id AS id, lang FROM documents WHERE doc_id % 3 <> 0",
    "collection_metadata": "SELECT 64 AS dimension, 'alpha' AS model, count(*) AS rows FROM documents",
    "point_rows": f"WITH h AS (SELECT *, sha256('vec:' || vec_id) AS h FROM embeddings) SELECT vec_id, {knowledge._UUID4.format(h='h')} AS id, len(embedding) AS size, 'label ' || label AS payload FROM h",
    "invalid_payloads": "SELECT chunk_id FROM code_chunks WHERE start_line < 20 OR end_line < 0",
    "payload_problems": """SELECT chunk_id, 'chunk' AS type, start_line, CASE WHEN start_line IS NULL THEN 'start_line is missing' WHEN start_line < 0 THEN 'start_line is negative' WHEN end_line IS NULL THEN 'end_line is missing' WHEN end_line < 0 THEN 'end_line is negative'
  WHEN content IS NULL THEN 'content is missing' WHEN path IS NULL THEN 'path is missing' WHEN abs_path IS NULL THEN 'abs_path is missing' WHEN language IS NULL THEN 'language is missing' WHEN file_hash IS NULL THEN 'file_hash is missing'
  WHEN chunk_type IS NULL THEN 'chunk_type is missing' WHEN name IS NULL THEN 'name is missing' END AS problem FROM code_chunks""",
    "ignored_paths": r"""WITH p AS (SELECT DISTINCT replace(relative_path, chr(92), '/') AS path FROM file_snapshots WHERE relative_path IS NOT NULL)
SELECT path, CASE WHEN regexp_full_match(path, '(.*/)?keep_[^/]*\.md(/.*)?') THEN false ELSE regexp_full_match(path, '(.*/)?core/.+') OR regexp_full_match(path, '(.*/)?[^/]*\.md(/.*)?') END AS ignored FROM p""",
    "discovered_files": "SELECT doc_id, strlen(text) + 1 AS size, sha256(text || chr(10)) AS content_hash, len(string_split(text, chr(10))) + 1 AS lines FROM documents WHERE text IS NOT NULL AND strlen(text) < 1000000",
    "fact_batch": f"WITH {_S} SELECT length(subject) AS ordinal, id, subject, (SELECT count(*) FROM sources WHERE fact_id = f.id) AS sources FROM facts f",
    "fact_update": "SELECT id, CASE WHEN mine THEN 'changed' ELSE context END AS context, CASE WHEN mine THEN NULL ELSE confidence END AS confidence, valid_from, coalesce(mine, false) AS now FROM (SELECT *, id = (SELECT min(id) FROM facts) AS mine FROM facts)",
    "fact_add_sources": f"WITH {_S} SELECT id, (SELECT count(*) FROM sources WHERE fact_id = f.id) + CASE WHEN confidence < 0.7 THEN 1 ELSE 0 END AS sources, coalesce(confidence < 0.7, false) AS now FROM facts f",
    "fact_by_hash": "SELECT id FROM facts WHERE spo_hash IN (SELECT spo_hash FROM facts WHERE confidence > 0.9)",
    "fact_count": "SELECT count(*) AS facts FROM facts",
    "fact_iter": "SELECT id, subject, modified FROM facts WHERE id IS NOT NULL AND modified IS NOT NULL",
    "fact_documents": "SELECT id, subject, predicate, context FROM facts",
    "source_marks": f"WITH {_S} SELECT fact_id, content_hash, CASE WHEN source_type = 'note' AND source_id = 'src-3' THEN 'deleted' WHEN source_type = 'glossary' AND source_id = 'src-4' THEN 'modified' WHEN source_type = 'document' AND source_id = 'src-5' THEN 'active' ELSE status END AS status FROM sources",
    "glossary_create": f"WITH {_G} SELECT id, term, {_HASH} AS entry_hash, (SELECT count(*) FROM aliases WHERE entry_id = id) AS aliases FROM entries",
    "glossary_read": f"WITH {_G} SELECT id, term, coalesce((SELECT alias FROM aliases WHERE entry_id = id), '') AS aliases FROM entries WHERE length(term) % 2 = 0",
    "glossary_update": f"""WITH {_G} SELECT id, CASE WHEN id = 'g3' THEN 'Renamed' ELSE term END AS term, CASE WHEN id = 'g3' THEN NULL ELSE domain END AS domain,
  CASE WHEN id = 'g3' THEN 'Other' ELSE (SELECT alias FROM aliases WHERE entry_id = id) END AS alias, CASE WHEN id = 'g3' THEN sha256(concat_ws('|', 'Renamed', expansion, definition, '', 'Other')) ELSE {_HASH} END AS entry_hash FROM entries""",
    "glossary_delete": f"WITH {_G} SELECT id, 'entry' AS what FROM entries WHERE id <> 'g3' UNION ALL SELECT entry_id, 'alias' FROM aliases WHERE entry_id <> 'g3'",
    "glossary_find": f"WITH {_G} SELECT CASE WHEN length(term) % 2 = 0 THEN id ELSE upper(term) END AS asked, id FROM entries UNION ALL SELECT alias, entry_id FROM aliases",
    "glossary_stats": f"WITH {_G} SELECT (SELECT count(*) FROM entries) AS entries, (SELECT count(*) FROM aliases) AS aliases, (SELECT count(DISTINCT domain) FROM entries) AS domains",
    "glossary_tools": f"SELECT * FROM {_values([('created', 'Fresh'), ('twice', 'DUPLICATE'), ('missing', 'INVALID_INPUT'), ('by alias', 'new'), ('updated', 'Fresher'), ('unknown', 'NOT_FOUND'), ('deleted', 'new'), ('gone', 'NOT_FOUND'), ('listed', '7')], 'what, answer')}",
    "glossary_search": f"""WITH {_G}, q AS (SELECT p_partkey AS query_id, lower(unnest(regexp_extract_all(p_name, '[A-Za-z0-9_]+'))) AS term FROM part WHERE p_partkey % 100 = 0),
a AS (SELECT query_id, term, count(*) AS asked, sum(count(*)) OVER (PARTITION BY query_id) AS total FROM q GROUP BY 1, 2),
i AS (SELECT id, lower(unnest(regexp_extract_all(definition, '[A-Za-z0-9_]+') || regexp_extract_all(term, '[A-Za-z0-9_]+') || regexp_extract_all(term, '[A-Za-z0-9_]+'))) AS term FROM entries),
c AS (SELECT id, term, count(*) AS n FROM i GROUP BY 1, 2),
s AS (SELECT query_id, id, sum(least(n, 5) * asked) / any_value(CAST(total AS DOUBLE)) AS score FROM c JOIN a ON c.term = a.term GROUP BY 1, 2)
SELECT query_id, s.id, rank, term, expansion FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) s JOIN entries e ON s.id = e.id WHERE rank <= 5""",
    "byte_spans_checks": f"SELECT doc_id, true AS whole, true AS counted, true AS small FROM {_FULL}",
    "token_spans_checks": f"SELECT doc_id, true AS whole, true AS counted, true AS small FROM {_FULL}",
    "fragment_points": f"WITH {knowledge._SPANS.format(m=400)} SELECT CAST(doc_id AS VARCHAR) AS parent_id, \"index\", \"index\" = 0 AS own_id, d.path, \"index\" = 0 AND n_chars IS NOT NULL AS has_size, \"end\" - \"start\" AS length FROM spans JOIN documents d USING (doc_id)",
    "fragment_markers": f"WITH {knowledge._SPANS.format(m=400)} SELECT CAST(doc_id AS VARCHAR) AS parent_id, \"index\", sha256(text) AS source_hash, true AS valid, \"index\" > 0 AS derived FROM spans",
    "fragment_replace": f"SELECT CAST(doc_id AS VARCHAR) AS parent_id, CAST(ceil(length(text) / 900.0) AS BIGINT) AS pieces FROM {_FULL}",
    "embedding_texts": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 't:' || path ELSE doc_type END AS text FROM documents WHERE path IS NOT NULL AND doc_type IS NOT NULL",
    "shared_texts": f"WITH {_G}, {_CLEAN} SELECT 'p-' || id AS id, md5({_GTEXT}) AS hash FROM entries UNION ALL SELECT id, md5(content) FROM clean UNION ALL SELECT 'n-' || doc_id, md5(text) FROM {_FULL}",
    "index_facts": f"WITH {_CLEAN}, {_tokens_of('clean', 'id', 'content')} SELECT id AS fact_id, (SELECT count(*) FROM tk WHERE k = id) AS terms, CASE WHEN content <> '' THEN {DIM} END AS size FROM clean",
    "index_glossary": f"WITH {_G}, g AS (SELECT id, {_GTEXT} AS t FROM entries), {_tokens_of('g', 'id', 't')} SELECT token, count(*) AS doc_freq FROM tk GROUP BY 1",
    "index_entries": f"""WITH {_CLEAN}, kept AS (SELECT * FROM clean WHERE ('0x' || substr(md5(id), 1, 2))::INT % 5 <> 0), {_tokens_of('kept', 'id', 'content')}
SELECT token, count(*) AS doc_freq FROM tk GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM kept""",
    "stored_tokens": f"WITH {_CLEAN}, f AS (SELECT *, sha256('fact:' || id) AS h FROM clean), {_tokens_of('clean', 'id', 'content')} SELECT {knowledge._UUID4.format(h='h')} AS point_id, (SELECT count(*) FROM tk WHERE k = id) AS tokens FROM f",
    "generation_publish": "SELECT count(*) AS points, 2.0::DOUBLE AS value, true AS same, true AS moved, 'beta' AS model FROM documents",
    "identity_fingerprints": _identity_sql(),
    "request_checks": f"SELECT count(*) AS texts, true AS bounded FROM {_FULL}",
    "embedded_texts": f"SELECT DISTINCT md5(text) AS hash, {DIM} AS size, true AS unit FROM {_FULL}",
    "embed_all": f"SELECT doc_id, CASE WHEN length(text) > 0 THEN {DIM} END AS size FROM documents",
    "embed_progress": f"SELECT count(*) AS rows, count(DISTINCT text) AS texts, count(DISTINCT CASE WHEN text IN (SELECT text FROM {_FULL} AND doc_id % 3 = 0) THEN text END) AS cached, count(DISTINCT text) - count(DISTINCT CASE WHEN text IN (SELECT text FROM {_FULL} AND doc_id % 3 = 0) THEN text END) AS made FROM {_FULL}",
    "embedding_prefixes": "SELECT * FROM (VALUES ('raw', 'query', ''), ('raw', 'document', ''), ('qwen3', 'query', 'Instruct: find it' || chr(10) || 'Query:'), ('qwen3', 'document', ''), ('nemotron3', 'query', 'query: '), ('nemotron3', 'document', 'passage: ')) AS t(profile, role, prefix)",
    "cache_keys": """SELECT doc_id, sha256('{"cache_schema":2,"content_hash":"' || sha256(text) || '","dim":64,"model":"alpha","namespace":"space","preprocessing":"1","profile":"raw","role":"query"}') AS cache_key FROM documents WHERE text IS NOT NULL""",
    "cache_set": f"WITH {knowledge._CACHE} SELECT cache_key, CASE WHEN length(cache_key) % 2 = 0 THEN 64 ELSE len(embedding) END AS size, legacy AND length(cache_key) % 2 <> 0 AS legacy FROM cache",
    "cache_touch": f"WITH {knowledge._CACHE} SELECT cache_key, length(cache_key) % 2 = 0 AS touched FROM cache WHERE length(cache_key) % 2 <> 0 OR len(embedding) = 64",
    "cache_legacy": "SELECT CAST(vec_id AS VARCHAR) AS cache_key, 64 AS size FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 5 <> 0",
    "cache_cleared": "SELECT 0 AS entries, 0.0::DOUBLE AS size_mb, 0.0::DOUBLE AS hit_rate",
    "cache_ttl": f"SELECT * FROM {_values([(w, True) for w in ('oldest went', 'others stay', 'expired', 'cleaned', 'empty')], 'what, holds')}",
    "registry_lookup": f"WITH {_R} SELECT content_hash, CASE WHEN length(path) % 2 = 0 THEN 'uuid' ELSE 'hash' END AS by FROM registry",
    "registry_verify": f"WITH {_R} SELECT content_hash, status = 'missing' AS verified FROM registry WHERE length(path) % 3 <> 0",
}
