"""Lossless spans of long texts, fragment rows, and the checks of their lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.functions.ids import fragment_id, glossary_text, payload_hash

#: Columns that a derived fragment keeps of its parent's payload (fixed values).
CHILD_FIELDS = (
    "type", "note_id", "title", "tags", "category", "created", "modified", "created_at", "updated_at", "hash", "content_hash", "note_hash", "document_id",
    "filename", "path", "doc_type", "chunk_index", "section_title", "glossary_id", "domain", "term", "term_normalized", "aliases", "entry_hash", "fact_id",
    "subject", "subject_type", "predicate", "object_type", "subject_normalized", "object_normalized", "confidence", "valid_from", "valid_to", "source_types",
    "source_count", "has_deleted_source", "has_modified_source", "has_relocated_source", "embedding_text_source",
)


def char_spans(df: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(key, index, start, end, text, count): consecutive spans of `most` characters; together they are the text."""
    n = F.ceil(F.length(text) / F.lit(most)).cast("int")
    each = df.filter(F.length(text) > 0).select(F.col(key), F.col(text).alias("__t"), n.alias("count"), F.explode(F.sequence(F.lit(0), n - 1)).alias("index"))
    start = F.col("index") * most
    return each.select(key, "index", start.alias("start"), F.least(start + most, F.length("__t")).alias("end"), F.substr("__t", start + 1, F.lit(most)).alias("text"), "count")


def span_cuts(text: str, prefix: str = "", most_chars: int | None = None, most_bytes: int | None = None, most_tokens: int | None = None, count: Callable[[str], int] | None = None) -> list[tuple[int, int]]:
    """Ranges that partition the text so that prefix + part meets every limit.

    A part is the longest that the limits of characters and bytes allow; if it has too many tokens it is
    shortened in proportion until it fits, and the next one starts from the density seen. Parts that the
    tokenizer gives no token join a neighbour. Limits that can't hold one character are an error.
    """
    if not text:
        raise ValueError("there is no text to split")
    chars = len(text) if most_chars is None else most_chars - len(prefix)
    size = None if most_bytes is None else most_bytes - len(prefix.encode())
    if chars <= 0 or (size is not None and size <= 0):
        raise ValueError("the limits leave no room after the prefix")
    window = chars if most_tokens is None else min(chars, 8 * most_tokens)
    out: list[tuple[int, int]] = []
    start = 0

    def fitting(a: int, b: int) -> int:
        """The largest end up to b whose part has few enough bytes."""
        part = text[a:b]
        return b if size is None else a + len(part.encode()[:size].decode(errors="ignore"))

    while start < len(text):
        end = fitting(start, min(len(text), start + (window if size is None else min(window, size))))
        while end > start and most_tokens is not None:
            n = count(prefix + text[start:end])
            if n <= most_tokens:
                window = min(chars, max(1, (end - start) * most_tokens // max(1, n)))
                break
            end = start + min(end - start - 1, (end - start) * most_tokens // n)
        if end <= start:
            raise ValueError("the limits can't hold a character after the prefix")
        if out and count is not None and most_tokens is not None and count(text[start:end]) == 0 and _fits(text, out[-1][0], end, prefix, most_chars, most_bytes, most_tokens, count):
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
        start = end
    return out


def _fits(text: str, a: int, b: int, prefix: str, chars: int | None, size: int | None, tokens: int | None, count: Callable[[str], int]) -> bool:
    part = prefix + text[a:b]
    return (chars is None or len(part) <= chars) and (size is None or len(part.encode()) <= size) and (tokens is None or count(part) <= tokens)


def spans(df: DataFrame, key: str, text: str, prefix: str = "", most_chars: int | None = None, most_bytes: int | None = None, most_tokens: int | None = None, counter: Callable[[], Callable[[str], int]] | None = None) -> DataFrame:
    """(key, index, start, end, text, count) with limits of characters, bytes and tokens; one text is one unit of work.

    `counter` makes the token counter on the executor. Null and empty texts give no row.
    """
    kind = dict(df.dtypes)[key]
    arrow_key = pa.int64() if kind in ("bigint", "int") else pa.string()
    schema = pa.schema([(key, arrow_key), ("index", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("count", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter() if counter else None
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cuts = span_cuts(t, prefix, most_chars, most_bytes, most_tokens, count)
                rows.extend((k, i, a, b, t[a:b], len(cuts)) for i, (a, b) in enumerate(cuts))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    own = df.filter(F.length(text) > 0).select(F.col(key).cast("long" if arrow_key == pa.int64() else "string").alias(key), F.col(text))
    return own.mapInArrow(run, f"`{key}` {'long' if arrow_key == pa.int64() else 'string'}, index int, start int, end int, text string, count int")


def marker(parent: Column, digest: Column, start: Column, end: Column, index: Column, count: Column) -> Column:
    """The lineage of a fragment."""
    values = (("schema", F.lit(1)), ("parent_id", parent.cast("string")), ("source_hash", digest), ("start", start), ("end", end), ("index", index), ("count", count))
    return F.struct(*[(v.cast("int") if k in ("schema", "start", "end", "index", "count") else v).alias(k) for k, v in values])


def valid_marker(m: str = "fragment") -> Column:
    """Whether a lineage is well-formed; a row without one is canonical and fine."""
    c = lambda f: F.col(f"{m}.{f}")
    ok = (c("schema") == 1) & c("parent_id").isNotNull() & c("source_hash").rlike("^[0-9a-f]{64}$") & (c("start") >= 0) & (c("end") > c("start")) & (c("index") >= 0) & (c("index") < c("count")) & ((c("index") > 0) | (c("start") == 0))
    return F.col(m).isNull() | F.coalesce(ok, F.lit(False))


def is_derived(m: str = "fragment") -> Column:
    return F.coalesce(F.col(f"{m}.index") > 0, F.lit(False))


def fragment_rows(parents: DataFrame, cuts: DataFrame, key: str = "id", text: str = "text", key_is_int: bool = False) -> DataFrame:
    """One row per span: `id`, `fragment`, `fragment_text` and the payload.

    The first span keeps its parent's id and whole payload; the others get an id of their own and the
    payload columns that describe the parent. `cuts` is as of spans or char_spans.
    """
    digest = parents.select(F.col(key), F.sha2(F.col(text), 256).alias("__digest"), *[c for c in parents.columns if c != key])
    own = cuts.select(F.col(key).alias("__parent"), "index", "start", "end", F.col("text").alias("fragment_text"), "count")
    joined = own.join(digest, own["__parent"] == digest[key])
    first = F.col("index") == 0
    new_id = F.when(first, F.col("__parent").cast("string")).otherwise(fragment_id("__parent", "__digest", "start", "end", "index", key_is_int))
    payload = [c for c in parents.columns if c != key]
    kept = [F.col(c) if c in CHILD_FIELDS else F.when(first, F.col(c)).alias(c) for c in payload]
    return joined.select(new_id.alias("id"), marker(F.col("__parent"), F.col("__digest"), F.col("start"), F.col("end"), F.col("index"), F.col("count")).alias("fragment"), "fragment_text", *kept)


def replace_groups(points: DataFrame, fragments: DataFrame, text_length: str | None = None) -> DataFrame:
    """The points after the fragments replace all rows of their parents, stale children included.

    Groups that don't cover their source once and in order (and up to the length in the column
    `text_length`, if there is one) are an error before anything is replaced. A new row whose id belongs to a row of another parent is an error when it is read.
    """
    own = fragments.filter("fragment IS NOT NULL").select(*[F.col(f"fragment.{c}").alias(c) for c in ("parent_id", "index", "start", "end", "count", "source_hash")], *([text_length] if text_length else []))
    if bad := lineage_gaps(own, text_length).limit(1).collect():
        raise ValueError(f"the fragments of {bad[0]['parent_id']} are broken: {bad[0]['problem']}")
    fragments = fragments.drop(text_length) if text_length else fragments
    parents = fragments.select(F.col("fragment.parent_id").alias("__p")).distinct()
    owner = F.coalesce(F.col("fragment.parent_id"), F.col("id"))
    kept = points.withColumn("__o", owner).join(parents, F.col("__o") == F.col("__p"), "left_anti").drop("__o")
    taken = kept.select("id", F.lit(True).alias("__taken"))
    error = F.raise_error(F.concat(F.lit("another parent has the id "), "id")).cast("string")
    checked = fragments.join(taken, "id", "left").withColumn("id", F.when(F.col("__taken"), error).otherwise(F.col("id"))).drop("__taken")
    return kept.unionByName(checked, allowMissingColumns=True)


def lineage_gaps(rows: DataFrame, text_length: str | None = None) -> DataFrame:
    """(parent_id, problem) of groups that don't cover their source once and in order.

    `rows` is (parent_id, index, start, end, count, source_hash) and optionally the length of the source.
    The neighbours are compared in one window per group; a group is bounded by its source's length.
    """
    w = W.partitionBy("parent_id").orderBy("index", "start")
    before = F.coalesce(F.lag("end").over(w), F.lit(0))
    step = F.coalesce(F.lag("index").over(w), F.lit(-1))
    marked = rows.select("*", (F.col("start") - before).alias("__gap"), (F.col("index") - step).alias("__step"))
    ends = [F.max("end").alias("__end")] + ([F.max(text_length).alias("__len")] if text_length else [])
    groups = marked.groupBy("parent_id").agg(
        F.max((F.col("__gap") > 0).cast("int")).alias("gap"), F.max((F.col("__gap") < 0).cast("int")).alias("overlap"), F.max((F.col("__step") != 1).cast("int")).alias("order"),
        F.count_distinct("source_hash").alias("hashes"), F.count(F.lit(1)).alias("n"), F.min("count").alias("least"), F.max("count").alias("most"), *ends,
    )
    problem = F.when(F.col("hashes") > 1, "hash").when((F.col("least") != F.col("n")) | (F.col("most") != F.col("n")), "count").when(F.col("order") == 1, "order").when(F.col("overlap") == 1, "overlap").when(F.col("gap") == 1, "gap")
    if text_length:
        problem = problem.when(F.col("__end") != F.col("__len"), "coverage")
    return groups.select("parent_id", problem.alias("problem")).filter("problem IS NOT NULL")


def orphans(points: DataFrame) -> DataFrame:
    """(id, parent_id) of derived fragments whose parent isn't there."""
    derived = points.filter(is_derived()).select("id", F.col("fragment.parent_id").alias("parent_id"))
    return derived.join(points.filter(~is_derived()).select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("id", "parent_id")


def embedding_text(columns: list[str]) -> Column:
    """The text a row was embedded from: its own, or that of the column it names; a broken reference is an error."""
    named = F.coalesce(*[F.when(F.col("embedding_text_field") == c, F.col(c)) for c in columns]) if columns else F.lit(None).cast("string")
    broken = F.raise_error(F.lit("a row has no valid embedding text")).cast("string")
    full = lambda c: F.when(F.length(c) > 0, c).otherwise(broken)
    return F.when(F.col("embedding_text").isNotNull(), full(F.col("embedding_text"))).when(F.col("embedding_text_field").isNotNull(), full(named))


def resolved_texts(points: DataFrame, entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, embedding_text) of points by their `type`: the text each was embedded from.

    Facts give their content, glossary points the text of their entry, which must be there with the same
    term, expansion and shown definition; all others their own embedding_text or else content. A point
    without a text, or a glossary point that no longer matches its entry, is an error when it is read.
    """
    listed = aliases.groupBy(F.col("entry_id").alias("__id")).agg(F.array_sort(F.collect_list("alias")).alias("__aliases"))
    names = F.coalesce("__aliases", F.array().cast("array<string>"))
    canonical = entries.join(listed, entries["id"] == listed["__id"], "left").select(
        F.col("id").alias("__g"), glossary_text("term", "expansion", "definition", "domain", names).alias("__text"), payload_hash("term", "expansion", "definition").alias("__hash")
    )
    joined = points.join(canonical, (points["type"] == "glossary") & (points["glossary_id"] == canonical["__g"]), "left")
    own = F.coalesce(F.nullif("embedding_text", F.lit("")), F.nullif("content", F.lit("")))
    glossary = F.when(F.col("entry_hash") == F.col("__hash"), F.col("__text"))
    chosen = F.when(F.col("type") == "glossary", glossary).when(F.col("type") == "fact", F.nullif("content", F.lit(""))).otherwise(own)
    broken = F.raise_error(F.concat(F.lit("no valid embedding text for "), F.col("id").cast("string"))).cast("string")
    return joined.select("id", F.coalesce(chosen, broken).alias("embedding_text"))
