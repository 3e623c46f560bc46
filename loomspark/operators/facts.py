"""Facts (subject, predicate, object) with provenance: selection, integrity, and state transitions.

Tables: facts (id, subject, subject_type, predicate, object, object_type, context, confidence, valid_from,
valid_to, spo_hash, created, modified) and sources (fact_id, source_type, source_id, content_hash, status,
verified_at, ...). Transitions return new tables; nothing is changed in place.
"""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.ids import spo_hash
from loomspark.functions.scalars import UNSET, is_set
from loomspark.operators.skew import attach_by_key

STATUSES = ("active", "deleted", "modified", "relocated")


def adjacency(facts: DataFrame) -> DataFrame:
    """(entity_name, entity_type, fact_id, role): two rows a fact, names and types in lower case."""
    end = lambda role: F.struct(F.lower(F.col(role)).alias("entity_name"), F.lower(F.col(f"{role}_type")).alias("entity_type"), F.lit(role).alias("role"))
    each = facts.select(F.col("id").alias("fact_id"), F.explode(F.array(end("subject"), end("object"))).alias("e"))
    return each.select("e.entity_name", "e.entity_type", "fact_id", "e.role")


def invalid(facts: DataFrame) -> DataFrame:
    """`facts` with `problem`, for the rows that can't be stored."""
    blank = [F.when(F.col(c).isNull() | (F.trim(F.col(c)) == ""), F.lit(f"{c} is blank")) for c in ("subject", "predicate", "object")]
    wrong = F.when(F.isnan("confidence") | (F.col("confidence") < 0) | (F.col("confidence") > 1), F.lit("confidence is not between 0 and 1"))
    order = F.when(F.col("valid_from") > F.col("valid_to"), F.lit("valid_from is after valid_to"))
    return facts.withColumn("problem", F.coalesce(*blank, wrong, order)).filter("problem IS NOT NULL")


def insert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The facts after adding the valid rows of `new` whose five values aren't there yet, in any case of letters.

    Of equal new ones the first by (created, id) stays. A null confidence reads as 1.
    """
    checked = new.withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    ok = checked.join(invalid(checked).select("id"), "id", "left_anti")
    hashed = ok.withColumn("spo_hash", spo_hash("subject", "subject_type", "predicate", "object", "object_type"))
    rest = [c for c in hashed.columns if c != "spo_hash"]
    first = hashed.groupBy("spo_hash").agg(F.min_by(F.struct(*rest), F.struct("created", "id")).alias("r")).select("spo_hash", *[F.col(f"r.{c}").alias(c) for c in rest])
    return existing.unionByName(first.join(existing.select("spo_hash"), "spo_hash", "left_anti"), allowMissingColumns=True)


def _same(column: str, value: str | None) -> Column | None:
    return F.lower(F.col(column)) == value.lower() if value else None


def _where(df: DataFrame, *conditions: Column | None) -> DataFrame:
    for c in conditions:
        if c is not None:
            df = df.filter(c)
    return df


def valid_at(day: dt.date | Column) -> Column:
    """Whether a fact holds on a day; null is unbounded, both ends belong to it."""
    day = day if isinstance(day, Column) else F.lit(day)
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day))


def select_facts(facts: DataFrame, subject=None, predicate=None, object_value=None, subject_type=None, object_type=None, min_confidence: float | None = None, at: dt.date | None = None, limit: int | None = 50) -> DataFrame:
    """The facts that meet all given conditions, latest modified first, then by id.

    Texts compare without regard to case; empty ones are no condition. None as limit: all of them.
    """
    found = _where(
        facts, _same("subject", subject), _same("predicate", predicate), _same("object", object_value), _same("subject_type", subject_type), _same("object_type", object_type),
        None if min_confidence is None else F.col("confidence") >= min_confidence, None if at is None else valid_at(at),
    )
    return found if limit is None else found.orderBy(F.desc("modified"), "id").limit(limit)


def read_batch(facts: DataFrame, sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """The facts of `wanted` (ordinal, id) with their sources as an array; ids that aren't there are skipped."""
    own = wanted.join(facts, "id")
    each = sources.join(wanted.select(F.col("id").alias("fact_id")), "fact_id", "left_semi")
    nested = each.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in sources.columns if c != "fact_id"]))).alias("sources"))
    joined = own.join(nested, own["id"] == nested["fact_id"], "left").drop("fact_id")
    return joined.withColumn("sources", F.coalesce("sources", F.array().cast(joined.schema["sources"].dataType)))


def update(facts: DataFrame, fact_id: str, context: Any = UNSET, confidence: Any = UNSET, valid_from: Any = UNSET, valid_to: Any = UNSET, now: dt.datetime | None = None) -> DataFrame:
    """The facts with the given values set on one of them; UNSET leaves a value, None clears it; modified is now."""
    given = {k: v for k, v in (("context", context), ("confidence", confidence), ("valid_from", valid_from), ("valid_to", valid_to)) if is_set(v)}
    mine = F.col("id") == fact_id
    stamp = F.lit(now) if now else F.current_timestamp()
    changed = facts.withColumns({k: F.when(mine, F.lit(v).cast(facts.schema[k].dataType)).otherwise(F.col(k)) for k, v in given.items()} | {"modified": F.when(mine, stamp.cast(facts.schema["modified"].dataType)).otherwise(F.col("modified"))})
    if bad := invalid(changed.filter(mine)).limit(1).collect():
        raise ValueError(bad[0]["problem"])
    return changed


def delete(facts: DataFrame, sources: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, sources, adjacency) without the facts of `gone` (id) and all that hangs on them."""
    left = facts.join(gone.select("id"), "id", "left_anti")
    return left, sources.join(gone.select(F.col("id").alias("fact_id")), "fact_id", "left_anti"), adjacency(left)


def add_sources(facts: DataFrame, sources: DataFrame, new: DataFrame, now: dt.datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, sources) with more sources; the facts they belong to count as modified now."""
    touched = new.select(F.col("fact_id").alias("id")).distinct().withColumn("__t", F.lit(True))
    stamp = (F.lit(now) if now else F.current_timestamp()).cast(facts.schema["modified"].dataType)
    after = facts.join(touched, "id", "left").withColumn("modified", F.when(F.col("__t"), stamp).otherwise(F.col("modified"))).drop("__t")
    return after.select(*facts.columns), sources.unionByName(new, allowMissingColumns=True)


def entity_facts(facts: DataFrame, adjacent: DataFrame, name: str, entity_type: str | None = None) -> DataFrame:
    """The facts that an entity is an end of, each once."""
    ids = _where(adjacent.filter(F.col("entity_name") == name.lower()), _same("entity_type", entity_type)).select(F.col("fact_id").alias("id"))
    return facts.join(ids, "id", "left_semi")


def summaries(facts: DataFrame, sources: DataFrame, subject_type=None, object_type=None, predicate=None, limit: int | None = 50) -> DataFrame:
    """(id, subject, subject_type, predicate, object, object_type, confidence, source_count), latest modified first."""
    counts = sources.groupBy(F.col("fact_id").alias("id")).agg(F.count(F.lit(1)).alias("source_count"))
    found = select_facts(facts, None, predicate, None, subject_type, object_type, limit=limit)
    return found.join(counts, "id", "left").select("id", "subject", "subject_type", "predicate", "object", "object_type", "confidence", F.coalesce("source_count", F.lit(0)).alias("source_count"))


def _of_source(source_type=None, source_id=None, content_hash=None) -> list[Column]:
    return [F.col(c) == v for c, v in (("source_type", source_type), ("source_id", source_id), ("content_hash", content_hash)) if v is not None]


def facts_of_source(facts: DataFrame, sources: DataFrame, source_type=None, source_id=None, content_hash=None) -> DataFrame:
    """The facts with a source of the given kind; without a selector, those with any source."""
    ids = _where(sources, *_of_source(source_type, source_id, content_hash)).select(F.col("fact_id").alias("id"))
    return facts.join(ids, "id", "left_semi")


def set_source_status(sources: DataFrame, status: str = "deleted", source_type=None, source_id=None, content_hash=None, now: dt.datetime | None = None) -> DataFrame:
    """The sources with a new status where all given selectors match; without a selector nothing changes."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status}")
    chosen = _of_source(source_type, source_id, content_hash)
    if not chosen:
        return sources
    hit = F.lit(True)
    for c in chosen:
        hit = hit & F.coalesce(c, F.lit(False))
    stamp = (F.lit(now) if now else F.current_timestamp()).cast(sources.schema["verified_at"].dataType)
    return sources.withColumns({"status": F.when(hit, F.lit(status)).otherwise(F.col("status")), "verified_at": F.when(hit, stamp).otherwise(F.col("verified_at"))})


def mark_note(sources: DataFrame, note_id: str, status: str = "deleted", now: dt.datetime | None = None) -> DataFrame:
    """The sources after a note was deleted, modified or moved."""
    return set_source_status(sources, status, "note", note_id, now=now)


def mark_glossary(sources: DataFrame, entry_id: str, status: str = "deleted", now: dt.datetime | None = None) -> DataFrame:
    """The sources after a glossary entry was deleted or modified."""
    return set_source_status(sources, status, "glossary", entry_id, now=now)


def mark_document(sources: DataFrame, content_hash: str, status: str = "modified", now: dt.datetime | None = None) -> DataFrame:
    """The sources after the document with this content was modified or deleted."""
    return set_source_status(sources, status, "document", content_hash=content_hash, now=now)


def revalidate(sources: DataFrame, source_type: str, source_id: str, now: dt.datetime | None = None) -> DataFrame:
    """The sources with all of one origin active again."""
    return set_source_status(sources, "active", source_type, source_id, now=now)


def documents(facts: DataFrame) -> DataFrame:
    """(id, json): each fact as one JSON document; null values are left out."""
    return facts.select("id", F.to_json(F.struct(*facts.columns)).alias("json"))


def facts_by_source_status(facts: DataFrame, sources: DataFrame, status: str, limit: int | None = 100) -> DataFrame:
    """The facts with a source of this status, latest modified first."""
    found = facts.join(sources.filter(F.col("status") == status).select(F.col("fact_id").alias("id")), "id", "left_semi")
    return found if limit is None else found.orderBy(F.desc("modified"), "id").limit(limit)


def source_statistics(sources: DataFrame) -> DataFrame:
    """(kind, value, sources): counts by status and by source_type and the total, in one pass."""
    sets = sources.groupingSets([["status"], ["source_type"], []], "status", "source_type").agg(F.count(F.lit(1)).alias("sources"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 1, "status").when(F.col("g") == 2, "type").otherwise("total")
    return sets.select(kind.alias("kind"), F.when(F.col("g") == 1, F.col("status")).when(F.col("g") == 2, F.col("source_type")).alias("value"), "sources")


def integrity(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, total, active, deleted, modified, relocated, score) for every fact; score is active / total, 1 without sources."""
    counts = sources.groupBy(F.col("fact_id").alias("id")).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    joined = facts.select("id").join(counts, "id", "left").fillna(0)
    return joined.withColumn("score", F.when(F.col("total") == 0, 1.0).otherwise(F.col("active") / F.col("total")))


def neighbors(facts: DataFrame, adjacent: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, entity, type, predicate, direction, fact_id) for `entities` (name): what each is linked with.

    Names and types of the other end are as written in the fact; a fact from an entity to itself gives two
    rows. An entity that very many facts name is met by its rows in many tasks.
    """
    asked = entities.select(F.lower("name").alias("entity_name"), "name").distinct()
    per_name = adjacent.groupBy("entity_name").agg(F.count(F.lit(1)).alias("__n")).join(asked, "entity_name")
    mine = attach_by_key(adjacent, per_name, ["entity_name"], "__n", ["fact_id"]).select("name", "fact_id", "role")
    joined = mine.join(facts, mine["fact_id"] == facts["id"])
    out = F.col("role") == "subject"
    return joined.select(
        "name", F.when(out, F.col("object")).otherwise(F.col("subject")).alias("entity"), F.when(out, F.col("object_type")).otherwise(F.col("subject_type")).alias("type"),
        "predicate", F.when(out, "outgoing").otherwise("incoming").alias("direction"), "fact_id",
    )


def all_facts(facts: DataFrame) -> DataFrame:
    """Every readable fact, latest modified first; rows without id or with a broken time are skipped."""
    return facts.filter("id IS NOT NULL AND modified IS NOT NULL").orderBy(F.desc("modified"), "id")


def by_hash(facts: DataFrame, hashes: DataFrame) -> DataFrame:
    """The facts with one of the `hashes` (spo_hash)."""
    return facts.join(hashes.select("spo_hash").distinct(), "spo_hash", "left_semi")


def counted(facts: DataFrame) -> DataFrame:
    """One row: facts."""
    return facts.agg(F.count(F.lit(1)).alias("facts"))
