"""A glossary: entries with aliases, unique in lower case over terms and aliases together.

Tables: entries (id, term, expansion, definition, domain, created, modified, entry_hash) and aliases
(entry_id, alias). Null terms and aliases are errors on insert and match nothing on lookup.
"""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.errors import ErrorCode, error_response
from loomspark.functions.ids import entry_hash
from loomspark.functions.scalars import UNSET, is_set


def names(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, entry_id, priority): every term (0) and alias (1) in lower case."""
    own = entries.select(F.lower("term").alias("name"), F.col("id").alias("entry_id"), F.lit(0).alias("priority"))
    return own.unionByName(aliases.select(F.lower("alias").alias("name"), "entry_id", F.lit(1).alias("priority")))


def collisions(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, uses): names that more than one term or alias has."""
    return names(entries, aliases).groupBy("name").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1")


def with_hash(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """`entries` with their content hash, which takes in the aliases."""
    listed = aliases.groupBy(F.col("entry_id").alias("id")).agg(F.array_sort(F.collect_list("alias")).alias("__a"))
    joined = entries.drop("entry_hash").join(listed, "id", "left").withColumn("__a", F.coalesce("__a", F.array().cast("array<string>")))
    return joined.withColumn("entry_hash", entry_hash("term", "expansion", "definition", "domain", "__a")).drop("__a")


def create(entries: DataFrame, aliases: DataFrame, new: DataFrame, new_aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, aliases) with more entries; any collision is an error and nothing is added."""
    mine = names(new, new_aliases)
    if bad := mine.filter("name IS NULL OR trim(name) = ''").limit(1).collect():
        raise ValueError(f"entry {bad[0]['entry_id']} has a blank term or alias")
    clash = mine.groupBy("name").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1").select("name").unionByName(mine.join(names(entries, aliases).select("name"), "name", "left_semi").select("name"))
    if bad := clash.orderBy("name").limit(1).collect():
        raise ValueError(f"the name {bad[0]['name']!r} is taken")
    return entries.unionByName(with_hash(new, new_aliases), allowMissingColumns=True), aliases.unionByName(new_aliases)


def read(entries: DataFrame, aliases: DataFrame, ids: DataFrame) -> DataFrame:
    """The entries of `ids` (id) with their aliases as a sorted array."""
    listed = aliases.join(ids.select(F.col("id").alias("entry_id")), "entry_id", "left_semi").groupBy(F.col("entry_id").alias("id")).agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    own = entries.join(ids.select("id"), "id", "left_semi").join(listed, "id", "left")
    return own.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def update(entries: DataFrame, aliases: DataFrame, entry_id: str, term: Any = UNSET, expansion: Any = UNSET, definition: Any = UNSET, domain: Any = UNSET, new_aliases: Any = UNSET, now: dt.datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, aliases) with the given values on one entry; its own names don't count as taken."""
    spark = entries.sparkSession
    given = {k: v for k, v in (("term", term), ("expansion", expansion), ("definition", definition), ("domain", domain)) if is_set(v)}
    if any(v is None for k, v in given.items() if k != "domain"):
        raise ValueError("only the domain can be cleared")
    mine = F.col("id") == entry_id
    stamp = (F.lit(now) if now else F.current_timestamp()).cast(entries.schema["modified"].dataType)
    changed = entries.withColumns({k: F.when(mine, F.lit(v).cast("string")).otherwise(F.col(k)) for k, v in given.items()} | {"modified": F.when(mine, stamp).otherwise(F.col("modified"))})
    after = aliases
    if is_set(new_aliases):
        rows = spark.createDataFrame([(entry_id, a) for a in new_aliases or []], "entry_id string, alias string")
        after = aliases.filter(F.col("entry_id") != entry_id).unionByName(rows)
    every = names(changed, after)
    own = every.filter(F.col("entry_id") == entry_id)
    clash = own.groupBy("name").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1").select("name").unionByName(own.join(every.filter(F.col("entry_id") != entry_id).select("name"), "name", "left_semi").select("name"))
    if bad := clash.limit(1).collect():
        raise ValueError(f"the name {bad[0]['name']!r} is taken")
    hashed = with_hash(changed.filter(mine), after).select(*[c for c in entries.columns])
    return changed.filter(~mine).unionByName(hashed), after


def delete(entries: DataFrame, aliases: DataFrame, entry_id: str) -> tuple[DataFrame, DataFrame]:
    return entries.filter(F.col("id") != entry_id), aliases.filter(F.col("entry_id") != entry_id)


def lookup(entries: DataFrame, aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """(asked, id) for `wanted` (asked): the entry of a term or else of an alias, in any case of letters."""
    keyed = wanted.select("asked", F.lower("asked").alias("name"))
    hit = keyed.join(names(entries, aliases), "name")
    return hit.groupBy("asked").agg(F.min_by("entry_id", F.struct("priority", "entry_id")).alias("id"))


def find(entries: DataFrame, aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """(asked, id): as lookup, but an entry's own id comes first."""
    by_id = wanted.join(entries.select("id"), F.col("asked") == F.col("id")).select("asked", "id")
    rest = wanted.join(by_id.select("asked"), "asked", "left_anti")
    return by_id.unionByName(lookup(entries, aliases, rest))


def exists(entries: DataFrame, aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """(asked, there): whether a term or alias has the name."""
    known = names(entries, aliases).select("name").distinct().withColumn("there", F.lit(True))
    return wanted.withColumn("name", F.lower("asked")).join(known, "name", "left").select("asked", F.coalesce("there", F.lit(False)).alias("there"))


def list_entries(entries: DataFrame, domain: str | None = None, limit: int | None = None) -> DataFrame:
    """(id, term, expansion, domain) by term; a limit of 0 gives none, None all."""
    own = entries if domain is None else entries.filter(F.col("domain") == domain)
    listed = own.select("id", "term", "expansion", "domain").orderBy("term", "id")
    return listed if limit is None else listed.limit(max(0, limit))


def domains(entries: DataFrame) -> DataFrame:
    return entries.filter("domain IS NOT NULL").select("domain").distinct().orderBy("domain")


class Tools:
    """Checked, capped access for callers that want values and not exceptions."""

    MOST = 100

    def __init__(self, entries: DataFrame, aliases: DataFrame):
        self.entries, self.aliases = entries, aliases

    def create(self, **entry: Any) -> dict[str, Any]:
        """Adds an entry given as id, term, expansion, definition[, domain, aliases]; texts are stripped."""
        clean = {k: v.strip() if isinstance(v, str) else v for k, v in entry.items()}
        if missing := [k for k in ("id", "term", "expansion", "definition") if not clean.get(k)]:
            return error_response(ErrorCode.INVALID_INPUT, f"missing {missing[0]}")
        spark = self.entries.sparkSession
        names_ = [a.strip() for a in clean.pop("aliases", None) or [] if a and a.strip()]
        now = dt.datetime.now(dt.UTC)
        row = spark.createDataFrame([(clean["id"], clean["term"], clean["expansion"], clean["definition"], clean.get("domain"), now, now)], "id string, term string, expansion string, definition string, domain string, created timestamp, modified timestamp")
        try:
            self.entries, self.aliases = create(self.entries, self.aliases, row, spark.createDataFrame([(clean["id"], a) for a in names_], "entry_id string, alias string"))
        except ValueError as e:
            return error_response(ErrorCode.DUPLICATE, str(e))
        return {"id": clean["id"], "term": clean["term"]}

    def get(self, term_or_id: str) -> dict[str, Any]:
        spark = self.entries.sparkSession
        hit = find(self.entries, self.aliases, spark.createDataFrame([(term_or_id.strip(),)], "asked string"))
        rows = read(self.entries, self.aliases, hit.select("id")).limit(1).collect()
        return rows[0].asDict() if rows else error_response(ErrorCode.NOT_FOUND, f"no entry {term_or_id!r}")

    def delete(self, term_or_id: str) -> dict[str, Any]:
        own = self.get(term_or_id)
        if "error" not in own:
            self.entries, self.aliases = delete(self.entries, self.aliases, own["id"])
        return own

    def search(self, ranked: DataFrame, limit: int = 10) -> list[dict[str, Any]]:
        """The entries of a search result (id, score, rank), best first, with their whole texts."""
        best = ranked.filter(F.col("rank") <= max(1, min(limit, self.MOST)))
        return [r.asDict() for r in best.join(self.entries.select("id", "term", "expansion", "definition", "domain"), "id").orderBy("rank").collect()]

    def list(self, domain: str | None = None, limit: int = 50) -> list[dict[str, Any]]:
        return [r.asDict() for r in list_entries(self.entries, domain, min(limit, self.MOST)).collect()]

    def update(self, term_or_id: str, **changes: Any) -> dict[str, Any]:
        """Changes the given values (term, expansion, definition, domain, aliases) of an entry; texts are stripped."""
        own = self.get(term_or_id)
        if "error" in own:
            return own
        clean = {k: v.strip() if isinstance(v, str) else v for k, v in changes.items()}
        if unknown := [k for k in clean if k not in ("term", "expansion", "definition", "domain", "aliases")]:
            return error_response(ErrorCode.INVALID_INPUT, f"unknown value {unknown[0]}")
        if blank := [k for k in ("term", "expansion", "definition") if k in clean and not clean[k]]:
            return error_response(ErrorCode.INVALID_INPUT, f"blank {blank[0]}")
        if "aliases" in clean:
            clean["new_aliases"] = [a.strip() for a in clean.pop("aliases") or [] if a and a.strip()]
        try:
            self.entries, self.aliases = update(self.entries, self.aliases, own["id"], **clean)
        except ValueError as e:
            return error_response(ErrorCode.DUPLICATE, str(e))
        return {"id": own["id"], "term": clean.get("term", own["term"])}

    def domains(self) -> list[str]:
        return [r["domain"] for r in domains(self.entries).limit(self.MOST).collect()]

    def stats(self) -> dict[str, int]:
        row = stats(self.entries, self.aliases).first()
        return row.asDict()


def stats(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row: entries, aliases, domains."""
    own = entries.select(F.lit(1).alias("e"), F.lit(0).alias("a"), "domain").unionByName(aliases.select(F.lit(0).alias("e"), F.lit(1).alias("a"), F.lit(None).cast("string").alias("domain")))
    return own.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("entries"), F.coalesce(F.sum("a"), F.lit(0)).alias("aliases"), F.count_distinct("domain").alias("domains"))
