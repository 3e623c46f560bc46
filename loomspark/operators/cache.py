"""A cache of embeddings: (cache_key, embedding, dim, created_at, accessed_at, legacy)."""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.sources.tables import numbered, upsert

#: Version of the key's form (fixed value).
SCHEMA_VERSION = 2


def make_key(text: Column | str, namespace: str, model: str, dim: int, preprocessing: str = "1", role: str = "document", profile: str = "raw") -> Column:
    """The key of a prepared text in one embedding space."""
    if not namespace or dim <= 0:
        raise ValueError("a cache key needs a namespace and a dimension")
    text = F.col(text) if isinstance(text, str) else text
    fields = {"cache_schema": SCHEMA_VERSION, "content_hash": "\0", "dim": dim, "model": model, "namespace": namespace, "preprocessing": preprocessing, "profile": profile, "role": role}
    before, after = json.dumps(fields, sort_keys=True, separators=(",", ":")).split(json.dumps("\0"))
    return F.sha2(F.concat(F.lit(before + '"'), F.sha2(text, 256), F.lit('"' + after)), 256)


def usable(dim: int) -> Column:
    """Whether a cached vector has the dimension and only finite numbers."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size("embedding") == dim) & fine, F.lit(False))


def get_many(cache: DataFrame, keys: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(hits (cache_key, embedding), misses (cache_key)); a broken vector is a miss."""
    wanted = keys.select("cache_key").distinct()
    good = cache.filter(usable(dim)).select("cache_key", "embedding").join(wanted, "cache_key", "left_semi")
    return good, wanted.join(good.select("cache_key"), "cache_key", "left_anti")


def touch(cache: DataFrame, keys: DataFrame, dim: int, now: Column) -> DataFrame:
    """The cache after a lookup: hits are accessed now, and broken vectors among the keys are gone."""
    own = keys.select("cache_key").distinct().withColumn("__k", F.lit(True))
    joined = cache.join(own, "cache_key", "left").filter(F.col("__k").isNull() | usable(dim))
    return joined.withColumn("accessed_at", F.when(F.col("__k"), now).otherwise(F.col("accessed_at"))).select(*cache.columns)


def set_many(cache: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """The cache with new vectors; one that isn't usable is an error when it is read."""
    error = F.raise_error(F.concat(F.lit("no usable vector for "), "cache_key"))
    checked = new.withColumn("embedding", F.when(usable(dim), F.col("embedding")).otherwise(error.cast("array<float>")))
    return upsert(cache, checked, ["cache_key"])


def evict(cache: DataFrame, most: int) -> DataFrame:
    """The cache without its oldest entries if it has more than `most`: at least a tenth of `most` and one goes, legacy ones first.

    How many go is one count; which ones is a global order that is numbered range by range, in many tasks.
    """
    total = cache.count()
    if total <= most:
        return cache
    n = max(total - most, int(most * 0.1), 1)
    order = [F.desc("legacy"), F.asc("accessed_at"), F.asc("cache_key")]
    going = numbered(cache.select("legacy", "accessed_at", "cache_key"), order, "__at").filter(F.col("__at") < n).select("cache_key")
    return cache.join(going, "cache_key", "left_anti")


def eviction_rank(cache: DataFrame) -> Column:
    """The order in which entries go, for inspection of small caches."""
    return F.row_number().over(W.orderBy(F.desc("legacy"), "accessed_at", "cache_key"))


def stats(cache: DataFrame, hits: int = 0, misses: int = 0) -> DataFrame:
    """One row: entries, size_mb (4 bytes a number), hit_rate."""
    total = hits + misses
    size = F.coalesce(F.sum(F.size("embedding").cast("long") * 4), F.lit(0))
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.round(size / F.lit(1024.0 * 1024.0), 2).alias("size_mb")).withColumn("hit_rate", F.lit(round(hits / total, 3) if total else 0.0))


class TtlCache:
    """A bounded dictionary on the driver whose entries expire; overwriting keeps an entry's place."""

    def __init__(self, most: int = 100, ttl: float = 300.0, clock=time.monotonic):
        self.most, self.ttl, self.clock = most, ttl, clock
        self._items: OrderedDict[str, tuple[float, Any]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: str, default: Any = None) -> Any:
        item = self._items.get(key)
        if item is None or self.clock() - item[0] > self.ttl:
            self._items.pop(key, None)
            self.misses += 1
            return default
        self.hits += 1
        self._items.move_to_end(key)
        return item[1]

    def set(self, key: str, value: Any) -> None:
        fresh = key not in self._items
        self._items[key] = (self.clock(), value)
        if fresh and len(self._items) > self.most:
            self._items.popitem(last=False)

    def invalidate(self, key: str) -> bool:
        return self._items.pop(key, None) is not None

    def invalidate_prefix(self, prefix: str) -> int:
        gone = [k for k in self._items if k.startswith(prefix)]
        for k in gone:
            del self._items[k]
        return len(gone)

    def cleanup(self) -> int:
        old = [k for k, (at, _) in self._items.items() if self.clock() - at > self.ttl]
        for k in old:
            del self._items[k]
        return len(old)

    def clear(self) -> None:
        self._items.clear()

    def __contains__(self, key: str) -> bool:
        item = self._items.get(key)
        return item is not None and self.clock() - item[0] <= self.ttl


def legacy_rows(rows: DataFrame, dim: int) -> DataFrame:
    """(cache_key, embedding) of rows whose vector is kept as JSON (cache_key, vector); a broken vector gives none."""
    parsed = rows.select("cache_key", F.from_json("vector", "array<float>").alias("embedding"))
    return parsed.filter(usable(dim))


def clear(cache: DataFrame) -> DataFrame:
    """The cache without its entries."""
    return cache.limit(0)
