"""Snapshot tables: immutable Parquet versions under a folder, selected by a pointer file.

A change writes a whole new version next to the old one and then moves the pointer, so readers never see
half a change and a failed writer leaves nothing behind that anyone reads. One writer per table.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from loomspark.session import cut_lineage


def numbered(df: DataFrame, order: list[Column], name: str, first: int = 0) -> DataFrame:
    """`df` with consecutive numbers in a total order, without sorting everything in one task.

    A range partitioning sorts in parallel; the counts per partition (as many rows as partitions) give
    each partition its offset. The sorted rows are kept by a checkpoint, so the ranges are drawn once.
    """
    ranged = df.repartitionByRange(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order)
    marked = cut_lineage(ranged.withColumn("__id", F.monotonically_increasing_id()))
    part, within = F.shiftrightunsigned("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    counts = marked.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("__part", before.alias("__before")))
    placed = marked.withColumn("__part", part).join(offsets, "__part")
    return placed.select(*df.columns, (F.col("__before") + within + first).cast("long").alias(name))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of `new` replace those with the same keys; of equal keys in `new` the one with the last `order` stays.

    Null keys are equal to each other. Columns that only one side has are null on the other.
    """
    if order:
        rest = [c for c in new.columns if c not in keys]
        last = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
        new = last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
    else:
        new = new.dropDuplicates(keys)
    other = new.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = [existing[k].eqNullSafe(other[f"__{k}"]) for k in keys]
    return existing.join(other, same, "left_anti").unionByName(new, allowMissingColumns=True)


class Store:
    """Collections of snapshot tables below one folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, path: str) -> str | None:
        p = self._path(path)
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, path: str, text: str) -> None:
        """Writes beside the target and renames over it, so that a reader sees the old or the new text."""
        beside = self._path(f"{path}.{uuid.uuid4().hex}")
        out = self._fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        sc = self.spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs
        options = sc._gateway.new_array(hadoop.Options.Rename, 1)
        options[0] = hadoop.Options.Rename.OVERWRITE
        context = hadoop.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        context.rename(beside.makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()), self._path(path).makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()), options)

    def exists(self, name: str) -> bool:
        return self._read(f"{self.root}/{name}/CURRENT") is not None

    def names(self, prefix: str | None = None) -> list[str]:
        """All collections, or those whose name begins with `prefix`."""
        root = self._path(self.root)
        if not self._fs.exists(root):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(root) if s.isDirectory()]
        return sorted(n for n in found if n.startswith(prefix or "") and self.exists(n))

    def create(self, name: str, schema: T.StructType | str, dimension: int | None = None) -> bool:
        """An empty collection; False if it is there. A dimension of 0 is an error."""
        if dimension == 0:
            raise ValueError("a collection needs a resolved dimension")
        if self.exists(name):
            return False
        self.publish(name, self.spark.createDataFrame([], schema), {"dimension": dimension} if dimension else {})
        return True

    def drop(self, name: str) -> bool:
        return bool(self._fs.delete(self._path(f"{self.root}/{name}"), True))

    def _manifest(self, name: str) -> dict[str, Any]:
        text = self._read(f"{self.root}/{name}/CURRENT")
        if text is None:
            raise KeyError(f"no collection {name}")
        return json.loads(text)

    def read(self, name: str, part: str | None = None) -> DataFrame:
        """The current version (or a part of it); it stays readable while later versions are written."""
        own = self._manifest(name)
        if "buckets" in own:
            schema = T.StructType.fromJson(own["schema"])
            paths = [f"{self.root}/{name}/{version}/__bucket={b}" for b, version in own["buckets"].items()]
            return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{name}/{self._manifest(name)['version']}" + (f"/{part}" if part else ""))

    def stage(self, name: str, df: DataFrame) -> str:
        """Writes `df` as a version that nobody reads until `switch` makes it the current one."""
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{version}")
        return version

    def staged(self, name: str, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def switch(self, name: str, version: str, metadata: dict[str, Any] | None = None) -> None:
        """Makes a staged version the current one; its metadata is exactly the given one."""
        self._write(f"{self.root}/{name}/CURRENT", json.dumps({"version": version, "metadata": metadata or {}}))

    def unstage(self, name: str, version: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}/{version}"), True)

    def publish(self, name: str, df: DataFrame, metadata: dict[str, Any] | None = None, partition_by: list[str] | None = None) -> str:
        """Writes `df` as the next version and makes it the current one; metadata carries over unless given."""
        old = json.loads(self._read(f"{self.root}/{name}/CURRENT") or "{}")
        version = f"v-{uuid.uuid4().hex}"
        writer = df.write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{name}/{version}")
        self._write(f"{self.root}/{name}/CURRENT", json.dumps({"version": version, "metadata": old.get("metadata", {}) | (metadata or {})}))
        return version

    def publish_buckets(self, name: str, df: DataFrame, keys: list[str], buckets: int, metadata: dict[str, Any] | None = None) -> str:
        """Writes `df` in `buckets` folders by a hash of its keys, so that an upsert writes only those that it touches."""
        old = json.loads(self._read(f"{self.root}/{name}/CURRENT") or "{}")
        return self._write_buckets(name, df, {"metadata": old.get("metadata", {}) | (metadata or {}), "keys": keys, "of": buckets, "schema": df.schema.jsonValue(), "buckets": {}})

    def _in_buckets(self, df: DataFrame, own: dict[str, Any]) -> DataFrame:
        return df.withColumn("__bucket", F.pmod(F.xxhash64(*own["keys"]), F.lit(own["of"])).cast("int"))

    def _write_buckets(self, name: str, df: DataFrame, own: dict[str, Any]) -> str:
        """The rows of `df` as new folders in the place of those of their buckets; the others stay where they are."""
        version = f"v-{uuid.uuid4().hex}"
        path = f"{self.root}/{name}/{version}"
        self._in_buckets(df, own).repartition("__bucket").write.partitionBy("__bucket").parquet(path)
        made = [s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.isDirectory()]
        own = own | {"version": version, "buckets": own["buckets"] | {n.split("=")[1]: version for n in made if n.startswith("__bucket=")}}
        self._write(f"{self.root}/{name}/CURRENT", json.dumps(own))
        return version

    def publish_parts(self, name: str, parts: dict[str, DataFrame], metadata: dict[str, Any] | None = None) -> str:
        """Several tables as one version: all of them become current at once, or none."""
        old = json.loads(self._read(f"{self.root}/{name}/CURRENT") or "{}")
        version = f"v-{uuid.uuid4().hex}"
        for part, df in parts.items():
            df.write.parquet(f"{self.root}/{name}/{version}/{part}")
        self._write(f"{self.root}/{name}/CURRENT", json.dumps({"version": version, "metadata": old.get("metadata", {}) | (metadata or {})}))
        return version

    def metadata(self, name: str) -> dict[str, Any]:
        return self._manifest(name).get("metadata", {})

    def set_metadata(self, name: str, **values: Any) -> None:
        """Adds metadata; the identity of a generation can't be overwritten by another one."""
        own = self._manifest(name)
        there = own.get("metadata", {})
        if "identity" in values and there.get("identity") not in (None, values["identity"]):
            raise ValueError("the identity of a generation can't be changed")
        own["metadata"] = there | values
        self._write(f"{self.root}/{name}/CURRENT", json.dumps(own))

    def upsert(self, name: str, new: DataFrame, keys: list[str], order: str | None = None, metadata: dict[str, Any] | None = None) -> str:
        """Rows of `new` in the place of those with the same keys. Of a collection in buckets of these keys only those touched are written.

        Which ones these are is at most the number of buckets, so that much comes to the driver.
        """
        own = self._manifest(name)
        if own.get("keys") == keys:
            own["metadata"] = own.get("metadata", {}) | (metadata or {})
            touched = {str(r[0]) for r in self._in_buckets(new, own).select("__bucket").distinct().collect()}
            schema = T.StructType.fromJson(own["schema"])
            paths = [f"{self.root}/{name}/{version}/__bucket={b}" for b, version in own["buckets"].items() if b in touched]
            old = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
            return self._write_buckets(name, upsert(old, new, keys, order).select(*schema.names), own)
        return self.publish(name, upsert(self.read(name), new, keys, order), metadata)

    def vacuum(self, name: str) -> int:
        """Deletes the versions that aren't current; returns how many."""
        own = self._manifest(name)
        current = {own["version"], *own.get("buckets", {}).values()}
        old = [s.getPath() for s in self._fs.listStatus(self._path(f"{self.root}/{name}")) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in current]
        for p in old:
            self._fs.delete(p, True)
        return len(old)
