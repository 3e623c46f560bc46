"""Files as rows: discovery with ignore rules, hashes, and changes against an index."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.config import DEFAULTS
from loomspark.session import cut_lineage

# Directories that never hold sources.
SKIPPED_DIRECTORIES = frozenset(
    ".git .svn .hg node_modules __pycache__ .venv venv .tox .pytest_cache .mypy_cache dist build .next .nuxt target coverage".split()
)


def _pattern(line: str) -> tuple[bool, re.Pattern] | None:
    """(ignored, form) of one line of an ignore file; None for blanks and comments."""
    line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\n"))
    if not line or line.startswith("#"):
        return None
    ignored = not line.startswith("!")
    line = line[1:] if not ignored else line
    line = line[1:] if line.startswith(("\\#", "\\!")) else line
    only_dirs = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    if not line:
        return None
    out, i = "", 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.*", i + 3
        elif c == "*":
            out, i = out + "[^/]*", i + (len(line[i:]) - len(line[i:].lstrip("*")))
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := line.find("]", i + 2)) > 0:
            body = line[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif c == "\\" and i + 1 < len(line):
            out, i = out + re.escape(line[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    start = "" if anchored else "(?:.*/)?"
    rest = "/.+" if only_dirs else "(?:/.*)?"
    return ignored, re.compile(f"{start}{out}{rest}", re.DOTALL)


class IgnoreRules:
    """The lines of one ignore file; the last line that matches a path decides."""

    def __init__(self, lines: Iterable[str]):
        self.patterns = [p for p in map(_pattern, lines) if p]

    def check(self, path: str) -> bool | None:
        """True: ignored, False: wanted after all, None: no line is about it."""
        return next((ignored for ignored, form in reversed(self.patterns) if form.fullmatch(path)), None)


def _lines_at(path: str) -> list[str] | None:
    try:
        with open(path, encoding="utf-8", errors="ignore") as f:
            return f.read().splitlines()
    except OSError:
        return None


@dataclass
class Discovery:
    """Which files of a tree are sources.

    Symbolic links, dot files and dot directories are skipped, as are empty and too large files. Exclude
    patterns win; then the deepest ignore file that says something about a file decides, and .git/info/exclude last.
    """

    extensions: set[str] | None = None
    max_size_kb: int = DEFAULTS.max_file_size_kb
    respect_ignore: bool = True
    exclude: list[str] = field(default_factory=list)
    ignore_names: tuple[str, ...] = (".gitignore",)

    def entries(self, root: str, here: str, inherited: list[tuple[str, list[str]]]) -> tuple[list[str], list[tuple[str, str, os.stat_result]], list[tuple[str, list[str]]]]:
        """(directories to enter, wanted files, ignore lines for what is below) of one directory.

        A file is its path, the path below the root and its stat; ignore lines go with the directory they are of.
        """
        lines = list(inherited)
        if self.respect_ignore:
            names = [os.path.join(".git", "info", "exclude")] * (here == root) + list(self.ignore_names)
            lines += [(here, found) for n in names if (found := _lines_at(os.path.join(here, n))) is not None]
        rules = [(base, IgnoreRules(own)) for base, own in reversed(lines)]
        exclude = IgnoreRules(self.exclude)
        dirs, files = [], []
        try:
            found = sorted(os.scandir(here), key=lambda e: e.name)
        except OSError:
            return [], [], lines
        for entry in found:
            if entry.name.startswith(".") or entry.is_symlink():
                continue
            if entry.is_dir(follow_symlinks=False):
                if entry.name not in SKIPPED_DIRECTORIES:
                    dirs.append(entry.path)
                continue
            below = os.path.relpath(entry.path, root)
            if self.extensions and os.path.splitext(entry.name)[1].lower() not in self.extensions:
                continue
            verdicts = [exclude.check(below) or None, *[r.check(os.path.relpath(entry.path, base)) for base, r in rules]]
            if next((v for v in verdicts if v is not None), False):
                continue
            try:
                stat = os.stat(entry.path)
            except OSError:
                continue
            if 0 < stat.st_size <= self.max_size_kb * 1024:
                files.append((entry.path, below, stat))
        return dirs, files, lines

    def walk(self, root: str) -> Iterator[tuple[str, str, os.stat_result]]:
        """(absolute path, path below the root, stat) of the wanted files of a tree on this machine."""
        todo: list[tuple[str, list[tuple[str, list[str]]]]] = [(root, [])]
        while todo:
            dirs, files, lines = self.entries(root, *todo.pop())
            yield from files
            todo.extend((d, lines) for d in reversed(dirs))

    def listed(self, spark: SparkSession, root: str) -> DataFrame:
        """(path, relative_path, size, mtime) of the wanted files, listed level by level by the executors.

        They all have to see the tree under the same path. A level's directories are spread over the tasks,
        with the ignore lines that hold for them; the driver only learns whether there is another level.
        """
        own = self
        schema = pa.schema([("path", pa.string()), ("relative_path", pa.string()), ("size", pa.int64()), ("mtime", pa.float64()), ("lines", pa.string())])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for here, inherited in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    dirs, files, lines = own.entries(root, here, json.loads(inherited))
                    rows += [(p, below, s.st_size, s.st_mtime, None) for p, below, s in files] + [(d, None, None, None, json.dumps(lines)) for d in dirs]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        tasks = spark.sparkContext.defaultParallelism
        level = spark.createDataFrame([(root, "[]")], "path string, lines string")
        out = None
        while True:
            found = cut_lineage(level.mapInArrow(scan, "path string, relative_path string, size long, mtime double, lines string"))
            files = found.filter("lines IS NULL").drop("lines")
            out = files if out is None else out.unionByName(files)
            level = found.filter("lines IS NOT NULL").select("path", "lines")
            if level.isEmpty():
                return out
            level = level.repartition(tasks)

    def metadata(self, spark: SparkSession, root: str) -> DataFrame:
        """(relative_path, size, mtime) without reading any content."""
        return self.listed(spark, root).drop("path")

    def discover(self, spark: SparkSession, root: str) -> DataFrame:
        """(path, relative_path, size, mtime, content_hash, content, lines) of the wanted files, read by the executors."""
        return with_content(self.listed(spark, root).repartition(spark.sparkContext.defaultParallelism))


def with_content(listed: DataFrame) -> DataFrame:
    """Files with hash, text and lines of their content; a file that can't be read any more has nulls."""

    @F.pandas_udf("struct<content_hash:string,content:string,lines:int>")
    def load(paths: pd.Series) -> pd.DataFrame:
        out = []
        for p in paths:
            try:
                with open(p, encoding="utf-8", errors="ignore", newline="") as f:
                    text = f.read()
                out.append((hashlib.sha256(text.encode()).hexdigest(), text, text.count("\n") + 1))
            except OSError:
                out.append((None, None, None))
        return pd.DataFrame(out, columns=["content_hash", "content", "lines"])

    return listed.withColumn("__c", load("path")).select(*listed.columns, "__c.content_hash", "__c.content", "__c.lines")


def binary_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, mtime, size, content_hash) of a tree on shared storage, listed and read by Spark itself."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    return files.select("path", F.unix_micros("modificationTime").cast("double").alias("mtime") / 1e6, F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"))


def change_set(indexed: DataFrame, seen: DataFrame) -> DataFrame:
    """(path, change) of `seen` against `indexed`, both (path, content_hash, mtime, size).

    added: not indexed. modified: size or mtime differs, or the indexed mtime is 0, and the hash differs.
    deleted: indexed but not seen. Touched files with equal content are no change.
    """
    old = indexed.select("path", F.col("content_hash").alias("old_hash"), F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"), F.lit(True).alias("was"))
    both = old.join(seen.withColumn("is", F.lit(True)), "path", "full")
    suspect = ~F.col("mtime").eqNullSafe(F.col("old_mtime")) | ~F.col("size").eqNullSafe(F.col("old_size")) | (F.col("old_mtime") == 0)
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(suspect & ~F.col("content_hash").eqNullSafe(F.col("old_hash")), "modified")
    return both.select("path", change.alias("change")).filter("change IS NOT NULL")


def changes_of_tree(indexed: DataFrame, root: str, discovery: Discovery) -> DataFrame:
    """change_set of a tree on disk; only new files and those whose metadata differs are read."""
    listed = discovery.listed(indexed.sparkSession, root)
    old = indexed.select(F.col("path").alias("relative_path"), F.col("mtime").alias("m"), F.col("size").alias("s"), F.col("content_hash").alias("h"))
    joined = listed.join(old, "relative_path", "left")
    suspect = F.col("h").isNull() | ~F.col("mtime").eqNullSafe(F.col("m")) | ~F.col("size").eqNullSafe(F.col("s")) | (F.col("m") == 0)
    read = with_content(joined.filter(suspect).select("path", "relative_path", "size", "mtime")).select("relative_path", "content_hash", "mtime", "size")
    same = joined.filter(~suspect).select("relative_path", F.col("h").alias("content_hash"), "mtime", "size")
    return change_set(indexed, read.unionByName(same).withColumnRenamed("relative_path", "path"))


def change_counts(changes: DataFrame) -> DataFrame:
    """(change, files)."""
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("files"))
