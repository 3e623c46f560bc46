"""What changed between full snapshots: Merkle digests over hash ranges, rows compared in differing ranges only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows that a leaf range holds on average in the largest snapshot.
LEAF_ROWS = 64
#: Each level of the tree splits a range in so many (as a power of two).
FAN_BITS = 4
#: No tree is deeper than this.
MOST_LEVELS = 6

KEY = ["group", "snapshot"]


def normal_path(path: Column | str) -> Column:
    """A path with `/` as its separator, without doubled separators and without a leading `./`."""
    slashes = F.regexp_replace(F.translate(path, "\\", "/"), "/{2,}", "/")
    return F.regexp_replace(slashes, r"^(\./)+", "")


def file_lists(df: DataFrame) -> DataFrame:
    """(group, snapshot, path, at, hash, size, mtime) from delivered file lists.

    Hashes are compared in lower case and kept as bytes; an empty hash is a missing one. Rows without
    group, snapshot or path are left out.
    """
    known = F.nullif(F.lower(F.trim("content_hash")), F.lit(""))
    packed = F.coalesce(F.concat(F.unhex(F.lit("00")), F.unhex(known)), F.concat(F.unhex(F.lit("01")), F.encode(known, "UTF-8")))
    rows = df.select(F.col("codebase_id").alias("group"), F.col("snapshot_no").alias("snapshot"), normal_path("relative_path").alias("path"), F.col("delivered_at").alias("at"), packed.alias("hash"), "size", "mtime")
    return rows.filter("group IS NOT NULL AND snapshot IS NOT NULL AND path IS NOT NULL")


def _digests(states: DataFrame) -> DataFrame:
    """(group, snapshot, leaf, a, b, n): two digests of the rows of each leaf range, and their number.

    A digest is the exclusive or of the rows' 64-bit hashes. Paths are unique in a snapshot, so equal rows
    never cancel out; digests of any number of rows combine in any order and never overflow. The hash
    function skips nulls, so each value goes in with a mark of whether it is one.
    """
    marked = [c for name in ("hash", "size", "mtime") for c in (F.col(name).isNull(), F.col(name))]
    row = F.xxhash64("path", *marked)
    other = F.xxhash64(F.lit(31), *reversed(marked), "path")
    return states.groupBy(*KEY, "leaf").agg(F.bit_xor(row).alias("a"), F.bit_xor(other).alias("b"), F.count(F.lit(1)).alias("n"))


def _combined(nodes: DataFrame, level: str) -> DataFrame:
    """The digests of the nodes of a level from those below them."""
    return nodes.groupBy(*KEY, level).agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("n").alias("n"))


def _leaf(bits: int) -> Column:
    """The range of a path's hash: its first `bits` bits."""
    return F.shiftrightunsigned(F.xxhash64("path"), 64 - bits).cast("int") if bits else F.lit(0)


def _steps(digests: DataFrame) -> DataFrame:
    """(group, snapshot, match, sign): each delivered snapshot with itself (+1) and the one delivered before (-1)."""
    delivered = digests.select(*KEY).distinct()
    earlier = F.lag("snapshot").over(W.partitionBy("group").orderBy("snapshot"))
    pairs = delivered.withColumn("earlier", earlier).filter("earlier IS NOT NULL")
    sides = F.array(F.struct(F.col("snapshot").alias("match"), F.lit(1).alias("sign")), F.struct(F.col("earlier").alias("match"), F.lit(-1).alias("sign")))
    return pairs.select(*KEY, F.explode(sides).alias("side")).select(*KEY, "side.match", "side.sign")


def _differing(steps: DataFrame, digests: DataFrame, bits: int) -> DataFrame:
    """(group, snapshot, leaf): the leaf ranges whose digests differ between a snapshot and the one before.

    Top-down: the roots of all pairs are compared, then the children of differing nodes only. A node's
    digest combines its children's; combined over both snapshots it is 0 where they are alike.
    """
    at = steps.withColumnRenamed("snapshot", "target").withColumnRenamed("match", "snapshot")
    own = digests.join(at, KEY).select("group", F.col("target").alias("snapshot"), "leaf", "a", "b", (F.col("n") * F.col("sign")).alias("n"))
    leaves = _combined(own, "leaf")
    nodes, depth = None, 0
    for level in [*range(0, bits, 2 * FAN_BITS), bits]:
        tree = leaves.withColumn("node", F.shiftright("leaf", bits - level))
        if nodes is not None:
            above = nodes.withColumnRenamed("node", "above")
            tree = tree.withColumn("above", F.shiftright("node", level - depth)).join(above, [*KEY, "above"], "left_semi")
        nodes = _combined(tree, "node").filter("a <> 0 OR b <> 0 OR n <> 0").select(*KEY, "node")
        depth = level
    return nodes.withColumnRenamed("node", "leaf")


def snapshot_changes(lists: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(group, path, snapshot, change): what was added, removed or changed since the group's snapshot before.

    `lists` is as of file_lists. Of several rows of a file in a snapshot the latest delivery counts; of
    deliveries of the same time the largest values, so the choice is repeatable. A group without any row
    in a snapshot wasn't delivered then; its first snapshot gives nothing. Changed: both hashes are known
    and differ, or one is missing and size or mtime differs (null differs from any value). Each (group,
    snapshot) has a Merkle tree over ranges of the paths' hashes, as deep as the largest of them needs.
    Rows are shuffled once, by group, snapshot and leaf range, which spreads a large group and serves
    de-duplication, digests and the comparison alike; beyond that only digests move, and the rows of
    differing ranges. An empty table gives an empty result.
    """
    largest = lists.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    levels = 0
    while levels < MOST_LEVELS and leaf_rows << (FAN_BITS * levels) < largest:
        levels += 1
    bits = FAN_BITS * levels
    routed = lists.withColumn("leaf", _leaf(bits)).repartition(*KEY, "leaf")
    last = routed.groupBy(*KEY, "leaf", "path").agg(F.max(F.struct("at", "hash", "size", "mtime")).alias("s"))
    states = last.select(*KEY, "leaf", "path", "s.hash", "s.size", "s.mtime")
    digests = _digests(states)
    steps = _steps(digests)
    leaves = _differing(steps, digests, bits)
    wanted = leaves.join(steps, KEY).select("group", F.col("match").alias("snapshot"), "leaf", F.col("snapshot").alias("target"), "sign")
    rows = states.join(wanted, [*KEY, "leaf"])
    state = F.struct("hash", "size", "mtime")
    both = rows.groupBy("group", "target", "path").agg(F.max(F.when(F.col("sign") == 1, state)).alias("new"), F.max(F.when(F.col("sign") == -1, state)).alias("old"))
    same = F.when(F.col("new.hash").isNotNull() & F.col("old.hash").isNotNull(), F.col("new.hash") == F.col("old.hash")).otherwise(
        F.col("new.size").eqNullSafe(F.col("old.size")) & F.col("new.mtime").eqNullSafe(F.col("old.mtime"))
    )
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~same, "changed")
    return both.select("group", "path", F.col("target").alias("snapshot"), change.alias("change")).filter("change IS NOT NULL")
