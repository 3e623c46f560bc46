"""Bounded breadth-first search over the entities that facts link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.config import DEFAULTS
from loomspark.session import cut_lineage


def connections(adjacent: DataFrame, source: str, target: str | None = None, source_type: str | None = None, target_type: str | None = None, max_depth: int = 3, limit: int = 10, visited_cap: int | None = DEFAULTS.graph_visited) -> DataFrame:
    """(path_no, depth, path, entity, type): paths of facts from an entity, shortest first.

    With a target: one path for every link that reaches it from an entity the search visits. Without: one
    path to each entity that can be reached, the source excluded. Depth is 1 to 10. Level by level, the
    links of all entities of a level are found by one join; an entity belongs to the first that discovers
    it, by (rank of the parent, fact id), so the order is that of a queue. No fact repeats in a path. The
    search ends at `limit` paths, at the depth, without new entities, or beyond `visited_cap` visited ones;
    so a level has at most that many entities, and may be broadcast. With None there is no such end, and
    levels of any size are joined without a hint.
    """
    spark = adjacent.sparkSession
    max_depth = min(max(1, max_depth), DEFAULTS.graph_depth)
    key = ["entity_name", "entity_type"]
    start = adjacent.filter(F.col("entity_name") == source.lower())
    if source_type:
        start = start.filter(F.col("entity_type") == source_type.lower())
    rank = F.row_number().over(W.orderBy("parent", "fact_id", *key))
    frontier = start.select(*key).distinct().orderBy(*key)
    frontier = (frontier if visited_cap is None else frontier.limit(visited_cap + 1)).select(*key, F.array().cast("array<string>").alias("path"), F.row_number().over(W.orderBy(*key)).alias("rank"))
    frontier = cut_lineage(frontier)
    visited = frontier.select(*key)
    seen, found, paths = frontier.count(), 0, None
    hinted = F.broadcast if visited_cap is not None else lambda df: df
    other = adjacent.select("fact_id", "role", F.col("entity_name").alias("name"), F.col("entity_type").alias("type"))
    for depth in range(1, max_depth + 1):
        if visited_cap is not None and seen > visited_cap or found >= limit:
            break
        mine = adjacent.join(hinted(frontier), key).groupBy(*key, "fact_id").agg(F.min("role").alias("own"), F.first("path").alias("path"), F.first("rank").alias("parent"))
        mine = mine.filter(~F.array_contains("path", F.col("fact_id")))
        steps = mine.join(other, (mine["fact_id"] == other["fact_id"]) & (mine["own"] != other["role"])).select(
            F.col("name").alias("entity_name"), F.col("type").alias("entity_type"), mine["fact_id"], "parent", F.array_append("path", mine["fact_id"]).alias("path")
        )
        steps = cut_lineage(steps) if target else steps
        first = steps.groupBy(*key).agg(F.min_by(F.struct("parent", "fact_id", "path"), F.struct("parent", "fact_id")).alias("f")).select(*key, "f.parent", "f.fact_id", "f.path")
        new = first.join(hinted(visited), key, "left_anti")
        new = new if visited_cap is None else new.orderBy("parent", "fact_id").limit(visited_cap + 1)
        new = cut_lineage(new.select(*key, "path", rank.alias("rank")))
        if target:
            hit = steps.filter(F.col("entity_name") == target.lower())
            hit = hit.filter(F.col("entity_type") == target_type.lower()) if target_type else hit
            out = hit.orderBy("parent", "fact_id").limit(limit).select("path", *key, rank.alias("rank"))
        else:
            out = new.orderBy("rank").limit(limit).select("path", *key, "rank")
        out = cut_lineage(out.withColumn("depth", F.lit(depth)))
        found += out.count()
        paths = out if paths is None else paths.unionByName(out)
        frontier, added = new, new.count()
        if not added:
            break
        seen += added
        visited = visited.unionByName(new.select(*key))
    if paths is None:
        return spark.createDataFrame([], "path_no int, depth int, path array<string>, entity string, type string")
    numbered = paths.withColumn("path_no", F.row_number().over(W.orderBy("depth", "rank"))).filter(F.col("path_no") <= limit)
    return numbered.select("path_no", "depth", "path", F.col("entity_name").alias("entity"), F.col("entity_type").alias("type"))


def distances(adjacent: DataFrame, source: str, max_depth: int = 3) -> DataFrame:
    """(entity, type, depth) of every entity within `max_depth` facts of an entity, the source excluded.

    Level by level like `connections`, but without paths and without a cap: a level is a join and an
    anti-join on the entity, of any size, and nothing is broadcast by hand. Depth is 1 to 10.
    """
    max_depth = min(max(1, max_depth), DEFAULTS.graph_depth)
    key = ["entity_name", "entity_type"]
    other = adjacent.select("fact_id", "role", F.col("entity_name").alias("name"), F.col("entity_type").alias("type"))
    frontier = cut_lineage(adjacent.filter(F.col("entity_name") == source.lower()).select(*key).distinct())
    levels = frontier.withColumn("depth", F.lit(0).cast("long"))
    for depth in range(1, max_depth + 1):
        mine = adjacent.join(frontier, key, "left_semi").select("fact_id", F.col("role").alias("own"))
        steps = mine.join(other, "fact_id").filter("own <> role").select(F.col("name").alias("entity_name"), F.col("type").alias("entity_type")).distinct()
        frontier = cut_lineage(steps.join(levels.select(*key), key, "left_anti"))
        if frontier.isEmpty():
            break
        levels = levels.unionByName(frontier.withColumn("depth", F.lit(depth).cast("long")))
    nearest = levels.groupBy(*key).agg(F.min("depth").alias("depth")).filter("depth > 0")
    return nearest.select(F.col("entity_name").alias("entity"), F.col("entity_type").alias("type"), "depth")
