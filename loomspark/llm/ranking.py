"""One ranking from several differently-scaled scores, by closeness to an ideal point."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.operators.skew import HOT_ROWS, attach_by_key
from loomspark.session import cut_lineage

#: The scorers of the search results, and their weights when the caller names none.
SCORERS = ("dense", "sparse", "lexical", "rerank")
#: Closeness is ranked within this many ranges of a query, so that no query is sorted in one task.
RANGES = 1024
#: Closeness and its floors are compared with this much room for rounding.
SLACK = 1e-6


def current_scores(df: DataFrame, scorers: tuple[str, ...] = SCORERS) -> DataFrame:
    """(query_id, point_id, one column per scorer): each scorer's score with the latest time, else null.

    Null and non-finite scores are no scores, also where they supersede one. Of two scores with the same
    time the larger one counts. Rows of other scorers are left out, points without any score stay; rows
    with a null query or point form groups of their own.
    """
    score = F.when(F.isnan("score") | (F.abs("score") == float("inf")), F.lit(None)).otherwise(F.col("score"))
    last = [F.max(F.when(F.col("scorer") == s, F.struct("scored_at", score.alias("score")))).alias(s) for s in scorers]
    own = df.select("query_id", "point_id", "scorer", "scored_at", "score").filter(F.col("scorer").isin(*scorers))
    return own.groupBy("query_id", "point_id").agg(*last).select("query_id", "point_id", *[F.col(f"{s}.score").alias(s) for s in scorers])


def ideal_point_closeness(
    points: DataFrame, scorers: tuple[str, ...] = SCORERS, weights: tuple[float, ...] | None = None, tail: float = 0.05, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """`points` with `closeness` (0 to 1, nine decimals), `floor` and `points_n`, the size of the query.

    Per query, each scorer's scores are winsorised to their `tail` and 1 - `tail` quantiles and divided by
    their Euclidean norm, so no range rules. A missing score counts as the worst one. closeness is
    d_worst / (d_worst + d_best) for the weighted distances to the best and the worst value of each scorer;
    where all points are alike it is 0.5. floor is the least closeness of any point that is at least as
    good as this one in all scorers but one. Quantiles are approximate with relative rank error 1e-4: exact up
    to 10,000 points a query.
    """
    weights = weights or tuple(1.0 for _ in scorers)
    ends = [F.percentile_approx(s, F.array(F.lit(tail), F.lit(1 - tail)), 10_000).alias(f"__q_{s}") for s in scorers]
    sized = points.withColumn("__k", F.coalesce(F.col("query_id").cast("string"), F.lit("")))
    limits = sized.groupBy("__k").agg(F.count(F.lit(1)).alias("points_n"), *ends)
    rows = attach_by_key(sized, limits, ["__k"], "points_n", ["point_id"], hot_rows=hot_rows)
    clipped = rows.withColumns({f"__w_{s}": F.greatest(F.element_at(f"__q_{s}", 1), F.least(F.element_at(f"__q_{s}", 2), F.coalesce(s, F.element_at(f"__q_{s}", 1)))) for s in scorers})
    norms = clipped.groupBy("__k").agg(F.count(F.lit(1)).alias("__n"), *[F.sqrt(F.sum(F.pow(f"__w_{s}", F.lit(2.0)))).alias(f"__norm_{s}") for s in scorers])
    rows = attach_by_key(clipped, norms, ["__k"], "__n", ["point_id"], hot_rows=hot_rows)

    def parts(of) -> list[Column]:
        scaled = lambda s: F.coalesce(F.pow(F.lit(weights[scorers.index(s)]) * of(s) / F.nullif(F.col(f"__norm_{s}"), F.lit(0.0)), F.lit(2.0)), F.lit(0.0))
        return [scaled(s) for s in scorers]

    def share(far: Column, near: Column) -> Column:
        far, near = F.sqrt(F.greatest(far, F.lit(0.0))), F.sqrt(near)
        return far / F.nullif(far + near, F.lit(0.0))

    low, high = (lambda s: F.element_at(f"__q_{s}", 1)), (lambda s: F.element_at(f"__q_{s}", 2))
    names = [(f"__near_{s}", f"__far_{s}", f"__all_{s}") for s in scorers]
    measured = zip(parts(lambda s: high(s) - F.col(f"__w_{s}")), parts(lambda s: F.col(f"__w_{s}") - low(s)), parts(lambda s: high(s) - low(s)))
    rows = rows.withColumns({n: c for three, columns in zip(names, measured) for n, c in zip(three, columns)})
    near, far = (reduce(Column.__add__, [F.col(three[i]) for three in names]) for i in (0, 1))
    closeness = F.round(F.coalesce(share(far, near), F.lit(0.5)), 9)
    # As good in all scorers but one, and there the worst.
    floors = [F.coalesce(share(far - F.col(f), near - F.col(n) + F.col(a)), F.lit(0.0)) for n, f, a in names]
    return rows.withColumns({"closeness": closeness, "floor": F.least(*floors) if len(floors) > 1 else floors[0]}).select(*points.columns, "points_n", "closeness", "floor")


def ranked(scored: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """`scored` with `rank`: 1 plus the number of points of the query with a larger closeness.

    Points of equal closeness share a rank. Counts per distinct closeness are summed within one of 1,024
    ranges and the ranges' totals are summed per query, so neither a large query nor a large tie is ever
    sorted in one task.
    """
    own = scored.withColumn("__k", F.coalesce(F.col("query_id").cast("string"), F.lit("")))
    values = own.groupBy("__k", "closeness").agg(F.count(F.lit(1)).alias("__n")).withColumn("__r", F.floor((1 - F.col("closeness")) * RANGES).cast("int"))
    upto = F.sum("__t").over(W.partitionBy("__k").orderBy("__r").rowsBetween(W.unboundedPreceding, -1))
    ranges = values.groupBy("__k", "__r").agg(F.sum("__n").alias("__t")).withColumn("__range", F.coalesce(upto, F.lit(0))).drop("__t")
    within = F.sum("__n").over(W.partitionBy("__k", "__r").orderBy(F.desc("closeness")).rowsBetween(W.unboundedPreceding, -1))
    before = values.withColumn("__within", F.coalesce(within, F.lit(0))).join(ranges, ["__k", "__r"])
    before = before.select("__k", "closeness", "__n", (F.col("__range") + F.col("__within")).alias("__before"))
    placed = attach_by_key(own, before, ["__k", "closeness"], "__n", ["point_id"], hot_rows=hot_rows)
    return placed.withColumn("rank", F.col("__before") + 1).select(*scored.columns, "rank")


def _ahead(points: DataFrame, k: int) -> DataFrame:
    """(query_id, scorer, value, n, a0, a1, ...) for every value that a scorer gave in a query.

    n points have the value, and a_j is the largest score of scorer j among the points of the query with a
    strictly larger value of this scorer (null: none). Points of one value are combined first. The values
    are sorted over range partitions, so neither a large query nor a tie is one task; what a partition
    needs to know of those before it is one row of maxima per query and scorer in it.
    """
    best = [f"m{j}" for j in range(k)]
    sides = F.array(*[F.struct(F.lit(i).alias("scorer"), F.col(f"s{i}").alias("value")) for i in range(k)])
    each = points.select("query_id", *[F.col(f"s{j}").alias(f"m{j}") for j in range(k)], F.explode(sides).alias("side"))
    values = each.groupBy("query_id", "side.scorer", "side.value").agg(F.count(F.lit(1)).alias("n"), *[F.max(m).alias(m) for m in best])
    order = ["query_id", "scorer", F.desc("value")]
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(values.repartitionByRange(max(1, parts), *order).withColumn("part", F.spark_partition_id()))
    key = ["part", "query_id", "scorer"]
    above = W.partitionBy(*key).orderBy(F.desc("value")).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy("query_id", "scorer").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = ranged.groupBy(*key).agg(*[F.max(m).alias(m) for m in best]).select(*key, *[F.max(m).over(earlier).alias(f"c{m}") for m in best])
    within = ranged.select(*key, "value", "n", *[F.max(m).over(above).alias(m) for m in best])
    return within.join(carried, key).select("query_id", "scorer", "value", "n", *[F.greatest(m, f"c{m}").alias(f"a{j}") for j, m in enumerate(best)])


def clear_leaders(ranking: DataFrame, scorers: tuple[str, ...] = SCORERS, least: int = 3, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The points with `least` or more scores that no other point of the query beats in two scorers.

    A score beats a lower one and a missing one. `ranking` is as of ideal_point_closeness, with the same
    scorers. Only points near enough to the ideal can lead: whatever point q is taken, a leader is at least
    as good as q in all scorers but one, so its closeness is no less than the floor of q, and the points
    below the highest floor of their query are out. Those left are checked exactly by sweeps over the
    values of each scorer (see _ahead). No pairs of points are formed. The ranking is written to the shared
    folder once, since floors, candidates and sweeps all read it. Rows without a query or point are
    left out, repeated points are judged each but don't beat themselves.
    """
    k = len(scorers)
    score = [F.coalesce(F.col(s).cast("double"), F.lit(float("-inf"))).alias(f"s{i}") for i, s in enumerate(scorers)]
    own = ranking.filter("query_id IS NOT NULL AND point_id IS NOT NULL").select("query_id", "point_id", "closeness", "floor", *score)
    own = cut_lineage(own)
    floors = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("__n"), F.max("floor").alias("__floor"))
    given = sum([(F.col(f"s{i}") > float("-inf")).cast("int") for i in range(1, k)], (F.col("s0") > float("-inf")).cast("int"))
    near = attach_by_key(own.filter(given >= least), floors, ["query_id"], "__n", ["point_id"], hot_rows=hot_rows)
    near = near.filter(F.col("closeness") >= F.col("__floor") - SLACK)
    sides = F.array(*[F.struct(F.lit(i).alias("scorer"), F.col(f"s{i}").alias("value")) for i in range(k)])
    asked = near.select("query_id", "point_id", *[f"s{j}" for j in range(k)], F.explode(sides).alias("side"))
    asked = asked.select("query_id", "point_id", "side.scorer", "side.value", *[f"s{j}" for j in range(k)])
    met = attach_by_key(asked, _ahead(own, k), ["query_id", "scorer", "value"], "n", ["point_id"], hot_rows=hot_rows)
    lost = [F.coalesce(F.col(f"a{j}") > F.col(f"s{j}"), F.lit(False)) & (F.col("scorer") != j) for j in range(k)]
    beaten = lost[0]
    for c in lost[1:]:
        beaten = beaten | c
    return met.groupBy("query_id", "point_id").agg(F.bool_or(beaten).alias("beaten")).filter("NOT beaten").select("query_id", "point_id")
