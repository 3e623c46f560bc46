"""Overlapping and gapped time intervals: a sweep over boundary events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: This date means an open end (fixed value).
OPEN_END = dt.date(9999, 12, 31)
#: Stands for a time before all dates, in days since 1970.
EARLIEST = -(10**7)


def periods_and_gaps(df: DataFrame, entity: str = "subject", start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """(entity, kind, first_day, last_day): the covered periods of each entity and the gaps between them.

    Both dates of an interval are included; null, or 9999-12-31 as the end, is open on that side. Intervals
    with neither date or with start after end are left out. Runs that follow each other by one day are one
    period. Days are yyyy-MM-dd, or `open`. Each interval is an event of +1 on its first day and -1 after its
    last; events are summed per entity and day before the shuffle, so an entity with any number of rows
    comes to the sweep with at most one row per calendar day, and a prefix sum of the active count gives
    the boundaries. A null entity is an entity of its own; repeated rows change nothing; an empty table
    gives an empty result.
    """
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    open_end = F.col(end).isNull() | (F.col(end).cast("date") == F.lit(OPEN_END))
    kept = df.select(F.col(entity).alias("entity"), start, end).filter(
        (F.col(start).isNotNull() | F.col(end).isNotNull()) & (F.col(start).isNull() | F.col(end).isNull() | (F.col(start) <= F.col(end)))
    )
    events = F.array(
        F.struct(F.coalesce(day(start), F.lit(EARLIEST)).alias("day"), F.lit(1).alias("delta")),
        F.when(~open_end, F.struct((day(end) + 1).alias("day"), F.lit(-1).alias("delta"))),
    )
    each = kept.select("entity", F.explode(events).alias("e")).filter("e IS NOT NULL").select("entity", "e.day", "e.delta")
    daily = each.groupBy("entity", "day").agg(F.sum("delta").alias("delta")).filter("delta <> 0")
    line = W.partitionBy("entity").orderBy("day")
    active = F.sum("delta").over(line.rowsBetween(W.unboundedPreceding, 0))
    bounds = daily.withColumn("active", active).withColumn("before", F.col("active") - F.col("delta")).filter("(active > 0) <> (before > 0)")
    spans = bounds.withColumn("next", F.lead("day").over(line)).filter("active > 0 OR next IS NOT NULL")
    text = lambda c: F.date_format(F.date_from_unix_date(c), "yyyy-MM-dd")
    return spans.select(
        F.col("entity").alias(entity),
        F.when(F.col("active") > 0, "period").otherwise("gap").alias("kind"),
        F.when(F.col("day") == EARLIEST, "open").otherwise(text(F.col("day"))).alias("first_day"),
        F.when(F.col("next").isNull(), "open").otherwise(text(F.col("next") - 1)).alias("last_day"),
    )
