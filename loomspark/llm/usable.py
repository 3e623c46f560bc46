"""The usable term counts that the frequency and distinctiveness operators start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_counts(df: DataFrame, record: str = "codebase_id", term: str = "token", count: str = "doc_freq") -> DataFrame:
    """(record, term, count) summed over the distinct rows with a non-null term and a count above 0.

    Repeated rows count once; spellings that differ in letter case or in spaces and tabs around the term
    are one term, whose counts add up. A null record is kept as a record of its own here.
    """
    return (
        df.select(F.col(record).alias("record"), F.col(term).alias("term"), F.col(count).alias("n"))
        .filter(F.col("term").isNotNull() & (F.col("n") > 0))
        .distinct()
        .withColumn("term", F.lower(F.trim(F.col("term"), F.lit(" \t"))))
        .groupBy("record", "term")
        .agg(F.sum("n").alias("n"))
    )
