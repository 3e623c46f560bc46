"""How characteristic a term is of a record: pointwise mutual information from joint and marginal counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.usable import usable_counts
from loomspark.operators.skew import attach_by_key

#: Up to so many record sizes (a key and a number each) are broadcast.
SMALL = 100_000


def latest_sizes(df: DataFrame, record: str = "codebase_id", size: str = "doc_count", at: str = "last_updated") -> DataFrame:
    """(record, size): the size with the latest time of each record; of a tie the larger one.

    Records whose latest size is null or not positive have no size and are left out.
    """
    last = F.max(F.struct(F.col(at).alias("at"), F.col(size).alias("size")))
    return df.groupBy(F.col(record).alias("record")).agg(last.alias("last")).select("record", F.col("last.size").alias("size")).filter("record IS NOT NULL AND size > 0")


def distinctive_terms(counts: DataFrame, sizes: DataFrame, smoothing: float = 0.75, small: int = SMALL) -> DataFrame:
    """(record, term, n, size, term_n, total, score, ppmi, shift, pmi) for every term of every record that has a size.

    The joint count is n, the records of `sizes` give the context counts, term_n the term's marginal and
    total the sum of all sizes. score is log2(n / term_n * total / size) with the record's share taken from
    size ** smoothing instead of size, which keeps small records from getting every high score; ppmi is
    that cut at 0, and pmi = score - shift is the information without smoothing. Terms and records of any
    frequency are kept; a record without a size is left out, repeated rows of `counts` are not expected.
    Group-bys and joins only: up to `small` sizes are broadcast, after they were counted; more of them, and
    the terms in any case, are attached by key with the hottest keys spread.
    """
    facts = sizes.agg(F.sum("size").alias("total"), F.sum(F.pow("size", F.lit(smoothing))).alias("smooth"), F.count(F.lit(1)).alias("records")).first()
    total, smooth = facts["total"] or 0, facts["smooth"] or 0.0
    if facts["records"] <= small:
        pairs = counts.join(F.broadcast(sizes), "record")
    else:
        per_record = counts.groupBy("record").agg(F.count(F.lit(1)).alias("terms")).join(sizes, "record")
        pairs = attach_by_key(counts, per_record, ["record"], "terms", ["term"]).drop("terms")
    per_term = pairs.groupBy("term").agg(F.sum("n").alias("term_n"), F.count(F.lit(1)).alias("records"))
    pairs = attach_by_key(pairs, per_term, ["term"], "records", ["record"]).drop("records")
    share = F.col("n").cast("double") / F.col("term_n")
    score = F.log2(share * F.lit(float(smooth)) / F.pow("size", F.lit(smoothing)))
    shift = F.log2(F.lit(float(smooth)) / F.lit(float(total)) * F.pow("size", F.lit(1 - smoothing)))
    scored = pairs.withColumns({"total": F.lit(total).cast("long"), "score": score, "shift": shift})
    return scored.withColumns({"ppmi": F.greatest(F.lit(0.0), "score"), "pmi": F.col("score") - F.col("shift")})


def clearly_distinctive(scored: DataFrame, least_n: int = 10, times: int = 8) -> DataFrame:
    """Rows of distinctive_terms with n of at least `least_n` whose score reaches that of a lift of `times`.

    A lift is a score once the record's shift is added; since scores are rounded numbers, those within
    a billionth of the border are decided in whole numbers.
    """
    above = F.col("score") - F.col("shift") - F.log2(F.lit(float(times)))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    exact = wide("n") * wide("total") >= wide("term_n") * wide("size") * F.lit(times).cast("decimal(4,0)")
    return scored.filter((F.col("n") >= least_n) & F.when(F.abs(above) > 1e-9, above > 0).otherwise(exact))


def distinctive_of(contributions: DataFrame, doc_counts: DataFrame, smoothing: float = 0.75) -> DataFrame:
    """distinctive_terms over the raw contribution and count tables."""
    counts = usable_counts(contributions).filter("record IS NOT NULL")
    return distinctive_terms(counts, latest_sizes(doc_counts), smoothing)
