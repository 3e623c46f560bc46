"""Counting every n-gram: truncated suffixes routed by first term, sorted in reverse, one stack per task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.operators.skew import HOT_ROWS, MAX_HOT

#: Separates terms inside a suffix; sorts below every printable character, so a prefix sorts next to its extensions.
SEP = "\u0001"


def _names(max_n: int) -> list[str]:
    """The columns that hold, per length of prefix, how many records a suffix counts for it."""
    return [f"r{j}" for j in range(1, max_n + 1)]


def _stack_counts(batches: Iterator[pa.RecordBatch], max_n: int) -> Iterator[pa.RecordBatch]:
    """Adds up the counts of all prefixes of the suffixes (suffix, w, r1, r2, ...), which come in descending order.

    The stack holds the terms of the current suffix, each with its count and its number of records. When
    a suffix no longer shares a term, that level is complete: it is emitted, and its count goes to the
    level below, whose prefix it extends. Records are numbers from the start, so no set is ever held.
    """
    schema = pa.schema([("gram", pa.string()), ("n", pa.int64()), ("records", pa.int64())])
    stack: list[list] = []  # term, count, records
    out: tuple[list, list, list] = ([], [], [])

    def pop() -> None:
        out[0].append(SEP.join([x[0] for x in stack]))
        _, count, records = stack.pop()
        out[1].append(count)
        out[2].append(records)
        if stack:
            stack[-1][1] += count

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)
        for x in out:
            x.clear()
        return batch

    for batch in batches:
        for suffix, n, *records in zip(*(batch.column(i).to_pylist() for i in range(2 + max_n))):
            terms = suffix.split(SEP)
            keep = 0
            while keep < min(len(stack), len(terms)) and stack[keep][0] == terms[keep]:
                keep += 1
            while len(stack) > keep:
                pop()
            stack.extend([t, 0, 0] for t in terms[keep:])
            stack[-1][1] += n
            for level, r in zip(stack, records):
                level[2] += r
        if len(out[0]) >= 50_000:
            yield flush()
    while stack:
        pop()
    yield flush()


def _suffix_batches(max_n: int):
    """Rows (counts a record, w, terms) to (head, suffix, w, r1, ...), equal suffixes of a batch added up.

    A row's record counts for a gram at the first of the row's suffixes that begins with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, list[int]] = {}
            for known, w, terms in zip(*(batch.column(i).to_pylist() for i in range(3))):
                seen: set[str] = set()
                for i in range(len(terms)):
                    grams, gram = [], ""
                    for t in terms[i : i + max_n]:
                        gram = gram + SEP + t if grams else t
                        grams.append(gram)
                    row = sums.get(gram)
                    if row is None:
                        row = sums[gram] = [0] * (1 + max_n)
                    row[0] += w
                    if known:
                        for j, g in enumerate(grams):
                            if g not in seen:
                                seen.add(g)
                                row[1 + j] += 1
            if sums:
                keys = list(sums)
                columns = [pa.array([k.partition(SEP)[0] for k in keys], pa.string()), pa.array(keys, pa.string())]
                columns += [pa.array(c, pa.int64()) for c in zip(*sums.values())]
                yield pa.RecordBatch.from_arrays(columns, names=["head", "suffix", "w", *_names(max_n)])

    return run


def _of_rows(base: DataFrame, max_n: int) -> DataFrame:
    """Suffixes of rows whose records share no gram: all that is to be known about a record is in its row."""
    if max_n == 1:  # a term is its own suffix, and the aggregate by head both combines and routes
        each = base.select(F.explode("terms").alias("head"), "w", F.col("record").isNotNull().cast("long").alias("r1"))
        return each.groupBy("head").agg(F.sum("w").alias("w"), F.sum("r1").alias("r1")).select("head", F.col("head").alias("suffix"), "w", "r1")
    ddl = "head string, suffix string, w long, " + ", ".join(f"{r} long" for r in _names(max_n))
    return base.select(F.col("record").isNotNull(), "w", "terms").mapInArrow(_suffix_batches(max_n), ddl)


def _of_records(base: DataFrame, max_n: int) -> DataFrame:
    """Suffixes of records that are spread over rows: sorted within (head, record), equal prefixes are neighbours."""
    at = base.select("record", "w", "terms", F.posexplode("terms").alias("at", "head"))
    each = at.select("record", "w", "head", F.array_join(F.slice("terms", F.col("at") + 1, F.lit(max_n)), SEP).alias("suffix"))
    own = each.groupBy("head", "record", "suffix").agg(F.sum("w").alias("w")).repartition("head", "record")
    before = F.split(F.lag("suffix").over(W.partitionBy("head", "record").orderBy("suffix")), SEP)
    terms = F.split("suffix", SEP)
    marked = own.select("head", "record", "suffix", "w", before.alias("before"), terms.alias("terms"))

    def counts(j: int):
        fresh = F.col("before").isNull() | (F.slice("before", 1, j) != F.slice("terms", 1, j))
        return (fresh & (F.size("terms") >= j) & F.col("record").isNotNull()).cast("long").alias(f"r{j}")

    return marked.select("head", "suffix", "w", *[counts(j) for j in range(1, max_n + 1)])


def ngram_frequencies(df: DataFrame, record: str, terms: str, weight: str | None = None, max_n: int = 1, hot_rows: int = HOT_ROWS, disjoint: bool = False) -> DataFrame:
    """(gram, n, records) for every n-gram of up to `max_n` terms: total weight and number of records.

    `terms` is an array of terms per row. Each position gives one suffix, cut to `max_n` terms. A suffix
    carries its weight and, per length of prefix, whether its record counts for that prefix there (each
    record does so once for a gram), so equal suffixes are added up before the shuffle whatever records
    they are of. They go to tasks by first term, are sorted there in descending order, and one pass with
    a stack counts all prefixes of all suffixes at once: each position is shuffled at most once and not
    once per n. A first term with `hot_rows` or more positions, by its measured count, is spread over as
    many tasks as it has shares of that size, by suffix; its parts add up at the end.

    `disjoint` says that no two rows of a record share a gram, such as with one row per record; otherwise
    rows of a record are first brought together by (first term, record). Null and empty arrays and null
    terms give nothing; a null weight counts as 0 and a null record counts in n but not in records. A
    gram's terms are joined by one space; the control characters U+0000 and U+0001 in a term read as U+FFFD.
    """
    w = F.lit(1) if weight is None else F.coalesce(F.col(weight), F.lit(0))
    clean = F.transform(F.filter(terms, lambda t: t.isNotNull()), lambda t: F.translate(t, "\u0000" + SEP, "\ufffd\ufffd"))
    base = df.select(F.col(record).alias("record"), w.cast("long").alias("w"), clean.alias("terms")).filter(F.size("terms") > 0)
    suffixes = _of_rows(base, max_n) if disjoint else _of_records(base, max_n)
    names = _names(max_n)
    sums = [F.sum(c).alias(c) for c in ("w", *names)]
    if max_n > 1:
        heads = base.select(F.explode("terms").alias("head")).groupBy("head").agg(F.count(F.lit(1)).alias("__n"))
        hot = heads.filter(F.col("__n") >= hot_rows).orderBy(F.desc("__n"), "head").limit(MAX_HOT)
        shares = F.coalesce(F.ceil(F.col("__n") / F.lit(hot_rows)), F.lit(1))
        routed = suffixes.join(F.broadcast(hot), "head", "left").withColumn("salt", F.pmod(F.xxhash64("suffix"), shares))
        suffixes = routed.repartition("head", "salt").groupBy("head", "salt", "suffix").agg(*sums)
    elif not disjoint:
        suffixes = suffixes.groupBy("head").agg(*sums).withColumn("suffix", F.col("head"))
    tasks = suffixes.select("suffix", "w", *names).sortWithinPartitions(F.desc("suffix"))
    part = tasks.mapInArrow(lambda batches: _stack_counts(batches, max_n), "gram string, n long, records long")
    if max_n == 1:  # each term was whole in one task
        return part.select(F.translate("gram", SEP, " ").alias("gram"), "n", "records")
    return part.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("records").alias("records")).select(F.translate("gram", SEP, " ").alias("gram"), "n", "records")
