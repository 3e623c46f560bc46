"""Queries of the general data-preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.intervals import periods_and_gaps
from loomspark.operators.snapshots import file_lists, snapshot_changes


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    changes = snapshot_changes(file_lists(spark.read.parquet(f"{sf}/file_snapshots.parquet")))
    return changes.select(F.col("group").alias("codebase_id"), F.col("path").alias("relative_path"), F.col("snapshot").alias("snapshot_no"), "change")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return periods_and_gaps(spark.read.parquet(f"{sf}/facts.parquet"))


QUERIES = {f.__name__: f for f in (p5_found, p7_found)}

SQL = {
    "p5_found": r"""
WITH raw AS (
  SELECT DISTINCT codebase_id, snapshot_no, regexp_replace(regexp_replace(replace(relative_path, chr(92), '/'), '/+', '/', 'g'), '^(\./)+', '') AS p,
    nullif(lower(trim(content_hash)), '') AS h, size, mtime, delivered_at FROM file_snapshots),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY codebase_id, snapshot_no, p ORDER BY delivered_at DESC NULLS LAST, h DESC NULLS LAST, size DESC NULLS LAST, mtime DESC NULLS LAST) AS k FROM raw) WHERE k = 1),
steps AS (SELECT codebase_id, snapshot_no, lag(snapshot_no) OVER (PARTITION BY codebase_id ORDER BY snapshot_no) AS earlier FROM (SELECT DISTINCT codebase_id, snapshot_no FROM raw)),
new AS (SELECT s.codebase_id, s.snapshot_no AS target, p, h, size, mtime FROM steps s JOIN last l ON s.codebase_id = l.codebase_id AND s.snapshot_no = l.snapshot_no WHERE earlier IS NOT NULL),
old AS (SELECT s.codebase_id, s.snapshot_no AS target, p, h, size, mtime FROM steps s JOIN last l ON s.codebase_id = l.codebase_id AND s.earlier = l.snapshot_no)
SELECT coalesce(n.codebase_id, o.codebase_id) AS codebase_id, coalesce(n.p, o.p) AS relative_path, coalesce(n.target, o.target) AS snapshot_no,
  CASE WHEN o.p IS NULL THEN 'added' WHEN n.p IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM new n FULL JOIN old o ON n.codebase_id = o.codebase_id AND n.target = o.target AND n.p = o.p
WHERE n.p IS NULL OR o.p IS NULL OR (n.h IS NOT NULL AND o.h IS NOT NULL AND n.h <> o.h)
  OR ((n.h IS NULL OR o.h IS NULL) AND (n.size IS DISTINCT FROM o.size OR n.mtime IS DISTINCT FROM o.mtime))
""",
    "p7_found": """
WITH kept AS (
  SELECT subject, coalesce(valid_from - DATE '1970-01-01', -10000000) AS a,
    CASE WHEN valid_to IS NULL OR valid_to = DATE '9999-12-31' THEN 10000000 ELSE valid_to - DATE '1970-01-01' END AS b
  FROM facts WHERE (valid_from IS NOT NULL OR valid_to IS NOT NULL) AND (valid_from IS NULL OR valid_to IS NULL OR valid_from <= valid_to)),
marked AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY subject ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS fresh FROM kept),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY subject ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM marked),
periods AS (SELECT subject, min(a) AS a, max(b) AS b FROM grouped GROUP BY subject, g),
spans AS (
  SELECT subject, 'period' AS kind, a, b FROM periods
  UNION ALL SELECT subject, 'gap', b + 1, n - 1 FROM (SELECT subject, b, lead(a) OVER (PARTITION BY subject ORDER BY a) AS n FROM periods) WHERE n IS NOT NULL)
SELECT subject, kind, CASE WHEN a = -10000000 THEN 'open' ELSE strftime(DATE '1970-01-01' + CAST(a AS INTEGER), '%Y-%m-%d') END AS first_day,
  CASE WHEN b = 10000000 THEN 'open' ELSE strftime(DATE '1970-01-01' + CAST(b AS INTEGER), '%Y-%m-%d') END AS last_day FROM spans
""",
}
