"""Session helpers: building a session, and the shared folder for checkpoints."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession


T = TypeVar("T")


def build_session(app: str = "loomspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is written for; `conf` overrides them."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local master may go without the setting; then a temporary folder of this machine serves,
    since driver and executors are one process. On a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    own = tempfile.mkdtemp(prefix="loomspark-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of the session, once per session.

    Executors get it as an archive from the driver, so they need neither a copy nor a search path.
    """
    sc = spark.sparkContext
    if getattr(sc, "_loomspark_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="loomspark-"), "loomspark_package")
    sc.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(here), os.path.basename(here)))
    sc._loomspark_shipped = True


def spread(scan: DataFrame) -> DataFrame:
    """A scan of files with at least one partition per core; one that has them is left as it is.

    Only for plain scans before costly work per row: a small table in one file would be one task. The
    partitions of a scan are known from its files, so nothing runs to count them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def in_time(spark: SparkSession, operation: str, seconds: float, run: Callable[[], T]) -> T:
    """What `run` gives, or a TimeoutError that names the operation; its jobs are cancelled when the time is up."""
    sc = spark.sparkContext
    tag = f"loomspark-{uuid.uuid4().hex}"
    over = threading.Event()

    def stop() -> None:
        over.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        return run()
    except Exception as e:
        if over.is_set():
            raise TimeoutError(f"{operation} took more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read from there: reliable, so a lost executor costs nothing."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
