"""What holds for the sources as a whole, and the session helpers."""

import os
import re

from loomspark.session import cut_lineage, shared_dir, ship_package, spread

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def sources(*parts):
    for here, _, files in os.walk(os.path.join(ROOT, *parts)):
        for f in files:
            if f.endswith(".py"):
                path = os.path.join(here, f)
                with open(path, encoding="utf-8") as text:
                    yield os.path.relpath(path, ROOT), text.read()


def test_core_does_not_know_the_subpackage():
    for path, text in sources("loomspark"):
        if not path.startswith(os.path.join("loomspark", "llm")):
            assert "loomspark.llm" not in text, path


def test_forbidden_calls():
    for path, text in sources("loomspark"):
        assert not re.search(r"localCheckpoint|crossJoin|\.toPandas\(", text), path


def test_session(spark, tmp_path):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    df = spark.range(10)
    assert cut_lineage(df).count() == 10
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert spread(one).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and spread(one).count() == 10
    ship_package(spark)
    ship_package(spark)

    def _imports(batches):
        import loomspark.config  # noqa: F401

        yield from batches

    assert spark.range(3).mapInArrow(_imports, "id long").count() == 3

