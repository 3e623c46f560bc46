import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loomspark.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    s = build_session(
        "tests", "local[4]", **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": str(shared),
            "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1",
        }
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
