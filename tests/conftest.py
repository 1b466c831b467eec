import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from gramwright.session import SETTINGS
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    settings = SETTINGS | {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": f"file://{base}/warehouse", "spark.checkpoint.dir": f"file://{base}/checkpoint", "spark.driver.memory": "6g"}
    s = SparkSession.builder.master("local[4]").config(map=settings).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
