from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false",
        "spark.executorEnv.PYTHONPATH": str(Path(__file__).resolve().parents[1]), "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    session = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Sorted plain rows of a DataFrame."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
