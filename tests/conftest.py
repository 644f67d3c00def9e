from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("archipelago-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        # Plans here are many and tiny: compiling them takes longer than interpreting them.
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hot_nodes(spark):
    """Treat every key with more than three rows as hot."""
    spark.conf.set("spark.archipelago.hot.rows", "3")
    yield
    spark.conf.unset("spark.archipelago.hot.rows")


@pytest.fixture
def edges_of(spark):
    def build(edges):
        return spark.createDataFrame(list(edges), "src bigint, dst bigint")

    return build
