"""Session defaults. Every value can be overridden by the cluster's own configuration."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("archivolt")
    for key, value in (
        DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory} | conf
    ).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder; the folder may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def default_partitions(spark: SparkSession) -> int:
    return int(os.environ.get("ARCHIVOLT_PARTITIONS", spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows that a task sorts within their keys.
ROWS_PER_TASK = 1 << 20


def partitions_for(rows: DataFrame) -> int:
    """Tasks that a sort of a table's rows within keys is dealt to: more for a larger table, so that none holds more with it."""
    return max(default_partitions(rows.sparkSession), -(-rows.count() // ROWS_PER_TASK))
