"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set a session on one machine gets a temporary one; on a cluster,
    whose machines would not see each other's files, that is an error."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="archivolt-"))
    return context.getCheckpointDir().rstrip("/")


#: Paths handed out inside of ``scratch`` blocks, the innermost last.
_open: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/archivolt/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in any store."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end: what is to stay is written to a path taken before."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``materialize`` wrote and that nothing reads any more."""
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        remove(df.sparkSession, folder)
