"""Arrow helpers of the subpackage, and the library's tables and shared storage by one name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.session import table
from archivolt.storage import discard, materialize, new_path

__all__ = ["discard", "join_by_text", "map_rows", "materialize", "merged_stretches", "new_path", "table", "text_groups", "unused", "version"]


def map_rows(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 256) -> DataFrame:
    """mapInArrow with each batch cut to at most ``rows`` rows, so that memory follows the texts in one slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = function(batch.slice(start, rows))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def text_groups(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges [start, end) of consecutive texts of about ``size`` bytes together; a longer text stands alone."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > size:
            yield start, i
            start, total = i, 0
        total += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def unused(name: str, df: DataFrame) -> str:
    """The name, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def version(text: Column) -> Column:
    """A hash of the text, which tells rows that share a doc_id apart."""
    return F.xxhash64(text.cast("string"))


def join_by_text(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``docs`` joined to a table that has one row for some pairs of doc_id (null included) and version of the text.

    Its other columns must have names that ``docs`` lacks.
    """
    key, text = unused("key_", docs), unused("version_", docs)
    right = found.withColumnsRenamed({"doc_id": key, "version": text})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (version(F.col("text")) == F.col(text))
    return docs.join(right, same, how).drop(key, text)


def merged_stretches(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint stretches [start, end) that cover the same places for each value of the keys; one shuffle by the keys."""
    own = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    return (
        stretches.select(*keys, "start", "end")
        .withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
        .withColumn("stretch", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "stretch")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("stretch")
    )
