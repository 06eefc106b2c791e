"""An index of files that is brought up to date run by run: only changed files are read, moved ones keep their history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.functions.values import filename_dates, filename_timestamps
from archivolt.operators.states import overwrite_partitions
from archivolt.operators.upsert import moved_rows
from archivolt.sources import files, media
from archivolt.storage import materialize, remove

_SEEN = ["path", "byte_size", "mtime"]
_FACTS = "path string, byte_size long, mtime long, sha256 string, captured string, capture_source string, width int, height int"
_INDEX = f"{_FACTS}, first_run int, shard int"
_RUNS = "run int, scanned long, read long, skipped long, moved long, pruned long, files long"
#: Files whose paths the driver holds for one read.
BATCH = 5000


def _there(spark: SparkSession, path: str) -> bool:
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()).exists(held)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _there(spark, path) else spark.createDataFrame([], schema)


def indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of an index; none before its first run."""
    return _table(spark, f"{folder}/files", _INDEX)


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger: a row of counters for each run that came to its end."""
    return _table(spark, f"{folder}/runs", _RUNS)


def _relative(root: str) -> Column:
    return F.regexp_replace("path", r"^[a-z]+:/*" + root.split(":")[-1].strip("/").replace(".", r"\.") + "/", "")


def _facts(contents: DataFrame, root: str) -> DataFrame:
    """What is read of a file: hash, size of the picture, and the first of the dates in it, in its name, and of the file."""
    name = F.element_at(F.split("path", "/"), -1)
    dates = media.exif_dates("content")
    exif = F.coalesce(dates["original"], dates["digitized"])
    named = F.coalesce(F.get(filename_timestamps(name), F.lit(0)).cast("string"), F.get(filename_dates(name), F.lit(0)).cast("string"))
    source = F.when(exif.isNotNull(), "exif").when(named.isNotNull(), "filename").otherwise("filesystem")
    size = media.dimensions("content")
    return contents.select(
        _relative(root).alias("path"),
        F.col("length").alias("byte_size"),
        F.unix_micros("modificationTime").alias("mtime"),
        F.sha2("content", 256).alias("sha256"),
        F.coalesce(exif, named, F.col("modificationTime").cast("string")).alias("captured"),
        source.alias("capture_source"),
        size["width"].alias("width"),
        size["height"].alias("height"),
    )


def index_files(spark: SparkSession, root: str, folder: str, extensions: list[str] | None = None, shards: int = 16, batch: int = BATCH) -> DataFrame:
    """One run: bring the index below ``folder`` up to date with the files below ``root``; returns its row of the ledger.

    A file is fresh if path, size and time are those of the index; all others are read, at most ``batch`` at a time, and
    what was read is kept, so that a run that was stopped goes on where it was. A new path with the content of a path that
    is gone is a move: the row keeps the run that it came with. Other paths that are gone are pruned. Only shards (by hash
    of the path) that hold such rows are written again. Files whose content cannot be told keep nulls.
    """
    waiting = f"{folder}/waiting"
    scanned = files.listing(spark, root, extensions).withColumns({"full": F.col("path"), "byte_size": F.col("length"), "mtime": F.unix_micros("modificationTime")})
    with files.few_tasks(spark):
        scan = materialize(scanned.withColumn("path", _relative(root)).select(*_SEEN, "full"), "scan")
    before = materialize(indexed(spark, folder), "index")
    stale = scan.join(before.select(*_SEEN), _SEEN, "left_anti").join(_table(spark, waiting, _FACTS).select(*_SEEN), _SEEN, "left_anti")
    stale = materialize(stale.select("full"), "stale")
    n = stale.count()
    parts = max(1, -(-n // batch))
    for k in range(parts if n else 0):
        paths = [r.full for r in stale.filter(F.pmod(F.xxhash64("full"), F.lit(parts)) == k).collect()]
        if paths:
            with files.few_tasks(spark):
                _facts(spark.read.format("binaryFile").load(paths), root).write.mode("append").parquet(waiting)
    fresh = materialize(_table(spark, waiting, _FACTS).join(scan.select(*_SEEN), _SEEN, "left_semi").dropDuplicates(["path"]), "fresh")

    content = ["sha256", "byte_size"]
    seen = scan.select("path", "byte_size").join(fresh.select("path", "sha256"), "path", "left")
    moves = materialize(moved_rows(before.select("path", *content), seen, "path", content), "moves")
    gone = materialize(before.join(scan.select("path"), "path", "left_anti").select("path"), "gone")
    run = (runs(spark, folder).agg(F.max("run")).first()[0] or 0) + 1
    history = before.select("path", F.col("first_run").alias("old_run"))
    inherited = moves.join(history.withColumnRenamed("path", "old_path"), "old_path").select(F.col("new_path").alias("path"), "old_run")
    known = history.unionByName(inherited)
    shard = F.pmod(F.xxhash64("path"), F.lit(shards)).cast("int")
    made = fresh.join(known, "path", "left").withColumns({"first_run": F.coalesce("old_run", F.lit(run)), "shard": shard}).drop("old_run")
    touched = materialize(made.select("shard").unionByName(gone.select(shard.alias("shard"))).distinct(), "touched")
    columns = [c.split()[0] for c in _INDEX.split(", ")]
    kept = before.join(touched, "shard", "left_semi").join(gone, "path", "left_anti").join(fresh.select("path"), "path", "left_anti")
    new = materialize(kept.select(*columns).unionByName(made.select(*columns)), "index")
    if not new.isEmpty():
        overwrite_partitions(new, f"{folder}/files", ["shard"])
    for row in touched.join(new.select("shard"), "shard", "left_anti").collect():
        remove(spark, f"{folder}/files/shard={row.shard}")
    counted = (scan.count(), n, fresh.count(), moves.count(), gone.count(), indexed(spark, folder).count())
    total, _, read, moved, lost, held = counted
    ledger = spark.createDataFrame([(run, total, read, total - read, moved, lost - moved, held)], _RUNS)
    ledger.coalesce(1).write.mode("append").parquet(f"{folder}/runs")
    remove(spark, waiting)
    return ledger
