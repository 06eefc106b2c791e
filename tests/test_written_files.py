"""Files written from rows."""

import glob
import re

from pyspark.sql import functions as F

from archivolt import session
from archivolt.plans import registry
from archivolt.sources import files, packages


def test_a_small_table_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(64).coalesce(1).selectExpr("concat('f', id) AS folder", "CAST(concat('text ', id) AS BINARY) AS content")
    packages.write_each(rows, "content", str(tmp_path / "out"), "folder")
    names = [p for p in (tmp_path / "out").rglob("part-*")]
    assert {p.parent.name[7:]: p.read_text() for p in names} == {f"f{i}": f"text {i}\n" for i in range(64)}
    assert len({re.match(r"part-(\d+)", p.name)[1] for p in names}) > 1


def test_a_long_diary_has_several_archives(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A"), (60_001, "A"), (60_002, "A"), (2, "B")], "c_custkey long, c_mktsegment string")
    rows.write.parquet(str(tmp_path / "customer.parquet"))
    shown = f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/archivolt/diaries-*/*/part-*"
    before = set(glob.glob(shown))
    found = registry.QUERIES["s16_diary_archives"](spark, str(tmp_path)).collect()
    assert sorted((r.archive, r.id, r.media) for r in found) == [("A", 1, 1), ("A", 60_001, 1), ("A", 60_002, 2), ("B", 2, 2)]
    assert len(set(glob.glob(shown)) - before) == 3


def test_archives_of_many_members_are_read_whole(spark, tmp_path):
    name = F.concat(F.lit("m"), F.col("id").cast("string"))
    member = F.struct(name.alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    held = spark.range(10_000).groupBy((F.col("id") % 2).alias("f")).agg(F.collect_list(member).alias("members"))
    packages.write_each(held.select("f", packages.zipped(F.col("members")).alias("content")), "content", str(tmp_path / "z"), "f")
    found = files.zip_members(spark, str(tmp_path / "z"), pattern="part-*").filter("issue IS NULL AND concat('m', CAST(content AS STRING)) = member")
    assert found.select("member").distinct().count() == found.count() == 10_000


def test_a_larger_package_is_made_by_more_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    spark.range(500).selectExpr("id AS o_orderkey", "'O' AS o_orderstatus").write.parquet(str(tmp_path / "orders.parquet"))
    lines = spark.range(2000).selectExpr("id % 400 AS l_orderkey", "CAST(id AS INT) AS l_linenumber", "id AS l_partkey", "id AS l_suppkey")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = registry.QUERIES["k25_nested_package"](spark, str(tmp_path))
    assert {r.id: r.parts for r in found.collect()} == {i: ",".join(str(i + 400 * k) for k in range(5)) if i < 400 else "" for i in range(500)}
    manifest = found.inputFiles()[0].removeprefix("file://").rsplit("/entries/", 1)[0] + "/manifest"
    assert len(glob.glob(f"{manifest}/part-*")) == 20
    assert registry.QUERIES["k26_package_counters"](spark, str(tmp_path)).first().asDict() == {"entries": 500, "media": 2000, "entries_without_media": 100}
