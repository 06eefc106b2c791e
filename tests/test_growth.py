"""Plans whose work or memory must not grow faster than the table."""

from pyspark.sql import functions as F

from archivolt.functions import records
from archivolt.operators import graph, photos, temporal


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_geocoders_answer_is_read_once(spark):
    found = spark.range(1).select(records.flat_address(F.concat(F.lit('{"address":{"city":"'), F.col("id").cast("string"), F.lit('"}}'))).alias("f"))
    assert plan(found.select("f.address", "f.city", "f.display")).count("get_json_object") <= 1
    assert found.first().f.display == "0"


def test_frames_of_nearest_overall_run_from_the_start(spark):
    rows = spark.range(9).select("id", F.timestamp_seconds("id").alias("ts"))
    found = temporal.nearest_overall(rows, rows.select(F.col("id").alias("right_id"), "ts"), "ts", "ts", "right_id", "id", 2)
    assert "unboundedfollowing" not in plan(found).lower()
    assert all(r.id == r.nearest_right_id for r in found.collect())


def test_tags_are_made_once_a_row(spark):
    tags = F.create_map(F.lit("EXIF:CreateDate"), F.concat(F.col("id").cast("string"), F.lit("021:02:03 04:05:06Z\n")), F.lit("QuickTime:CreateDate"), F.lit("2020:01:01 00:00:00"))
    found = spark.range(3).select(records.best_capture(tags).alias("b"))
    assert plan(found.select("b.timestamp", "b.source")).count("021:02:03") == 1
    last = found.collect()[2].b
    assert (last.timestamp, last.source) == ("2021-02-03T04:05:06+00:00", "exif_datetime_digitized")


def test_words_of_a_name_are_made_once_a_row(spark):
    name = F.concat(F.lit("Best marked "), F.col("id").cast("string"), F.lit(" low-res.jpg"))
    found = spark.range(1).select(records.quality_score(name).alias("q"))
    assert plan(found.select("q.score", "q.evidence")).count("Best marked") == 1
    assert found.first().q.asDict() == {"score": 10, "evidence": ["quality_positive_best", "quality_negative_low"]}


def test_rounds_of_components_shrink(spark, monkeypatch):
    written, keep = [], graph.materialize

    def counted(df, name):
        out = keep(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "materialize", counted)
    found = graph.connected_components(spark.range(1000).selectExpr("id AS src", "id + 1 AS dst"))
    assert found.count() == 1001 and found.filter("component <> 0").isEmpty()
    assert sum(written) < 8 * 1001


def test_photos_are_settled_without_a_frame_for_each_component(spark):
    pairs = spark.range(6).selectExpr("id AS loose_id", "id DIV 2 AS entry_id", "id DIV 2 AS photo_id", "0 AS distance", "id AS gap")
    loose = spark.range(6).selectExpr("id AS loose_id", "id AS place_in_order", "struct(id % 2 AS q) AS quality")
    held = spark.range(3).selectExpr("id AS entry_id", "id AS photo_id", "struct(CAST(1 AS LONG) AS q) AS quality")
    found = photos.merged_photos(pairs, loose, held)
    assert "InPandas" not in plan(found)
    assert sorted(found.collect()) == [(i, *((i // 2, i // 2, 0, True) if i % 2 == 0 else (None,) * 4)) for i in range(6)]
