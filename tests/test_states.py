"""State changes, records, reports and file formats on small tables, with their edge cases."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivolt.functions import records
from archivolt.operators import bands, crops, filters, ranking, reports, states
from archivolt.sources import files, packages


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_latest_and_children(spark):
    incoming = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, None, 1)], "k int, v string, at int")
    assert rows(states.latest_of(incoming, ["k"], ["at"]), "k", "v") == [(1, "b"), (2, None)]
    children = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, c string")
    fresh = spark.createDataFrame([(1, "n")], "k int, c string")
    parents = spark.createDataFrame([(1,), (3,)], "k int")
    assert rows(states.replace_children(children, fresh, parents, ["k"]), "k", "c") == [(1, "n"), (2, "z")]
    assert states.replace_children(children, fresh.limit(0), parents, ["k"]).count() == 1  # a file without dates keeps none


def test_decisions_meet_their_own_rows(spark):
    queue = spark.createDataFrame([(1, "s", " SELECT"), (1, "s", "select"), (1, "t", "reject"), (2, "u", "later"), (2, "u", None)], "e int, c string, d string")
    found = states.decided_media(queue, "e", "c", "d")
    assert rows(found, "entry", "content", "review_status") == [("1", "s", "confirmed"), ("1", "t", "rejected")]
    assert found.select("id").distinct().count() == 2


def test_groups_are_settled_only_with_their_keeper(spark):
    items = spark.createDataFrame(
        [(1, 1, "rejected", "problem"), (2, 1, "accepted", "problem"), (3, 2, "accepted", "problem"), (4, 3, "accepted", "problem"), (5, 3, "accepted", "keeper")],
        "i int, g int, review string, state string",
    )
    choices = spark.createDataFrame([(1, 1), (2, 3), (3, 9)], "g int, keeper int")
    assert rows(states.resolve_groups(items, choices, "i", "g"), "i", "review", "state", "duplicate_of") == [
        (1, "pending", "keeper", None),
        (2, "rejected", "auto_rejected", 1),
        (3, "accepted", "problem", None),  # a group of one
        (4, "accepted", "problem", None),  # the keeper is no member
        (5, "accepted", "keeper", None),
    ]


def test_one_main_frame_at_most(spark):
    frames = spark.createDataFrame(
        [(1, 1, True, True, "queued"), (2, 1, False, False, "not_queued"), (3, 2, False, False, "queued"), (4, 2, False, False, "not_queued")],
        "f int, v int, selected boolean, main boolean, status string",
    )
    changes = spark.createDataFrame([(1, False), (2, True), (3, True), (4, True)], "f int, wanted boolean")
    found = states.apply_selection(frames, changes, "f", "v")
    assert rows(found, "f", "selected", "main", "status") == [(1, False, False, "not_queued"), (2, True, True, "not_queued"), (3, True, True, "queued"), (4, True, False, "not_queued")]
    assert found.filter("main").groupBy("v").count().filter("count > 1").count() == 0


def test_work_queue_round(spark):
    frames = spark.createDataFrame(
        [(1, 1, True, "error", "x"), (2, 1, False, "queued", ""), (3, 2, True, "not_queued", ""), (4, 2, True, "rendered", "")], "f int, v int, selected boolean, status string, error string"
    )
    queued = states.queue_selected(frames)
    assert rows(queued, "f", "status") == [(1, "queued"), (2, "not_queued"), (3, "queued"), (4, "rendered")]
    claimed = states.claim(queued, [F.col("f")], 1, "f")
    assert rows(claimed, "f", "status")[0] == (1, "rendering")
    results = spark.createDataFrame([(1, "e" * 600), (3, None)], "f int, error string")
    done = states.finish(claimed, results, "f")
    assert [(f, s, len(e)) for f, s, e in rows(done, "f", "status", "error")] == [(1, "error", 500), (2, "not_queued", 0), (3, "queued", 0), (4, "rendered", 0)]
    accepted = spark.createDataFrame([(1,)], "v int")
    assert rows(states.requeue_errors(done, accepted, "v"), "f", "status")[0] == (1, "queued")
    assert rows(states.requeue_errors(done, accepted.limit(0), "v"), "f", "status")[0] == (1, "error")


def test_index_run_and_documents(spark):
    stored = spark.createDataFrame([("a", "s1", 1), ("b", "s2", 1), ("c", "s3", 1)], "path string, sha string, m int")
    scanned = spark.createDataFrame([("a", "s1", 1), ("x", "s2", 1), ("n", "s9", 1)], "path string, sha string, m int")
    state, ledger = states.index_run(stored, scanned, "path", ["sha"], ["m"])
    assert rows(state, "path", "sha") == [("a", "s1"), ("n", "s9"), ("x", "s2")]
    assert ledger.first().asDict() == {"scanned": 3, "taken": 1, "moved": 1, "pruned": 1, "skipped": 2}
    held = spark.createDataFrame([(1, '{"a":"1","b":"2"}'), (2, '{"a":"1"}')], "k int, record string")
    changes = spark.createDataFrame([(1, '{"b":"3"}'), (2, None), (3, '{"c":"4"}')], "k int, record string")
    assert rows(states.merged_documents(held, changes, "k"), "k", "record") == [(1, '{"a":"1","b":"3"}'), (3, '{"c":"4"}')]


def test_cache_and_first_of_each(spark):
    items = spark.createDataFrame([(1, "v1"), (2, "v1")], "k int, version string")
    cache = spark.createDataFrame([(1, "v1", None), (2, "v0", 7)], "k int, version string, x int")
    found = states.cached_or_computed(items, cache, ["k", "version"], F.lit(5), "x")
    assert rows(found, "k", "x", "cached") == [(1, None, True), (2, 5, False)]  # a cached null is a result
    picked = states.first_per_predicate(items, {"any": F.lit(True), "none": F.col("k") > 9}, ["k"])
    assert rows(picked, "name", "k") == [("any", 1)]


def test_reports(spark):
    log = spark.createDataFrame([("a: 1\nnoise\n a : 2\nb c: x:y",), ("",)], "t string").select(reports.key_values(F.col("t")).alias("m"))
    assert [r.m for r in log.collect()] == [{"a": "2", "b c": "x:y"}, {}]
    listed = spark.createDataFrame([(["a"],), (list("abcdefg"),), ([],)], "v array<string>").select(reports.first_and_more(F.col("v"), 5).alias("s"))
    assert [r.s for r in listed.collect()] == ["a", "a, b, c, d, e +2 more", ""]


def test_records(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    assert one(records.quality_score(F.lit("a.b/HI-RES final.jpg".split("/")[1]))).asDict() == {"score": 25, "evidence": ["quality_positive_final"]}
    assert one(records.quality_score(F.lit("HI-RES.jpg")))["score"] == 20  # a whole name is one word too
    assert one(records.capture_text(F.lit("2024:02:30 01:02:03"))) is None and one(records.capture_text(F.lit("2024:02:29 01:02:03.5 +0130"))) == "2024-02-29T01:02:03.5+01:30"
    assert one(records.time_delta_seconds(F.lit("2024-01-01T00:00:00+02:00"), F.lit("2023-12-31T22:00:00Z"))) == 0
    assert one(records.stays_inside(F.lit("a/../../b"))) is False and one(records.stays_inside(F.lit("a/../b/./c"))) is True
    assert one(records.in_range(F.lit("nan"), 0, 1)) is None and one(records.in_range(F.lit("TRUE"), 0, 1)) is None
    assert one(records.inferred_title(F.lit("2024-01-02 030405 A trip -.mp4"))) == "A trip" and one(records.inferred_title(F.lit("A trip.mp4"))) == ""
    assert one(records.memory_datetime(F.lit("x"), F.lit("2024-02-30"))) is None
    entity = F.array(*[F.struct(F.lit(k).alias("type"), F.lit("7").alias("id"), F.lit(a).alias("first"), F.lit(b).alias("last")) for k, a, b in (("user", 5, 8), ("user", 0, 99), ("venue", 5, 8))])
    assert [tuple(p) for p in one(records.companions(F.lit("with Ann"), entity))] == [("user:7", "Ann")]


def test_triage_takes_no_filter_for_granted(spark):
    items = spark.createDataFrame([(1, "2024", "a", 1.0), (2, "2025", "b", None)], "k int, date string, status string, amount double")
    frames = spark.createDataFrame([(1, True)], "k int, private boolean")
    assert filters.triage(items, frames, "k").count() == 2
    assert rows(filters.triage(items, frames, "k", without=F.col("private")), "k") == [(2,)]
    assert rows(filters.triage(items, frames, "k", with_frames=True, least=0.5), "k") == [(1,)]


def test_bounded_top_is_the_plain_one(spark):
    table = spark.range(1000).selectExpr("id % 3 AS k", "(id * 7919) % 1000 AS x", "id")
    found = ranking.bounded_top(table, ["k"], [F.col("x"), F.col("id")], 5, F.col("id"), parts=7)
    wanted = [sorted(((i * 7919) % 1000, i) for i in range(1000) if i % 3 == k)[:5] for k in range(3)]
    assert rows(found, "k", "x", "id") == sorted(((k, *p) for k in range(3) for p in wanted[k]), key=repr)


def test_bands_are_cut_before_the_join(spark):
    index = spark.createDataFrame([(p, "v", "b", "x") for p in range(100)], "path int, view string, band_name string, band_value string")
    votes = bands.view_votes(index.filter("path < 2").withColumnRenamed("path", "target"), index, 5)
    assert rows(votes, "target", "path", "best_band") == [(t, p, 5) for t in range(2) for p in range(5)]


def test_written_archives_are_whole(spark, tmp_path):
    member = "struct<name:string,content:binary>"
    table = spark.createDataFrame([("a", [("x.txt", b"1"), ("x.txt", b"2")]), ("b c", [])], f"name string, members array<{member}>")
    packages.write_each(table.select("name", packages.zipped(F.col("members")).alias("content")), "content", str(tmp_path / "z"), "name")
    found = [p for p in (tmp_path / "z").rglob("part-*") if not p.name.endswith(".crc")]
    assert len(found) == 2 and all(zipfile.is_zipfile(p) and zipfile.ZipFile(p).testzip() is None for p in found)
    members = files.zip_members(spark, str(tmp_path / "z"), pattern="part-*")
    assert [(r.member, r.issue) for r in members.collect()] == [("x.txt", None), ("x.txt", "duplicate_member")]
    with pytest.raises(ValueError, match="JSON files"):
        files.diary_archive(members, "id:int")


def test_windows_of_a_smooth_picture_are_found(spark):
    """Smooth pictures, as photos are; the least error of all windows of the true size is zero."""
    y, x = np.mgrid[0:48, 0:64]
    candidate = np.rint(120 + 60 * np.sin(x / 9) + 50 * np.cos(y / 7 + x / 23)).astype(int)
    places = [(0, 0, 40), (20, 8, 40), (8, 16, 28), (0, 0, 48)]
    picture = lambda p: (p.shape[1], p.shape[0], p.ravel().tolist())
    table = [(i, picture(candidate[y0 : y0 + w, x0 : x0 + w]), picture(candidate)) for i, (x0, y0, w) in enumerate(places)]
    kind = "struct<width:int,height:int,gray:array<int>>"
    for r in crops.found_crops(spark.createDataFrame(table, f"i int, reference {kind}, candidate {kind}")).collect():
        x0, y0, w = places[r.i]
        assert r.score <= 20 and max(abs(r.x - x0), abs(r.y - y0), abs(r.width - w)) <= 1, (places[r.i], r)


def test_archive_issues_without_a_range(spark):
    schema = "archive string, member string, byte_size long, crc long, content binary, issue string"
    members = spark.createDataFrame([("p/2024-01", "2024-01-05.png", 1, 1, None, None), ("p/2024-03", None, None, None, None, "unreadable_archive")], schema)
    found = files.archive_issues(members, F.regexp_extract("archive", "[^/]+$", 0))
    assert rows(found, "month", "code") == [("2024-03", "unreadable_archive")]
    ranged = files.archive_issues(members, F.regexp_extract("archive", "[^/]+$", 0), last="2024-04")
    assert ("2024-02", "missing_month") in rows(ranged, "month", "code") and ("2024-04", "missing_month") in rows(ranged, "month", "code")
