"""Semantics of operators on small inputs, and brute force where SQL does not reach."""

import itertools
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from archivolt.functions import text, values
from archivolt.operators import filters, graph, matching, ranking, reconcile, similarity, temporal, upsert


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_tiers_stop_at_the_first_preferred(spark):
    targets = spark.createDataFrame([("a", date(2024, 1, 10)), ("b", date(2024, 1, 10)), ("c", None)], "id string, d date")
    files = spark.createDataFrame(
        [("a", "p1", "png", date(2024, 1, 10)), ("a", "p2", "jpg", date(2024, 1, 11)), ("a", "p3", "jpg", date(2024, 1, 13)), ("b", "p4", "png", date(2024, 1, 13))],
        "id string, path string, kind string, f date",
    )
    found = temporal.tiered_interval_join(targets, files, ["id"], "d", "f", F.col("kind") != "png", ["id"])
    assert rows(found, "id", "path", "tier") == [("a", "p1", 0), ("a", "p2", 1), ("b", "p4", 2)]


def test_nearest_match_is_two_sided_and_breaks_ties_by_id(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    left = spark.createDataFrame([(1, "x", at(10)), (2, "x", at(30)), (3, "y", at(1))], "l long, k string, ts timestamp_ntz")
    right = spark.createDataFrame([(7, "x", at(8)), (6, "x", at(12)), (9, "x", at(31)), (5, "x", at(31))], "r long, k string, t timestamp_ntz")
    found = temporal.nearest_match(left, right, ["k"], "ts", "t", "r", "l")
    assert rows(found, "l", "nearest_r", "seconds") == [(1, 6, 2.0), (2, 5, 1.0), (3, None, None)]


def test_gap_sessions(spark):
    days = spark.createDataFrame([("a", date(2024, 1, d)) for d in (1, 2, 5, 9, 12)], "k string, d date")
    assert [r.session for r in temporal.gap_sessions(days, ["k"], "d", 3).orderBy("d").collect()] == [1, 1, 1, 2, 2]


def test_any_key_pairs_and_evidence(spark):
    a = spark.createDataFrame([(1, "s1", "x"), (2, None, "y"), (3, "s3", None)], "a_id int, a_sha string, a_stem string")
    b = spark.createDataFrame([(1, "s1", "x"), (2, None, "y"), (4, "s4", None)], "b_id int, b_sha string, b_stem string")
    pairs = matching.any_key_pairs(a, b, [[(F.col("a_sha"), F.col("b_sha"))], [(F.col("a_stem"), F.col("b_stem"))]], "a_id", "b_id")
    assert rows(pairs, "a_id", "b_id") == [(1, 1), (2, 2)]
    full = pairs.join(a, "a_id").join(b, "b_id")
    score, reasons = matching.additive_score({"exact_hash_size_match": F.col("a_sha") == F.col("b_sha"), "normalized_stem_match": F.col("a_stem") == F.col("b_stem")})
    kept = matching.accept(full.select("a_id", score.alias("score"), reasons.alias("reasons")), 55, ["exact_hash_size_match"])
    assert rows(kept, "a_id", "score") == [(1, 135)]


def test_unique_matching_against_brute_force(spark):
    rng = random.Random(5)
    edges = sorted({(g, rng.randrange(3), rng.randrange(3)) for g in range(60) for _ in range(rng.randrange(1, 6))})
    found = matching.unique_bipartite_matching(spark.createDataFrame(edges, "g long, a long, b long"), "g", "a", "b")
    wanted = []
    for g, group in itertools.groupby(edges, key=lambda e: e[0]):
        pairs = {(a, b) for _, a, b in group}
        left, right = sorted({a for a, _ in pairs}), sorted({b for _, b in pairs})
        perfect = [p for p in itertools.permutations(right) if len(left) == len(right) and all((a, b) in pairs for a, b in zip(left, p))]
        if len(perfect) == 1:
            wanted += [(g, a, b) for a, b in zip(left, perfect[0])]
    assert rows(found, "g", "a", "b") == sorted(wanted)


def test_spaced_top_k_against_a_fold(spark):
    rng = random.Random(3)
    frames = [(v, i, round(rng.random(), 3)) for v in range(5) for i in range(30)]
    found = ranking.spaced_top_k(spark.createDataFrame(frames, "v int, i long, s double"), "v", "i", "s", 6, 3)
    wanted = []
    for v in range(5):
        kept = []
        for _, i in sorted((-s, i) for w, i, s in frames if w == v):
            if len(kept) < 6 and all(abs(i - j) >= 3 for j in kept):
                kept.append(i)
        wanted += [(v, p, i) for p, i in enumerate(kept)]
    assert rows(found, "v", "place", "i") == sorted(wanted)


def test_agreed_pick_needs_agreement(spark):
    places = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0000005), (2, 1, 2.0), (2, 2, 3.0)], "e int, p int, lat double")
    assert rows(ranking.agreed_pick(places, ["e"], F.col("p"), ["lat"]), "e", "lat") == [(1, 2.0)]


def test_exact_then_date_names_every_record(spark):
    t = lambda d, h: datetime(2024, 1, d, h)
    exported = spark.createDataFrame([(1, t(1, 1)), (2, t(1, 1)), (3, t(2, 5)), (4, t(9, 9))], "x int, ts timestamp_ntz")
    manifest = spark.createDataFrame([(10, t(1, 1)), (20, t(2, 8)), (30, t(3, 3))], "m int, ts timestamp_ntz")
    found = reconcile.exact_then_date(exported, manifest, "x", "m", "ts", "ts").collect()
    assert {(r.x, r.m, r.match_status) for r in found} == {
        (1, 10, "matched_timestamp"),
        (2, 10, "duplicate_export_match"),
        (3, 20, "matched_date"),
        (4, None, "unmatched_export"),
        (None, 30, "missing_from_export"),
    }


def test_components_of_a_long_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 30)] + [(7, 7), (None, 3), (200, 7)]
    found = dict(rows(graph.connected_components(spark.createDataFrame(edges, "src long, dst long")), "node", "component"))
    assert all(found[i] == 100 for i in range(100, 161))
    assert all(found[k] == 5 for k in [*range(5, 30), 200])
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_thread_roots_and_cycles(spark):
    posts = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 4)], "id long, p long")
    assert rows(graph.thread_roots(posts, "id", "p"), "id", "root", "depth") == [(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 4, 0), (5, 4, 1)]
    with pytest.raises(ValueError, match="cycle"):
        graph.thread_roots(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, p long"), "id", "p")


def test_states(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    incoming = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert rows(upsert.keyed_upsert(stored, incoming, ["k"]), "k", "v") == [("a", 1), ("b", 3), ("c", 4)]
    assert rows(upsert.guarded_upsert(stored, incoming, ["k"], F.col("v") == 2), "k", "v") == [("a", 1), ("b", 2), ("c", 4)]
    roots = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/c/d",)], "root string")
    assert rows(upsert.outermost_roots(roots, "root"), "root", "outermost") == [("/a", "/a"), ("/a/b", "/a"), ("/ab", "/ab"), ("/c/d", "/c/d")]
    assert spark.range(1).select(upsert.is_permutation(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(1)))).first()[0]


def test_values(spark):
    row = spark.createDataFrame(
        [("IMG_20240131_120000 2023-02-30 x 2022.05.06 2022-05_07.jpg", "2024:01:31 10:11:12.5+02:00", "48 deg 30' 36\"", "Sun Mar 03 10:00:00 +0000 2024", "www.example.com")],
        "name string, exif string, gps string, post string, host string",
    ).select(
        values.filename_dates(F.col("name")).alias("dates"),
        values.exif_timestamp(F.col("exif")).alias("taken"),
        values.exif_offset_minutes(F.col("exif")).alias("offset"),
        values.signed_degrees(F.col("gps"), F.lit("S")).alias("lat"),
        values.post_timestamp(F.col("post")).alias("posted"),
        values.strict_date(F.lit("2024-2-1")).alias("loose"),
        values.name_uuid("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("host")).alias("uuid"),
        values.fixed_zone(F.lit(120)).alias("zone"),
    ).first()
    assert row.dates == [date(2022, 5, 7), date(2024, 1, 31)]
    assert row.taken == datetime(2024, 1, 31, 10, 11, 12, 500000) and row.offset == 120
    assert row.lat == -48.51 and row.loose is None and row.zone == "Etc/GMT-2"
    import uuid

    assert row.uuid == str(uuid.uuid5(uuid.NAMESPACE_DNS, "www.example.com"))


def test_text(spark):
    assert text.repaired("cafÃ©") == "café" and text.repaired("café") == "café" and text.repaired(None) is None
    assert text.repaired("Ã\x83Â©") == "é"
    assert text.html_text("<p>a <b>b</b></p><script>x</script><p>c&amp;d</p>") == "a b\nc&d"
    row = spark.createDataFrame([("Café (2) copy.JPG", "a  b \n\n\n\n c")], "n string, t string").select(
        text.normalized_stem(F.col("n")).alias("stem"), text.collapse_blank(F.col("t")).alias("t")
    ).first()
    assert row.stem == "cafe" and row.t == "a b\n\nc"


def test_filters(spark):
    paths = spark.createDataFrame([("/a/b",), ("/a/bc",), ("/a/b/c",), ("/a_b",)], "p string")
    assert rows(paths.filter(filters.under_path(F.col("p"), "/a/b")), "p") == [("/a/b",), ("/a/b/c",)]
    assert rows(paths.filter(filters.contains_text("A_B", "p")), "p") == [("/a_b",)]


def test_similarity(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 3, 8])], "a array<int>, b array<int>")
    row = df.select(
        similarity.mean_squared_error(F.col("a"), F.col("b")).alias("d"), similarity.average_hash(F.transform("a", lambda x: x.cast("double"))).alias("h")
    ).first()
    assert row.d == 4.0 and row.h == 0b0011
