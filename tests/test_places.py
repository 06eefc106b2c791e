"""Nearest rows in time without a key, perceptual hashes, and photos of a place that show the same."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from archivolt.operators import photos, temporal

START = datetime.datetime(2024, 1, 1)


def moments(spark, rows, key):
    return spark.createDataFrame([(i, None if s is None else START + datetime.timedelta(seconds=s), v) for i, s, v in rows], f"{key} long, ts timestamp, venue string")


def nearest(rows, s):
    return min(((abs(t - s), i) for i, t, _ in rows if t is not None), default=None)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_nearest_overall_against_all_pairs(spark, ranges):
    rng = random.Random(ranges)
    right = [(i, rng.choice((rng.randrange(0, 4000), 1000, None)), "a") for i in range(60)]
    left = [(i, rng.choice((rng.randrange(-500, 5000), 1500, None)), "b") for i in range(150)]
    found = {r.l: (r.nearest_r, r.seconds) for r in temporal.nearest_overall(moments(spark, left, "l"), moments(spark, right, "r"), "ts", "ts", "r", "l", ranges).collect()}
    for i, s, _ in left:
        best = None if s is None else nearest(right, s)
        assert found[i] == ((None, None) if best is None else (best[1], float(best[0]))), (i, s)


def test_nearest_overall_without_rows(spark):
    some, none = moments(spark, [(1, 5, "a")], "l"), moments(spark, [], "r")
    assert [tuple(r) for r in temporal.nearest_overall(some, none, "ts", "ts", "r", "l", 4).collect()] == [(1, None, None)]
    assert temporal.nearest_overall(none.withColumnRenamed("r", "l"), some.withColumnRenamed("l", "r"), "ts", "ts", "r", "l", 4).count() == 0


def test_no_window_holds_all_rows(spark):
    left, right = moments(spark, [(i, i, "a") for i in range(50)], "l"), moments(spark, [(i, 2 * i, "a") for i in range(50)], "r")
    plan = temporal.nearest_overall(left, right, "ts", "ts", "r", "l", 4)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_fallback_is_for_venues_without_a_match(spark):
    right = moments(spark, [(1, 0, "a"), (2, 100, "b"), (3, 90, None)], "r")
    left = moments(spark, [(10, 90, "a"), (11, 95, "c"), (12, 97, None)], "l")
    found = sorted(tuple(r) for r in temporal.nearest_with_fallback(left, right, ["venue"], "ts", "ts", "r", "l").collect())
    assert found == [(10, 1, 90.0, True), (11, 2, 5.0, False), (12, 2, 3.0, False)]


def test_perceptual_hash(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 200, (16, 16))
    rows = [(0, base), (1, base + 20), (2, np.clip(base + rng.integers(-2, 3, base.shape), 0, 255)), (3, 255 - base), (4, np.full((16, 16), 9))]
    data = [(i, x.ravel().tolist()) for i, x in rows] + [(5, None), (6, [1] * 65), (7, [1] * 49), (8, [None] * 64), (9, base[:8, :8].ravel().tolist())]
    found = {r.i: r.h for r in spark.createDataFrame(data, "i int, g array<int>").select("i", photos.perceptual_hash(F.col("g")).alias("h")).collect()}
    distance = lambda a, b: bin((found[a] ^ found[b]) & (1 << 64) - 1).count("1")
    assert distance(0, 1) == 0 and distance(0, 2) <= 4 and distance(0, 3) >= 40
    assert found[4] == 0 and [found[i] for i in (5, 6, 7, 8)] == [None] * 4 and found[9] is not None


def settled(pairs, loose, held):
    """One loose photo after the other."""
    gone, out = set(), []
    for loose_id, _, quality in sorted(loose, key=lambda x: (x[1], x[0])):
        mine = [p for p in pairs if p[0] == loose_id]
        standing = [p for p in mine if (p[1], p[2]) not in gone]
        if standing:
            _, entry, photo, distance, _ = min(standing, key=lambda p: (p[3], p[4], p[1], p[2]))
            better = quality < held[entry, photo]
            if better:
                gone.add((entry, photo))
            out.append((loose_id, entry, photo, distance, better))
        elif mine:
            out.append((loose_id, None, None, None, None))
    return sorted(out)


def test_pairs_and_their_settlement_against_plain_rules(spark):
    rng = random.Random(7)
    hashes = [rng.getrandbits(63) for _ in range(4)]
    flip = lambda h: h ^ sum(1 << b for b in rng.sample(range(63), rng.choice((0, 1, 2, 3, 5))))
    quality = lambda i: (-rng.randrange(3), rng.random() < 0.5, -rng.randrange(3), i)
    entries = [(e, rng.choice("ab"), rng.randrange(0, 200)) for e in range(25)]
    held = [(rng.choice(entries)[0], 100 + i, rng.randrange(0, 200), (f"d{i % 9}", flip(rng.choice(hashes))), quality(100 + i)) for i in range(50)]
    loose = [(500 + i, rng.choice("ab"), rng.randrange(0, 200), (f"d{i % 30}", flip(rng.choice(hashes))), rng.randrange(40), quality(500 + i)) for i in range(70)]
    place = {e: (p, t) for e, p, t in entries}
    pairs = []
    for loose_id, p, t, (d, h), _, _ in loose:
        for e, photo, s, (d2, h2), _ in held:
            distance = 0 if d == d2 else bin(h ^ h2).count("1")
            if place[e][0] == p and abs(place[e][1] - t) <= 120 and abs(s - t) <= 120 and distance <= 2:
                pairs.append((loose_id, e, photo, distance, abs(s - t)))
    photo, order = "struct<digest:string,hash:long>", "struct<pixels:long,explicit:boolean,size:long,id:long>"
    L = spark.createDataFrame(loose, f"loose_id long, place string, at long, photo {photo}, place_in_order int, quality {order}")
    H = spark.createDataFrame(held, f"entry_id long, photo_id long, at long, photo {photo}, quality {order}")
    found = photos.pairs_in_window(L, spark.createDataFrame(entries, "entry_id long, place string, at long"), H)
    assert sorted(tuple(r) for r in found.collect()) == sorted(pairs) and len(pairs) > 20
    merged = photos.merged_photos(found, L, H)
    wanted = settled(pairs, [(x[0], x[4], x[5]) for x in loose], {(e, i): q for e, i, _, _, q in held})
    assert sorted(tuple(r) for r in merged.collect()) == wanted
    assert {r[4] for r in wanted} >= {True, False}
