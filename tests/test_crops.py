"""Search for the window of a picture that shows a reference."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivolt.operators import crops

PICTURE = "struct<width:int,height:int,gray:array<int>>"


def picture(x):
    return (int(x.shape[1]), int(x.shape[0]), [int(v) for v in x.ravel()])


def scene(seed, width=150, height=120):
    """A smooth picture with some detail."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width]
    out = sum(rng.uniform(20, 45) * np.sin(x * rng.uniform(0.02, 0.12) + y * rng.uniform(-0.1, 0.1) + rng.uniform(0, 6)) for _ in range(6))
    return np.clip(np.rint(out - out.min()), 0, 255).astype(int)


def turned(image, degrees):
    """The picture seen under a rotation, by the rule of the search: nearest pixel, black outside."""
    height, width = image.shape
    a, (cy, cx) = math.radians(-degrees), (height / 2, width / 2)
    y, x = np.mgrid[0:height, 0:width]
    sx, sy = np.rint(cx + (x - cx) * math.cos(a) - (y - cy) * math.sin(a)).astype(int), np.rint(cy + (x - cx) * math.sin(a) + (y - cy) * math.cos(a)).astype(int)
    inside = (sx >= 0) & (sy >= 0) & (sx < width) & (sy < height)
    return np.where(inside, image[np.clip(sy, 0, height - 1), np.clip(sx, 0, width - 1)], 0)


def plain(reference, candidate, n, rotations):
    """The first look, window by window."""
    height, width = candidate.shape
    aspect = reference.shape[1] / reference.shape[0]
    at = lambda s: [round(i * (s - 1) / (n - 1)) for i in range(n)]
    wanted = [reference[y, x] for y in at(reference.shape[0]) for x in at(reference.shape[1])]
    best = None
    for r in rotations:
        for w, h in crops.crop_sizes(width, height, aspect):
            ys, xs = (sorted({*range(0, room - size + 1, max(1, size // 20)), room - size}) for room, size in ((height, h), (width, w)))
            for y in ys:
                for x in xs:
                    if r:
                        a, sample = math.radians(-r), []
                        for i in range(n):
                            for j in range(n):
                                dx, dy = x + j * (w - 1) / (n - 1) - width / 2, y + i * (h - 1) / (n - 1) - height / 2
                                u, v = round(width / 2 + dx * math.cos(a) - dy * math.sin(a)), round(height / 2 + dx * math.sin(a) + dy * math.cos(a))
                                sample.append(candidate[v, u] if 0 <= u < width and 0 <= v < height else 0)
                    else:
                        sample = [candidate[y + i, x + j] for i in at(h) for j in at(w)]
                    score = sum((int(a) - int(b)) ** 2 for a, b in zip(wanted, sample)) / len(wanted)
                    if best is None or score < best[0]:
                        best = (score, x, y, w, h, float(r))
    return best


def test_first_look_against_the_plain_search(spark, monkeypatch):
    monkeypatch.setattr(crops, "BLOCK", 3000)
    rng = np.random.default_rng(3)
    pairs = [(rng.integers(0, 256, (6, 8)), rng.integers(0, 256, (9, 14))), (scene(1, 12, 12), scene(1, 30, 24)), (rng.integers(0, 256, (5, 5)), rng.integers(0, 256, (5, 5))), (np.full((4, 9), 7), np.full((9, 4), 7))]
    for rotations in ((0.0,), (0.0, 90.0, -12.5)):
        rows = spark.createDataFrame([(i, picture(a), picture(b)) for i, (a, b) in enumerate(pairs)], f"i int, reference {PICTURE}, candidate {PICTURE}")
        found = {r.i: (r.score, r.x, r.y, r.width, r.height, r.rotation) for r in crops.found_crops(rows, 8, rotations, refine=False).collect()}
        for i, (a, b) in enumerate(pairs):
            assert found[i] == pytest.approx(plain(a, b, 8, rotations)), (i, rotations)


def test_planted_crops_are_found_within_a_pixel(spark):
    """Crops of odd places and sizes, under rotations, with noise and coarser levels."""
    rng, rows, planted = random.Random(4), [], {}
    for i in range(24):
        image, degrees = scene(i), rng.choice((0.0, 0.0, 90.0, 7.0))
        seen = turned(image, degrees) if degrees else image
        w = rng.randrange(70, 118)
        h = round(w * 0.8)
        x, y = rng.randrange(0, 150 - w), rng.randrange(0, 120 - h)
        if degrees == 90.0:  # the picture turned by a quarter fills a square in the middle
            w, h = 80, 64
            x, y = rng.randrange(16, 54), rng.randrange(0, 55)
        crop = seen[y : y + h, x : x + w]
        noise = np.random.default_rng(i).integers(-3, 4, crop.shape) if i % 3 else 0
        crop = np.clip(crop + noise, 0, 255)
        crop = crop // 6 * 6 + 3 if i % 4 == 1 else crop
        rows.append((i, picture(crop), picture(image)))
        planted[i] = (x, y, w, h, degrees)
    table = spark.createDataFrame(rows, f"i int, reference {PICTURE}, candidate {PICTURE}")
    for r in crops.found_crops(table, 24, (0.0, 90.0, 7.0)).collect():
        x, y, w, h, degrees = planted[r.i]
        assert r.rotation == degrees and max(abs(r.x - x), abs(r.y - y), abs(r.width - w), abs(r.height - h)) <= 1, (r.i, planted[r.i], r.x, r.y, r.width, r.height, r.score)
        assert r.score < 60


def test_what_has_no_crop(spark):
    good = (2, 2, [1, 2, 3, 4])
    rows = [(0, good, good), (1, None, good), (2, (2, 2, [1]), good), (3, (0, 2, []), good), (4, good, (2, 2, [1, None, 3, 4])), (5, good, (None, 2, [1, 2]))]
    table = spark.createDataFrame(rows, f"i int, reference {PICTURE}, candidate {PICTURE}")
    found = {r.i: r for r in crops.found_crops(table, 8).withColumn("c", crops.confidence(F.col("score"))).collect()}
    assert (found[0].score, found[0].c) == (0.0, "high") and all(found[i].score is None and found[i].x is None and found[i].c is None for i in range(1, 6))
    assert crops.found_crops(table.limit(0), 8).count() == 0
