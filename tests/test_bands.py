"""Coarse features, the band index and the distance of views."""

import random

import pytest
from pyspark.sql import functions as F

from archivolt.operators import bands

VIEWS = f"array<{bands.VIEW}>"
FEATURES = "array<struct<name:string,gray:array<double>,mean_rgb:array<double>>>"


def grid(gray, side):
    """Cell means as the rule says them; Python rounds half to even."""
    out = []
    for cy in range(4):
        for cx in range(4):
            ys = range(round(cy * side / 4), max(round(cy * side / 4) + 1, round((cy + 1) * side / 4)))
            xs = range(round(cx * side / 4), max(round(cx * side / 4) + 1, round((cx + 1) * side / 4)))
            cells = [gray[y * side + x] for y in ys for x in xs]
            out.append(sum(cells) / len(cells))
    return out


def test_coarse_grids_of_all_sides(spark):
    rng = random.Random(1)
    rows = [(side, [float(rng.randrange(256)) for _ in range(side * side)]) for side in (4, 5, 6, 7, 8, 9, 13, 32)]
    found = {r.s: r.g for r in spark.createDataFrame(rows, "s int, g array<double>").select("s", bands.coarse_grid(F.col("g")).alias("g")).collect()}
    for side, gray in rows:
        assert found[side] == pytest.approx(grid(gray, side), abs=1e-9), side


def test_what_has_no_features(spark):
    good = {"name": "full", "gray": [1.0] * 16, "mean_rgb": [1.0, 2.0, 3.0]}
    rows = [
        (1, 5, 5, [good], ""),
        (2, 0, 5, [good], "dimensions_missing"),
        (3, None, 5, [good], "dimensions_missing"),
        (4, 5, 5, [], "views_missing"),
        (5, 5, 5, None, "views_missing"),
        (6, 5, 5, [good, {**good, "gray": []}], "view_incomplete"),
        (7, 5, 5, [{**good, "mean_rgb": [1.0]}], "view_incomplete"),
        (8, 5, 5, [{**good, "gray": [1.0] * 17}], "gray_not_square"),
        (9, 5, 5, [{**good, "gray": [1.0] * 4}], "gray_not_square"),
    ]
    table = spark.createDataFrame([r[:4] for r in rows], f"i int, width int, height int, views {VIEWS}")
    assert {r.i: r.x for r in table.select("i", bands.descriptor_issue("views", "width", "height").alias("x")).collect()} == {r[0]: r[4] for r in rows}


def test_bands_of_a_view(spark):
    view = {"name": "full", "gray": [float(32 * (i % 8)) for i in range(16)], "mean_rgb": [0.0, 31.99, 255.0]}
    table = spark.createDataFrame([("p", 30, 20, [view])], f"path string, width int, height int, views {VIEWS}")
    found = {r.band_name: r.band_value for r in bands.bands_of(table.withColumn("features", bands.features(F.col("views"))), "path").collect()}
    assert found == {"color": "0-0-7", "gray_tl": "0-1-4-5", "gray_tr": "2-3-6-7", "gray_bl": "0-1-4-5", "gray_br": "2-3-6-7", "orientation": "landscape:15"}


@pytest.mark.parametrize("all_left", [True, False])
def test_distances_against_all_pairs_of_views(spark, all_left):
    rng = random.Random(2)
    view = lambda i: {"name": f"v{i}", "gray": [rng.choice((0.0, 200.0, 30.0 * rng.random())) for _ in range(16)], "mean_rgb": [255 * rng.random() for _ in range(3)]}
    rows = [(k, [view(i) for i in range(rng.randrange(0, 4))], [view(i % 5) for i in range(rng.randrange(0, 7))], rng.choice((None, [], ["v1"], ["v1", "v3"], ["none"]))) for k in range(200)]
    rows += [(900, None, [view(1)], None), (901, [view(1)], None, ["v1"])]
    table = spark.createDataFrame(rows, f"k int, a {FEATURES}, b {FEATURES}, liked array<string>").repartition(3)
    found = {r.k: (r.distance, r.best_view) for r in bands.nearest_views(table, "a", "b", "liked", all_left).collect()}
    mse = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y)) / len(x)
    for k, a, b, liked in rows:
        a, b = (a or []) if all_left else (a or [])[:1], b or []
        use = [v for v in b if v["name"] in (liked or ())] or b
        options = [(round(mse(x["gray"], y["gray"]) + 0.15 * mse(x["mean_rgb"], y["mean_rgb"]), 9), y["name"]) for x in a for y in use]
        wanted = min(options, default=(999_999.0, ""))
        assert found[k][1] == wanted[1] and found[k][0] == pytest.approx(wanted[0], abs=1e-6), k


def described(spark, rows):
    view = lambda i: {"name": "full", "gray": [float((i * 37 + j * 11) % 256) for j in range(16)], "mean_rgb": [float(i % 256)] * 3}
    full = [(f"p{i}", 10, mtime, "s", width, 10, [view(i)], 1.0) for i, mtime, width in rows]
    return spark.createDataFrame(full, f"path string, byte_size long, mtime_ns long, sha256 string, width int, height int, views {VIEWS}, quality double")


def test_only_stale_rows_are_made_anew(spark, tmp_path):
    folder = str(tmp_path / "index")
    with pytest.raises(RuntimeError, match="not built"):
        bands.ensure_ready(spark, folder)
    run = lambda rows, **options: tuple(bands.build_band_index(described(spark, rows), folder, shards=8, **options).first())
    first = [(i, 1, 10) for i in range(60)]
    assert run(first) == (60, 0, 60, 0)
    bands.ensure_ready(spark, folder)
    with pytest.raises(RuntimeError, match="other"):
        bands.ensure_ready(spark, folder, "other")
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("part-*.parquet")}
    before = files()
    assert run(first) == (60, 60, 0, 0) and files() == before
    # One changed, one new without a size: their shards alone are written again, and no row is lost.
    assert run([(i, 2 if i == 7 else 1, 10) for i in range(60)] + [(99, 1, 0)]) == (61, 59, 1, 1)
    assert 0 < len(files().keys() - before.keys()) < len(before)
    held = {r.path: (r.mtime_ns, r.issue) for r in bands.band_features(spark, folder).collect()}
    assert held == {f"p{i}": (2 if i == 7 else 1, "") for i in range(60)} | {"p99": (1, "dimensions_missing")}
    listed = {r.path for r in bands.band_rows(spark, folder).collect()}
    assert listed == {f"p{i}" for i in range(60)}
    # What failed is tried again; paths that are not given stay.
    assert run([(99, 1, 5)]) == (1, 0, 1, 0)
    assert bands.band_features(spark, folder).count() == 61
    assert run(first, rebuild=True) == (60, 0, 60, 0)


@pytest.mark.parametrize("most", [1, 3, 40])
def test_all_hits_of_a_band_count_without_a_cap(spark, monkeypatch, most):
    rng = random.Random(3)
    monkeypatch.setattr(bands, "CELL_TARGETS", 3)
    monkeypatch.setattr(bands, "CELL_PATHS", 20)
    monkeypatch.setattr(bands, "CELL_HITS", 50)
    # The band "a" holds all; equal votes and rarities come of few values.
    held = {(f"p{p}", f"v{v}", name, str(0 if name == "a" else rng.randrange(9))) for p in range(70) for v in range(2) for name in "abc"}
    held |= {(f"p{p}", f"v{v}", "d", "1") for p in range(70, 150) for v in range(2)}
    index = spark.createDataFrame(sorted(held), "path string, view string, band_name string, band_value string")
    asked = {(t, name, str(0 if name == "a" else rng.randrange(9))) for t in range(10) for name in "aabbc"} | {(11, "d", "1"), (12, "e", "1")}
    targets = spark.createDataFrame(sorted(asked), "target int, band_name string, band_value string")
    wanted = {}
    size = {b: sum(r[2:] == b for r in held) for b in {r[2:] for r in held}}
    for t in range(13):
        found = {}
        for p, v, *b in held:
            if (t, *b) in asked:
                found.setdefault(p, []).append((size[tuple(b)], v))
        rows = [(-len(h), -round(sum(1 / n for n, _ in h), 9), min(n for n, _ in h), p, sorted({v for _, v in h})) for p, h in found.items()]
        wanted[t] = [(-r[0], r[2], *r[3:]) for r in sorted(rows)[:most]]
    for rows in (bands.likeliest(targets, index, most), bands._by_votes(bands.view_votes(targets, index, None), most)):
        order = lambda r: (-r.votes, -round(r.rarity, 9), r.best_band, r.path)
        listed = sorted(rows.collect(), key=order)
        assert {t: [(r.votes, r.best_band, r.path, sorted(r.hit_views)) for r in listed if r.target == t] for t in range(13)} == wanted
