import io
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivolt.sources import files, media, packages
from archivolt.streaming import events as streams


def write_bmp(path, rgb):
    height, width, _ = rgb.shape
    row = (width * 3 + 3) // 4 * 4
    body = b"".join(rgb[y, :, ::-1].tobytes().ljust(row, b"\0") for y in reversed(range(height)))
    head = b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 0, 0, 0, 0)
    path.write_bytes(head + body)


def test_zip_members_and_pairs(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "2024-01.zip", "w") as z:
        z.writestr("2024-01-31.png", b"image")
        z.writestr("2024-01-31.txt", "﻿hello".encode())
        z.writestr(".hidden", b"x")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    members = files.zip_members(spark, str(tmp_path))
    assert {(r.member, r.issue) for r in members.collect()} == {("2024-01-31.png", None), ("2024-01-31.txt", None), (None, "unreadable_archive")}
    pair = files.dated_pairs(members).collect()
    assert [(r.text, bytes(r.image)) for r in pair] == [("hello", b"image")]


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.js").write_text('window.YTD.tweets.part0 = [{"id": "1", "n": 2}, {"id": "2", "n": 3}];\n')
    assert sorted(tuple(r) for r in files.assigned_json(spark, str(tmp_path / "a.js"), "id:string,n:int").collect()) == [("1", 2), ("2", 3)]
    folder = tmp_path / "c"
    folder.mkdir()
    (folder / "checkins1.json").write_text(json.dumps({"count": 2, "items": [{"id": "a", "v": 1}, {"id": "b", "v": 1}]}))
    (folder / "checkins2.json").write_text(json.dumps({"count": 2, "items": [{"id": "a", "v": 1}, {"id": "b", "v": 2}]}))
    found = files.chunked_records(spark, str(folder), "id:string,v:int")
    assert sorted((r.id, r.item.v, r.conflict) for r in found.collect()) == [("a", 1, False), ("b", 1, True)]
    (tmp_path / "l.jsonl").write_text('{"id": "x"}\nbroken\n')
    lines = files.json_lines(spark, str(tmp_path / "l.jsonl"), "id string")
    assert sorted(str(r.id) for r in lines.cache().collect()) == ["None", "x"]


def test_csv_listing_and_manifest(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,note\n1,"a, ""b"""\n2,\n')
    assert [tuple(r) for r in files.csv_queue(spark, str(tmp_path / "q.csv"), ["id", "note", "extra"]).orderBy("id").collect()] == [("1", 'a, "b"', ""), ("2", "", "")]
    assert files.listing(spark, str(tmp_path), ["csv"]).count() == 1
    row = files.manifest(spark, str(tmp_path)).first()
    assert row.relative_path == "q.csv" and len(row.sha256) == 64
    assert files.table_count(spark, str(tmp_path / "none.parquet")) is None


def test_pixels_views_and_headers(spark, tmp_path):
    rgb = np.zeros((4, 8, 3), np.uint8)
    rgb[:, 4:] = (255, 0, 0)
    write_bmp(tmp_path / "a.bmp", rgb)
    data = (tmp_path / "a.bmp").read_bytes()
    assert (media.pixels(data) == rgb).all() and media.image_size(data) == (8, 4)
    ppm = b"P6\n# c\n8 4\n255\n" + rgb.tobytes()
    assert (media.pixels(ppm) == rgb).all() and media.pixels(b"nothing") is None
    views = [v[0] for v in media.square_views(8, 4, 3)]
    assert views == ["full", "square_0", "square_1", "square_2"]
    df = spark.read.format("binaryFile").load(str(tmp_path / "a.bmp"))
    row = df.select(media.descriptors(F.col("content"), 3, 4).alias("v"), media.dimensions("content").alias("d")).first()
    assert len(row.v) == 4 and row.v[0].mean_rgb == [127.5, 0.0, 0.0] and tuple(row.d) == (8, 4)
    dark = b"P6\n8 4\n255\n" + bytes(96)
    pairs = spark.createDataFrame([(ppm, dark), (dark, dark), (ppm, ppm), (b"nothing", dark)], "a binary, b binary")
    assert [r.x for r in pairs.select(media.black_conversion(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False, False]


def test_exif_and_sidecars():
    text = b"2024:01:31 10:11:12\0"
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x9003, 2, len(text), 26) + struct.pack("<I", 0) + text
    body = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"
    assert media.jpeg_dates(jpeg) == {"original": "2024:01:31 10:11:12"}
    assert media.jpeg_dates(jpeg[:30]) == {} and media.jpeg_dates(None) == {}
    xmp = '<x xmlns:d="u"><d:PersonInImage><d:Bag><d:li>Ann</d:li><d:li>Bo</d:li></d:Bag></d:PersonInImage></x>'
    assert media.sidecar_values(xmp, ("PersonInImage",)) == ["Ann", "Bo"] and media.sidecar_values("<", ("a",)) == []


def test_html_cards(spark):
    page = '<div class="post card"><span class="body x">Hi <b>you</b></span><br><a class="url">u1</a></div><div class="other">no</div>'
    found = spark.createDataFrame([(page,)], "h string").select(media.html_cards(F.col("h"), "card", {"text": "body", "url": "url"}).alias("c")).first().c
    assert found == [{"text": "Hi you", "url": "u1"}]
    # Void and unclosed nodes keep no card open, and an end without a start closes none.
    page = '<div class="card"><source><p class="body">one<li></i></div><p class="body">outside</p><div class="card"><p class="body">two</div>'
    found = spark.createDataFrame([(page,)], "h string").select(media.html_cards(F.col("h"), "card", {"text": "body"}).alias("c")).first().c
    assert found == [{"text": "one"}, {"text": "two"}]


def test_packages_and_gate(spark, tmp_path):
    entries = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    items = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "id int, position int, name string")
    counts = packages.write_package(entries, items, "id", str(tmp_path / "p")).first()
    assert tuple(counts) == (2, 2, 1)
    back = spark.read.json(str(tmp_path / "p/entries")).orderBy("id").first()
    assert [m.name for m in back.media] == ["x", "y"]
    packages.write_report(entries, str(tmp_path / "r"), "Report")
    with pytest.raises(ValueError, match="positive"):
        packages.gate(entries, {"positive": F.col("id") > 1})


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (1, "b", 5.0)], "version long, k string, value double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = streams.upsert_stream(stream, str(tmp_path / "out"), ["k"], "version", str(tmp_path / "check"))
    query.awaitTermination(60)
    stored = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted((r.k, r.value) for r in streams.latest(stored, ["k"], "version").collect()) == [("a", 2.0), ("b", 5.0)]


def test_scratch_tables_go(spark):
    import os

    from archivolt.storage import materialize, new_path, scratch

    kept = new_path(spark, "kept")
    with scratch(spark):
        inside = materialize(spark.range(5), "inside")
        folder = inside.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        inside.write.parquet(kept)
        assert os.path.isdir(folder)
    assert not os.path.exists(folder) and spark.read.parquet(kept).count() == 5


def test_html_cards_of_a_page_of_open_nodes(spark):
    """Nodes that stay open outside of cards are not walked again for each end."""
    import time

    one = '<div class="card"><p class="body">one<li></i></div><p class="body">outside'
    page = spark.range(1).select(F.repeat(F.lit(one), 20_000).alias("h"))
    began = time.monotonic()
    found = page.select(F.explode(media.html_cards(F.col("h"), "card", {"text": "body"})).alias("c")).groupBy("c.text").count().collect()
    assert [tuple(r) for r in found] == [("one", 20_000)]
    assert time.monotonic() - began < 20
