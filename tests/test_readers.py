"""Readers of damaged files give null or an issue, and never hang or raise."""

import io
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivolt.functions import values
from archivolt.sources import files, media, packages


def bmp(width, height, bits=24):
    row = (width * bits // 8 + 3) // 4 * 4
    body = bytes(i % 251 for i in range(row * height))
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, len(body), 0, 0, 0, 0) + body


def ppm(width, height, most=255, comment=b""):
    size = width * height * 3
    body = bytes(i % 256 for i in range(size)) if most < 256 else struct.pack(f">{size}H", *[(i * 977) % (most + 1) for i in range(size)])
    return b"P6\n" + comment + f"{width} {height}\n{most}\n".encode() + body


@pytest.mark.parametrize("whole", [bmp(3, 2), bmp(2, 3, 32), ppm(3, 2), ppm(2, 2, 65535), ppm(2, 2, 255, b"# a comment\n")])
def test_every_cut_length_is_null(whole):
    assert media.pixels(whole) is not None
    for n in range(len(whole)):
        assert media.pixels(whole[:n]) is None
        media.image_size(whole[:n])


def test_random_damage_never_raises():
    rng = random.Random(1)
    for whole in (bmp(5, 4), ppm(5, 4), b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x07\x00\x09" + bytes(20)):
        for _ in range(300):
            data = bytearray(whole)
            for _ in range(rng.randrange(1, 6)):
                data[rng.randrange(len(data))] = rng.randrange(256)
            media.pixels(bytes(data))
            media.image_size(bytes(data))


def test_wide_samples_and_long_comments():
    found = media.pixels(ppm(2, 2, 65535))
    wide = np.array([(i * 977) % 65536 for i in range(12)]).reshape(2, 2, 3)
    assert (found == np.rint(wide * (255 / 65535))).all() and found.dtype == np.uint8
    long = ppm(3, 2, 255, b"#" + b"x" * 300_000 + b"\n# and another\n")
    assert media.image_size(long) == (3, 2)
    assert media.pixels(long).shape == (2, 3, 3)


def test_jpeg_sizes_behind_fill_bytes_and_short_markers():
    frame = b"\xff\xc2\x00\x11\x08\x00\x07\x00\x09" + bytes(12)
    assert media.image_size(b"\xff\xd8\xff\xff\xff\xe0\x00\x04ab\xff\x01\xff\xd0\xff\xff" + frame) == (9, 7)


def test_damaged_archives(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for i in range(3):
            archive.writestr(f"m{i}.txt", bytes(random.Random(i).randrange(256) for _ in range(400)) + b"a" * 400)
    whole, rng = out.getvalue(), random.Random(5)
    for k in range(60):
        data = bytearray(whole)
        for _ in range(3):
            data[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
        (tmp_path / f"a{k}.zip").write_bytes(bytes(data[: rng.randrange(len(data))] if k % 5 == 0 else data))
    rows = files.zip_members(spark, str(tmp_path)).collect()
    assert len({r.archive for r in rows}) == 60
    assert {r.issue for r in rows} >= {"unreadable_archive", "unreadable_member"}
    assert all((r.content is None) == (r.issue in ("unreadable_archive", "unreadable_member")) for r in rows)


def test_names_with_dates_and_times(spark):
    names = ["2024-01_31 x", "2024.01.31", "x20240131_123005", "2024-01-31 12.30.05", "20240230", "2024-02-30T101010", "120240131", "2024-01-31_99", None, "2024-01-31 2024-01-31"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    found = {r.i: ([str(d) for d in r.d or []], [str(t) for t in r.t or []]) for r in rows.select("i", values.filename_dates(F.col("n")).alias("d"), values.filename_timestamps(F.col("n")).alias("t")).collect()}
    noon = ["2024-01-31 12:30:05"]
    assert found == {0: (["2024-01-31"], []), 1: ([], []), 2: (["2024-01-31"], noon), 3: (["2024-01-31"], noon), 4: ([], []), 5: ([], []), 6: ([], []), 7: (["2024-01-31"], []), 8: ([], []), 9: (["2024-01-31"], ["2024-01-31 20:24:01"])}


def test_reports_hold_every_row(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"<b>&'\"|{i}\nx") for i in range(1000)], "id int, `a.b` string").repartition(7)
    packages.write_report(rows, str(tmp_path), "T & <T>")
    text = {k: "".join(p.read_text() for p in sorted((tmp_path / k).glob("part-*"))).splitlines() for k in ("markdown", "html")}
    assert text["html"][0] == "<h1>T &amp; &lt;T&gt;</h1>" and text["html"][-1] == "</table>" and len(text["html"]) == 1003
    assert text["html"][2] == "<tr><td>0</td><td>&lt;b&gt;&amp;&#x27;&quot;|0 x</td></tr>"
    assert text["markdown"][:4] == ["# T & <T>", "", "| id | a.b |", "| --- | --- |"] and text["markdown"][4] == "| 0 | <b>&'\"\\|0 x |"
    assert [int(line.split(" | ")[0].strip("| ")) for line in text["markdown"][4:]] == list(range(1000))
