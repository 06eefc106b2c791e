"""Runs of the file index over changing files."""

import os
import struct

import pytest

from archivolt.sources import file_index as I


def jpeg(date):
    text = date.encode() + b"\0"
    tiff = b"II*\0\x08\0\0\0" + struct.pack("<HHHII", 1, 0x9003, 2, len(text), 26) + b"\0\0\0\0" + text
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xc0\x00\x11\x08\x00\x07\x00\x09" + bytes(12) + b"\xff\xda"


@pytest.fixture
def library(tmp_path):
    root = tmp_path / "lib.rary"
    for i in range(12):
        path = root / f"d{i % 3}" / f"file{i}.txt"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"content {i}")
    (root / "d0" / "IMG_20240131_123005.jpg").write_bytes(jpeg("2020:01:02 03:04:05"))
    (root / "d0" / "2023-05-06 x.png").write_bytes(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 30, 20))
    return root


def counters(row):
    return (row.run, row.scanned, row.read, row.skipped, row.moved, row.pruned, row.files)


def held(spark, folder):
    return {r.path: r for r in I.indexed(spark, folder).collect()}


def test_runs_over_changing_files(spark, library, tmp_path):
    folder = str(tmp_path / "index")
    run = lambda: counters(I.index_files(spark, str(library), folder, shards=5, batch=4).first())
    assert run() == (1, 14, 14, 0, 0, 0, 14)
    rows = held(spark, folder)
    shown = rows["d0/IMG_20240131_123005.jpg"]
    assert (shown.captured, shown.capture_source, shown.width, shown.height) == ("2020:01:02 03:04:05", "exif", 9, 7)
    named = rows["d0/2023-05-06 x.png"]
    assert (named.captured, named.capture_source, named.width) == ("2023-05-06", "filename", 30)
    assert rows["d1/file1.txt"].capture_source == "filesystem" and rows["d1/file1.txt"].width is None

    files = lambda: {p for p in (tmp_path / "index" / "files").rglob("part-*.parquet")}
    before = files()
    assert run() == (2, 14, 0, 14, 0, 0, 14) and files() == before

    # One changes in place, one moves, one goes, one comes.
    (library / "d1" / "file1.txt").write_text("changed")
    os.utime(library / "d1" / "file1.txt", (1_700_000_000, 1_700_000_000))
    os.rename(library / "d2" / "file2.txt", library / "d0" / "other.txt")
    (library / "d0" / "file3.txt").unlink()
    (library / "d2" / "new.txt").write_text("new")
    assert run() == (3, 14, 3, 11, 1, 1, 14)
    rows = held(spark, folder)
    assert {p: rows[p].first_run for p in ("d1/file1.txt", "d0/other.txt", "d2/new.txt")} == {"d1/file1.txt": 1, "d0/other.txt": 1, "d2/new.txt": 3}
    assert "d2/file2.txt" not in rows and "d0/file3.txt" not in rows

    for path in library.rglob("file*.txt"):
        path.unlink()
    assert run()[5] == 10 and len(held(spark, folder)) == 4
    assert [r.run for r in sorted(I.runs(spark, folder).collect())] == [1, 2, 3, 4]


def test_a_stopped_run_goes_on(spark, library, tmp_path, monkeypatch):
    folder, facts, reads = str(tmp_path / "index"), I._facts, []

    def stopping(contents, root):
        if len(reads) == 2:
            raise KeyboardInterrupt
        reads.append(contents.count())
        return facts(contents, root)

    monkeypatch.setattr(I, "_facts", stopping)
    with pytest.raises(KeyboardInterrupt):
        I.index_files(spark, str(library), folder, batch=4)
    assert held(spark, folder) == {} and I.runs(spark, folder).count() == 0
    first = sum(reads)
    monkeypatch.setattr(I, "_facts", lambda contents, root: (reads.append(contents.count()), facts(contents, root))[1])
    assert counters(I.index_files(spark, str(library), folder, batch=4).first()) == (1, 14, 14, 0, 0, 0, 14)
    assert 0 < first < 14 and sum(reads) == 14  # no file is read twice
    assert len(held(spark, folder)) == 14


def test_tasks_do_not_grow_with_files(spark, tmp_path):
    for i in range(400):
        (tmp_path / "lib" / f"d{i}").mkdir(parents=True)
        (tmp_path / "lib" / f"d{i}" / "file.txt").write_text(f"content {i}")
    context, names = spark.sparkContext, ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.maxPartitionNum")
    before = [spark.conf.get(name, None) for name in names]
    context.setJobGroup("many-files", "many files")
    try:
        row = counters(I.index_files(spark, str(tmp_path / "lib"), str(tmp_path / "index"), shards=2).first())
        tracker = context.statusTracker()
        stages = [tracker.getStageInfo(s) for job in tracker.getJobIdsForGroup("many-files") for s in tracker.getJobInfo(job).stageIds]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert row == (1, 400, 400, 0, 0, 0, 400)
    assert 0 < max(s.numTasks for s in stages if s) <= 4 * max(context.defaultParallelism, 4) + 4
    assert [spark.conf.get(name, None) for name in names] == before
