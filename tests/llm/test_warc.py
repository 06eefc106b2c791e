import gzip
import hashlib
import uuid

import pytest

from archivolt.llm import warc as W

SCHEMA = "page_id long, url string, html string, record_type string, payload string"
LONG = "é<p>x</p>\r\n\r\nWARC/1.1\r\n" * 60


@pytest.fixture(scope="module")
def rows():
    return [
        (1, "http://a/1", LONG),
        (2, "http://a/2", LONG),
        (3, "http://a/3 b\r\nX: y", LONG),
        (4, None, "short"),
        (5, "http://a/5", "short"),
        (6, "http://a/6", None),
        (7, "http://a/7", ""),
        (8, "http://a/8", LONG * 500),
        (8, "http://a/8", LONG * 500),
        (None, "http://a/n", LONG),
    ]


def wanted(rows):
    best = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            best[h] = max(best.get(h, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = i is not None and h in best and i < best[h]
        out.append((repr(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", best[h] if again else None))
    return sorted(out, key=repr)


def test_archives_round_trip(spark, rows):
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    found = W.archive_pages(pages).collect()
    assert sorted(((repr(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == wanted(rows)


def test_archives_are_valid_records(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "FILE_ROWS", 2)
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    W.write_archive(W.crawl_records(pages), str(tmp_path / "w"))
    files = sorted((tmp_path / "w").glob("part-*"))
    seen = set()
    for file in files:
        found = list(W.parse_archive(file.read_bytes()))
        whole = gzip.decompress(file.read_bytes())  # any reader of gzip takes the members
        assert whole.count(b"WARC-Record-ID: ") == len(found)
        for headers, block in found:
            assert len(block) == int(headers["content-length"]) and "\n" not in headers.get("warc-target-uri", "")
            seen.add(headers["warc-record-id"])
    assert len(seen) == len(rows)  # ids are unique, even those of rows that repeat
    texts = {r.page_id: r.payload for r in W.read_archive(spark, str(tmp_path / "w"), payload=True).collect()}
    assert texts[3] == LONG and texts[6] == "" and texts[8] == LONG * 500


def test_files_are_bounded_in_bytes(spark, tmp_path):
    """Pages of a megabyte that hardly compress: over 100 MB, in one task."""
    pages = spark.range(40, numPartitions=1).selectExpr(
        "id AS page_id", "'http://a' AS url", "array_join(transform(sequence(1, 40000), i -> md5(string(i * 1000 + id))), '') AS html"
    )
    W.write_archive(W.crawl_records(pages), str(tmp_path / "w"))
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    largest = W.FILE_ROWS * (W.ROW_BYTES + W.MEMBER_BYTES)
    assert sum(sizes) > 25_000_000 and max(sizes) < largest and len(sizes) >= 1
    assert W.read_archive(spark, str(tmp_path / "w")).count() == 40


def test_every_member_ends_with_a_zero_byte(monkeypatch):
    monkeypatch.setattr(W, "MEMBER_BYTES", 1000)
    record = bytes(range(256)) * 17
    parts = W.members(record)
    assert len(parts) == 5 and all(p.endswith(b"\0") for p in parts) and gzip.decompress(b"".join(parts)) == record


def test_revisits_name_the_record_of_their_response(spark, rows, tmp_path):
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(2)
    W.write_archive(W.crawl_records(pages), str(tmp_path / "a"))
    W.deduplicate(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    found = W.read_archive(spark, str(tmp_path / "b")).collect()
    responses = {r.record_id: r for r in found if r.record_type == "response"}
    revisits = [r for r in found if r.record_type == "revisit"]
    assert len({r.record_id for r in found}) == len(rows) and revisits
    assert all(uuid.UUID(r.record_id) for r in found)
    assert all(responses[r.refers_to_record].payload_digest == r.payload_digest and r.block_bytes == 0 for r in revisits)


def test_damage_is_noticed():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    assert [b for _, b in W.parse_archive(gzip.compress(record) + gzip.compress(record))] == [b"abcd"] * 2
    for bad in (record[:-6], record.replace(b"WARC/1.1", b"HTTP/1.1"), record.replace(b"Length: 4", b"Length: 3")):
        with pytest.raises(ValueError):
            list(W.parse_archive(gzip.compress(bad)))


def test_empty_table(spark):
    assert W.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_hot_payload_in_many_passes(spark, monkeypatch):
    """A payload in most records, decisions of a few records at a time, and no payload in a shuffle."""
    monkeypatch.setattr(W, "PASS_RECORDS", 7)
    monkeypatch.setattr(W, "FILE_ROWS", 1)
    rows = [(i, f"http://a/{i}", LONG if i % 4 else LONG + str(i % 8)) for i in range(60)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(9)
    plans, write = [], W.write_archive
    monkeypatch.setattr(W, "write_archive", lambda records, path: (plans.append(records._jdf.queryExecution().toString()), write(records, path)))
    found = W.archive_pages(pages).collect()
    assert sorted(((repr(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == wanted(rows)
    assert len(plans) > 3 and not any("Exchange" in plan for plan in plans[1:])


def test_empty_archives(spark):
    assert W.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0
