"""Operator 7: WARC archives and the resolution of revisit records.

A record is a WARC/1.1 header, built by column functions, and a block of UTF-8 text. Each record is a gzip member of its
own, so that readers can seek to it; a record of ``MEMBER_BYTES`` or more is cut into several. Tasks join members into
rows of about ``ROW_BYTES``, and Spark's own text writer puts at most ``FILE_ROWS`` rows into a file, through its commit
protocol into any store that Spark writes: files are bounded in bytes. A member ends with a zero byte (the high byte of
its length), which is what the writer is told to put after each row. Archives are read back as binary files and parsed
from a decompressing stream by Content-Length, so a reading task holds one compressed file and one record.

``deduplicate`` reads the headers of an archive, shuffles them by payload digest (a combinable maximum, so a
payload in a third of all records is one partial row per task), joins them to their originals, and writes a second archive
with fresh headers in which every repeated payload but one is a revisit record that refers to the original response.
Payloads are in no shuffle: the archive's files are read again, in passes that each know the decisions on their files. ``resolve`` joins
revisit records to their responses by record id.

Record ids are UUIDs: random in the first archive, and in the second derived from those of the first, so that a revisit
can name its response. Page ids go into a header of their own, for they may be null or repeat.

Defined cases: a null payload is empty; payloads under ``LEAST_BYTES`` are always responses; of equal payloads the
record with the largest id is the response; rows that repeat an id and its payload are all responses if the id is
the largest, else all revisits; a null id is never a reference and its record is a response; extra columns are
ignored; an empty table gives empty archives.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm._io import materialize, new_path

LEAST_BYTES = 1000
CRLF = "\r\n"
END = CRLF * 2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes before compression of one gzip member, below 2^24 so that the high byte of its length is zero.
MEMBER_BYTES = 1 << 23
#: Compressed bytes of one row of the writer, but for its last member, and rows of one file: about 64 MB.
ROW_BYTES, FILE_ROWS = 1 << 22, 16
#: Revisits whose ids are broadcast at once, about 100 MB.
PASS_RECORDS = 1 << 19

#: Columns of a parsed record; everything but the payload comes from its headers.
SCHEMA = (
    "page_id long, record_id string, record_type string, target_uri string, warc_date string, payload_digest string, "
    "payload_bytes long, refers_to_record string, block_bytes long, archive string"
)


def _line(name: str, value: Column) -> Column:
    """A header line; none for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _record(body: Column) -> Column:
    """One record from its columns."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"), body)
    block = F.when(revisit, F.lit("")).otherwise(http)
    uri = F.regexp_replace("target_uri", r"[\x00-\x20\x7f]+", "%20")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        _line("WARC-Target-URI", uri),
        _line("WARC-Date", F.col("warc_date")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to_record"), F.lit(">"))),
        _line("X-Page-ID", F.col("page_id").cast("string")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
        F.lit(END),
    )


def members(record: bytes) -> list[bytes]:
    """The gzip members of a record, each with a zero byte at its end."""
    out = []
    for start in range(0, len(record), MEMBER_BYTES):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(packer.compress(record[start : start + MEMBER_BYTES]) + packer.flush())
    return out


def write_archive(records: DataFrame, path: str) -> None:
    """Write records (page_id, record_id, record_type, target_uri, warc_date, payload_digest, refers_to_record, payload)."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for record in batch.column(0).cast(pa.binary()):
                for member in members(record.as_py()):
                    held.append(member)
                    size += len(member)
                    if size >= ROW_BYTES:
                        yield row(held)
                        held, size = [], 0
        if held:
            yield row(held)

    def row(held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])

    rows = records.select(_record(F.coalesce("payload", F.lit(""))).alias("value")).mapInArrow(run, "value binary")
    # The writer puts out the bytes of a string as they are.
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_ROWS).mode("append").text(path)


class _Stream:
    """Bytes of a gzipped archive, decompressed as they are asked for."""

    def __init__(self, data: bytes, step: int = 1 << 16):
        self.data, self.at, self.step = memoryview(data), 0, step
        self.inflate = zlib.decompressobj(31)
        self.buffer = bytearray()
        self.start = 0

    def _more(self) -> bool:
        if self.inflate.eof:
            self.at -= len(self.inflate.unused_data)
            self.inflate = zlib.decompressobj(31)
        if self.at >= len(self.data):
            return False
        self.buffer += self.inflate.decompress(self.data[self.at : self.at + self.step])
        self.at = min(self.at + self.step, len(self.data))
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (found := self.buffer.find(mark, self.start)) < 0:
            if not self._more():
                return None
        out = bytes(self.buffer[self.start : found])
        self._skip(found + len(mark))
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.start < n:
            if not self._more():
                raise ValueError("an archive ends inside a record")
        out = bytes(self.buffer[self.start : self.start + n])
        self._skip(self.start + n)
        return out

    def _skip(self, to: int) -> None:
        self.start = to
        if self.start > 1 << 22:
            del self.buffer[: self.start]
            self.start = 0


def parse_archive(data: bytes):
    """(headers, block) of each record of a gzipped archive."""
    stream = _Stream(data)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8").split(CRLF)
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines[1:])}
        block = stream.take(int(headers["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end with blank lines")
        yield headers, block


def _identity(value: str | None) -> str | None:
    return value[1:-1] if value else None


def read_archive(spark: SparkSession, path: str | list[str], payload: bool = False, revisits: dict[str, str] | None = None) -> DataFrame:
    """One row per record: SCHEMA, and the payload on request. Records that ``revisits`` names come as revisits of the record
    that it gives, without their payload; it is broadcast."""
    known = spark.sparkContext.broadcast(revisits or {})
    schema = SCHEMA + (", payload string" if payload else "")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                archive, rows, size, again = name.as_py(), [], 0, known.value
                for headers, block in parse_archive(content.as_py()):
                    kind = headers["warc-type"]
                    body = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    if body is not None and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"payload of {headers.get('warc-record-id')} does not match its digest")
                    page, identity = headers.get("x-page-id"), _identity(headers["warc-record-id"])
                    original = again.get(identity)
                    row = (
                        None if page is None else int(page),
                        identity,
                        kind if original is None else "revisit",
                        headers.get("warc-target-uri"),
                        headers.get("warc-date"),
                        digest,
                        None if body is None else len(body),
                        original or _identity(headers.get("warc-refers-to")),
                        len(block),
                        archive,
                    )
                    if payload:
                        row = (*row, None if body is None or original else body.decode("utf-8"))
                        size += len(block)
                    rows.append(row)
                    if len(rows) >= 5_000 or size > 1 << 23:
                        yield _batch(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(run, schema)


_TYPES = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "block_bytes": pa.int64()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], names)


def crawl_records(pages: DataFrame, date: Column | None = None) -> DataFrame:
    """A response record for each row of a table of pages, with a random id; without a date it has the present one."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.concat(F.lit("urn:uuid:"), F.uuid()).alias("record_id"),
        F.lit("response").alias("record_type"),
        F.col("url").cast("string").alias("target_uri"),
        (F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date is None else date).alias("warc_date"),
        F.sha1(body.cast("binary")).alias("payload_digest"),
        F.lit(None).cast("string").alias("refers_to_record"),
        body.alias("payload"),
    )


def derived_id(record_id: Column) -> Column:
    """The id that a record of the first archive has in the second: a name-based UUID (version 5) of its own."""
    name = F.sha1(record_id.cast("binary"))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(name, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(
        F.lit("urn:uuid:"), F.substring(name, 1, 8), F.lit("-"), F.substring(name, 9, 4), F.lit("-5"), F.substring(name, 14, 3),
        F.lit("-"), variant, F.substring(name, 18, 3), F.lit("-"), F.substring(name, 21, 12),
    )


def originals(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """payload_digest and original (its largest id) of payloads that several ids share, and one record of that id."""
    last = F.max(F.struct("page_id", "record_id"))
    return (
        headers.filter((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
        .groupBy("payload_digest", "payload_bytes")
        .agg(last["page_id"].alias("original"), last["record_id"].alias("original_record"), F.min("page_id").alias("lowest"))
        .filter("lowest < original")
        .drop("lowest")
    )


def _passes(spark: SparkSession, headers: DataFrame, decided: DataFrame):
    """(files, revisits) of passes over the archive: each of its files is read once, with the decisions on its own records."""
    counted = {r.archive: r.n for r in decided.groupBy("archive").agg(F.count(F.lit(1)).alias("n")).collect()}
    rest = [r.archive for r in headers.select("archive").distinct().collect() if r.archive not in counted]
    groups, held = [rest], 0
    for archive in sorted(counted):
        if held + counted[archive] > PASS_RECORDS or len(groups) == 1:
            groups.append([])
            held = 0
        groups[-1].append(archive)
        held += counted[archive]
    for files in filter(None, groups):
        rows = decided.filter(F.col("archive").isin(files)).select("record_id", "original_record").toArrow() if files is not rest else None
        yield files, {} if rows is None else dict(zip(*(rows[c].to_pylist() for c in ("record_id", "original_record")), strict=True))


def deduplicate(spark: SparkSession, source: str, target: str, least_bytes: int = LEAST_BYTES) -> None:
    """Rewrite an archive so that repeated payloads are revisit records with fresh headers.

    Headers alone are shuffled, by digest. Payloads go from file to file within a task: the decisions on the records of
    some files, at most ``PASS_RECORDS`` but for those of one file, are broadcast to the tasks that read these files.
    """
    headers = materialize(read_archive(spark, source), "headers")
    first = materialize(originals(headers, least_bytes), "originals")
    again = headers.join(first, ["payload_digest", "payload_bytes"]).filter(F.col("page_id") < F.col("original"))
    decided = materialize(again.select("archive", "record_id", "original_record"), "revisits")
    if headers.isEmpty():
        write_archive(read_archive(spark, source, payload=True), target)
    for files, revisits in _passes(spark, headers, decided):
        write_archive(
            read_archive(spark, files, True, revisits).select(
                "page_id",
                derived_id(F.col("record_id")).alias("record_id"),
                "record_type",
                "target_uri",
                "warc_date",
                "payload_digest",
                derived_id(F.col("refers_to_record")).alias("refers_to_record"),
                "payload",
            ),
            target,
        )


def resolve(records: DataFrame) -> DataFrame:
    """Records with payload_bytes of revisits taken from the response they refer to, and its page id as refers_to."""
    responses = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("original_bytes")
    )
    plain = records.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    # Only responses that are referred to are wanted, and each once: their ids are distinct.
    revisits = (
        records.filter("record_type = 'revisit'")
        .drop("payload_bytes")
        .join(responses, "refers_to_record", "left")
        .withColumnRenamed("original_bytes", "payload_bytes")
    )
    return plain.unionByName(revisits)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives."""
    spark = pages.sparkSession
    crawl, deduplicated = new_path(spark, "crawl-warc"), new_path(spark, "warc")
    write_archive(crawl_records(pages), crawl)
    deduplicate(spark, crawl, deduplicated)
    records = materialize(read_archive(spark, deduplicated), "records")
    return resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
