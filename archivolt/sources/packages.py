"""Package sinks: nested JSON entries, manifests, reports."""

from __future__ import annotations

import html
import io
import warnings
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.session import default_partitions


def entry_documents(entries: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """Entries with their media as an ordered array of structs; media carry the key and ``position``."""
    fields = [c for c in media.columns if c != key]
    nested = media.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", *[c for c in fields if c != "position"]))).alias("media"))
    return entries.join(nested, key, "left")


def write_package(entries: DataFrame, media: DataFrame, key: str, path: str) -> DataFrame:
    """Write ``entries`` as JSON lines and ``manifest`` as CSV below a folder; returns one row of counts and warnings
    of what was written."""
    documents = entry_documents(entries, media, key)
    documents.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/entries")
    media.write.mode("overwrite").option("header", True).csv(f"{path}/manifest")
    written = entries.sparkSession.read.schema("media array<struct<position:long>>").json(f"{path}/entries")
    n = F.count(F.lit(1))
    return written.agg(
        n.alias("entries"),
        F.coalesce(F.sum(F.size(F.coalesce("media", F.array()))), F.lit(0)).alias("media"),
        F.count_if(F.col("media").isNull()).alias("entries_without_media"),
    )


def _escaped(text: Column, marks: dict[str, str]) -> Column:
    for mark, written in marks.items():
        text = F.replace(text, F.lit(mark), F.lit(written))
    return text


def write_report(rows: DataFrame, path: str, title: str) -> None:
    """Write rows as CSV and JSON, and all of them in the order of the columns as Markdown and HTML tables.

    The tables are lines that Spark sorts and writes; read in the order of their names, the part files are one document.
    """
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/json")
    names = rows.columns
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names]
    in_html = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"}
    in_markdown = {"|": "\\|", "\n": " "}
    cells = [F.concat(F.lit("<td>"), _escaped(F.replace(t, F.lit("\n"), F.lit(" ")), in_html), F.lit("</td>")) for t in texts]
    pages = {
        "markdown": (
            [f"# {title}", "", f"| {' | '.join(names)} |", f"|{' --- |' * len(names)}"],
            F.concat(F.lit("| "), F.concat_ws(" | ", *[_escaped(t, in_markdown) for t in texts]), F.lit(" |")),
            [],
        ),
        "html": (
            [f"<h1>{html.escape(title)}</h1>", f"<table><tr>{''.join(f'<th>{html.escape(n)}</th>' for n in names)}</tr>"],
            F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")),
            ["</table>"],
        ),
    }
    for name, (head, line, foot) in pages.items():
        keys = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(names)]
        body = rows.select(F.lit(len(head)).alias("_at"), line.alias("value"), *keys)
        fixed = [(i, text) for i, text in enumerate(head)] + [(len(head) + 1 + i, text) for i, text in enumerate(foot)]
        frame = rows.sparkSession.createDataFrame(fixed, "_at int, value string")
        lines = body.unionByName(frame, allowMissingColumns=True).orderBy("_at", *[f"_k{i}" for i in range(len(names))])
        lines.select("value").write.mode("overwrite").text(f"{path}/{name}")


def gate(rows: DataFrame, checks: dict[str, object]) -> None:
    """Raise with all checks that some row fails; nothing is written past a failed gate."""
    counts = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()]).first()
    failed = {name: counts[name] for name in checks if counts[name]}
    if failed:
        raise ValueError(f"gate failed: {failed}")


def zipped(members: Column) -> Column:
    """A ZIP archive of an array of (name, content), but for its last byte, which is a line end.

    The archive's comment is one line end, so that ``write_each`` completes the file. A task holds one archive, and its
    members as Arrow has them.
    """

    def pack(held: pa.StructArray) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.comment = b"\n"
            with warnings.catch_warnings():
                warnings.simplefilter("ignore", UserWarning)  # a name may repeat
                for name, content in zip(held.field("name"), held.field("content"), strict=True):
                    archive.writestr(zipfile.ZipInfo(name.as_py()), content.as_py())
        return out.getvalue()[:-1]

    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        return pa.array((pack(held.values) if held.is_valid else None for held in values), pa.binary())

    return run(members)


def write_each(rows: DataFrame, content: str, path: str, folder: str) -> None:
    """A file for each row, below a folder named after its value of ``folder``; a line end follows the content.

    Spark's own writer puts out the bytes as they are, into any store. A file costs the same however small it is, so rows are
    dealt to all tasks: a small table is one partition, whose task would write every file.
    """
    held = rows.select(F.col(content).cast("string").alias("value"), folder)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, default_partitions(rows.sparkSession))
    held.repartition(tasks, folder).write.partitionBy(folder).option("maxRecordsPerFile", 1).text(path)


def folder_of(path: Column, folder: str) -> Column:
    """The folder that ``write_each`` gave a file."""
    return F.regexp_extract(path, rf"/{folder}=([^/]+)/", 1)


def snapshot(folders: dict[str, DataFrame], path: str) -> DataFrame:
    """Copy tables below a folder; returns name, rows and a digest of the rows in any order for each."""
    out = None
    for name, rows in folders.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
        kept = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{name}")
        row = F.xxhash64(*kept.columns)
        part = kept.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("digest"))
        part = part.select(F.lit(name).alias("name"), "rows", "digest")
        out = part if out is None else out.unionByName(part)
    return out
