"""Files as tables: folder listings with hashes, members of ZIP archives, JSON behind an assignment, chunked JSON, CSV queues."""

from __future__ import annotations

import io
import lzma
import struct
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from archivolt.session import default_partitions


@contextmanager
def few_tasks(spark: SparkSession) -> Iterator[None]:
    """Files that are loaded and read inside are dealt to a few tasks a core. Spark's own rule is a task for each folder or file
    that is listed, up to 10,000, and one for every 32 small files that are read, so that tasks outweigh the files."""
    tasks = 4 * max(spark.sparkContext.defaultParallelism, default_partitions(spark))
    names = ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.maxPartitionNum")
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in before.items():
        spark.conf.set(name, str(min(int(value or tasks), tasks)))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def listing(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """path, modificationTime, length of all files below a folder, hidden ones excluded; contents are not read."""
    with few_tasks(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).drop("content")
    hidden = F.col("path").rlike(r"/\.[^/]*")
    files = files.filter(~hidden)
    if extensions:
        files = files.filter(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions]))
    return files


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """relative_path, byte_size, sha256 of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    relative = F.regexp_replace("path", r"^[a-z]+:/*" + folder.split(":")[-1].strip("/").replace(".", r"\.") + "/", "")
    return files.select(relative.alias("relative_path"), F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"))


MEMBER_SCHEMA = "archive string, member string, byte_size long, crc long, content binary, issue string"
#: What a damaged archive or member raises.
_DAMAGE = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, RuntimeError, NotImplementedError, EOFError, ValueError, OSError, struct.error, OverflowError)
#: Bytes of members, and members, that a task holds before it hands them on.
_HELD, _ROWS = 1 << 23, 1 << 12


def zip_members(spark: SparkSession, folder: str, with_content: bool = True, pattern: str = "*.zip") -> DataFrame:
    """One row per member of every archive; unreadable archives and members are rows with an issue.

    Repeated member names are marked ``duplicate_member``; hidden members and folders are skipped. A task holds
    archives as they are stored, the directory of one, and members of about 8 MB, 4,096 at most.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "member", "byte_size", "crc", "content", "issue"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows, seen, held = [], set(), 0
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                    listed = archive.infolist()
                except _DAMAGE:
                    yield pd.DataFrame([(path, None, None, None, None, "unreadable_archive")], columns=columns)
                    continue
                for info in listed:
                    name = info.filename
                    if info.is_dir() or any(part.startswith((".", "__MACOSX")) for part in name.split("/")):
                        continue
                    issue, data = ("duplicate_member" if name in seen else None), None
                    seen.add(name)
                    try:
                        data = archive.read(info)
                    except _DAMAGE:
                        issue = "unreadable_member"
                    rows.append((path, name, info.file_size, info.CRC, data if with_content else None, issue))
                    held += len(data or b"")
                    if held > _HELD or len(rows) >= _ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInPandas(run, MEMBER_SCHEMA)


def member_text(content: Column) -> Column:
    """Bytes of a member as text, without a byte order mark."""
    return F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")


def dated_pairs(members: DataFrame) -> DataFrame:
    """date, image and text content of members that share a dated stem such as 2024-01-31.png and 2024-01-31.txt."""
    stem = F.regexp_extract("member", r"(\d{4}-\d{2}-\d{2})\.(png|txt)$", 1)
    kind = F.regexp_extract("member", r"(\d{4}-\d{2}-\d{2})\.(png|txt)$", 2)
    dated = members.filter("issue IS NULL").withColumn("date", F.try_to_date(stem, "yyyy-MM-dd")).withColumn("kind", kind).filter("date IS NOT NULL")
    return dated.groupBy("archive", "date").agg(
        F.any_value(F.when(F.col("kind") == "png", F.col("content")), True).alias("image"),
        F.any_value(F.when(F.col("kind") == "txt", member_text(F.col("content"))), True).alias("text"),
    )


def assigned_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of a JSON array that a script assigns, ``window.X = [...];``, or of a bare array."""
    whole = spark.read.text(path, wholetext=True)
    body = F.regexp_replace(F.regexp_replace("value", r"^﻿?\s*[\w.\[\]\"']+\s*=\s*", ""), r";\s*$", "")
    kind = schema if isinstance(schema, str) else schema.simpleString()
    return whole.select(F.explode(F.from_json(body, f"array<struct<{kind}>>" if isinstance(schema, str) else f"array<{kind}>")).alias("r")).select("r.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; broken lines are kept in ``_corrupt``."""
    return spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def chunked_records(spark: SparkSession, path: str, item_schema: str, key: str = "id") -> DataFrame:
    """Items of numbered files {count, items: [...]}: equal repeats once, different rows of one key as ``conflict``."""
    files = spark.read.schema(f"count long, items array<struct<{item_schema}>>").option("multiLine", True).json(path)
    number = F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).try_cast("int")
    return keyed_items(files.select(F.coalesce(number, F.lit(0)).alias("chunk"), F.posexplode("items").alias("place", "item")), key)


def keyed_items(items: DataFrame, key: str) -> DataFrame:
    """The first item of each key by chunk and place, and whether others of the key differ."""
    body = F.to_json("item")
    return items.groupBy(F.col("item")[key].alias(key)).agg(
        F.min_by("item", F.struct("chunk", "place")).alias("item"), (F.count_distinct(body) > 1).alias("conflict")
    )


def csv_queue(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV work queue: all strings by header, missing columns empty, nulls as empty strings."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns])


def table_count(spark: SparkSession, path: str, distinct: str | None = None) -> int | None:
    """Rows, or distinct values, of an optional Parquet table; null if it is not there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    rows = spark.read.parquet(path)
    return rows.count() if distinct is None else rows.select(distinct).distinct().count()


def archive_issues(members: DataFrame, archive: Column, first: str | None = None, last: str | None = None) -> DataFrame:
    """(archive, month, member, code) of what is wrong with monthly archives and their dated members.

    ``archive`` is the name of a member's archive, yyyy-MM if it is right. With a range of months, or the ends that
    occur where one is left out, months without an archive are named too.
    """
    found = members.withColumns({"_path": F.col("archive"), "_name": archive})
    month = F.nullif(F.regexp_extract("_name", r"^((?:19|20)\d{2}-(?:0[1-9]|1[0-2]))(?:$|[^0-9])", 1), F.lit(""))
    day = F.regexp_extract("member", r"^(\d{4}-\d{2}-\d{2})\.(png|txt)$", 1)
    found = found.withColumns({"month": month, "_day": day, "_strict": F.col("_name").rlike(r"^\d{4}-(0[1-9]|1[0-2])$")})
    dated = F.try_to_date("_day", "yyyy-MM-dd")
    code = (
        F.when(F.col("issue").isNotNull(), F.col("issue"))
        .when(F.col("_day") == "", "invalid_internal_filename")
        .when(dated.isNull(), "invalid_internal_date")
        .when(F.substring("_day", 1, 7) != F.col("month"), "member_of_other_month")
    )
    inside = found.select(F.col("_name").alias("archive"), "month", "member", code.alias("code")).filter("code IS NOT NULL")
    archives = found.select("_path", F.col("_name").alias("archive"), "month", "_strict").distinct()
    named = archives.filter(~F.col("_strict")).select("archive", "month", F.lit(None).cast("string").alias("member"), F.lit("invalid_zip_filename").alias("code"))
    several = archives.groupBy("month").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND month IS NOT NULL")
    twice = several.select(F.lit(None).cast("string").alias("archive"), "month", F.lit(None).cast("string").alias("member"), F.lit("duplicate_month").alias("code"))
    out = inside.unionByName(named).unionByName(twice)
    if first or last:
        ends = archives.agg(F.min("month").alias("a"), F.max("month").alias("b"))
        start = lambda given, seen: F.to_date(F.concat(F.lit(given) if given else F.col(seen), F.lit("-01")))
        wanted = ends.select(F.explode(F.sequence(start(first, "a"), start(last, "b"), F.expr("interval 1 month"))).alias("m"))
        gone = wanted.select(F.date_format("m", "yyyy-MM").alias("month")).join(archives.filter("month IS NOT NULL"), "month", "left_anti")
        none = F.lit(None).cast("string")
        out = out.unionByName(gone.select(none.alias("archive"), "month", none.alias("member"), F.lit("missing_month").alias("code")))
    return out


def diary_archive(members: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records of the one JSON member of each archive, media per archive and local time); several or no JSON is an error.

    Media lie in folders media/yyyy-MM-dd_HHmmss.../, whose name is the time of their entry.
    """
    is_json = F.lower("member").endswith(".json")
    odd = members.groupBy("archive").agg(F.count_if(is_json).alias("n")).filter("n <> 1").limit(1).collect()
    if odd:
        raise ValueError(f"{odd[0].archive} holds {odd[0].n} JSON files instead of one")
    documents = members.filter(is_json).select("archive", F.explode(F.from_json(member_text(F.col("content")), f"array<struct<{schema}>>")).alias("r"))
    at = F.regexp_extract("member", r"^media/(\d{4}-\d{2}-\d{2}_\d{6})[^/]*/.+", 1)
    local = F.regexp_replace(at, r"^(.{10})_(..)(..)(..)$", "$1T$2:$3:$4")
    media = members.filter(at != "").groupBy("archive", local.alias("date")).agg(F.count(F.lit(1)).alias("media"))
    return documents.select("archive", "r.*"), media


def social_entries(posts: Column, kind: str) -> Column:
    """Entries of nested post records as an array of structs: kind, timestamp, text, media, links and place.

    A post's texts are joined once each, its title comes first if no text holds it, and attachments give media and links.
    """

    def entry(r: Column) -> Column:
        texts = F.array_distinct(F.filter(F.transform(F.coalesce(r["data"], F.array().cast("array<struct<post:string>>")), lambda d: F.trim(d["post"])), lambda t: t != ""))
        body = F.array_join(texts, "\n\n")
        titled = F.when((F.coalesce(r["title"], F.lit("")) != "") & ~F.contains(body, r["title"]), F.concat_ws("\n\n", r["title"], F.nullif(body, F.lit("")))).otherwise(body)
        items = F.flatten(F.transform(r["attachments"], lambda a: a["data"]))
        return F.struct(
            F.lit(kind).alias("kind"),
            r["timestamp"].alias("timestamp"),
            titled.alias("text"),
            F.array_distinct(F.array_compact(F.transform(items, lambda i: i["media"]["uri"]))).alias("media"),
            F.array_distinct(F.array_compact(F.transform(items, lambda i: i["external_context"]["url"]))).alias("links"),
            r["place"].alias("place"),
        )

    return F.transform(posts, entry)


POST_SCHEMA = (
    "timestamp:bigint,title:string,data:array<struct<post:string>>,place:struct<latitude:double,longitude:double>,"
    "attachments:array<struct<data:array<struct<media:struct<uri:string,description:string>,external_context:struct<name:string,url:string>>>>>"
)


def staged_records(documents: DataFrame, document: str, adapter: dict[str, str | dict[str, str]]) -> DataFrame:
    """JSON documents in the staging schema, by an adapter's selectors; documents without a source id are left out."""
    fields = adapter["fields"]
    one = lambda name: F.get_json_object(F.col(document), fields[name]) if name in fields else F.lit(None).cast("string")

    def many(name: str) -> Column:
        if name not in fields:
            return F.array().cast("array<string>")
        held = F.get_json_object(F.col(document), fields[name])
        listed = F.when(held.startswith("["), F.from_json(held, "array<string>")).otherwise(F.array(held))
        return F.coalesce(F.filter(listed, lambda x: F.coalesce(x, F.lit("")) != ""), F.array().cast("array<string>"))

    staged = documents.select(
        F.lit(adapter["adapter_id"]).alias("adapter_id"),
        F.lit(adapter["source_name"]).alias("source_name"),
        one("source_id").alias("source_id"),
        one("timestamp").alias("timestamp"),
        one("text").alias("text"),
        many("urls").alias("urls"),
        many("media_references").alias("media_references"),
        one("latitude").try_cast("double").alias("latitude"),
        one("longitude").try_cast("double").alias("longitude"),
        one("place_name").alias("place_name"),
    )
    return staged.filter("source_id IS NOT NULL AND source_id <> ''")


def index_rows(files: DataFrame, path: str, size: str, modified: str, capture: Column | None = None) -> DataFrame:
    """One index row per file: name, extension, size, time, dates with their source, and quality words."""
    from archivolt.functions import records, values

    name = F.regexp_extract(path, r"[^/]+$", 0)
    dates = values.filename_dates(name)
    taken = F.lit(None).cast("date") if capture is None else F.to_date(capture)
    quality = records.quality_score(name)
    return files.select(
        F.col(path).alias("path"),
        name.alias("filename"),
        F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"),
        F.col(size).alias("byte_size"),
        F.col(modified).alias("modified"),
        F.coalesce(taken, F.try_element_at(dates, F.lit(1)), F.to_date(modified)).alias("best_date"),
        F.when(taken.isNotNull(), "capture").when(F.size(dates) > 0, "filename").otherwise("filesystem").alias("date_source"),
        quality["score"].alias("quality"),
    )


def marked_folders(spark: SparkSession, root: str, markers: dict[str, str]) -> DataFrame:
    """(kind, folder, n) of the folders below a root that hold each kind's marker file; n over one is ambiguous."""
    files = listing(spark, root).select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"[^/]+$", 0).alias("name"))
    kind = F.coalesce(*[F.when(F.col("name").rlike(pattern), k) for k, pattern in markers.items()])
    found = files.select(kind.alias("kind"), "folder").filter("kind IS NOT NULL").distinct()
    return found.groupBy("kind").agg(F.min("folder").alias("folder"), F.count(F.lit(1)).alias("n"))


def latest_documents(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Of JSON reports in several files the newest one of each key: by the file's time, then its name."""
    rows = spark.read.schema(schema).json(path).select("*", F.struct("_metadata.file_modification_time", "_metadata.file_name").alias("_at"))
    names = [c for c in rows.columns if c not in (key, "_at")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "_at").alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in names])


ALBUM_SCHEMA = (
    "name string, description string, last_modified_timestamp long, "
    "photos array<struct<uri:string,creation_timestamp:long,title:string,description:string>>, "
    "cover_photo struct<uri:string,creation_timestamp:long,title:string,description:string>"
)


def _filled(text: Column) -> Column:
    """A text without space around it, null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def album_photos(albums: DataFrame) -> DataFrame:
    """source, place, uri, taken, undated, caption, name, about of each photo of albums (source, and ``ALBUM_SCHEMA``), the cover last."""
    cover = F.when(F.col("cover_photo").isNotNull(), F.array("cover_photo")).otherwise(F.array())
    listed = albums.select("source", "name", "description", "last_modified_timestamp", F.posexplode(F.concat(F.coalesce("photos", F.array()), cover)).alias("place", "photo"))
    name = _filled(F.col("name"))
    title = _filled(F.col("photo.title"))
    return listed.select(
        "source",
        "place",
        _filled(F.col("photo.uri")).alias("uri"),
        F.coalesce("photo.creation_timestamp", "last_modified_timestamp").alias("taken"),
        F.col("photo.creation_timestamp").isNull().alias("undated"),
        F.coalesce(_filled(F.col("photo.description")), F.when(~title.eqNullSafe(name), title)).alias("caption"),
        name.alias("name"),
        _filled(F.col("description")).alias("about"),
    ).filter("uri IS NOT NULL")


def album_entries(albums: DataFrame, attached: DataFrame, key: str = "uri") -> tuple[DataFrame, DataFrame]:
    """Entries of albums, and what albums add to media that entries hold already.

    Entries: source, timestamp (of the first photo), text, media (place, uri, caption, taken), date_source. A photo that an
    entry holds is no part of an album's entry; of photos in several albums the first by source and place counts; albums
    left without photos give no entry. Additions: uri, caption, taken, the first by source and place of each.
    """
    photos = album_photos(albums)
    held = attached.select(F.col(key).alias("uri")).distinct()
    undated = photos.groupBy("source").agg(F.bool_or("undated").alias("any_undated"))
    order = F.struct("source", "place")
    firsts = photos.join(held, "uri", "left_anti").groupBy("uri").agg(F.min_by(F.struct(*photos.columns), order).alias("p")).select("p.*")
    text = F.concat_ws("\n\n", F.coalesce(F.concat(F.lit("Album: "), F.col("name")), F.lit("Photo album")), F.col("about"))
    grouped = firsts.groupBy("source", text.alias("text")).agg(
        F.min("taken").alias("timestamp"), F.sort_array(F.collect_list(F.struct("place", "uri", "caption", "taken"))).alias("media")
    )
    source = F.when(F.col("any_undated"), "album_last_modified").otherwise("album_first_photo")
    entries = grouped.join(undated, "source").select("source", "timestamp", "text", "media", source.alias("date_source"))
    added = photos.join(held, "uri").groupBy("uri").agg(
        F.min(F.when(F.col("caption").isNotNull(), F.struct("source", "place", "caption")))["caption"].alias("caption"), F.min(F.struct("source", "place", "taken"))["taken"].alias("taken")
    )
    return entries, added


def unlinked_comments(comments: DataFrame) -> DataFrame:
    """One row: comments (``comments_v2`` with data, comment, comment) that have a text. They name no post, so none becomes an entry."""
    texts = comments.select(F.explode("comments_v2").alias("c")).select(F.explode("c.data").alias("d")).select(_filled(F.col("d.comment.comment")).alias("text"))
    return texts.agg(F.count("text").alias("unlinked_comments"))
