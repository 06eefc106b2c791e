"""Queries of sources and sinks: files are written to the shared folder from a table and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.functions import records, values
from archivolt.operators import crops, upsert
from archivolt.plans._base import collector
from archivolt.session import partitions_for, table
from archivolt.sources import file_index, files, media, packages
from archivolt.storage import new_path, remove

QUERIES, ORACLES, query = collector()


def _bytes(column: Column) -> Column:
    return F.encode(column, "UTF-8")


# -- archives -----------------------------------------------------------------------------------------------------

_MONTHS = """
WITH d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%m') AS m, count(*) AS n FROM orders GROUP BY 1, 2, 3),
k AS (SELECT DISTINCT month, m FROM d WHERE m <> '07')
"""


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of an archive for each month but July, with some that are wrong, as read back from ZIP files."""
    days = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days = days.withColumns({"month": F.substring("day", 1, 7), "m": F.substring("day", 6, 2)}).filter("m <> '07'")
    text = F.concat(F.lit("﻿"), F.col("n").cast("string"))

    def member(name: Column, content: Column) -> Column:
        return F.struct(name.alias("name"), _bytes(content).alias("content"))

    held = days.select(
        "month", F.explode(F.array(member(F.concat("day", F.lit(".png")), F.lit("image")), member(F.concat("day", F.lit(".txt")), text))).alias("member")
    )
    months = days.select("month", "m").distinct()
    wrong = F.when(F.col("m") == "03", "notes/readme.txt").when(F.col("m") == "02", F.concat("month", F.lit("-30.txt"))).when(F.col("m") == "05", F.lit("1990-01-01.png"))
    odd = months.select("month", member(wrong, F.lit("x")).alias("member")).filter("member.name IS NOT NULL")
    name = F.when(F.col("month").endswith("-09"), F.concat("month", F.lit(" copy"))).otherwise(F.col("month"))
    whole = held.unionByName(odd).groupBy("month").agg(F.array_sort(F.collect_list("member")).alias("members"))
    extra = whole.filter("month LIKE '%-11'").select("month", F.slice("members", 1, 1).alias("members"))
    path = new_path(spark, "archives")
    rows = whole.unionByName(extra).select(name.alias("name"), packages.zipped(F.col("members")).alias("content"))
    packages.write_each(rows, "content", path, "name")
    return files.zip_members(spark, path, pattern="part-*")


@query(_MONTHS + """
SELECT CASE WHEN m = '09' THEN month || ' copy' ELSE month END AS archive, month, CASE m WHEN '03' THEN 'notes/readme.txt' WHEN '02' THEN month || '-30.txt' ELSE '1990-01-01.png' END AS member,
  CASE m WHEN '03' THEN 'invalid_internal_filename' WHEN '02' THEN 'invalid_internal_date' ELSE 'member_of_other_month' END AS code FROM k WHERE m IN ('02', '03', '05')
UNION ALL SELECT month || ' copy', month, NULL, 'invalid_zip_filename' FROM k WHERE m = '09'
UNION ALL SELECT NULL, month, NULL, 'duplicate_month' FROM k WHERE m = '11'
UNION ALL SELECT NULL, strftime(x, '%Y-%m'), NULL, 'missing_month' FROM (SELECT unnest(generate_series(TIMESTAMP '1994-12-01', (SELECT max(month) || '-01' FROM k)::TIMESTAMP, INTERVAL 1 MONTH)) AS x) WHERE strftime(x, '%Y-%m') NOT IN (SELECT month FROM k)
""")
def s01_archive_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with monthly archives: names, members, dates, months that occur twice or are missing."""
    members = _archives(spark, sf_dir)
    return files.archive_issues(members, F.regexp_replace(packages.folder_of(F.col("archive"), "name"), "%20", " "), first="1994-12")


@query(_MONTHS + "SELECT CAST(day AS DATE) AS date, CAST(n AS VARCHAR) AS text, 5 AS image_bytes FROM d WHERE m <> '07'")
def s02_dated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and texts of archives that share a date, the text without its byte order mark."""
    pairs = files.dated_pairs(_archives(spark, sf_dir).filter("member <> '1990-01-01.png'"))
    return pairs.groupBy("date").agg(F.max("text").alias("text"), F.max(F.octet_length("image")).alias("image_bytes"))


@query("""
SELECT c_mktsegment AS archive, c_custkey AS id, strftime(TIMESTAMP '2024-01-01 08:00:00' + to_minutes(CAST(c_custkey AS INTEGER)), '%Y-%m-%dT%H:%M:%S') AS date, (c_custkey % 3)::BIGINT AS media FROM customer
""")
def s16_diary_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diaries in archives of one JSON document each, with the media that lie in folders named after the entry's time.

    A diary of many entries has several archives, by spans of ids, so that none grows with the table.
    """
    at = F.timestamp_add("MINUTE", F.col("c_custkey").cast("int"), F.lit("2024-01-01 08:00:00").cast("timestamp_ntz"))
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_custkey").alias("id"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("date"), F.date_format(at, "yyyy-MM-dd_HHmmssSSS").alias("folder"))
    photo = lambda i: F.struct(F.concat(F.lit("media/"), F.col("folder"), F.lit("/"), i.cast("string"), F.lit(".jpg")).alias("name"), _bytes(F.lit("x")).alias("content"))
    photos = F.transform(F.filter(F.sequence(F.lit(0), F.lit(1)), lambda i: i < F.col("id") % 3), photo)
    grouped = rows.groupBy("c_mktsegment", F.floor(F.col("id") / 50_000).alias("span")).agg(F.array_sort(F.collect_list(F.struct("id", "date"))).alias("entries"), F.flatten(F.collect_list(photos)).alias("photos"))
    document = F.struct(F.lit("diary.json").alias("name"), _bytes(F.to_json("entries")).alias("content"))
    path = new_path(spark, "diaries")
    packages.write_each(grouped.select("c_mktsegment", packages.zipped(F.concat(F.array(document), "photos")).alias("content")), "content", path, "c_mktsegment")
    found, counts = files.diary_archive(files.zip_members(spark, path, pattern="part-*"), "id:bigint,date:string")
    return found.join(counts, ["archive", "date"], "left").select(
        packages.folder_of(F.col("archive"), "c_mktsegment").alias("archive"), "id", "date", F.coalesce("media", F.lit(0)).alias("media")
    )


@query("SELECT n_name AS name, n_nationkey AS id, 'n' || n_nationkey || '.txt' AS file, length(n_name) AS bytes FROM nation")
def s17_repackaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package in an archive, emitted again as CSV rows with the sizes of their attachments."""
    file = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".txt"))
    rows = table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), file.alias("file"))
    member = lambda name, content: F.struct(name.alias("name"), _bytes(content).alias("content"))
    grouped = rows.groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("id", "name", "file"))).alias("m"), F.collect_list(member(F.concat(F.lit("photos/"), "file"), F.col("name"))).alias("attached"))
    path, out = new_path(spark, "package"), new_path(spark, "csv")
    packed = packages.zipped(F.concat(F.array(member(F.lit("manifest.json"), F.col("m"))), "attached"))
    packages.write_each(grouped.select("n_regionkey", packed.alias("content")), "content", path, "n_regionkey")
    members = files.zip_members(spark, path, pattern="part-*")
    entries, _ = files.diary_archive(members, "id:int,name:string,file:string")
    sizes = members.filter("member LIKE 'photos/%'").select("archive", F.regexp_extract("member", "[^/]+$", 0).alias("file"), F.col("byte_size").alias("bytes"))
    entries.join(sizes, ["archive", "file"]).select("name", "id", "file", "bytes").write.option("header", True).csv(out)
    return files.csv_queue(spark, out, ["name", "id", "file", "bytes"]).select("name", F.col("id").cast("int"), "file", F.col("bytes").cast("long"))


# -- listings and texts -------------------------------------------------------------------------------------------


@query("SELECT CAST(r_regionkey AS VARCHAR) AS folder, length(r_name) + 1 AS length, sha256(r_name || chr(10)) AS sha256 FROM region")
def s03_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files of a folder, not the JSON ones beside them, with their sizes and digests."""
    path = new_path(spark, "listing")
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("folder"), _bytes(F.col("r_name")).alias("content"))
    packages.write_each(rows, "content", path, "folder")
    rows.select("folder").write.json(f"{path}/folder=json")
    listed = files.listing(spark, path, ["txt"]).select("path", "length")
    digests = files.manifest(spark, path).select(F.concat(F.lit("/"), "relative_path").alias("relative_path"), "sha256")
    joined = listed.join(digests, packages.folder_of(F.col("path"), "folder") == packages.folder_of(F.col("relative_path"), "folder"))
    return joined.select(packages.folder_of(F.col("path"), "folder").alias("folder"), "length", "sha256").filter("folder <> 'json'")


@query("""
SELECT p_partkey, 'jpg' AS extension, CASE WHEN p_partkey % 2 = 0 THEN DATE '1997-03-01' ELSE DATE '2020-05-06' END AS best_date, CASE WHEN p_partkey % 2 = 0 THEN 'filename' ELSE 'filesystem' END AS date_source, CASE WHEN p_partkey % 2 = 0 THEN 40 ELSE -35 END AS quality FROM part
""")
def s04_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows of files: dates by their source, quality by the words of the name."""
    name = F.concat(F.lit("/lib/2/"), F.when(F.col("p_partkey") % 2 == 0, "IMG_19970301_edited").otherwise("small"), F.lit(".JPG"))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("path"), F.col("p_size").alias("size"), F.lit("2020-05-06 07:08:09").cast("timestamp").alias("at"))
    shared = files.index_rows(rows.withColumn("path", F.concat("path", F.lit(""))), "path", "size", "at").select("path", "extension", "best_date", "date_source", "quality").distinct()
    return rows.select("p_partkey", "path").join(shared, "path").drop("path")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00' ELSE '' END AS timestamp, CASE WHEN event_id % 3 = 0 THEN 'xmp_create_date' ELSE '' END AS source FROM events")
def s05_tool_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of a metadata tool, joined by path: the most trusted capture time."""
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("/m/"), F.col("event_id").cast("string")).alias("path"), "ts")
    path = new_path(spark, "metadata")
    tags = F.create_map(F.lit("XMP-xmp:CreateDate"), F.concat(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), F.lit("+0200")), F.lit("QuickTime:CreateDate"), F.lit("0000:00:00"))
    rows.filter("event_id % 3 = 0").select(F.col("path").alias("SourceFile"), tags.alias("tags")).write.json(path)
    found = spark.read.schema("SourceFile string, tags map<string,string>").json(path).select(F.col("SourceFile").alias("path"), records.best_capture(F.col("tags")).alias("b"))
    joined = rows.join(found, "path", "left")
    return joined.select("event_id", F.coalesce("b.timestamp", F.lit("")).alias("timestamp"), F.coalesce("b.source", F.lit("")).alias("source"))


def _jpeg(date: Column) -> Column:
    """A JPEG with one EXIF date and no picture."""
    head = F.unhex(F.lit("FFD8FFD0FFFFE1003645786966000049492A0008000000010003900200140000001A00000000000000"))
    return F.concat(head, _bytes(date), F.unhex(F.lit("00FFDA")))


@query("SELECT event_id, strftime(ts, '%Y:%m:%d %H:%M:%S') AS original FROM events")
def s06_exif_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date in the EXIF block of JPEG bytes, after markers without a length and fill bytes."""
    return table(spark, sf_dir, "events").select("event_id", media.exif_dates(_jpeg(F.date_format("ts", "yyyy:MM:dd HH:mm:ss")))["original"].alias("original"))


@query("""
WITH t AS (SELECT min(CAST(o_orderdate AS DATE)) AS d FROM orders GROUP BY date_trunc('month', o_orderdate))
SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN t ON CAST(l_shipdate AS DATE) BETWEEN d - 3 AND d + 3
""")
def s08_files_near_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose names hold a date within three days of a wanted one: the first order of each month."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    name = F.concat(F.lit("IMG_"), F.date_format("l_shipdate", "yyyyMMdd"), F.lit(".jpg"))
    dated = table(spark, sf_dir, "lineitem").select(*keys, F.explode(values.filename_dates(name)).alias("day"))
    wanted = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.min(F.to_date("o_orderdate")).alias("d"))
    near = wanted.select(F.explode(F.sequence(F.date_sub("d", 3), F.date_add("d", 3), F.expr("interval 1 day"))).alias("day")).distinct()
    return dated.join(near, "day", "left_semi").select(*keys).distinct()


_ADAPTER = {
    "adapter_id": "chat",
    "source_name": "Chat",
    "fields": {"source_id": "$.id", "timestamp": "$.meta.at", "text": "$.body", "urls": "$.links[*].href", "media_references": "$.media", "latitude": "$.geo.lat", "place_name": "$.geo.name"},
}


@query("""
SELECT 'chat' AS adapter_id, conv_id || '-' || turn AS source_id, '2024-01-' || lpad(CAST(turn + 1 AS VARCHAR), 2, '0') AS timestamp, md5(text) AS digest, CASE WHEN turn = 0 THEN 2 WHEN turn = 1 THEN 1 ELSE 0 END AS urls, 1 AS media, CASE WHEN turn = 2 THEN 48.5 END AS latitude FROM conversations WHERE role = 'user'
""")
def s10_adapter_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents in the staging schema by the selectors of an adapter; those without an id are left out."""
    turn = F.col("turn")
    rows = table(spark, sf_dir, "conversations")
    link = lambda n: F.struct(F.lit(n).alias("href"))
    document = F.struct(
        F.when(F.col("role") == "user", F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))).alias("id"),
        F.struct(F.format_string("2024-01-%02d", turn + 1).alias("at")).alias("meta"),
        F.col("text").alias("body"),
        F.when(turn == 0, F.array(link("a"), link("b"))).when(turn == 1, F.array(link("a"))).alias("links"),
        F.lit("m.jpg").alias("media"),
        F.when(turn == 2, F.struct(F.lit(48.5).alias("lat"), F.lit("Here").alias("name"))).alias("geo"),
    )
    path = new_path(spark, "chat")
    rows.select(F.to_json(document).alias("value")).write.text(path)
    staged = files.staged_records(spark.read.text(path), "value", _ADAPTER)
    return staged.select("adapter_id", "source_id", "timestamp", F.md5(_bytes(F.col("text"))).alias("digest"), F.size("urls").alias("urls"), F.size("media_references").alias("media"), "latitude")


@query("SELECT event_id, event_id % 50 = 0 AS broken, CASE WHEN event_id % 50 <> 0 THEN value END AS value FROM events")
def s12_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON, broken ones kept as they are."""
    path = new_path(spark, "lines")
    key = F.col("event_id").cast("string")
    good = F.to_json(F.struct(F.col("event_id").alias("id"), "value"))
    table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 50 == 0, F.concat(F.lit('{"id": '), key)).otherwise(good).alias("value")).write.text(path)
    # A broken line is asked for by its own text: what was read of it before the break is no value.
    lines = files.json_lines(spark, path, "id long, value double")
    number = F.coalesce("id", F.regexp_extract("_corrupt", r"(\d+)", 1).try_cast("long"))
    return lines.select(number.alias("event_id"), F.col("_corrupt").isNotNull().alias("broken"), F.when(F.col("_corrupt").isNull(), F.col("value")).alias("value"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS value, c_custkey % 7 = 0 AS conflict FROM customer")
def s13_chunked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections in numbered chunks that overlap: equal repeats once, different ones marked."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_acctbal").alias("value"), F.col("c_custkey").alias("k"))
    path = new_path(spark, "chunks")
    again = rows.filter("k % 7 = 0 OR k % 5 = 0").withColumn("value", F.when(F.col("k") % 7 == 0, F.col("value") + 1).otherwise(F.col("value")))
    stacked = rows.withColumn("chunk", F.col("k") % 4).unionByName(again.withColumn("chunk", F.lit(9).cast("long")))
    documents = stacked.groupBy("chunk").agg(F.count(F.lit(1)).alias("count"), F.collect_list(F.struct("id", "value")).alias("items"))
    documents.repartition("chunk").write.partitionBy("chunk").json(path)
    read = spark.read.schema("count long, items array<struct<id:string,value:double>>, chunk long").json(path)
    found = files.keyed_items(read.select(F.col("chunk"), F.posexplode("items").alias("place", "item")), "id")
    return found.select("id", "item.value", "conflict")


@query("""
SELECT o_orderkey AS timestamp, CASE WHEN o_orderkey % 3 = 0 THEN 'story' ELSE 'post' END AS kind, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority || chr(10) || chr(10) || 'a' || chr(10) || chr(10) || 'b' WHEN 1 THEN 'a' || chr(10) || chr(10) || 'b' WHEN 2 THEN o_orderpriority ELSE '' END AS text,
  CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 0 END AS media, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS links FROM orders
UNION ALL SELECT c_custkey, 'listing', 'Marketplace listing' || chr(10) || chr(10) || 'Item: ' || c_name || CASE WHEN c_acctbal > 0 THEN chr(10) || chr(10) || 'Price: ' || c_nationkey ELSE '' END, 0, 0 FROM customer
""")
def s14_nested_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts, stories and listings of a nested JSON export as entries; texts once each, media and links of attachments."""
    key = F.col("o_orderkey")
    text = lambda t: F.struct(F.lit(t).alias("post"))
    no_text = F.lit(None).cast("array<struct<post:string>>")
    item = lambda uri, url: F.struct(
        F.struct(F.lit(uri).alias("uri"), F.lit("d").alias("description")).alias("media"), F.struct(F.lit("n").alias("name"), F.lit(url).alias("url")).alias("external_context")
    )
    some = F.array(F.struct(F.array(item("1.jpg", "http://a"), item("2.jpg", "http://a")).alias("data")), F.struct(F.array(item("1.jpg", None)).alias("data")))
    post = F.struct(
        key.alias("timestamp"),
        F.when(key % 2 == 0, F.col("o_orderpriority")).alias("title"),
        F.when(key % 4 < 2, F.array(text("a"), text("b"), text("a"), text(" "))).otherwise(no_text).alias("data"),
        F.when(key % 5 == 0, some).alias("attachments"),
    )
    posts, listings = new_path(spark, "posts"), new_path(spark, "listings")
    kind = F.when(key % 3 == 0, "story").otherwise("post")
    chunks = table(spark, sf_dir, "orders").groupBy(kind.alias("kind"), (F.floor(key / 1000)).alias("file")).agg(F.collect_list(post).alias("records"))
    chunks.write.partitionBy("kind").json(posts)  # there are two kinds: by them alone, two tasks would hold all
    read = spark.read.schema(f"records array<struct<{files.POST_SCHEMA}>>, kind string").json(posts)
    entries = None
    for name in ("post", "story"):
        part = read.filter(F.col("kind") == name).select(F.explode(files.social_entries(F.col("records"), name)).alias("e")).select("e.*")
        entries = part if entries is None else entries.unionByName(part)
    fields = F.struct(F.col("c_custkey").alias("created_timestamp"), F.col("c_name").alias("title"), F.when(F.col("c_acctbal") > 0, F.col("c_nationkey").cast("string")).alias("price"))
    table(spark, sf_dir, "customer").select(fields.alias("r")).select("r.*").write.json(listings)
    sold = spark.read.schema("created_timestamp long, title string, price string").json(listings)
    details = F.concat_ws("\n\n", F.lit("Marketplace listing"), F.concat(F.lit("Item: "), "title"), F.concat(F.lit("Price: "), "price"))
    rows = entries.select("timestamp", "kind", "text", F.size(F.coalesce("media", F.array())).alias("media"), F.size(F.coalesce("links", F.array())).alias("links"))
    return rows.unionByName(sold.select(F.col("created_timestamp").alias("timestamp"), F.lit("listing").alias("kind"), details.alias("text"), F.lit(0).alias("media"), F.lit(0).alias("links")))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN md5(CAST(o_orderkey AS VARCHAR)) ELSE sha256(o_orderpriority || chr(0) || round(o_totalprice)::BIGINT) END AS video_id, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) - 1 ELSE CAST(o_orderdate AS DATE) END AS day FROM orders WHERE o_orderstatus <> 'P'
""")
def s20_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos of an index with their preferred date, and an id from path and size where no digest is known."""
    from archivolt.operators import filters

    rows = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    dates = rows.select("o_orderkey", F.lit("filesystem").alias("source"), F.to_date("o_orderdate").alias("day")).unionByName(
        rows.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("capture").alias("source"), F.date_sub(F.to_date("o_orderdate"), 1).alias("day"))
    )
    best = filters.best_date(dates, "o_orderkey", "source", "day", ["capture", "filesystem"]).select("o_orderkey", "day")
    known = F.when(F.col("o_orderkey") % 4 == 0, F.md5(_bytes(F.col("o_orderkey").cast("string"))))
    made = F.sha2(_bytes(F.concat_ws("\0", "o_orderpriority", F.round("o_totalprice").cast("long").cast("string"))), 256)
    return rows.select("o_orderkey", F.coalesce(known, made).alias("video_id")).join(best, "o_orderkey")


@query("SELECT o_custkey, string_agg(DISTINCT strftime(o_orderdate, '%Y-%m-%d'), ';' ORDER BY strftime(o_orderdate, '%Y-%m-%d')) AS dates FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, '' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def s21_rows_with_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an index with their dates in order."""
    dates = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set(F.date_format("o_orderdate", "yyyy-MM-dd"))), ";").alias("dates"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")).join(dates, "o_custkey", "left").select("o_custkey", F.coalesce("dates", F.lit("")).alias("dates"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ', "' || p_brand || '"' AS note, CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE '' END AS size, '' AS extra FROM part""")
def s23_csv_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV queue with quotes and commas, all texts; a missing column and nulls are empty."""
    path = new_path(spark, "queue")
    note = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), note.alias("note"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return files.csv_queue(spark, path, ["id", "note", "size", "extra"])


@query("""
SELECT 'entries' AS name, count(*) AS n, count(DISTINCT o_custkey) AS keys FROM orders UNION ALL SELECT 'media', count(*), count(DISTINCT l_partkey) FROM lineitem UNION ALL SELECT 'tags', NULL, NULL
""")
def s26_store_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct keys of the tables of a store; nothing for one that is not there."""
    folder = sf_dir.rstrip("/")
    rows = [(name, files.table_count(spark, f"{folder}/{t}.parquet"), files.table_count(spark, f"{folder}/{t}.parquet", key)) for name, t, key in (("entries", "orders", "o_custkey"), ("media", "lineitem", "l_partkey"), ("tags", "no_such_table", "x"))]
    return spark.createDataFrame(rows, "name string, n long, keys long")


@query("SELECT 'posts' AS kind, 'region=0' AS folder, 1 AS n UNION ALL SELECT 'chats', 'region=1', (SELECT count(*) - 1 FROM region)")
def s29_marked_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders found by a marker file; several of one kind are ambiguous."""
    path = new_path(spark, "exports")
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), "r_name")
    rows.filter("region = 0").write.partitionBy("region").json(path)
    rows.filter("region > 0").write.mode("append").partitionBy("region").text(path)
    found = files.marked_folders(spark, path, {"posts": r"\.json$", "chats": r"\.txt$"})
    return found.select("kind", F.regexp_extract("folder", "[^/]+$", 0).alias("folder"), "n")


@query("SELECT c_mktsegment AS source, count(*) + 1 AS n FROM customer GROUP BY 1")
def s30_latest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several reports the newest one of each source."""
    path = new_path(spark, "reports")
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    counts.coalesce(1).write.json(f"{path}/run=1")
    counts.select("source", (F.col("n") + 1).alias("n")).coalesce(1).write.json(f"{path}/run=2")
    return files.latest_documents(spark, f"{path}/run=*", "source string, n long", "source")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name || ';Bo' WHEN c_custkey % 4 = 1 THEN '' ELSE c_name END AS people, CASE WHEN c_custkey % 3 = 0 THEN -48.5 END AS latitude, c_custkey % 5 = 0 AS private FROM customer")
def s18_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People, place and privacy of XMP sidecars; damaged ones hold nothing."""
    key = F.col("c_custkey")
    people = F.when(key % 4 == 0, F.concat(F.lit("<d:li>"), "c_name", F.lit("</d:li><d:li>Bo</d:li>"))).when(key % 4 == 1, "").otherwise(F.concat(F.lit("<d:li>"), "c_name", F.lit("</d:li>")))
    place = F.when(key % 3 == 0, F.lit(' d:GPSLatitude="48,30.0S"')).otherwise("")
    tag = F.when(key % 5 == 0, "<d:Tag>private</d:Tag>").otherwise("")
    xmp = F.concat(F.lit('<x xmlns:d="u"'), place, F.lit("><d:PersonInImage><d:Bag>"), people, F.lit("</d:Bag></d:PersonInImage>"), tag, F.lit("</x>"))
    gps = F.try_element_at(media.sidecar_column(xmp, "GPSLatitude"), F.lit(1))
    named = F.filter(media.sidecar_column(xmp, "PersonInImage"), lambda x: x != "")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.array_join(named, ";").alias("people"),
        values.signed_degrees(F.regexp_replace(gps, "[SN]$", ""), F.regexp_extract(gps, "([SN])$", 1)).alias("latitude"),
        F.array_contains(media.sidecar_column(xmp, "Tag"), "private").alias("private"),
    )


@query("""
SELECT event_id, 'user_1' AS account, CAST(ts - INTERVAL 330 MINUTE AS DATE) AS local_day, event_type AS text FROM events
""")
def s11_assigned_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of arrays that scripts assign, with the account and its time zone from a file of the same kind."""
    path = new_path(spark, "posts-js")
    post = F.struct(F.col("event_id").cast("string").alias("id"), F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy").alias("created_at"), F.col("event_type").alias("full_text"))
    parts = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("part")).agg(F.to_json(F.collect_list(post)).alias("body"))
    script = F.concat(F.lit("window.YTD.posts.part"), F.col("part").cast("string"), F.lit(" = "), "body", F.lit(";"))
    packages.write_each(parts.select("part", _bytes(script).alias("content")), "content", path, "part")
    account = spark.createDataFrame([('window.YTD.account.part0 = [{"username": "user_1", "offset": -330}]',)], "value string")
    account.coalesce(1).write.text(f"{path}-account")
    posts = files.assigned_json(spark, path, "id:string,created_at:string,full_text:string")
    owner = files.assigned_json(spark, f"{path}-account", "username:string,offset:int")
    at = values.post_timestamp(F.col("created_at"))
    joined = posts.crossJoin(F.broadcast(owner))  # one row
    return joined.select(F.col("id").cast("long").alias("event_id"), F.col("username").alias("account"), values.local_date(at, F.col("offset")).alias("local_day"), F.col("full_text").alias("text"))


@query("SELECT c_name AS author, 'Balance ' || c_nationkey || ' in ' || c_mktsegment AS body, CASE WHEN c_custkey % 2 = 0 THEN 'https://example.org/' || c_custkey ELSE '' END AS url FROM customer")
def s15_html_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of HTML pages by their classes, with void and unclosed nodes inside and text outside of them."""
    link = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('<a class="url" href="#">https://example.org/'), F.col("c_custkey").cast("string"), F.lit("</a>"))).otherwise("")
    body = F.concat(F.lit('<p class="x body">Balance <b>'), F.col("c_nationkey").cast("string"), F.lit("</b> in<br> "), "c_mktsegment")
    card = F.concat(F.lit('<div class="card post"><source><span class="author">'), "c_name", F.lit("</span>"), body, F.lit("<li></p>"), link, F.lit('</div></i> outside <p class="body">no'))
    # More customers are more pages, not longer ones.
    pages = table(spark, sf_dir, "customer").groupBy("c_nationkey", F.floor(F.col("c_custkey") / 10_000)).agg(F.concat_ws("", F.collect_list(card)).alias("html"))
    found = pages.select(F.explode(media.html_cards(F.col("html"), "card", {"author": "author", "body": "body", "url": "url"})).alias("c"))
    field = lambda n: F.coalesce(F.try_element_at("c", F.lit(n)), F.lit("")).alias(n)
    return found.select(field("author"), field("body"), field("url"))


@query("SELECT n_nationkey AS folder, length(n_name) + 1 AS byte_size, sha256(n_name || chr(10)) AS sha256 FROM nation")
def s28_file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative paths, sizes and digests of all files below a folder."""
    path = new_path(spark, "manifest")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("folder"), _bytes(F.col("n_name")).alias("content"))
    packages.write_each(rows, "content", path, "folder")
    return files.manifest(spark, path).select(F.regexp_extract("relative_path", r"^folder=(\d+)/", 1).cast("int").alias("folder"), "byte_size", "sha256").filter("folder IS NOT NULL")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'private' WHEN c_custkey % 4 = 1 THEN 'public' ELSE 'unknown' END AS privacy FROM customer")
def s19_privacy_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The privacy of a sidecar by its tags: private wins, damaged sidecars and those without a tag say nothing."""
    quarter = F.col("c_custkey") % 4
    tags = F.when(quarter == 0, "<t:Tag>public</t:Tag><t:Tag>private</t:Tag>").when(quarter == 1, "<t:Tag>public</t:Tag>").when(quarter == 2, "<t:Tag>").otherwise("")
    found = media.sidecar_column(F.concat(F.lit('<x xmlns:t="u">'), tags, F.lit("</x>")), "Tag")
    privacy = F.when(F.array_contains(found, "private"), "private").when(F.array_contains(found, "public"), "public").otherwise("unknown")
    return table(spark, sf_dir, "customer").select("c_custkey", privacy.alias("privacy"))


@query("""
SELECT o_custkey AS path, CASE WHEN o_custkey % 2 = 0 THEN strftime(max(o_orderdate), '%Y-%m-%dT00:00:00') ELSE 'reported ' || max(o_orderkey) END AS taken FROM orders GROUP BY 1
""")
def r44_tool_or_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times from the JSON of a tool, and where it has none from the report of an earlier run."""
    path = new_path(spark, "times")
    newest = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.max("o_orderdate").alias("at"), F.max("o_orderkey").alias("k"))
    tool = F.when(F.col("path") % 2 == 0, F.date_format("at", "yyyy:MM:dd HH:mm:ss"))
    newest.select(F.col("path").alias("SourceFile"), tool.alias("CreateDate")).write.json(f"{path}/tool")
    newest.select("path", F.concat(F.lit("reported "), F.col("k").cast("string")).alias("taken")).write.option("header", True).csv(f"{path}/report")
    read = spark.read.schema("SourceFile long, CreateDate string").json(f"{path}/tool").select(F.col("SourceFile").alias("path"), records.capture_text(F.col("CreateDate")).alias("tool"))
    report = files.csv_queue(spark, f"{path}/report", ["path", "taken"]).select(F.col("path").cast("long"), "taken")
    return read.join(report, "path", "left").select("path", F.coalesce("tool", "taken").alias("taken"))


# -- pictures -----------------------------------------------------------------------------------------------------

_GRAY = "WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: floor(least(greatest((CAST(x AS DOUBLE) + 4) * 32, 0), 255))::INT) AS gray FROM embeddings WHERE len(embedding) = 64)\n"


def _gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    gray = F.transform("embedding", lambda x: F.floor(F.least(F.greatest((x.cast("double") + 4) * 32, F.lit(0.0)), F.lit(255.0))).cast("int"))
    return table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64).select("vec_id", gray.alias("gray"))


def _ppm(gray: Column, width: int, height: int) -> Column:
    """A binary PPM of gray values."""
    hexed = F.array_join(F.transform(gray, lambda x: F.repeat(F.lpad(F.hex(x.cast("long")), 2, "0"), 3)), "")
    return F.concat(_bytes(F.lit(f"P6\n{width} {height}\n255\n")), F.unhex(hexed))


@query(_GRAY + "SELECT vec_id, 16 AS width, 4 AS height, list_sum(gray)::BIGINT AS total, round(list_sum(gray) / 64.0, 4) AS mean FROM g")
def v01_image_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of images, their sizes from the header, gray samples of the whole view and the mean colour."""
    image = _gray(spark, sf_dir).select("vec_id", _ppm(F.col("gray"), 16, 4).alias("content"))
    found = image.select("vec_id", media.dimensions("content").alias("d"), media.descriptors(F.col("content"), 1, 16)[0].alias("v"))
    total = F.aggregate("v.gray", F.lit(0).cast("long"), lambda s, x: s + x)
    # 16 x 16 samples of 16 x 4 pixels take each pixel four times.
    return found.select("vec_id", "d.width", "d.height", (total / 4).cast("long").alias("total"), F.round(F.element_at("v.mean_rgb", 1), 4).alias("mean"))


@query(_GRAY + "SELECT vec_id, 'square_' || i AS name, round(list_sum(list_concat(gray[i * 4 + 1 : i * 4 + 4], gray[i * 4 + 17 : i * 4 + 20], gray[i * 4 + 33 : i * 4 + 36], gray[i * 4 + 49 : i * 4 + 52])) / 16.0, 4) AS mean FROM g, range(4) r(i)")
def v02_square_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares along the longer side of an image, each with its mean."""
    image = _gray(spark, sf_dir).select("vec_id", _ppm(F.col("gray"), 16, 4).alias("content"))
    views = image.select("vec_id", F.explode(media.descriptors(F.col("content"), 4, 4)).alias("v")).filter("v.name <> 'full'")
    return views.select("vec_id", "v.name", F.round(F.element_at("v.mean_rgb", 1), 4).alias("mean"))


@query(_GRAY + "SELECT vec_id, 0.0::DOUBLE AS score, CAST(4 * (vec_id % 3) AS INTEGER) AS x, 0 AS y, 8 AS width, 'high' AS confidence FROM g WHERE len(list_distinct(gray)) > 3")
def v05_suggested_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of a larger image that shows a reference, found by size and place (also V06's score)."""
    rows = _gray(spark, sf_dir).filter(F.size(F.array_distinct("gray")) > 3)
    line = lambda i: F.slice("gray", i * 8 + 1, 8)
    pad = lambda n, v: F.array_repeat(F.lit(v), n)
    # The reference stands in a bright frame of 16 x 8 pixels, at one of three places.
    wide = [F.concat(*[F.concat(pad(4 * k, 255), line(i), pad(8 - 4 * k, 255)) for i in range(8)]) for k in range(3)]
    framed = F.element_at(F.array(*wide), (F.col("vec_id") % 3 + 1).cast("int"))
    pictures = rows.select("vec_id", media.gray_pictures(_ppm(F.col("gray"), 8, 8)).alias("reference"), media.gray_pictures(_ppm(framed, 16, 8)).alias("candidate"))
    return crops.found_crops(pictures, n=8).select("vec_id", "score", "x", "y", "width", crops.confidence(F.col("score")).alias("confidence"))


@query("""
WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 45 THEN 0.005 ELSE l_quantity END AS score, l_linenumber % 2 = 0 AS same_size, l_returnflag = 'R' AS decided FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN score <= 20 THEN 'high' WHEN score <= 200 THEN 'medium' ELSE 'low' END AS confidence, NOT decided AND score <= 0.01 AND same_size AS hidden FROM q
""")
def v06_equal_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the queue by the confidence of their score; undecided ones that equal the export are hidden."""
    score = F.when(F.col("l_quantity") > 45, 0.005).otherwise(F.col("l_quantity"))
    hidden = (F.col("l_returnflag") != "R") & (score <= 0.01) & (F.col("l_linenumber") % 2 == 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", crops.confidence(score).alias("confidence"), hidden.alias("hidden"))


@query("""
WITH i AS (SELECT p_partkey, 1000 + p_partkey % 500 AS w, 800 + p_size AS h, p_partkey % 900 AS sx, p_size * 10 AS sy FROM part),
k AS (SELECT *, floor(least(w, h) * (1 - (k - 1) * 0.25))::INT AS size, k FROM i, range(1, 4) r(k)),
c AS (SELECT p_partkey, sx, sy, w, h, size, greatest(0, least(floor(cx - size / 2)::INT, w - size)) AS x, greatest(0, least(floor(cy - size / 2)::INT, h - size)) AS y FROM (SELECT *, sx AS cx, sy AS cy FROM k UNION ALL SELECT *, w / 2, h / 2 FROM k)),
s AS (SELECT DISTINCT p_partkey, size, x, y, round((1 - size * size / (least(w, h) * least(w, h))) * 0.5 + (abs(x + size / 2 - sx) + abs(y + size / 2 - sy)) / size, 6) AS penalty FROM c)
SELECT p_partkey, min(penalty) AS penalty, count(*) AS candidates FROM s GROUP BY 1
""")
def v12_crop_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square crops around a subject and the middle, and the least that speaks against one of them."""
    w, h, sx, sy = 1000 + F.col("p_partkey") % 500, (800 + F.col("p_size")).cast("long"), F.col("p_partkey") % 900, (F.col("p_size") * 10).cast("long")
    crops = table(spark, sf_dir, "part").select("p_partkey", w.alias("w"), h.alias("h"), sx.alias("sx"), sy.alias("sy"))
    spread = crops.select("*", F.explode(media.crop_candidates(F.col("sx"), F.col("sy"), F.col("w"), F.col("h"))).alias("c"))
    penalty = F.round(media.crop_penalty(F.col("c"), F.col("sx"), F.col("sy"), F.col("w"), F.col("h")), 6)
    return spread.groupBy("p_partkey").agg(F.min(penalty).alias("penalty"), F.count(F.lit(1)).alias("candidates"))


@query(_GRAY + "SELECT vec_id, vec_id % 2 = 0 AND list_max(gray) > 5 AS black FROM g")
def r48_black_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversions that came out black of a picture that is not."""
    rows = _gray(spark, sf_dir)
    output = F.when(F.col("vec_id") % 2 == 0, F.transform("gray", lambda x: F.lit(0))).otherwise(F.col("gray"))
    return rows.select("vec_id", media.black_conversion(_ppm(F.col("gray"), 8, 8), _ppm(output, 8, 8)).alias("black"))


@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 5 THEN NULL ELSE 100 + p_size END AS width, CASE p_partkey % 6 WHEN 5 THEN NULL ELSE 7 END AS height FROM part
""")
def v14_header_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width and height from the first bytes of PNG, GIF, BMP, PPM and JPEG files; none of others."""
    big = lambda n: F.lpad(F.hex((100 + F.col("p_size")).cast("long")), n, "0")
    little = F.rpad(big(2), 4, "0")
    headers = [
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(8), F.lit("00000007")),
        F.concat(F.lit("474946383961"), little, F.lit("0700")),
        F.concat(F.lit("424D00000000000000003600000028000000"), F.rpad(little, 8, "0"), F.lit("F9FFFFFF")),
        F.hex(F.concat(F.lit("P6\n# c\n"), (100 + F.col("p_size")).cast("string"), F.lit(" 7\n255\n"))),
        F.concat(F.lit("FFD8FFE000044A46FFC0001108"), F.lit("0007"), big(4)),
        F.lit("00"),
    ]
    found = media.dimensions(F.unhex(F.element_at(F.array(*headers), (F.col("p_partkey") % 6 + 1).cast("int"))))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("d")).select("p_partkey", "d.width", "d.height")


# -- packages and reports -----------------------------------------------------------------------------------------

_PACKED = """
WITH m AS (SELECT l_orderkey, count(*) AS n, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts FROM lineitem GROUP BY 1)
"""


def _package(spark: SparkSession, sf_dir: str, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with their ordered lines, written as a package and read back; and its counters."""
    from archivolt.operators.states import numbered

    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")]
    # All joins, the numbering and the nesting keep this one partitioning.
    tasks = partitions_for(lines)
    wanted = entries.select(F.col("id").alias("l_orderkey")).repartition(tasks, "l_orderkey")
    held = lines.join(wanted, "l_orderkey", "left_semi").repartition(tasks, "l_orderkey")
    items = numbered(held, ["l_orderkey"], order, "position").select(F.col("l_orderkey").alias("id"), "position", F.col("l_partkey").alias("part"))
    path = new_path(spark, "package")
    counts = packages.write_package(entries, items, "id", path)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema.fields)
    return spark.read.schema(kind + ", media array<struct<position:int,part:bigint>>").json(f"{path}/entries"), counts


def _listed(documents: DataFrame) -> DataFrame:
    parts = F.array_join(F.transform("media", lambda m: m["part"].cast("string")), ",")
    return documents.withColumn("parts", F.coalesce(parts, F.lit(""))).drop("media")


@query(_PACKED + "SELECT o_orderkey AS id, o_orderstatus AS text, coalesce(parts, '') AS parts FROM orders LEFT JOIN m ON l_orderkey = o_orderkey")
def k25_nested_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package of entries with their media in order, as read back."""
    return _listed(_package(spark, sf_dir, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("text")))[0])


@query(_PACKED + "SELECT count(*) AS entries, sum(coalesce(n, 0))::BIGINT AS media, count(*) FILTER (n IS NULL) AS entries_without_media FROM orders LEFT JOIN m ON l_orderkey = o_orderkey")
def k26_package_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a package's manifest."""
    return _package(spark, sf_dir, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("text")))[1]


@query(_PACKED + "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'staged' WHEN o_orderkey % 2 = 0 THEN 'stored' ELSE o_orderstatus END AS text, coalesce(parts, '') AS parts FROM orders LEFT JOIN m ON l_orderkey = o_orderkey")
def k27_package_with_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package of entries with stored decisions and staged ones over them."""
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("text"))
    layer = lambda rule, word: entries.filter(rule).select("id", F.lit(word).alias("text"))
    once = upsert.staged_over_stored(entries, layer("id % 2 = 0", "stored"), ["id"], ["text"])
    return _listed(_package(spark, sf_dir, upsert.staged_over_stored(once, layer("id % 3 = 0", "staged"), ["id"], ["text"]))[0])


@query(_PACKED + "SELECT o_orderkey AS id, o_orderstatus AS text, coalesce(parts, '') AS parts FROM orders LEFT JOIN m ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def k28_approved_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package of approved entries alone."""
    approved = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("text"))
    return _listed(_package(spark, sf_dir, approved)[0])


@query("""
SELECT 'csv' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'json', count(*) FROM customer UNION ALL SELECT 'markdown', count(*) + 4 FROM customer UNION ALL SELECT 'html', count(*) FROM customer
""")
def k29_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as CSV, JSON, Markdown and HTML: all its rows in each."""
    path = new_path(spark, "report")
    packages.write_report(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path, "Customers")
    read = {
        "csv": spark.read.option("header", True).csv(f"{path}/csv"),
        "json": spark.read.schema("c_custkey long").json(f"{path}/json"),
        "markdown": spark.read.text(f"{path}/markdown"),
        "html": spark.read.text(f"{path}/html").filter(F.contains("value", F.lit("<td>"))),
    }
    out = None
    for kind, rows in read.items():
        part = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation UNION ALL SELECT CAST(r_regionkey + 100 AS VARCHAR), r_name FROM region")
def k31_csv_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV log that is written anew and then appended to."""
    path = new_path(spark, "log")
    for mode, rows in (("overwrite", table(spark, sf_dir, "region").select("r_regionkey", "r_name")), ("overwrite", table(spark, sf_dir, "nation").select("n_nationkey", "n_name")), ("append", table(spark, sf_dir, "region").selectExpr("r_regionkey + 100", "r_name"))):
        rows.toDF("id", "name").write.mode(mode).option("header", True).csv(path)
    return files.csv_queue(spark, path, ["id", "name"])


@query("SELECT 'nation' AS name, count(*) AS rows FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'part', count(*) FROM part")
def k32_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy of tables with a manifest of their rows and digests."""
    kept = packages.snapshot({n: table(spark, sf_dir, n) for n in ("nation", "region", "part")}, new_path(spark, "snapshot"))
    return kept.filter("digest <> 0").select("name", "rows")


def _write_files(rows: DataFrame, path: str) -> None:
    """Text files of rows (folder, content)."""
    packages.write_each(rows.select("folder", _bytes(F.col("content")).alias("content")), "content", path, "folder")


@query("""
WITH s AS (SELECT s_suppkey AS k FROM supplier),
c AS (SELECT count(*) AS a, count(*) FILTER (k % 5 = 0) AS moved, count(*) FILTER (k % 5 = 1) AS pruned, count(*) FILTER (k % 5 = 2) AS added, count(*) FILTER (k % 5 = 3) AS changed FROM s)
SELECT 1 AS run, a AS scanned, a AS read, 0 AS skipped, 0 AS moved, 0 AS pruned, a AS files FROM c
UNION ALL SELECT 2, a - pruned + added, moved + added + changed, a - pruned - moved - changed, moved, pruned + changed, a - pruned + added FROM c
UNION ALL SELECT 3, a - pruned + added, 0, a - pruned + added, 0, 0, a - pruned + added FROM c
""")
def r10_index_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs of the index over files of which some move, go, come and change between the first two, and none after."""
    root, folder, k = new_path(spark, "library"), new_path(spark, "library-index"), F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws(" ", k.cast("string"), "s_name").alias("content"))
    # A folder holds many files: one for each would be made, renamed and listed as well.
    place = lambda name: F.concat(F.lit(f"{name}-"), F.pmod(F.xxhash64(k), F.lit(256)).cast("string")).alias("folder")
    # What goes later has a folder of its own, so that it goes at once and not file by file from the driver.
    goes = "s_suppkey % 5 IN (0, 1, 3)"
    _write_files(rows.filter(f"NOT {goes}").select(place("first"), "content"), f"{root}/a")
    _write_files(rows.filter(goes).select(place("first"), "content"), f"{root}/gone")
    file_index.index_files(spark, root, folder, shards=4)
    remove(spark, f"{root}/gone")
    again = rows.filter("s_suppkey % 5 = 0").select(place("moved"), "content")
    added = rows.filter("s_suppkey % 5 = 2").select(place("added"), F.concat("content", F.lit(" new")).alias("content"))
    _write_files(again.unionByName(added), f"{root}/b")
    # Files of another content and place than those that are gone are new ones.
    _write_files(rows.filter("s_suppkey % 5 = 3").select(place("first"), F.concat("content", F.lit(" changed")).alias("content")), f"{root}/c")
    for _ in range(2):
        file_index.index_files(spark, root, folder, shards=4)
    return file_index.runs(spark, folder)


_ALBUMS = """
WITH c AS (SELECT c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place, 'p' || c_custkey % 400 AS uri, CASE WHEN c_custkey % 9 > 0 THEN c_custkey * 10 END AS tm, CASE WHEN c_custkey % 2 = 0 THEN 'Album ' || c_nationkey ELSE c_name END AS title,
    CASE WHEN c_acctbal > 5000 THEN c_mktsegment END AS description FROM customer),
p AS (SELECT * FROM c UNION ALL SELECT k, max(place) + 1, 'p' || k * 7, NULL, NULL, 'cover' FROM c WHERE k % 2 = 0 GROUP BY k),
q AS (SELECT k, 'album_' || lpad(k::VARCHAR, 3, '0') AS source, place, uri, coalesce(tm, 5 + k) AS taken, tm IS NULL AS undated, coalesce(description, CASE WHEN title <> 'Album ' || k OR k % 5 = 0 THEN title END) AS caption, uri IN (SELECT 'p' || o_custkey % 60 FROM orders) AS held FROM p),
"""


def _albums(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Albums of customers by nation, from JSON files, and the media that entries hold."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    photo = F.struct(
        F.concat(F.lit("p"), (k % 400).cast("string")).alias("uri"),
        F.when(k % 9 > 0, k * 10).alias("creation_timestamp"),
        F.when(k % 2 == 0, F.concat(F.lit("Album "), n.cast("string"))).otherwise(F.col("c_name")).alias("title"),
        F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("description"),
    )
    grouped = table(spark, sf_dir, "customer").groupBy(n.alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), photo.alias("p")))), lambda x: x["p"]).alias("photos"))
    cover = F.struct(F.concat(F.lit("p"), (F.col("k") * 7).cast("string")).alias("uri"), F.lit(None).cast("long").alias("creation_timestamp"), F.lit(None).cast("string").alias("title"), F.lit("cover").alias("description"))
    named = F.when(F.col("k") % 5 > 0, F.concat(F.lit("Album "), F.col("k").cast("string")))
    about = F.when(F.col("k") % 3 == 0, "About it")
    made = grouped.select("k", named.alias("name"), about.alias("description"), (F.col("k") + 5).cast("long").alias("last_modified_timestamp"), "photos", F.when(F.col("k") % 2 == 0, cover).alias("cover_photo"))
    path = new_path(spark, "albums")
    made.withColumn("album", F.format_string("album_%03d", "k")).drop("k").repartition("album").write.partitionBy("album").json(path)
    read = spark.read.schema(f"{files.ALBUM_SCHEMA}, album string").json(path).withColumnRenamed("album", "source")
    attached = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), (F.col("o_custkey") % 60).cast("string")).alias("uri"))
    return read, attached


@query(_ALBUMS + """
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY source, place) AS n FROM q WHERE NOT held) WHERE n = 1)
SELECT source, min(taken) AS timestamp, CASE WHEN k % 5 > 0 THEN 'Album: Album ' || k ELSE 'Photo album' END || CASE WHEN k % 3 = 0 THEN chr(10) || chr(10) || 'About it' ELSE '' END AS text,
  string_agg(uri || '=' || coalesce(caption, ''), ',' ORDER BY place) AS media, CASE WHEN (SELECT bool_or(undated) FROM q WHERE q.k = f.k) THEN 'album_last_modified' ELSE 'album_first_photo' END AS date_source FROM f GROUP BY source, k
""")
def s14_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Albums as entries of the photos that no entry holds, each photo once."""
    entries, _ = files.album_entries(*_albums(spark, sf_dir))
    shown = F.array_join(F.transform("media", lambda m: F.concat(m["uri"], F.lit("="), F.coalesce(m["caption"], F.lit("")))), ",")
    return entries.select("source", "timestamp", "text", shown.alias("media"), "date_source")


@query(_ALBUMS + "h AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY source, place) AS n FROM q WHERE held) SELECT uri, arg_min(caption, n) FILTER (caption IS NOT NULL) AS caption, arg_min(taken, n) AS taken FROM h GROUP BY 1")
def s14_album_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions and times that albums add to media that entries hold."""
    return files.album_entries(*_albums(spark, sf_dir))[1]


@query("SELECT count(*) FILTER (turn % 3 > 0 AND trim(text) <> '') AS unlinked_comments FROM conversations")
def s14_unlinked_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of an export: they name no post, so they are counted only."""
    comment = F.when(F.col("turn") % 3 > 0, F.struct(F.col("text").alias("comment")))
    records = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(comment.alias("comment"))).alias("data"))
    path = new_path(spark, "comments")
    records.select(F.array(F.struct("data")).alias("comments_v2")).write.json(path)
    kind = "comments_v2 array<struct<data:array<struct<comment:struct<comment:string>>>>>"
    return files.unlinked_comments(spark.read.schema(kind).json(path))
