"""Queries that apply the value functions to whole tables, and state changes between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.functions import text, values
from archivolt.operators import ranking, upsert
from archivolt.plans._base import collector
from archivolt.session import table

QUERIES, ORACLES, query = collector()


_NAMES = """
WITH n AS (SELECT o_orderkey, o_orderdate AS d, strftime(o_orderdate, '%Y%m%d') AS c, strftime(o_orderdate, '%Y-%m-%d') AS i, strftime(o_orderdate, '%Y_%m-%d') AS m, strftime(o_orderdate, '%Y.%m.%d') AS p,
    format('{:02d}', o_orderkey % 24) AS h, format('{:02d}', o_orderkey % 60) AS s FROM orders)
"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of eight forms; some hold several dates, digits too many, or what is no date."""
    day = lambda form: F.date_format("o_orderdate", form)
    two = lambda n: F.format_string("%02d", F.col("o_orderkey") % n)
    forms = [
        F.concat(F.lit("IMG_"), day("yyyyMMdd"), F.lit("_20019999_"), two(24), two(60), F.lit("00.jpg")),
        F.concat(F.lit("a "), day("yyyy-MM-dd"), F.lit(" x 1999_12_31 y "), day("yyyy-MM-dd"), F.lit(".png")),
        F.concat(day("yyyy_MM-dd"), F.lit("T"), two(24), F.lit("."), two(60), F.lit(".07.heic")),
        F.concat(F.lit("v"), day("yyyyMMdd"), two(24), two(60), F.lit("59.mov")),
        F.concat(day("yyyy.MM.dd"), F.lit(" dotted.jpg")),
        F.concat(F.lit("2023-02-30 x "), day("yyyy-MM-dd"), F.lit(" "), two(24), F.lit(":"), two(60), F.lit(":00 2024-02-29_000000.jpg")),
        F.concat(F.lit("9"), day("yyyyMMdd"), F.lit("-"), day("yyyyMMdd"), F.lit("9.png")),
        F.concat(F.lit("2024-01-00 101010 "), day("yyyyMMdd"), F.lit(" T-"), two(24), two(60), two(60), F.lit(".jpg")),
    ]
    return table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*forms), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("name"))


@query(_NAMES + """
SELECT o_orderkey, array_to_string(list_sort(list_distinct(CASE o_orderkey % 8 WHEN 1 THEN ['1999-12-31', i] WHEN 3 THEN [] WHEN 4 THEN [] WHEN 6 THEN [] WHEN 5 THEN ['2024-02-29', i] ELSE [i] END)), ';') AS dates FROM n
""")
def x01_filename_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All valid dates in file names of several forms; impossible dates are ignored."""
    found = F.transform(values.filename_dates(F.col("name")), lambda d: d.cast("string"))
    return _named(spark, sf_dir).select("o_orderkey", F.array_join(found, ";").alias("dates"))


@query(_NAMES + """
SELECT o_orderkey, array_to_string(list_sort(CASE o_orderkey % 8 WHEN 2 THEN [i || ' ' || h || ':' || s || ':07'] WHEN 3 THEN [i || ' ' || h || ':' || s || ':59'] WHEN 5 THEN list_distinct([i || ' ' || h || ':' || s || ':00', '2024-02-29 00:00:00'])
  WHEN 7 THEN [i || ' ' || h || ':' || s || ':' || s] ELSE [] END), ';') AS times FROM n
""")
def x01_filename_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All valid times in file names of several forms."""
    found = F.transform(values.filename_timestamps(F.col("name")), lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
    return _named(spark, sf_dir).select("o_orderkey", F.array_join(found, ";").alias("times"))


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL (o_orderkey % 24) HOUR AS local_time, CAST(((o_orderkey % 27) - 13) * 60 AS INTEGER) AS offset_minutes FROM orders
""")
def x03_exif_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colon dates with an offset, read as a wall clock and minutes."""
    hours = F.col("o_orderkey") % 27 - 13
    sign = F.when(hours < 0, "-").otherwise("+")
    text_ = F.concat(F.date_format("o_orderdate", "yyyy:MM:dd"), F.lit(" "), F.format_string("%02d", F.col("o_orderkey") % 24), F.lit(":00:00"), sign, F.format_string("%02d:00", F.abs(hours)))
    rows = table(spark, sf_dir, "orders").withColumn("t", text_)
    return rows.select("o_orderkey", values.exif_timestamp(F.col("t")).alias("local_time"), values.exif_offset_minutes(F.col("t")).alias("offset_minutes"))


@query("""
SELECT c_custkey, round_even((CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END) * (c_custkey % 90 + (c_custkey % 60) / 60.0 + (c_custkey % 50) / 3600.0), 8) + 0.0 AS degrees FROM customer
""")
def x05_signed_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees, minutes and seconds with a reference letter as signed degrees."""
    key = F.col("c_custkey")
    dms = F.format_string("%d deg %d' %d\"", key % 90, key % 60, key % 50)
    return table(spark, sf_dir, "customer").select("c_custkey", values.signed_degrees(dms, F.when(key % 2 == 0, "South").otherwise("N")).alias("degrees"))


@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 4 THEN 'photo' || p_partkey || 'kopie' WHEN 5 THEN 'photo' || p_partkey || '2' ELSE 'photo' || p_partkey END AS stem FROM part
""")
def x07_normalized_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems without accents, extensions and the suffixes of copies and edits, in any number and order."""
    forms = ["Phóto_%d copy (2).JPG", "PHOTO-%d Edited duplicate.jpeg", "photo %d - 12 dup.tar", "photo%d alternate (1) trimmed.x", "photo %d kopie.png", "photo %d-2.png"]
    name = F.element_at(F.array(*[F.format_string(f, F.col("p_partkey")) for f in forms]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.normalized_stem(name).alias("stem"))


@query("SELECT a.p_partkey, list_sort([a.p_size, a.p_partkey % 50]) = list_sort([a.p_partkey % 50, a.p_size]) AS same, list_sort([a.p_size, 7]) = list_sort([a.p_partkey % 9, a.p_size]) AS other FROM part a")
def x09_same_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions compared in either orientation."""
    size, side = F.col("p_size").cast("long"), F.col("p_partkey") % 50
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        values.same_dimensions(size, side, side, size).alias("same"),
        values.same_dimensions(size, F.lit(7).cast("long"), F.col("p_partkey") % 9, size).alias("other"),
    )


@query("""
SELECT l_orderkey, coalesce(min(abs(date_diff('day', CAST(l_shipdate AS DATE), DATE '1997-01-01'))) FILTER (l_returnflag = 'R'), -1) AS days FROM lineitem GROUP BY 1
""")
def x11_least_day_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days to the nearest date of an array, -1 where there is none."""
    dates = F.collect_list(F.when(F.col("l_returnflag") == "R", F.to_date("l_shipdate"))).alias("dates")
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(dates)
    return lists.select("l_orderkey", values.least_day_distance(F.col("dates"), F.lit("1997-01-01").cast("date"), F.lit(-1)).alias("days"))


@query("SELECT p_partkey, 'brand:' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g')) AS tag FROM part")
def x12_namespaced_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as tags of a namespace."""
    return table(spark, sf_dir, "part").select("p_partkey", text.namespaced_tag(F.lit("Brand"), F.col("p_brand")).alias("tag"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unchanged' WHEN doc_id % 3 = 1 THEN 'normalized_unchanged' ELSE 'changed' END AS status FROM documents WHERE length(trim(text)) > 3 AND text <> upper(text) || '  '
""")
def x13_text_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How an edited text differs from the one before."""
    docs = table(spark, sf_dir, "documents").filter("length(trim(text)) > 3")
    after = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("  "), F.regexp_replace("text", " ", "  "))).otherwise(F.concat("text", F.lit(" more")))
    return docs.select("doc_id", text.text_change(F.col("text"), after).alias("status"))


@query("""
SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN text || ' 🙂' WHEN 1 THEN '中 “' || text || '” Ã' ELSE 'café naïve ' || doc_id END) AS digest FROM documents
""")
def x15_repaired_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that were read once or twice with the wrong encoding, in whole or in part, restored to what they were."""

    def wrong(c):
        return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")

    mixed = F.concat(F.lit("中 “"), wrong(F.col("text")), F.lit("” Ã"))
    third = F.col("doc_id") % 3
    twice = wrong(wrong(F.concat(F.lit("café naïve "), F.col("doc_id").cast("string"))))
    broken = F.when(third == 0, wrong(F.concat("text", F.lit(" 🙂")))).when(third == 1, mixed).otherwise(twice)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.repair_mojibake(broken).cast("binary")).alias("digest"))


@query(r"""
SELECT doc_id, md5('see https://example.org/' || doc_id || ' now' || chr(10) || chr(10) || trim(regexp_replace(regexp_replace(replace(text, chr(9), ' '), ' +', ' ', 'g'), ' ?\n ?', chr(10), 'g'))) AS digest FROM documents
WHERE text NOT LIKE '%' || chr(10) || chr(10) || '%'
""")
def x17_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short links expanded, blanks and blank lines collapsed."""
    docs = table(spark, sf_dir, "documents").filter(~F.contains("text", F.lit("\n\n")))
    number = F.col("doc_id").cast("string")
    links = F.array(F.struct(F.lit("https://t.co/x").alias("short"), F.concat(F.lit("https://example.org/"), number).alias("target")), F.struct(F.lit("https://t.co/y").alias("short"), F.lit("").alias("target")))
    raw = F.concat(F.lit("  see  https://t.co/x \t now https://t.co/y\n\n \n\n"), "text")
    return docs.select("doc_id", F.md5(text.clean_text(raw, links).cast("binary")).alias("digest"))


@query("""
SELECT c_custkey, CASE WHEN o = 0 THEN 'Etc/UTC' WHEN o % 60 = 0 THEN 'Etc/GMT' || CASE WHEN o > 0 THEN '-' ELSE '+' END || abs(o) // 60 WHEN o = 330 THEN 'Asia/Kolkata' END AS zone,
  CAST(TIMESTAMP '2024-03-01 00:30:00' + to_minutes(o) AS DATE) AS day FROM (SELECT c_custkey, CAST(c_custkey % 57 * 30 - 840 AS INTEGER) AS o FROM customer)
""")
def x19_fixed_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of a fixed zone, and the date on its clock."""
    offset = F.col("c_custkey") % 57 * 30 - 840
    at = F.lit("2024-03-01 00:30:00").cast("timestamp")
    return table(spark, sf_dir, "customer").select("c_custkey", values.fixed_zone(offset).alias("zone"), values.local_date(at, offset).alias("day"))


@query("SELECT p_partkey, '[' || p_name || '](' || p_brand || ') end' AS body FROM part")
def x16_markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link tokens as Markdown."""
    token = F.concat(F.lit("[["), "p_name", F.lit("|"), "p_brand", F.lit("]] end"))
    return table(spark, sf_dir, "part").select("p_partkey", text.markdown_links(token).alias("body"))


@query("SELECT event_id, date_trunc('second', ts) AS instant, CAST(date_trunc('second', ts) + to_hours(CAST(event_id % 25 - 12 AS INTEGER)) AS DATE) AS local_day FROM events")
def x18_post_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps with names of days and months, and the date on the author's clock."""
    written = F.concat(F.lit("Mon "), F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("ts", "yyyy"))
    parsed = values.post_timestamp(written)
    return table(spark, sf_dir, "events").select(
        "event_id", parsed.cast("timestamp_ntz").alias("instant"), values.local_date(parsed, (F.col("event_id") % 25 - 12) * 60).alias("local_day")
    )


@query("""
SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS lang, regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1) AS number FROM pages
""")
def x20_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, kind and id of a URL."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"),
        F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1).alias("lang"),
        F.regexp_extract("url", r"/([0-9]+)(?:[?#]|$)", 1).alias("number"),
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
def x23_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors into JSON; what is absent is null."""
    return table(spark, sf_dir, "events").select(
        "event_id", values.selected(F.col("props"), "$.k").cast("long").alias("k"), values.selected(F.col("props"), "$.none").alias("none")
    )


@query("SELECT p_partkey, array_to_string(list_transform(range(1, 6), lambda i: CAST(CAST(round_even(p_size * i / 6.0, 3) * 1000 AS BIGINT) AS VARCHAR)), ';') AS times FROM part")
def x26_sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five times inside a duration, in milliseconds."""
    times = F.transform(values.sample_times(F.col("p_size").cast("double"), 5), lambda t: F.round(t * 1000).cast("long").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(times, ";").alias("times"))


@query("SELECT event_id, ts + INTERVAL 3 HOUR + INTERVAL 25 MINUTE AS corrected FROM events")
def x28_corrected_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera times moved by the offset of a baseline pair."""
    camera, actual = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-01 03:25:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", values.corrected_clock(F.col("ts"), camera, actual).alias("corrected"))


@query("""
WITH r AS (SELECT p_partkey, p_brand AS o0, p_brand || '-' || p_size AS o1, p_brand || '-' || p_size || '-' || p_partkey AS o2 FROM part),
a AS (SELECT *, count(*) OVER (PARTITION BY o0) AS n0 FROM r),
b AS (SELECT *, count(*) OVER (PARTITION BY o1) AS n1 FROM a WHERE n0 > 1)
SELECT p_partkey, o0 AS name, 0 AS level FROM a WHERE n0 = 1 UNION ALL SELECT p_partkey, o1, 1 FROM b WHERE n1 = 1 AND o1 NOT IN (SELECT o0 FROM a WHERE n0 = 1)
UNION ALL SELECT p_partkey, o2, 2 FROM b WHERE NOT (n1 = 1 AND o1 NOT IN (SELECT o0 FROM a WHERE n0 = 1))
""")
def x30_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names where they are unique, longer ones where they are not."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    options = [F.col("p_brand"), F.concat_ws("-", "p_brand", size), F.concat_ws("-", F.col("p_brand"), size, key)]
    return ranking.unique_names(table(spark, sf_dir, "part"), "p_partkey", options)


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def x33_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks since year one back to dates."""
    days = F.datediff(F.to_date("o_orderdate"), F.lit("0001-01-01").cast("date")).cast("long")
    ticks = days * F.lit(864_000_000_000) + F.col("o_orderkey") % 1000
    return table(spark, sf_dir, "orders").select("o_orderkey", values.ticks_date(ticks).alias("day"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'video/mp4' WHEN 2 THEN 'image/heic' ELSE 'application/octet-stream' END AS mime FROM part")
def x34_media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media types by extension."""
    extension = F.element_at(F.split(F.lit("JPG,mp4,Heic,xyz"), ","), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", values.media_type(F.concat(F.lit("a.b."), extension)).alias("mime"))


@query("SELECT p_partkey, p_partkey % 5 <> 0 AND p_partkey % 7 <> 3 AS valid FROM part")
def x35_valid_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops with a positive size and a rotation in range."""
    crop = F.format_string('{"x": 1, "y": 2.5, "size": %d, "rotation": %d}', F.col("p_partkey") % 5, F.when(F.col("p_partkey") % 7 == 3, 181).otherwise(-90))
    return table(spark, sf_dir, "part").select("p_partkey", values.crop_square(crop).isNotNull().alias("valid"))


@query("SELECT strftime(d, '%Y-%m') AS month FROM (SELECT unnest(generate_series(date_trunc('month', (SELECT min(o_orderdate) FROM orders)), date_trunc('month', (SELECT max(o_orderdate) FROM orders)), INTERVAL 1 MONTH)) AS d)")
def x36_month_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All months between two dates."""
    from archivolt.operators.temporal import month_calendar

    bounds = table(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return month_calendar(bounds, "a", "b")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM customer
UNION ALL SELECT c_custkey + 10000000, c_acctbal, 'new' FROM customer WHERE c_custkey % 10 = 0
""")
def k01_keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming rows replace or join the stored ones."""
    stored = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit("old").alias("state"))
    changed = stored.filter("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("new").alias("state"))
    added = stored.filter("c_custkey % 10 = 0").select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), "c_acctbal", F.lit("new").alias("state"))
    return upsert.keyed_upsert(stored, changed.unionByName(added), ["c_custkey"])


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_mktsegment <> 'BUILDING' THEN 'suggested' ELSE c_mktsegment END AS c_mktsegment FROM customer
""")
def k05_guarded_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed rows are never overwritten."""
    stored = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    incoming = stored.filter("c_custkey % 2 = 0").withColumn("c_mktsegment", F.lit("suggested"))
    return upsert.guarded_upsert(stored, incoming, ["c_custkey"], F.col("c_mktsegment") == "BUILDING")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'fp2' ELSE 'fp1' END AS fingerprint, c_custkey % 4 <> 0 AS active,
  CASE WHEN c_custkey % 5 = 0 AND c_custkey % 4 <> 0 THEN false ELSE c_custkey % 2 = 0 END AS reviewed,
  CASE WHEN c_custkey % 5 = 0 AND c_custkey % 4 <> 0 THEN 'now' ELSE 'then' END AS updated_at
FROM (SELECT c_custkey FROM customer WHERE NOT (c_custkey % 5 = 0 AND c_custkey % 4 = 0))
UNION ALL SELECT c_custkey, 'fp1', false, c_custkey % 2 = 0, 'then' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 4 = 0
""")
def k06_soft_delete_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full sync: vanished rows become inactive, changed ones lose their review."""
    key = F.col("c_custkey")
    stored = table(spark, sf_dir, "customer").select(
        "c_custkey", F.lit("fp1").alias("fingerprint"), F.lit(True).alias("active"), (key % 2 == 0).alias("reviewed"), F.lit("then").alias("updated_at")
    )
    incoming = table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select(
        "c_custkey", F.when(key % 5 == 0, "fp2").otherwise("fp1").alias("fingerprint")
    )
    return upsert.soft_delete_sync(stored, incoming, "c_custkey", "fingerprint", F.lit("now"))


@query("SELECT 'old/' || c_custkey AS old_path, 'new/' || c_custkey AS new_path FROM customer WHERE c_custkey % 6 = 0")
def k09_moved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New paths with the content of vanished ones."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.md5(F.col("c_custkey").cast("string").cast("binary")).alias("sha"), F.col("c_acctbal").alias("size")
    )
    path = F.concat(F.lit("old/"), F.col("c_custkey").cast("string"))
    moved = F.when(F.col("c_custkey") % 6 == 0, F.concat(F.lit("new/"), F.col("c_custkey").cast("string"))).otherwise(path)
    stored, scanned = rows.select(path.alias("path"), "sha", "size"), rows.select(moved.alias("path"), "sha", "size")
    return upsert.moved_rows(stored, scanned, "path", ["sha", "size"])


@query("SELECT CASE WHEN c_custkey % 6 = 0 THEN 'new/' || c_custkey ELSE 'old/' || c_custkey END AS path, c_nationkey FROM customer")
def k10_relinked_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependent rows follow moved paths."""
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("old/"), F.col("c_custkey").cast("string")).alias("path"), "c_nationkey")
    return upsert.relink_paths(rows, k09_moved_files(spark, sf_dir), "path")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def k11_prune_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the scan saw."""
    seen = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return upsert.prune_unseen(table(spark, sf_dir, "customer"), seen, ["c_custkey"]).select("c_custkey")


@query("""
WITH t AS (SELECT *, CASE WHEN p_size % 7 = 2 THEN 2 ELSE p_partkey % 3 END AS third FROM part),
r AS (SELECT DISTINCT '/lib/' || (p_size % 7) || CASE WHEN third > 0 THEN '/' || (p_size % 11) ELSE '' END || CASE WHEN third > 1 THEN '/' || (p_partkey % 13) ELSE '' END AS root FROM t)
SELECT a.root, arg_min(b.root, length(b.root)) AS outermost FROM r a JOIN r b ON a.root = b.root OR starts_with(a.root, b.root || '/') GROUP BY 1
""")
def k12_outermost_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested roots folded into the outermost; below one of them only deep roots are there."""
    third = F.when(F.col("p_size") % 7 == 2, 2).otherwise(F.col("p_partkey") % 3)
    parts = [F.lit("/lib"), (F.col("p_size") % 7).cast("string"), F.when(third > 0, (F.col("p_size") % 11).cast("string")), F.when(third > 1, (F.col("p_partkey") % 13).cast("string"))]
    rows = table(spark, sf_dir, "part").select(F.concat_ws("/", *parts).alias("root")).distinct()
    return upsert.outermost_roots(rows, "root")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'F' WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 1 THEN 'O' ELSE o_orderstatus END AS o_orderstatus,
 (o_orderstatus = 'O' AND o_orderkey % 2 = 0) OR (o_orderstatus = 'P' AND o_orderkey % 2 = 1) AS changed FROM orders
""")
def k20_guarded_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes where the present status allows them."""
    wanted = F.when(F.col("o_orderkey") % 2 == 0, "F").otherwise("O")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return upsert.guarded_transition(rows, "o_orderstatus", {"O": ["F"], "P": ["O"]}, wanted)


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN -1.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def k24_staged_over_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged decisions win over submitted ones on read."""
    stored = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    staged = stored.filter("c_custkey % 4 = 1").select("c_custkey", F.lit(-1.0).alias("c_acctbal"))
    return upsert.staged_over_stored(stored, staged, ["c_custkey"], ["c_acctbal"])


@query("""
SELECT o_orderkey, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS statuses FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = o_orderkey AND x.l_quantity > 48) GROUP BY 1 HAVING NOT bool_and(l_quantity < 5)
""")
def r02_target_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets less those confirmed or of clear quality, with their statuses joined."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_quantity").alias("most"),
        F.bool_and(F.col("l_quantity") < 5).alias("low"),
        F.array_join(F.sort_array(F.collect_set("l_returnflag")), ";").alias("statuses"),
    )
    open_ = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select("o_orderkey")
    return open_.join(lines.filter("most <= 48 AND NOT low"), "o_orderkey").select("o_orderkey", "statuses")


@query("""
SELECT o_orderkey, count(*) FILTER (l_returnflag <> 'R') AS visible, count(*) FILTER (l_returnflag = 'R') AS hidden, count(*) FILTER (l_returnflag <> 'R') = 0 AS placeholder
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity <= 45 GROUP BY 1
""")
def r05_queue_after_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue without applied rows; emptied entries become placeholders."""
    left = table(spark, sf_dir, "lineitem").filter("l_quantity <= 45").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count_if(F.col("l_returnflag") != "R").alias("visible"), F.count_if(F.col("l_returnflag") == "R").alias("hidden")
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(left, "o_orderkey", "left")
    visible = F.coalesce("visible", F.lit(0))
    hidden = F.greatest(F.coalesce("hidden", F.lit(0)), F.when(F.col("visible").isNull(), 0))
    return rows.select("o_orderkey", visible.alias("visible"), hidden.alias("hidden"), (visible == 0).alias("placeholder"))
