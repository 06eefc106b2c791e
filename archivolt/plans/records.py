"""Queries of record functions: scores, captures, keys, names, shapes, and the small filters and lists of the inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivolt.functions import records
from archivolt.operators import filters, matching, ranking
from archivolt.plans._base import collector
from archivolt.session import table

QUERIES, ORACLES, query = collector()


def _pick(column: str, values: list[str]) -> Column:
    """One of the texts by the rest of a key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values) + 1).cast("int"))


_WORDS = {"quality_positive_" + w if n > 0 else "quality_negative_" + w: (w, n) for w, n in records.QUALITY_POINTS.items()}


@query(
    """
WITH n AS (SELECT p_partkey, [p_partkey || '-edited_final', 'Best small ' || p_brand, 'HI-RES', 'web thumb low-res', p_name || ' full'][p_partkey % 5 + 1] AS name FROM part),
t AS (SELECT p_partkey, list_append(regexp_split_to_array(lower(name), '[^a-z0-9]+'), regexp_replace(lower(name), '[^a-z0-9]+', '', 'g')) AS words FROM n),
q(place, word, name, points) AS (VALUES """
    + ", ".join(f"({i}, '{w}', '{name}', {n})" for i, (name, (w, n)) in enumerate(_WORDS.items()))
    + """)
SELECT p_partkey, coalesce(sum(points), 0)::INT AS score, coalesce(string_agg(name, ';' ORDER BY place), '') AS evidence FROM t LEFT JOIN q ON list_contains(words, word) GROUP BY 1
"""
)
def x02_quality_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the quality words of file names; a whole name may be one word with marks inside."""
    parts = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    forms = [F.concat(key, F.lit("-edited_final")), F.concat(F.lit("Best small "), "p_brand"), F.lit("HI-RES"), F.lit("web thumb low-res"), F.concat("p_name", F.lit(" full"))]
    name = F.concat(F.element_at(F.array(*forms), (F.col("p_partkey") % 5 + 1).cast("int")), F.lit(".JPG"))
    found = parts.select("p_partkey", records.quality_score(name).alias("q"))
    return found.select("p_partkey", "q.score", F.array_join("q.evidence", ";").alias("evidence"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-05:30' END AS timestamp,
  CASE event_id % 4 WHEN 0 THEN 'exif_datetime_digitized' WHEN 1 THEN 'gps_datetime_utc' WHEN 2 THEN 'quicktime_create_date' END AS source FROM events
""")
def x04_best_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capture time of the most trusted tag that holds one."""
    at = F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    tags = [
        {"EXIF:DateTimeOriginal": F.lit("0000:00:00 00:00:00"), "EXIF:CreateDate": F.concat(at, F.lit("Z")), "QuickTime:CreateDate": at},
        {"XMP-xmp:CreateDate": F.lit("2024"), "Composite:GPSDateTime": F.date_format("ts", "yyyy:MM:dd HH:mm:ss.SSSSSS")},
        {"QuickTime:CreateDate": F.concat(at, F.lit("-0530")), "QuickTime:TrackCreateDate": at},
        {"File:Name": at},
    ]
    maps = F.array(*[F.create_map(*[x for k, v in t.items() for x in (F.lit(k), v)]) for t in tags])
    found = table(spark, sf_dir, "events").select("event_id", records.best_capture(F.element_at(maps, (F.col("event_id") % 4 + 1).cast("int"))).alias("b"))
    return found.select("event_id", "b.timestamp", "b.source")


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN abs(event_id % 1000 - 3600.0) WHEN 1 THEN (event_id % 1000)::DOUBLE END AS seconds FROM events
""")
def x08_time_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds between written times: as instants if both have a zone, else by their clocks; none for unreadable ones."""
    first = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    later = F.date_format(F.timestamp_add("SECOND", (F.col("event_id") % 1000).cast("int"), F.col("ts")), "yyyy-MM-dd'T'HH:mm:ss")
    third = F.col("event_id") % 3
    a = F.when(third == 0, F.concat(first, F.lit("Z"))).when(third == 1, F.concat(first, F.lit("+02:00"))).otherwise("unknown")
    b = F.when(third == 0, F.concat(later, F.lit("+01:00"))).otherwise(later)
    return table(spark, sf_dir, "events").select("event_id", records.time_delta_seconds(a, b).alias("seconds"))


@query("SELECT p_partkey, sha256('photo' || chr(0) || p_name || chr(0) || p_brand) AS pair_key FROM part")
def x10_pair_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of pairs of paths."""
    return table(spark, sf_dir, "part").select("p_partkey", records.pair_key(F.lit("photo"), F.col("p_name"), F.col("p_brand")).alias("pair_key"))


@query("""
SELECT event_id, date_trunc('second', (ts::TIMESTAMP AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin') AS local,
  strftime(((CAST(ts AS DATE) + INTERVAL 12 HOUR)::TIMESTAMP AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS noon FROM events
""")
def x14_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The local clock of an instant, and the instant of local noon, over changes of summer time."""
    noon = records.noon_utc(F.to_date("ts"), F.lit("America/New_York"))
    return table(spark, sf_dir, "events").select("event_id", records.local_clock(F.col("ts"), F.lit("Europe/Berlin")).alias("local"), noon.alias("noon"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'user:' || c_custkey ELSE '' END AS identity, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END AS name,
  CASE WHEN c_custkey % 4 = 3 THEN c_mktsegment ELSE c_name END AS canonical FROM customer
""")
def x21_companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People that a message names after "with", by the place of the name, and names without the path of their tag."""
    lead = _pick("c_custkey", ["Lunch with ", "Lunch by ", "Lunch with "])
    message = F.concat(lead, F.lit("@"), "c_name", F.lit(" today"))
    first = F.length(lead).cast("int")
    last = (first + 1 + F.length("c_name")).cast("int")
    kind = _pick("c_custkey", ["user", "user", "venue"])
    entity = F.struct(kind.alias("type"), F.col("c_custkey").cast("string").alias("id"), first.alias("first"), last.alias("last"))
    people = records.companions(message, F.array(entity, entity))
    tag = F.concat(_pick("c_custkey", ["person: ", "People|Friends/", "  ", "Persons/"]), F.when(F.col("c_custkey") % 4 == 3, F.col("c_mktsegment")).otherwise(F.col("c_name")))
    canonical = records.people_name(tag)
    one = F.try_element_at(people, F.lit(1))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.coalesce(one["identity"], F.lit("")).alias("identity"), F.coalesce(one["name"], F.lit("")).alias("name"), canonical.alias("canonical")
    )


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE o_orderkey % 3 WHEN 0 THEN ' 142503' ELSE ' 000000' END AS memory,
  CASE o_orderkey % 4 WHEN 0 THEN 'Trip ' || o_custkey WHEN 1 THEN '' WHEN 2 THEN '' ELSE 'a_b' END AS title FROM orders
""")
def x25_memory_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory's day with the clock of its capture, and the title in the name of a video."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    capture = _pick("o_orderkey", ["2001-02-03T14:25:03.5Z", "2001-02-03 99:00:00", ""])
    name = F.concat(day, F.element_at(F.array(F.concat(F.lit(" 101112 Trip "), F.col("o_custkey").cast("string"), F.lit(" -")), F.lit(""), F.lit("_10.11.12"), F.lit(" - a_b")), (F.col("o_orderkey") % 4 + 1).cast("int")), F.lit(".mp4"))
    return table(spark, sf_dir, "orders").select("o_orderkey", records.memory_datetime(capture, day).alias("memory"), records.inferred_title(name).alias("title"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_brand END AS person, CASE WHEN p_partkey % 2 = 0 THEN 'entry:2024-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') END AS entry FROM part
""")
def x32_path_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People from the paths of tags, and entries from the names of working copies."""
    tag = F.concat(_pick("p_partkey", ["People/Family/", "person|", "Places/"]), "p_brand")
    day = F.format_string("2024-01-%02d", F.col("p_partkey") % 28 + 1)
    path = F.concat(F.lit("/x/"), F.when(F.col("p_partkey") % 2 == 0, "Working Copy - ").otherwise("Copy - "), day, F.lit(" - sq2560.jpg"))
    found = F.nullif(F.regexp_extract(path, r"(?:^|/)Working Copy - (\d{4}-\d{2}-\d{2}) - (?:associated )?sq\d+(?: - [0-9a-f]{12})?\.(?:jpe?g|heic)$", 1), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", records.person_from_tag(tag).alias("person"), F.concat(F.lit("entry:"), found).alias("entry"))


@query("""
SELECT c_custkey, c_custkey || ' ' || c_mktsegment AS address, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Town' END AS city, CASE WHEN c_custkey % 3 = 0 THEN 'TOWN' ELSE '' END AS state,
  c_custkey || ' ' || c_mktsegment || ', ' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Town' END || CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN ', TOWN' ELSE '' END || ', Land' AS display FROM customer
""")
def x37_flat_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A geocoder's nested answer as a flat address, each part shown once."""
    third, even = F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 2 == 0
    address = F.struct(
        F.col("c_custkey").cast("string").alias("house_number"),
        F.col("c_mktsegment").alias("street"),
        F.when(even, F.col("c_name")).alias("city"),
        F.lit("Town").alias("town"),
        F.when(third, "TOWN").alias("region"),
        F.lit(" Land ").alias("country"),
    )
    found = records.flat_address(F.to_json(F.struct(address.alias("address"))))
    return table(spark, sf_dir, "customer").select("c_custkey", found.alias("f")).select("c_custkey", "f.address", "f.city", "f.state", "f.display")


@query("""
WITH g AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(least(greatest((CAST(x AS DOUBLE) + 4) * 32, 0), 255))::INT) AS gray FROM embeddings),
d AS (SELECT a.vec_id, a.label = b.label AS sized, list_transform(list_zip(a.gray, b.gray), lambda z: abs(z[1] - z[2])) AS gaps FROM g a JOIN g b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, sized AND list_sum(gaps) <= 4 * len(gaps) AND len(list_filter(gaps, lambda x: x > 32)) <= 10 AS same FROM d
""")
def v08_same_picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring samples that show one picture: equal size, small differences in sum, few large ones."""
    gray = F.transform("embedding", lambda x: F.floor(F.least(F.greatest((x.cast("double") + 4) * 32, F.lit(0.0)), F.lit(255.0))).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", gray.alias("gray"))
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("l"), F.col("gray").alias("g"))
    return rows.join(other, "vec_id").select("vec_id", records.same_picture(F.col("gray"), F.col("g"), F.col("label"), F.col("l")).alias("same"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'R' AS same, l_linestatus = 'O' AS dated, CASE l_linenumber % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS crop, l_quantity > 45 AS fallback FROM lineitem),
p AS (SELECT *, (CASE WHEN same THEN 100 ELSE 0 END + CASE WHEN dated THEN 20 ELSE 0 END + CASE WHEN NOT same AND crop = 'high' THEN 40 WHEN NOT same AND crop = 'medium' THEN 15 ELSE 0 END) AS score FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, score, CASE WHEN score >= 100 AND NOT fallback THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS confidence,
  concat_ws(';', CASE WHEN same THEN 'same_sha256' END, CASE WHEN dated THEN 'date_hint' END, CASE WHEN NOT same AND crop = 'high' THEN 'crop_high' WHEN NOT same AND crop = 'medium' THEN 'crop_medium' END, CASE WHEN fallback THEN 'fallback_source' END) AS evidence FROM p
""")
def v10_original_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of evidence for originals: content, date, crop; fallback sources are never of high confidence."""
    crop = _pick("l_linenumber", ["high", "medium", "low"])
    found = records.original_score(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", crop, F.col("l_quantity") > 45)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return table(spark, sf_dir, "lineitem").select(*keys, found.alias("f")).select(*keys, "f.score", "f.confidence", "f.evidence")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-28' AND DATE '1996-03-31'")
def f03_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an inclusive range of dates; the range reaches the scan as limits of the timestamp."""
    first, after = F.lit("1996-02-28").cast("timestamp_ntz"), F.lit("1996-04-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").filter((F.col("o_orderdate") >= first) & (F.col("o_orderdate") < after)).select("o_orderkey")


@query("""
SELECT o_orderkey, action, action IN ('import', 'selected', 'reviewed_import') AS selected, nothing FROM (
  SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'import' WHEN 1 THEN 'reviewed_import' WHEN 2 THEN 'canonical_only' ELSE 'skip' END AS action, o_orderkey % 5 = 0 AND o_orderkey % 2 = 0 AS nothing FROM orders)
""")
def f15_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be done with a staged record, whether it is selected, and whether it is empty."""
    action = records.action_of(_pick("o_orderkey", ["import", "", "", "skip"]), F.when(F.col("o_orderkey") % 4 == 1, "reviewed_import"))
    empty = F.array().cast("array<string>")
    media = F.when(F.col("o_orderkey") % 2 == 1, F.array(F.lit("m"))).otherwise(empty)
    nothing = records.has_nothing(F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise("t"), media, F.lit(None).cast("array<string>"), F.lit(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", action.alias("action"), records.is_selected(action).alias("selected"), nothing.alias("nothing"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r JOIN orders ON o_orderkey = l_orderkey WHERE abs(date_diff('day', d, CAST(o_orderdate AS DATE))) <= CASE WHEN o_orderstatus = 'P' THEN 7 ELSE 30 END
""")
def f17_scope_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results cut to the window of dates that their entry's scope now has."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    stored = table(spark, sf_dir, "lineitem").select(*keys, F.to_date("l_shipdate").alias("d"))
    scope = F.when(F.col("o_orderstatus") == "P", 7).otherwise(30)
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("t"), scope.alias("days"))
    return stored.join(entries, "l_orderkey").filter(F.abs(F.datediff("d", "t")) <= F.col("days")).select(*keys)


@query("""
SELECT c_custkey, CASE WHEN abs(c_acctbal / 50) <= 90 AND c_custkey % 7 <> 0 THEN round(c_acctbal / 50, 4) END AS latitude,
  CASE WHEN c_custkey % 3 = 0 AND abs(c_custkey % 2000 - 1000) <= 840 THEN CAST(c_custkey % 2000 - 1000 AS INTEGER) END AS minutes FROM customer
""")
def f18_checked_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates and offsets inside their ranges; words, fractions and truth values are none."""
    key = F.col("c_custkey")
    latitude = F.when(key % 7 == 0, "true").otherwise(F.round(F.col("c_acctbal") / 50, 4).cast("string"))
    whole = (key % 2000 - 1000).cast("string")
    minutes = F.when(key % 3 == 0, whole).when(key % 3 == 1, F.concat(whole, F.lit(".5"))).otherwise("soon")
    return table(spark, sf_dir, "customer").select("c_custkey", records.in_range(latitude, -90, 90).alias("latitude"), records.offset_minutes(minutes).alias("minutes"))


#: Named views of a review table as predicates.
VIEWS = {
    "recommended": "active AND NOT excluded AND NOT reviewed",
    "needs_context": "active AND classification = 'missing_context' AND NOT reviewed",
    "included": "active AND decision = 'include' AND reviewed",
    "excluded": "active AND decision = 'exclude'",
    "all": "active",
}
_REVIEW_SQL = """
WITH r AS (SELECT o_orderkey, o_orderkey % 11 <> 0 AS active, o_orderkey % 5 = 0 AS excluded, o_orderkey % 2 = 0 AS reviewed, CASE WHEN o_orderpriority = '1-URGENT' THEN 'missing_context' ELSE 'plain' END AS classification,
  CASE o_orderstatus WHEN 'F' THEN 'include' WHEN 'O' THEN 'exclude' ELSE '' END AS decision, o_totalprice, o_orderdate FROM orders)
"""


def review_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries of a review."""
    key, state = F.col("o_orderkey"), F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (key % 11 != 0).alias("active"),
        (key % 5 == 0).alias("excluded"),
        (key % 2 == 0).alias("reviewed"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "missing_context").otherwise("plain").alias("classification"),
        F.when(state == "F", "include").when(state == "O", "exclude").otherwise("").alias("decision"),
        "o_totalprice",
        "o_orderdate",
    )


@query(_REVIEW_SQL + " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM r WHERE {rule}" for name, rule in VIEWS.items()))
def f20_named_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All named views of a review in one pass: each its predicate."""
    rows = review_table(spark, sf_dir)
    parts = [F.struct(F.lit(n).alias("name"), F.expr(rule).alias("held")) for n, rule in VIEWS.items()]
    spread = rows.select("o_orderkey", F.explode(F.array(*parts)).alias("v")).select("o_orderkey", "v.*")
    return spread.groupBy("name").agg(F.count_if("held").alias("n"), F.sum(F.when(F.col("held"), F.col("o_orderkey"))).alias("keys"))


@query(_REVIEW_SQL + "SELECT o_orderkey, row_number() OVER (ORDER BY decision DESC, o_totalprice DESC, o_orderdate, o_orderkey) AS place FROM r WHERE active AND NOT excluded AND NOT reviewed QUALIFY place <= 50")
def w15_queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of a review queue by four keys."""
    order = [F.col("decision").desc(), F.col("o_totalprice").desc(), F.col("o_orderdate"), F.col("o_orderkey")]
    head = review_table(spark, sf_dir).filter(VIEWS["recommended"]).orderBy(*order).limit(50)
    return head.select("o_orderkey", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query(_REVIEW_SQL + "SELECT o_orderkey, count(*) OVER () AS total FROM r WHERE active AND reviewed ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def o05_review_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of a filtered list with the size of the whole."""
    rows = review_table(spark, sf_dir).filter("active AND reviewed")
    page = rows.orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset(50).limit(25).select("o_orderkey")
    return page.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))  # one row


@query("""
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 25
""")
def o07_undecided_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of candidates that no decision names."""
    decided = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    left = table(spark, sf_dir, "orders").join(decided, "o_orderkey", "left_anti")
    return left.orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(25).limit(25).select("o_orderkey")


@query("""
WITH n AS (SELECT l_partkey, min(abs(date_diff('day', CAST(l_shipdate AS DATE), DATE '1997-06-15'))) AS distance FROM lineitem WHERE abs(date_diff('day', CAST(l_shipdate AS DATE), DATE '1997-06-15')) <= 20 GROUP BY 1)
SELECT l_partkey, distance FROM n ORDER BY distance, l_partkey LIMIT 250
""")
def o10_nearby_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos near a date, each path once at its closest date, 250 at most."""
    distance = F.abs(F.datediff("l_shipdate", F.lit("1997-06-15").cast("date")))
    near = table(spark, sf_dir, "lineitem").select("l_partkey", distance.alias("distance")).filter("distance <= 20")
    return near.groupBy("l_partkey").agg(F.min("distance").alias("distance")).orderBy("distance", "l_partkey").limit(250)


@query("SELECT o_orderkey AS id, 'primary' AS role FROM orders UNION ALL SELECT l_orderkey, 'associated' FROM lineitem WHERE l_linenumber > 1")
def u02_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary and associated sources in one list."""
    primary = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("primary").alias("role"))
    more = table(spark, sf_dir, "lineitem").filter("l_linenumber > 1").select(F.col("l_orderkey").alias("id"), F.lit("associated").alias("role"))
    return primary.unionByName(more)


@query("""
SELECT l_orderkey, count(*) AS n FROM (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 40) GROUP BY 1
""")
def u08_merged_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of rejected candidates of two stages, united by entry."""
    lines = table(spark, sf_dir, "lineitem")
    held = [lines.filter(rule).select("l_orderkey", "l_partkey") for rule in ("l_returnflag = 'R'", "l_quantity > 40")]
    return held[0].unionByName(held[1]).distinct().groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS returned, count(DISTINCT CASE WHEN l_quantity > 40 THEN l_suppkey END) AS large FROM lineitem")
def u10_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of sets under conditions."""
    return table(spark, sf_dir, "lineitem").agg(
        F.count_distinct("l_partkey").alias("parts"),
        F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("returned"),
        F.count_distinct(F.when(F.col("l_quantity") > 40, F.col("l_suppkey"))).alias("large"),
    )


@query("""
SELECT count(*) AS total, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (value > 50) AS large, count(DISTINCT user_id) AS users, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day FROM events
""")
def a27_source_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a source in one pass."""
    return table(spark, sf_dir, "events").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("event_type") == "view").alias("views"),
        F.count_if(F.col("value") > 50).alias("large"),
        F.count_distinct("user_id").alias("users"),
        F.min(F.to_date("ts")).alias("first_day"),
        F.max(F.to_date("ts")).alias("last_day"),
    )


@query("""
WITH s AS (SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'),
m AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS ready FROM lineitem GROUP BY 1)
SELECT count(*) AS entries, count(*) FILTER (coalesce(ready, 0) = coalesce(n, 0) AND n > 0) AS ready, count(*) FILTER (n IS NULL) AS without_media, coalesce(sum(n - ready), 0)::BIGINT AS missing FROM s LEFT JOIN m ON l_orderkey = o_orderkey
""")
def a33_scope_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the media of a range of dates are ready."""
    scope = table(spark, sf_dir, "orders").filter(F.to_date("o_orderdate").between(F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date"))).select("o_orderkey")
    media = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("ready"))
    return scope.join(media, "o_orderkey", "left").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if((F.col("ready") == F.col("n")) & (F.col("n") > 0)).alias("ready"),
        F.count_if(F.col("n").isNull()).alias("without_media"),
        F.coalesce(F.sum(F.col("n") - F.col("ready")), F.lit(0)).alias("missing"),
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_size AS width, p_brand AS place FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10")
def j40_lookup_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of an index looked up by path; unknown paths stay empty. Which side is small is left to the planner."""
    facts = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("width"), F.col("p_brand").alias("place"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return table(spark, sf_dir, "lineitem").select(*keys).join(facts, "l_partkey", "left").select(*keys, "width", "place")


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://example.org/' || page_id ELSE url END AS url FROM pages")
def r22_url_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with the corrections that a small table holds."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fixes = pages.filter("page_id % 4 = 0").select("page_id", F.concat(F.lit("https://example.org/"), F.col("page_id").cast("string")).alias("fixed"))
    return pages.join(fixes, "page_id", "left").select("page_id", F.coalesce("fixed", "url").alias("url"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'photos' WHEN 1 THEN 'videos' WHEN 2 THEN 'videos' END AS kind, p_partkey % 4 < 2 AS inside FROM part
""")
def r23_media_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of a file by extension or first bytes, and whether its path stays in the export."""
    head = F.when(F.col("p_partkey") % 5 == 2, F.unhex(F.lit("000000186674797069736F6D"))).otherwise(F.unhex(F.lit("0000001866")))
    path = _pick("p_partkey", ["photos/./a/../b.jpg", "a/b", "a/../../b", "/etc/x"])
    return table(spark, sf_dir, "part").select(
        "p_partkey", records.media_class(_pick("p_partkey", ["JPG", "mp4", "", "", "txt"]), head).alias("kind"), records.stays_inside(path).alias("inside")
    )


@query("SELECT l_returnflag AS action, l_linestatus AS reason, count(*) AS n FROM lineitem GROUP BY 1, 2")
def r46_action_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned actions by reason."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("action"), F.col("l_linestatus").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, 'jpeg_' || (o_orderkey % 3 + 1) * 640 || '_q' || (80 + o_orderkey % 10) AS policy,
 'Working Copy - ' || strftime(o_orderdate, '%Y-%m-%d') || ' - ' || CASE WHEN o_orderkey % 2 = 0 THEN 'sq640' ELSE 'associated sq640 - ' || left(sha256(CAST(o_orderkey AS VARCHAR)), 12) END AS stem FROM orders
""")
def r47_policy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of policies and of the files made by them."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    digest = F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 12)
    size = F.when(key % 2 == 0, F.lit("sq640")).otherwise(F.concat(F.lit("associated sq640 - "), digest))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", records.policy_name(F.lit("jpeg"), (key % 3 + 1) * 640, 80 + key % 10).alias("policy"), F.concat(F.lit("Working Copy - "), day, F.lit(" - "), size).alias("stem")
    )


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS n FROM lineitem)
SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM f WHERE n = 1
""")
def v09_preferred_photo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of photos that show the same (a distance of zero by content), the larger, then the heavier, then the first."""
    order = [F.col("l_quantity").desc(), F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")]
    return ranking.first_by(table(spark, sf_dir, "lineitem"), ["l_partkey"], order).select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")


@query("""
SELECT o_orderkey FROM orders o WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND o_orderstatus IN ('O', 'P') AND contains(lower(o_orderpriority), 'e') AND o_totalprice BETWEEN 50000 AND 400000
  AND o_orderkey NOT IN (7, 14, 21) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
""")
def f21_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten optional filters at once, with items left out that have a private frame."""
    items = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    frames = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    kept = filters.triage(
        items, frames, "o_orderkey", first="1996-01-01", last="1999-12-31", date="day", statuses=["O", "P"], status="o_orderstatus", term="E",
        texts=("o_orderpriority",), least=50_000, most=400_000, amount="o_totalprice", skip=[7, 14, 21], with_frames=True, without=F.col("l_returnflag") == "R",
    )
    return kept.select("o_orderkey")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'A' AS e1, l_linestatus = 'O' AS e2, l_quantity > 25 AS e3, l_tax = 0 AS e4 FROM lineitem),
s AS (SELECT *, (CASE WHEN e1 THEN 100 ELSE 0 END + CASE WHEN e2 THEN 35 ELSE 0 END + CASE WHEN e3 THEN 20 ELSE 0 END + CASE WHEN e4 THEN 2 ELSE 0 END) AS score FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, score FROM s WHERE score >= 55 AND (e1 OR e2)
""")
def f26_anchored_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with enough points of evidence, of which one must be an anchor."""
    evidence = {
        "exact_hash_size_match": F.col("l_returnflag") == "A",
        "normalized_stem_match": F.col("l_linestatus") == "O",
        "dimensions_match": F.col("l_quantity") > 25,
        "source_root_match": F.col("l_tax") == 0,
    }
    score, reasons = matching.additive_score(evidence)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    scored = table(spark, sf_dir, "lineitem").select(*keys, score.alias("score"), reasons.alias("reasons"))
    return matching.accept(scored, 55, ["exact_hash_size_match", "normalized_stem_match"]).select(*keys, "score")
