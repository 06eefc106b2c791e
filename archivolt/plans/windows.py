"""Ranking, sessions, sampling, ordering and paging queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivolt.operators import ranking, temporal
from archivolt.plans._base import collector
from archivolt.session import table

QUERIES, ORACLES, query = collector()


@query("""
SELECT l_partkey, l_orderkey, l_linenumber, CAST(n AS INTEGER) AS rank, round(l_extendedprice - best, 6) AS gap_to_best FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_quantity DESC, l_discount DESC, l_orderkey, l_linenumber) AS n,
         min(l_extendedprice) OVER (PARTITION BY l_partkey) AS best FROM lineitem)
""")
def w01_rank_with_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank by rounded score and three tie keys, with the gap to the best score."""
    rows = table(spark, sf_dir, "lineitem")
    order = [F.col("l_quantity").desc(), F.col("l_discount").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    ranked = ranking.rank_with_gap(rows, ["l_partkey"], F.col("l_extendedprice"), order)
    return ranked.select("l_partkey", "l_orderkey", "l_linenumber", "rank", F.round("gap_to_best", 6).alias("gap_to_best"))


@query("""
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, count(*) OVER (PARTITION BY user_id) AS frames FROM events
""")
def w02_row_number_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of a frame in its video and the number of its frames."""
    window = Window.partitionBy("user_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.row_number().over(window.orderBy("ts", "event_id")).alias("place"),
        F.count(F.lit(1)).over(window).alias("frames"),
    )


@query("""
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1
""")
def w03_latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each group, by the grouped maximum of a struct."""
    newest = F.max(F.struct("ts", "event_id")).alias("m")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(newest).select("m.event_id")


@query("""
WITH e AS (SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN value END AS score FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score NULLS LAST, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM e)
SELECT event_id, CAST(CASE WHEN score IS NOT NULL AND c > 60 THEN n END AS INTEGER) AS visual_rank,
       coalesce(CASE WHEN score IS NOT NULL AND c > 60 THEN n <= 5 END, false) AS likely FROM r
""")
def w04_likely_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks in groups over a size; the first five are likely; rows without a score stay unranked."""
    events = table(spark, sf_dir, "events").withColumn("score", F.when(F.col("event_type") != "error", F.col("value")))
    return ranking.likely_candidates(events, ["user_id"], "score", [F.col("event_id")], 5, 60).select("event_id", "visual_rank", "likely")


_SESSIONS = """
WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders),
g AS (SELECT o_custkey, day, CASE WHEN date_diff('day', lag(day) OVER (PARTITION BY o_custkey ORDER BY day), day) <= 60 THEN 0 ELSE 1 END AS fresh FROM d),
s AS (SELECT o_custkey, day, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY day ROWS UNBOUNDED PRECEDING) AS session FROM g)
"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")).distinct()
    return temporal.gap_sessions(days, ["o_custkey"], "day", 60)


@query(_SESSIONS + "SELECT o_custkey, day, session FROM s")
def w05_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of days of each customer with gaps of at most sixty."""
    return _sessions(spark, sf_dir)


@query(_SESSIONS + """
SELECT o_custkey, 'B' || lpad(CAST(session AS VARCHAR), 3, '0') AS batch_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days,
       string_agg(CAST(day AS VARCHAR), ';' ORDER BY day) AS dates FROM s GROUP BY o_custkey, session
""")
def a20_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gap session as a batch with its id, range and list of dates."""
    days = F.array_join(F.transform(F.sort_array(F.collect_list("day")), lambda d: d.cast("string")), ";")
    return _sessions(spark, sf_dir).groupBy("o_custkey", "session").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days"), days.alias("dates")
    ).select("o_custkey", F.format_string("B%03d", F.col("session")).alias("batch_id"), "first_day", "last_day", "days", "dates")


@query("""
WITH l AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day, ts FROM events),
g AS (SELECT *, CASE WHEN date_diff('day', lag(day) OVER w, day) <= 3 THEN 0 ELSE 1 END AS fresh FROM l WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, event_type, session, count(*) AS n, min(event_id) AS first_id FROM s GROUP BY 1, 2, 3
""")
def w06_sessions_of_equal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identical listings merged while each is at most three days after the one before."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    window = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    fresh = F.coalesce(F.datediff("ts", F.lag("ts").over(window)) > 3, F.lit(True)).cast("int")
    numbered = events.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(window))
    return numbered.groupBy("user_id", "event_type", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


_SPACED = "WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame, value FROM events),\ns0 AS (SELECT user_id, CAST([] AS BIGINT[]) AS kept FROM f GROUP BY 1)" + "".join(
    f",\ns{k + 1} AS (SELECT user_id, list_append(kept, arg_min(frame, (-value, frame))) AS kept FROM f JOIN s{k} USING (user_id) WHERE len(list_filter(kept, lambda x: abs(x - frame) < 3)) = 0 GROUP BY user_id, kept)"
    for k in range(6)
)


@query(_SPACED + " UNION ALL ".join(f"\nSELECT user_id, {k} AS place, kept[{k + 1}] AS frame FROM s{k + 1}" for k in range(6)))
def w08_spaced_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy best six frames of each user whose numbers lie at least three apart."""
    window = Window.partitionBy("user_id").orderBy("ts", "event_id")
    frames = table(spark, sf_dir, "events").withColumn("frame", F.row_number().over(window))
    return ranking.spaced_top_k(frames, "user_id", "frame", "value", 6, 3)


@query("""
WITH p AS (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS dist
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY dist, l_orderkey, l_linenumber, l_suppkey) = 1 AS assigned FROM p)
SELECT l_orderkey, count(*) AS candidates, count(*) FILTER (assigned) AS kept, count(*) FILTER (assigned) = 0 AS placeholder FROM r GROUP BY 1
""")
def w09_single_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate stays with its closest entry; entries that lose all become placeholders."""
    orders = table(spark, sf_dir, "orders")
    pairs = table(spark, sf_dir, "lineitem").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = pairs.withColumn("dist", F.abs(F.datediff("l_shipdate", "o_orderdate")))
    order = [F.col("dist"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")]
    kept = F.count_if("assigned")
    return ranking.single_assignment(pairs, "l_partkey", order).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("candidates"), kept.alias("kept"), (kept == 0).alias("placeholder")
    )


_SPREAD = """
WITH n AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS i,
             count(*) OVER (PARTITION BY o_orderpriority) AS c FROM orders)
"""


@query(_SPREAD + """, w AS (SELECT DISTINCT o_orderpriority, round_even(j * (c - 1) / 24.0, 0)::BIGINT AS i FROM n, range(25) r(j))
SELECT n.o_orderkey, n.o_orderpriority FROM n JOIN w USING (o_orderpriority, i)
""")
def w10_spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 orders of each priority at even steps in time; indices round half to even."""
    rows = table(spark, sf_dir, "orders")
    picked = ranking.spread_sample(rows, ["o_orderpriority"], [F.col("o_orderdate"), F.col("o_orderkey")], F.lit(25))
    return picked.select("o_orderkey", "o_orderpriority")


@query(_SPREAD + """, s AS (SELECT o_orderpriority, count(*) AS c FROM orders GROUP BY 1),
e AS (SELECT *, 97 * c / CAST(sum(c) OVER () AS DOUBLE) AS x FROM s),
q AS (SELECT o_orderpriority, c, CAST(floor(x) AS INTEGER) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, o_orderpriority) <= 97 - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS quota FROM e),
w AS (SELECT DISTINCT o_orderpriority, round_even(j * (c - 1) / CAST(quota - 1 AS DOUBLE), 0)::BIGINT AS i FROM q, range(97) r(j) WHERE j < quota)
SELECT n.o_orderkey, n.o_orderpriority FROM n JOIN w USING (o_orderpriority, i)
""")
def w11_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """97 orders with largest-remainder quotas by priority, spread within each."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    picked = ranking.stratified_sample(rows, "o_orderpriority", [F.col("o_orderdate"), F.col("o_orderkey")], 97)
    return picked.select("o_orderkey", "o_orderpriority")


@query("""
WITH b AS (SELECT o_orderkey, o_totalprice, ntile, (ntile - 0.5) / 8 AS mid, r FROM (
  SELECT o_orderkey, o_totalprice, least(floor(r * 8), 7) + 1 AS ntile, r FROM (
    SELECT o_orderkey, o_totalprice, (o_totalprice - lo) / (hi - lo) AS r FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)))),
m AS (SELECT *, row_number() OVER (PARTITION BY ntile ORDER BY abs(r - mid), o_orderkey) AS n FROM b)
SELECT CAST(ntile AS INTEGER) AS stratum, o_orderkey FROM m WHERE n = 1
""")
def w12_best_of_eight_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight equal ranges of a value, the row nearest to the middle of each; strata are disjoint, so none is used twice."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    bounds = orders.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))  # one row
    share = (F.col("o_totalprice") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    placed = orders.join(F.broadcast(bounds)).withColumn("r", share).withColumn("stratum", F.least(F.floor(F.col("r") * 8), F.lit(7)) + 1)
    off = F.abs(F.col("r") - (F.col("stratum") - 0.5) / 8)
    return placed.groupBy("stratum").agg(F.min(F.struct(off.alias("off"), "o_orderkey")).alias("m")).select(
        F.col("stratum").cast("int").alias("stratum"), "m.o_orderkey"
    )


@query("""
SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY 1
""")
def w13_correlated_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key by an order, as a grouped minimum."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("""
WITH v AS (SELECT l_partkey, l_linenumber, CASE WHEN l_partkey % 10 = 0 THEN 0.5 ELSE round(l_discount, 2) END AS lat, CASE WHEN l_partkey % 3 = 0 THEN 1.0 ELSE l_tax END AS lon FROM lineitem),
p AS (SELECT l_partkey, arg_min({'lat': lat, 'lon': lon}, (l_linenumber, lat, lon)) AS p FROM v GROUP BY 1)
SELECT p.l_partkey, p.p.lat AS lat, p.p.lon AS lon FROM p
WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.l_partkey = p.l_partkey AND (abs(v.lat - p.p.lat) > 1e-6 OR abs(v.lon - p.p.lon) > 1e-6))
""")
def w14_agreed_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first by priority, and none at all where candidates disagree."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(
        "l_partkey",
        "l_linenumber",
        F.when(F.col("l_partkey") % 10 == 0, 0.5).otherwise(F.round("l_discount", 2)).alias("lat"),
        F.when(F.col("l_partkey") % 3 == 0, 1.0).otherwise(F.col("l_tax")).alias("lon")
    )
    return ranking.agreed_pick(rows, ["l_partkey"], F.col("l_linenumber"), ["lat", "lon"])


@query("SELECT event_type, user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def w16_latest_per_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current run of each scope."""
    newest = F.max(F.struct("ts", "event_id", "user_id")).alias("m")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(newest).select("event_type", "m.user_id", "m.event_id", "m.ts")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 6 <= 0 THEN 3 WHEN o_orderkey % 6 <= 1 THEN 7 WHEN o_orderkey % 6 <= 2 THEN 14 ELSE 30 END AS window_days FROM orders
""")
def w17_widening_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next window of targets that were rejected so many times."""
    return table(spark, sf_dir, "orders").select("o_orderkey", temporal.widening_window(F.col("o_orderkey") % 6).alias("window_days"))


@query("""
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 11 END, 1000 + o_orderkey), o_orderkey) AS place FROM orders
""")
def w18_custom_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom position where there is one, else the default order."""
    position = F.coalesce(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 11), 1000 + F.col("o_orderkey"))
    window = Window.partitionBy("o_custkey").orderBy(position, "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(window).alias("place"))


@query("""
WITH n AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders)
SELECT o_orderkey, CAST(i // 4 + 1 AS INTEGER) AS part, CAST(ceil(c / 4.0) AS INTEGER) AS parts, CAST(i % 4 + 1 AS INTEGER) AS place FROM n
""")
def w19_chunked_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists cut into labelled parts."""
    rows = table(spark, sf_dir, "orders")
    return ranking.chunk_list(rows, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 4).select("o_orderkey", "part", "parts", "place")


@query("""
SELECT user_id, CAST(ts AS DATE) AS day, string_agg(CAST(event_id AS VARCHAR), ';' ORDER BY ts, event_id) AS ids FROM events GROUP BY 1, 2
""")
def w20_album_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An album cut into days with ordered members."""
    members = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda m: m["event_id"].cast("string")), ";")
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(members.alias("ids"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) - 1 AS occurrence FROM documents")
def w21_occurrence_of_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of earlier rows with the same content."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return ranking.occurrence(docs, ["digest"], [F.col("doc_id")]).select("doc_id", "occurrence")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1")
def w22_first_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row by several keys."""
    order = [F.col("l_extendedprice").desc(), F.col("l_linenumber"), F.col("l_partkey")]
    return ranking.first_by(table(spark, sf_dir, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey FROM orders ORDER BY md5('11:' || o_orderkey), o_orderkey LIMIT 100")
def w23_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of a fixed size; the order is a hash of seed and key, so it does not depend on partitions."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return orders.orderBy(F.md5(F.concat(F.lit("11:"), F.col("o_orderkey").cast("string")).cast("binary")), "o_orderkey").limit(100)


@query("SELECT o_orderkey, rn <= 20 AS on_page, rn > 20 AS has_more FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 21")
def o01_page_with_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page and one row more, which says whether another page follows."""
    page = table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(21)
    n = F.row_number().over(Window.orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return page.select("o_orderkey", (n <= 20).alias("on_page"), (n > 20).alias("has_more"))


@query("""
(SELECT o_orderkey, 'after' AS side FROM orders WHERE (CAST(o_orderdate AS DATE), o_orderkey) > (DATE '1998-01-01', 0) ORDER BY CAST(o_orderdate AS DATE), o_orderkey LIMIT 10)
UNION ALL
(SELECT o_orderkey, 'before' FROM orders WHERE (CAST(o_orderdate AS DATE), o_orderkey) < (DATE '1998-01-01', 0) ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC LIMIT 10)
""")
def o02_keyset_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of a date on both sides, by keyset instead of offset."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    at = F.lit("1998-01-01").cast("date")
    after = rows.filter((F.col("d") > at) | ((F.col("d") == at) & (F.col("o_orderkey") > 0))).orderBy("d", "o_orderkey").limit(10)
    before = rows.filter((F.col("d") < at) | ((F.col("d") == at) & (F.col("o_orderkey") < 0))).orderBy(F.col("d").desc(), F.col("o_orderkey").desc()).limit(10)
    return after.select("o_orderkey", F.lit("after").alias("side")).unionByName(before.select("o_orderkey", F.lit("before").alias("side")))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def o03_most_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most recent rows: one top-k per partition, merged."""
    return table(spark, sf_dir, "events").select("event_id", "ts").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(25)


@query("""
WITH p AS (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 30)
SELECT p.o_orderkey, count(l_linenumber) AS n_lines FROM p LEFT JOIN lineitem ON l_orderkey = p.o_orderkey GROUP BY 1
""")
def o04_sorted_page_with_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page in a custom order, joined to its children only after it is cut."""
    urgency = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    page = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").orderBy(urgency, F.col("o_totalprice").desc(), "o_orderkey").limit(30)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return page.select("o_orderkey").join(lines, "o_orderkey", "left").groupBy("o_orderkey").agg(F.count("l_linenumber").alias("n_lines"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY (o_orderpriority <> '1-URGENT')::INT, o_orderdate, o_orderkey) AS n FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-01-31') WHERE n <= 40")
def o06_boolean_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range listed with one source first."""
    rows = table(spark, sf_dir, "orders").filter(F.to_date("o_orderdate").between(F.lit("1997-01-01").cast("date"), F.lit("1997-01-31").cast("date")))
    return rows.orderBy(F.col("o_orderpriority") != "1-URGENT", "o_orderdate", "o_orderkey").limit(40).select("o_orderkey")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
def o08_top_by_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rated."""
    return table(spark, sf_dir, "part").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(15).select("p_partkey", "p_retailprice")


@query("""
SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_suppkey) AS n FROM lineitem)
WHERE n <= 5 AND l_extendedprice < 5000
""")
def o09_top_k_then_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold applies after the cut, not before."""
    order = [F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")]
    best = ranking.top_k(table(spark, sf_dir, "lineitem"), ["l_partkey"], order, 5)
    return best.filter("l_extendedprice < 5000").select("l_partkey", "l_orderkey", "l_linenumber")
