"""Join queries on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivolt.operators import matching, reconcile, temporal
from archivolt.plans._base import collector
from archivolt.session import table
from archivolt.storage import materialize

QUERIES, ORACLES, query = collector()


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("o_date", F.to_date("o_orderdate"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("ship_date", F.to_date("l_shipdate"))


@query("""
WITH p AS (
  SELECT o_orderkey, l_linenumber, l_returnflag,
         abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS day_distance
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
t AS (SELECT *, CASE WHEN day_distance = 0 THEN 0 WHEN day_distance = 1 THEN 1 ELSE 2 END AS tier
      FROM p WHERE day_distance <= 3),
m AS (SELECT *, min(CASE WHEN l_returnflag <> 'R' THEN tier END) OVER (PARTITION BY o_orderkey) AS last FROM t)
SELECT o_orderkey, l_linenumber, l_returnflag, CAST(day_distance AS INTEGER) AS day_distance,
       CAST(tier AS INTEGER) AS tier
FROM m WHERE last IS NULL OR tier <= last
""")
def j01_tiered_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped near their order's date, tier by tier until one has a line not returned."""
    targets = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("target_date"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        "l_linenumber",
        "l_returnflag",
        F.to_date("l_shipdate").alias("ship_date"),
    )
    return temporal.tiered_interval_join(
        targets, lines, ["o_orderkey"], "target_date", "ship_date", F.col("l_returnflag") != "R", ["o_orderkey"]
    ).select("o_orderkey", "l_linenumber", "l_returnflag", "day_distance", "tier")


@query("""
SELECT o_orderkey, l_linenumber, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS day_distance
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) <= 14
""")
def j01_flat_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat window of n days instead of tiers."""
    targets = _orders(spark, sf_dir).select("o_orderkey", "o_date")
    lines = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "ship_date")
    return temporal.date_window_join(targets, lines, "o_date", "ship_date", 14, ["o_orderkey"]).select(
        "o_orderkey", "l_linenumber", "day_distance"
    )


@query("""
SELECT l_partkey, min(abs(date_diff('day', DATE '1998-06-15', CAST(l_shipdate AS DATE)))) AS day_distance,
       array_to_string(list_sort(list(DISTINCT l_returnflag)), ';') AS sources
FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1998-06-12' AND DATE '1998-06-18' AND l_returnflag IN ('A', 'N')
GROUP BY l_partkey
""")
def j02_candidates_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a date: least distance and the sources that gave it, one row per path."""
    lines = _lines(spark, sf_dir).filter(
        F.col("ship_date").between(F.lit("1998-06-12").cast("date"), F.lit("1998-06-18").cast("date"))
        & F.col("l_returnflag").isin("A", "N")
    )
    distance = F.abs(F.datediff(F.lit("1998-06-15").cast("date"), "ship_date"))
    return lines.groupBy("l_partkey").agg(
        F.min(distance).alias("day_distance"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ";").alias("sources")
    )


@query("""
WITH p AS (SELECT o_orderkey, l_linenumber, l_returnflag, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS day_distance
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
m AS (SELECT *, min(CASE WHEN l_returnflag = 'N' THEN day_distance END) OVER (PARTITION BY o_orderkey) AS d FROM p)
SELECT o_orderkey, l_linenumber, l_returnflag, day_distance FROM m WHERE d IS NULL OR day_distance <= d OR l_linenumber = 1
""")
def j04_closest_until_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closest candidates up to the first preferred one; hidden ones (line 1) always stay."""
    pairs = (
        _orders(spark, sf_dir)
        .join(_lines(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"))
        .select("o_orderkey", "l_linenumber", "l_returnflag", F.abs(F.datediff("ship_date", "o_date")).alias("day_distance"))
    )
    return temporal.closest_until_preferred(
        pairs, ["o_orderkey"], F.col("day_distance"), F.col("l_returnflag") == "N", F.col("l_linenumber") == 1
    )


_EVIDENCE_SQL = """
WITH d AS (SELECT *, md5(text) AS sha, md5(nullif(regexp_replace(lower(text), '[^a-z]+', '', 'g'), '')) AS stem,
        md5(array_to_string(list_sort(list_distinct(string_split(lower(text), ' '))), ' ')) AS words FROM documents),
p AS (SELECT a.doc_id AS new_id, b.doc_id AS old_id,
        (a.sha = b.sha AND a.n_chars = b.n_chars) AS e1, (a.stem = b.stem) AS e2, abs(a.n_chars - b.n_chars) <= 1 AS e3,
        a.lang = b.lang AS e4, a.source = b.source AS e5
      FROM d a JOIN d b ON a.doc_id % 2 = 1 AND b.doc_id % 2 = 0
        AND ((a.sha = b.sha AND a.n_chars = b.n_chars) OR a.stem = b.stem OR (a.words = b.words AND abs(a.n_chars - b.n_chars) <= 1))),
s AS (SELECT new_id, old_id, e1, e2,
        (CASE WHEN e1 THEN 100 ELSE 0 END + CASE WHEN e2 THEN 35 ELSE 0 END + CASE WHEN e3 THEN 25 ELSE 0 END
         + CASE WHEN e4 THEN 5 ELSE 0 END + CASE WHEN e5 THEN 2 ELSE 0 END) AS score,
        array_to_string(list_filter([CASE WHEN e1 THEN 'exact_hash_size_match' END, CASE WHEN e2 THEN 'normalized_stem_match' END,
          CASE WHEN e3 THEN 'duration_within_tolerance' END, CASE WHEN e4 THEN 'extension_match' END,
          CASE WHEN e5 THEN 'source_root_match' END], lambda x: x IS NOT NULL), ';') AS reasons FROM p)
"""


def _evidence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.md5(F.col("text").cast("binary")).alias("sha"),
        F.md5(F.nullif(F.regexp_replace(F.lower("text"), "[^a-z]+", ""), F.lit("")).cast("binary")).alias("stem"),
        F.md5(F.array_join(F.array_sort(F.array_distinct(F.split(F.lower("text"), " "))), " ").cast("binary")).alias("words"),
    )
    # The keys read whole texts; they are used by every rule and side, and made once.
    docs = materialize(docs, "evidence-keys")
    new = docs.filter("doc_id % 2 = 1").select(*[F.col(c).alias(f"new_{c}") for c in docs.columns]).withColumnRenamed("new_doc_id", "new_id")
    old = docs.filter("doc_id % 2 = 0").select(*[F.col(c).alias(f"old_{c}") for c in docs.columns]).withColumnRenamed("old_doc_id", "old_id")
    near = F.sequence(F.col("new_n_chars") - 1, F.col("new_n_chars") + 1)
    rules = [
        [(F.col("new_sha"), F.col("old_sha")), (F.col("new_n_chars"), F.col("old_n_chars"))],
        [(F.col("new_stem"), F.col("old_stem"))],
        # Few values of length and source are shared by ever more rows, so they are no rule of their own.
        [(F.col("new_words"), F.col("old_words")), (near, F.col("old_n_chars"))],
    ]
    pairs = matching.any_key_pairs(new, old, rules, "new_id", "old_id")
    full = pairs.join(new, "new_id").join(old, "old_id")
    score, reasons = matching.additive_score(
        {
            "exact_hash_size_match": (F.col("new_sha") == F.col("old_sha")) & (F.col("new_n_chars") == F.col("old_n_chars")),
            "normalized_stem_match": F.col("new_stem") == F.col("old_stem"),
            "duration_within_tolerance": F.abs(F.col("new_n_chars") - F.col("old_n_chars")) <= 1,
            "extension_match": F.col("new_lang") == F.col("old_lang"),
            "source_root_match": F.col("new_source") == F.col("old_source"),
        }
    )
    return full.select("new_id", "old_id", score.alias("score"), reasons.alias("reasons"))


@query(_EVIDENCE_SQL + "SELECT new_id, old_id, score, reasons FROM s WHERE score >= 55 AND (e1 OR e2)")
def j05_multi_key_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs found by any of three keys, with additive evidence, a threshold and anchors (photo rule: 55)."""
    found = matching.accept(_evidence_pairs(spark, sf_dir), 55, ["exact_hash_size_match", "normalized_stem_match"])
    return found.withColumn("reasons", F.array_join("reasons", ";"))


@query(_EVIDENCE_SQL + "SELECT new_id, old_id, score, reasons FROM s WHERE score >= 45 AND (e1 OR e2 OR reasons LIKE '%duration%')")
def j06_multi_key_evidence_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the video rule: threshold 45 and a wider set of anchors."""
    found = matching.accept(
        _evidence_pairs(spark, sf_dir), 45, ["exact_hash_size_match", "normalized_stem_match", "duration_within_tolerance"]
    )
    return found.withColumn("reasons", F.array_join("reasons", ";"))


@query("""
SELECT o_orderkey, CAST(unnest(generate_series(CAST(o_orderdate AS DATE) - INTERVAL 2 DAY, CAST(o_orderdate AS DATE) + INTERVAL 2 DAY, INTERVAL 1 DAY)) AS DATE) AS day
FROM orders
""")
def j07_date_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates expanded by a tolerance, once each."""
    rows = _orders(spark, sf_dir)
    days = F.sequence(F.date_sub("o_date", 2), F.date_add("o_date", 2), F.expr("interval 1 day"))
    return rows.select("o_orderkey", F.explode(F.array_distinct(days)).alias("day"))


@query("""
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
v AS (SELECT event_id AS v_id, user_id, ts AS v_ts FROM events WHERE event_type = 'view'),
j AS (SELECT event_id, v_id, abs(epoch_us(p.ts) - epoch_us(v.v_ts)) / 1000000.0 AS seconds,
        row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(v.v_ts)), v_id) AS n
      FROM p JOIN v USING (user_id))
SELECT event_id, v_id AS nearest_view_id, seconds FROM j WHERE n = 1
""")
def j12_nearest_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the nearest view of its user, before or after."""
    events = table(spark, sf_dir, "events")
    purchases = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.filter("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", "ts")
    return (
        temporal.nearest_match(purchases, views, ["user_id"], "ts", "ts", "view_id", "event_id")
        .filter("nearest_view_id IS NOT NULL")
        .drop("user_id")
    )


@query("""
WITH p AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
v AS (SELECT event_id AS v_id, user_id, ts AS v_ts, value AS v_value FROM events WHERE event_type = 'click'),
j AS (SELECT event_id, v_id, round(abs(value - v_value), 6) AS delta,
        row_number() OVER (PARTITION BY event_id ORDER BY abs(value - v_value), v_id) AS n
      FROM p JOIN v USING (user_id) WHERE abs(epoch_us(p.ts) - epoch_us(v.v_ts)) <= 7200000000)
SELECT event_id, v_id, delta FROM j WHERE n = 1
""")
def j13_interval_best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one user within two hours, the closest in value. Time is bucketed, so the join is on equal buckets."""
    events = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    width = 7_200_000_000
    bucket = F.floor(F.col("us") / width)
    left = events.filter("event_type = 'purchase'").select(
        "event_id", "user_id", F.col("us").alias("p_us"), F.col("value").alias("p_value"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b")
    )
    right = events.filter("event_type = 'click'").select(
        F.col("event_id").alias("v_id"), "user_id", "us", "value", bucket.alias("b")
    )
    pairs = left.join(right, ["user_id", "b"]).filter(F.abs(F.col("p_us") - F.col("us")) <= width)
    delta = F.abs(F.col("p_value") - F.col("value"))
    return pairs.groupBy("event_id").agg(F.min(F.struct(delta.alias("delta"), "v_id")).alias("m")).select(
        "event_id", "m.v_id", F.round("m.delta", 6).alias("delta")
    )


@query("""
WITH e AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT'),
c AS (SELECT o_orderkey AS c_id, o_custkey, o_orderdate AS c_date, o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT'),
r AS (SELECT o_orderkey, c_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY (c_date < o_orderdate)::INT,
        abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(c_date AS DATE))), o_totalprice DESC, c_id) AS place
      FROM e JOIN c USING (o_custkey))
SELECT * FROM r WHERE place <= 3
""")
def j14_ranked_same_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries without a photo and photos of the same place: relation, distance, size, id; three at most."""
    orders = _orders(spark, sf_dir)
    entries = orders.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", "o_date", F.col("o_orderdate").alias("e_ts"))
    others = orders.filter("o_orderpriority <> '1-URGENT'").select(
        F.col("o_orderkey").alias("c_id"), "o_custkey", F.col("o_date").alias("c_date"), F.col("o_orderdate").alias("c_ts"), "o_totalprice"
    )
    order = Window.partitionBy("o_orderkey").orderBy(
        (F.col("c_ts") < F.col("e_ts")).cast("int"), F.abs(F.datediff("o_date", "c_date")), F.col("o_totalprice").desc(), "c_id"
    )
    return (
        entries.join(others, "o_custkey")
        .withColumn("place", F.row_number().over(order))
        .filter("place <= 3")
        .select("o_orderkey", "c_id", "place")
    )


@query("""
WITH w AS (SELECT event_id, user_id, event_type, props, row_number() OVER (PARTITION BY user_id, props ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT event_id, user_id, props FROM w WHERE n = 1
""")
def j15_newest_distinct_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier decisions of a place, the newest of each content."""
    order = Window.partitionBy("user_id", "props").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    events = table(spark, sf_dir, "events")
    return events.withColumn("n", F.row_number().over(order)).filter("n = 1").select("event_id", "user_id", "props")


@query("""
WITH a AS (SELECT DISTINCT ts + INTERVAL 5 HOUR AS t FROM events WHERE event_type = 'view'),
b AS (SELECT DISTINCT ts AS t FROM events WHERE event_type = 'view'),
o AS (SELECT h AS offset_hours, count(*) AS overlap FROM a, b, range(-14, 15) r(h) WHERE a.t + to_hours(CAST(h AS INTEGER)) = b.t GROUP BY h),
n AS (SELECT (SELECT count(*) FROM a) AS n, (SELECT count(*) FROM b) AS m)
SELECT CAST(offset_hours AS INTEGER) AS offset_hours, overlap FROM o, n WHERE overlap >= greatest(2, floor(0.8 * least(n, m))) ORDER BY overlap DESC, offset_hours LIMIT 1
""")
def j16_hour_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hour offset between two exports of one set of posts."""
    views = table(spark, sf_dir, "events").filter("event_type = 'view'")
    local = views.select((F.col("ts") + F.expr("interval 5 hours")).alias("local_ts"))
    return reconcile.infer_hour_offset(local, views.select("ts"), "local_ts", "ts")


@query("""
WITH a AS (SELECT l_partkey, count(*) AS l, min(l_orderkey) AS k FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
b AS (SELECT l_partkey, count(*) AS r, min(l_orderkey) AS k FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l_partkey, CASE WHEN l = 1 AND r = 1 THEN a.k END AS post_id, CASE WHEN l = 1 AND r = 1 THEN b.k END AS url_id,
       NOT (l = 1 AND r = 1) AS ambiguous FROM a JOIN b USING (l_partkey)
""")
def j17_unique_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attach only where exactly one row of either side shares the key."""
    lines = _lines(spark, sf_dir)
    posts = lines.filter("l_returnflag = 'A'").select("l_partkey", F.col("l_orderkey").alias("post_id"))
    urls = lines.filter("l_returnflag = 'R'").select("l_partkey", F.col("l_orderkey").alias("url_id"))
    return reconcile.unique_attachment(posts, urls, ["l_partkey"], "post_id", "url_id")


@query("""
WITH s AS (SELECT s_suppkey, s_name, regexp_extract(s_name, '(\\d+)$', 1) AS stem FROM supplier),
p AS (SELECT p_partkey, p_name FROM part),
c AS (SELECT c_custkey, regexp_extract(c_name, '(\\d+)$', 1) AS num FROM customer),
m AS (SELECT s_suppkey, count(*) AS n, min(c_custkey) AS c FROM s JOIN c ON starts_with(c.num, s.stem) GROUP BY 1)
SELECT s_suppkey, c AS c_custkey FROM m WHERE n = 1
""")
def j19_unique_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems that are a prefix of exactly one other stem; the longer side is exploded to its prefixes."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.regexp_extract("s_name", r"(\d+)$", 1).alias("stem"))
    number = F.regexp_extract("c_name", r"(\d+)$", 1)
    prefixes = F.transform(F.sequence(F.lit(0), F.length(number)), lambda n: F.substring(number, F.lit(1), n))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.explode(prefixes).alias("stem"))
    return (
        suppliers.join(customers, "stem")
        .groupBy("s_suppkey")
        .agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("c_custkey"))
        .filter("n = 1")
        .drop("n")
    )


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS g, l_linenumber AS a, unnest([l_partkey % 8, l_suppkey % 8]) AS b FROM lineitem),
n AS (SELECT g, count(DISTINCT a) AS na, count(DISTINCT b) AS nb FROM e GROUP BY g),
r AS (SELECT g, a, b, dense_rank() OVER (PARTITION BY g ORDER BY a) AS k FROM e JOIN n USING (g) WHERE na = nb),
m(g, k, used) AS (SELECT g, 1::BIGINT, [b] FROM r WHERE k = 1 UNION ALL
  SELECT m.g, m.k + 1, list_append(used, b) FROM m JOIN r ON r.g = m.g AND r.k = m.k + 1 AND NOT list_contains(used, b)),
u AS (SELECT m.g, any_value(used) AS used FROM m JOIN n ON n.g = m.g AND m.k = na GROUP BY m.g HAVING count(*) = 1)
SELECT r.g, r.a, used[r.k] AS b FROM (SELECT DISTINCT g, a, k FROM r) r JOIN u ON u.g = r.g
""")
def j20_unique_bipartite_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The perfect matching of a group's attachments and files, where there is exactly one."""
    lines = table(spark, sf_dir, "lineitem")
    edges = lines.select(
        F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("a"), F.explode(F.array(F.col("l_partkey") % 8, F.col("l_suppkey") % 8)).alias("b")
    ).distinct()
    return matching.unique_bipartite_matching(edges, "g", "a", "b")


@query("""
WITH x AS (SELECT event_id AS e_id, ts FROM events WHERE event_type = 'view'),
m AS (SELECT event_id AS m_id, ts FROM events WHERE event_type IN ('view', 'purchase') AND event_id % 2 = 0),
bt AS (SELECT ts, min(m_id) AS exact FROM m GROUP BY ts),
bd AS (SELECT CAST(ts AS DATE) AS d, min(m_id) AS dated FROM m GROUP BY 1 HAVING count(*) = 1),
f AS (SELECT e_id, x.ts, exact, coalesce(exact, dated) AS m_id FROM x LEFT JOIN bt USING (ts) LEFT JOIN bd ON bd.d = CAST(x.ts AS DATE)),
r AS (SELECT e_id, m_id, CASE WHEN m_id IS NULL THEN 'unmatched_export'
        WHEN row_number() OVER (PARTITION BY m_id ORDER BY (exact IS NULL)::INT, ts, e_id) > 1 THEN 'duplicate_export_match'
        WHEN exact IS NOT NULL THEN 'matched_timestamp' ELSE 'matched_date' END AS match_status FROM f)
SELECT * FROM r UNION ALL SELECT NULL, m_id, 'missing_from_export' FROM m WHERE m_id NOT IN (SELECT m_id FROM r WHERE m_id IS NOT NULL)
""")
def j21_exact_then_date_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact time, else the only record of the date; duplicates and missing ones are named."""
    events = table(spark, sf_dir, "events")
    exported = events.filter("event_type = 'view'").select(F.col("event_id").alias("e_id"), "ts")
    manifest = events.filter("event_type IN ('view', 'purchase') AND event_id % 2 = 0").select(
        F.col("event_id").alias("m_id"), "ts"
    )
    return reconcile.exact_then_date(exported, manifest, "e_id", "m_id", "ts", "ts")


@query("""
WITH e AS (SELECT o_orderkey AS k, o_orderkey % 7 + 1 AS n_lines, (o_totalprice > 100000)::INT AS flag FROM orders),
a AS (SELECT l_orderkey AS k, count(*) AS n_lines, max((l_quantity > 25)::INT) AS flag FROM lineitem GROUP BY 1)
SELECT coalesce(e.k, a.k) AS k, CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' ELSE
  array_to_string(list_filter([CASE WHEN e.n_lines <> a.n_lines THEN 'n_lines_differs' END, CASE WHEN e.flag <> a.flag THEN 'flag_differs' END], lambda x: x IS NOT NULL), ';') END AS issues
FROM e FULL JOIN a ON e.k = a.k WHERE e.k IS NULL OR a.k IS NULL OR e.n_lines <> a.n_lines OR e.flag <> a.flag
""")
def j22_count_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest against reconciliation: missing, unexpected, and counts that differ."""
    expected = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 7 + 1).alias("n_lines"), (F.col("o_totalprice") > 100000).cast("int").alias("flag")
    )
    actual = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("k"))
        .agg(F.count(F.lit(1)).alias("n_lines"), F.max((F.col("l_quantity") > 25).cast("int")).alias("flag"))
    )
    return reconcile.compare_counts(expected, actual, "k", ["n_lines", "flag"]).withColumn("issues", F.array_join("issues", ";"))


@query("""
WITH e AS (SELECT l_orderkey AS k, list(DISTINCT l_returnflag) AS names FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1),
a AS (SELECT l_orderkey AS k, list(DISTINCT l_returnflag) AS names FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1)
SELECT e.k, len(list_filter(e.names, lambda x: NOT list_contains(coalesce(a.names, []), x))) AS missing,
       len(list_filter(e.names, lambda x: list_contains(coalesce(a.names, []), x))) AS present FROM e LEFT JOIN a ON e.k = a.k
""")
def j23_name_set_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against actual name sets."""
    lines = table(spark, sf_dir, "lineitem")
    names = F.collect_set("l_returnflag")
    expected = lines.filter("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("k")).agg(names.alias("e"))
    actual = lines.filter("l_linenumber >= 2").groupBy(F.col("l_orderkey").alias("k")).agg(names.alias("a"))
    there = F.coalesce("a", F.array().cast("array<string>"))
    return expected.join(actual, "k", "left").select(
        "k", F.size(F.array_except("e", there)).alias("missing"), F.size(F.array_intersect("e", there)).alias("present")
    )


@query("""
SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(m, 0) AS n_urgent FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS m FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) b ON b.o_custkey = c_custkey
""")
def j24_preaggregated_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left joins to grouped subqueries; both counts come from one grouping."""
    counts = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("m"))
    )
    return table(spark, sf_dir, "customer").select("c_custkey").join(counts, "c_custkey", "left").select(
        "c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("m", F.lit(0)).alias("n_urgent")
    )


_J25 = """
SELECT o_orderkey, o_custkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND (l.l_returnflag = 'R' OR l.l_quantity > 45))
  AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey
              AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey AND s.s_acctbal < 0))
"""


@query(_J25)
def j25_nested_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT EXISTS with OR, and EXISTS with a nested NOT EXISTS, as anti and semi joins."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    poor = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return (
        table(spark, sf_dir, "orders")
        .join(lines.filter("l_returnflag = 'R' OR l_quantity > 45"), "o_orderkey", "left_anti")
        .join(lines.join(poor, "l_suppkey", "left_anti"), "o_orderkey", "left_semi")
        .select("o_orderkey", "o_custkey")
    )


@query("""
SELECT n_name, r_name, count(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2
""")
def j26_three_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables, the small ones left to the planner's size check."""
    return (
        table(spark, sf_dir, "customer")
        .groupBy(F.col("c_nationkey").alias("n_nationkey"))
        .agg(F.count(F.lit(1)).alias("n"))
        .join(table(spark, sf_dir, "nation"), "n_nationkey")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("n_name", "r_name")
        .agg(F.sum("n").alias("n_customers"))
    )


@query("""
WITH k AS (SELECT DISTINCT l_partkey FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-03-05')
SELECT l_partkey, array_to_string(list_sort(list(DISTINCT CASE WHEN l_returnflag = 'A' THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END)), ';') AS a_dates,
       array_to_string(list_sort(list(DISTINCT CASE WHEN l_returnflag = 'R' THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END)), ';') AS r_dates
FROM lineitem JOIN k USING (l_partkey) GROUP BY 1
""")
def j27_dates_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a date in range, joined back to all their dates, by source; null where a source has none."""
    lines = _lines(spark, sf_dir).select("l_partkey", "l_returnflag", "ship_date")
    chosen = lines.filter("ship_date BETWEEN DATE '1997-03-01' AND DATE '1997-03-05'").select("l_partkey")

    def dates(flag: str):
        own = F.sort_array(F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("ship_date").cast("string"))))
        return F.when(F.size(own) > 0, F.array_join(own, ";"))

    return lines.join(chosen, "l_partkey", "left_semi").groupBy("l_partkey").agg(
        dates("A").alias("a_dates"), dates("R").alias("r_dates")
    )


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'N'),
d AS (SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_linenumber = 1),
main AS (SELECT o_orderkey, coalesce(p.l_linenumber, d.l_linenumber) AS line, coalesce(p.l_extendedprice, d.l_extendedprice) AS price
  FROM orders LEFT JOIN p ON p.l_orderkey = o_orderkey AND n = 1 LEFT JOIN d ON d.l_orderkey = o_orderkey),
more AS (SELECT l_orderkey AS o_orderkey, l_linenumber AS line, l_extendedprice AS price FROM lineitem WHERE l_returnflag = 'A'
  AND NOT EXISTS (SELECT 1 FROM main m WHERE m.o_orderkey = l_orderkey AND m.line = l_linenumber))
SELECT o_orderkey, line, round(price, 2) AS price, 'primary' AS role FROM main UNION ALL SELECT o_orderkey, line, round(price, 2), 'associated' FROM more
""")
def j28_preferred_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest preferred row else the default one, united with associated rows that are not already there.

    Of preferred rows of one day and number, which the order leaves open, the lowest price counts.
    """
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    row = F.struct(F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("price"))
    preferred = (
        lines.filter("l_returnflag = 'N'")
        .groupBy("o_orderkey")
        .agg(F.max_by(row, F.struct("l_shipdate", -F.col("l_linenumber"), -F.col("l_extendedprice"))).alias("p"))
    )
    default = lines.filter("l_linenumber = 1").select("o_orderkey", row.alias("d"))
    main = (
        table(spark, sf_dir, "orders")
        .select("o_orderkey")
        .join(preferred, "o_orderkey", "left")
        .join(default, "o_orderkey", "left")
        .select("o_orderkey", F.coalesce("p.line", "d.line").alias("line"), F.coalesce("p.price", "d.price").alias("price"))
    )
    more = lines.filter("l_returnflag = 'A'").select("o_orderkey", row.alias("r")).select("o_orderkey", "r.*")
    more = more.join(main.select("o_orderkey", "line"), ["o_orderkey", "line"], "left_anti")
    return main.withColumn("role", F.lit("primary")).unionByName(more.withColumn("role", F.lit("associated"))).withColumn(
        "price", F.round("price", 2)
    )


@query("""
SELECT e.event_id, json_extract_string(e.props, '$.k')::BIGINT AS k, c.c_name
FROM events e JOIN customer c ON json_extract_string(e.props, '$.k')::BIGINT = c.c_custkey
""")
def j29_json_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on a key inside a JSON document."""
    events = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return events.join(customers, "k")


@query("""
SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR l.toxic <> 1
""")
def j30_left_join_not_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a decision, or with one that is no rejection."""
    labels = table(spark, sf_dir, "labels").withColumn("there", F.lit(True))
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id")
        .join(labels, "doc_id", "left")
        .filter(F.col("there").isNull() | (F.col("toxic") != 1))
        .select("doc_id", "quality")
    )


@query("""
WITH j AS (SELECT l_partkey, o_orderkey, abs(date_diff('day', DATE '1998-01-15', CAST(o_orderdate AS DATE))) AS dist,
  row_number() OVER (PARTITION BY l_partkey ORDER BY abs(date_diff('day', DATE '1998-01-15', CAST(o_orderdate AS DATE))), o_orderkey) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-01-31')
SELECT l_partkey, o_orderkey, dist FROM j WHERE n = 1
""")
def j32_nearest_per_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a range ordered by distance, one per path."""
    orders = _orders(spark, sf_dir).filter("o_date BETWEEN DATE '1998-01-01' AND DATE '1998-01-31'")
    dist = F.abs(F.datediff("o_date", F.lit("1998-01-15").cast("date"))).alias("dist")
    joined = _lines(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("l_partkey").agg(F.min(F.struct(dist, "o_orderkey")).alias("m")).select("l_partkey", "m.o_orderkey", "m.dist")


@query("""
SELECT o_orderkey, count(l_linenumber) AS n_large FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40 GROUP BY 1
""")
def j33_left_join_filtered_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate in ON: the right side is filtered and grouped before the join."""
    large = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(large, "o_orderkey", "left").select(
        "o_orderkey", F.coalesce("n", F.lit(0)).alias("n_large")
    )


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1 HAVING count(*) > 1")
def j35_entries_with_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with more than one active photo."""
    active = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'")
    return active.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("""
WITH a AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
b AS (SELECT o_custkey AS b_custkey, list_sort(list(DISTINCT o_orderpriority)) AS s FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT o_custkey, min(b_custkey) AS b_custkey, count(*) AS n FROM a JOIN b USING (s) GROUP BY 1
""")
def j36_set_equality_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches and attempts with equal sets: sets become sorted arrays, an equi-join key."""
    orders = table(spark, sf_dir, "orders")
    sets = F.sort_array(F.collect_set("o_orderpriority")).alias("s")
    left = orders.filter("o_orderkey % 2 = 0").groupBy("o_custkey").agg(sets)
    right = orders.filter("o_orderkey % 2 = 1").groupBy(F.col("o_custkey").alias("b_custkey")).agg(sets)
    right = right.groupBy("s").agg(F.min("b_custkey").alias("b_custkey"), F.count(F.lit(1)).alias("n"))
    return left.join(right, "s").select("o_custkey", "b_custkey", "n")


@query("""
WITH u AS (SELECT l_orderkey, l_partkey, l_linenumber, 0 AS src FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT l_orderkey, l_partkey, l_linenumber + 100, 1 FROM lineitem WHERE l_returnflag = 'A'
  UNION ALL SELECT o_orderkey, NULL, -1, 2 FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY src, l_linenumber, l_partkey) AS n FROM u)
SELECT l_orderkey, l_partkey, l_linenumber FROM r WHERE n = 1
""")
def j38_first_source_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue merge: user rows survive, candidates beat placeholders."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("l_linenumber"), "l_returnflag")
    first = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")

    def one(flag: str, add: int) -> DataFrame:
        rows = lines.filter(F.col("l_returnflag") == flag).withColumn("n", F.row_number().over(first)).filter("n = 1")
        return rows.select("l_orderkey", "l_partkey", (F.col("l_linenumber") + add).alias("l_linenumber"))

    empty = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.lit(None).cast("long").alias("l_partkey"), F.lit(-1).alias("l_linenumber")
    )
    return reconcile.first_source_wins([one("R", 0), one("A", 100), empty], ["l_orderkey"])


@query("""
SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n, count(DISTINCT c_mktsegment) > 1 AS conflict FROM customer GROUP BY 1
""")
def j42_conflicting_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that map to several values."""
    n = F.count_distinct("c_mktsegment")
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(n.alias("n"), (n > 1).alias("conflict"))


@query("""
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100
""")
def j44_anti_join_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undecided rows, then one page of them."""
    decided = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    left = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(decided, "o_orderkey", "left_anti")
    return left.orderBy("o_orderdate", "o_orderkey").offset(100).limit(50)
