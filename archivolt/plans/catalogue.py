"""Queries of the remaining parts of the inventory: overlays, fallbacks, gates, name plans, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivolt.functions import values
from archivolt.operators import filters, ranking, similarity, temporal, upsert
from archivolt.plans._base import collector
from archivolt.session import table

QUERIES, ORACLES, query = collector()


@query("""
WITH p AS (SELECT o_orderkey, l_partkey, l_returnflag, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
t AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN d = 1 THEN 1 ELSE 2 END AS tier FROM p WHERE d <= 3),
m AS (SELECT *, min(CASE WHEN l_returnflag <> 'R' THEN tier END) OVER (PARTITION BY o_orderkey) AS last FROM t)
SELECT l_partkey, min(d) AS distance, count(*) AS hits FROM m WHERE last IS NULL OR tier <= last GROUP BY 1
""")
def j03_first_hit_per_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tier rule, then one row per path with its closest hit."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_returnflag", F.to_date("l_shipdate").alias("f"))
    found = temporal.tiered_interval_join(orders, lines, ["o_orderkey"], "d", "f", F.col("l_returnflag") != "R", ["o_orderkey"])
    return found.groupBy("l_partkey").agg(F.min("day_distance").alias("distance"), F.count(F.lit(1)).alias("hits"))


_J11 = """
WITH q AS (SELECT doc_id, md5(text) AS sha, source, n_chars, lang FROM documents WHERE doc_id % 100 = 0),
c AS (SELECT doc_id AS c_id, md5(text) AS sha, source, n_chars, lang FROM documents WHERE doc_id % 100 <> 0),
e AS (SELECT doc_id, c_id, 'exact' AS how FROM q JOIN c USING (sha)),
f AS (SELECT doc_id, c_id, 'near' AS how, row_number() OVER (PARTITION BY doc_id ORDER BY abs(q.n_chars - c.n_chars), c_id) AS n
      FROM q JOIN c ON q.source = c.source AND q.lang = c.lang WHERE doc_id NOT IN (SELECT doc_id FROM e) AND abs(q.n_chars - c.n_chars) <= 400)
SELECT doc_id, c_id, how FROM e UNION ALL SELECT doc_id, c_id, how FROM f WHERE n <= 2
"""


@query(_J11)
def j11_match_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same content; where that gives nothing, the two nearest in length under a threshold.

    Candidates are cut to two for each length before the fallback, and asked lengths are joined once each, so it grows
    with the lengths that occur and not with the pairs of documents.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("sha"), "source", "n_chars", "lang")
    asked = docs.filter("doc_id % 100 = 0")
    others = docs.filter("doc_id % 100 <> 0").withColumnRenamed("doc_id", "c_id")
    exact = asked.join(others.select("c_id", "sha"), "sha").select("doc_id", "c_id", F.lit("exact").alias("how"))
    scope = ["source", "lang"]
    held = ranking.bounded_top(others.select(*scope, "n_chars", "c_id"), [*scope, "n_chars"], [F.col("c_id")], 2, F.col("c_id"))
    bucket = lambda c: F.floor(F.col(c) / 400)
    held = held.withColumnRenamed("n_chars", "c_chars").withColumn("b", bucket("c_chars"))
    rest = asked.join(exact.select("doc_id"), "doc_id", "left_anti")
    wanted = rest.select(*scope, "n_chars").distinct().withColumn("b", F.explode(F.array(*[bucket("n_chars") + i for i in (-1, 0, 1)])))
    gap = F.abs(F.col("n_chars") - F.col("c_chars"))
    near = wanted.join(held, [*scope, "b"]).filter(gap <= 400)
    near = ranking.top_k(near, [*scope, "n_chars"], [gap, F.col("c_id")], 2).select(*scope, "n_chars", "c_id")
    return exact.unionByName(rest.join(near, [*scope, "n_chars"]).select("doc_id", "c_id", F.lit("near").alias("how")))


@query("""
WITH p AS (SELECT user_id, props, event_id, ts FROM events WHERE event_type = 'purchase'),
l AS (SELECT user_id, event_id AS l_id, ts AS l_ts FROM events WHERE event_type = 'view'),
j AS (SELECT l_id, count(*) AS n, min(event_id) AS event_id FROM l JOIN p USING (user_id) WHERE abs(epoch_us(l_ts) - epoch_us(ts)) <= 7200000000 GROUP BY 1)
SELECT l_id, event_id FROM j WHERE n = 1
""")
def j18_only_one_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attach to the only listing within a span; several leave the photo alone."""
    width = 900_000_000 * 8
    events = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    bucket = F.floor(F.col("us") / width)
    photos = events.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("l_id"), F.col("us").alias("l_us"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b"))
    listings = events.filter("event_type = 'purchase'").select("user_id", "event_id", "us", bucket.alias("b"))
    near = photos.join(listings, ["user_id", "b"]).filter(F.abs(F.col("l_us") - F.col("us")) <= width)
    return near.groupBy("l_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("event_id")).filter("n = 1").drop("n")


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM supplier s JOIN nation ON s_nationkey = n_nationkey WHERE s.s_suppkey = l.l_suppkey AND n_regionkey = 2)")
def j31_delete_by_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after deleting rows without a counterpart in a join."""
    gone = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").filter("n_regionkey = 2"), F.col("s_nationkey") == F.col("n_nationkey"))
    gone = gone.select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf_dir, "lineitem").join(gone, "l_suppkey", "left_anti").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("""
WITH f AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events)
SELECT event_id, c_name, n_name FROM f JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey WHERE place = 3
""")
def j34_join_with_windowed_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A windowed step joined to two tables after it is cut."""
    window = Window.partitionBy("user_id").orderBy("ts", "event_id")
    third = table(spark, sf_dir, "events").withColumn("place", F.row_number().over(window)).filter("place = 3").select("event_id", F.col("user_id").alias("c_custkey"))
    return (
        third.join(table(spark, sf_dir, "customer"), "c_custkey")
        .join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        .select("event_id", "c_name", "n_name")
    )


@query("""
WITH r AS (SELECT p_partkey AS row_id, p_size AS sha, p_brand AS folder, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 2 = 0),
c AS (SELECT p_partkey AS path, p_size AS sha, p_brand AS folder, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 2 = 1)
SELECT row_id, path FROM r JOIN c USING (sha, folder, n)
""")
def j37_aligned_relinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows take files of their content and folder one to one, so that no file is used twice."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    window = Window.partitionBy("p_size", "p_brand").orderBy("p_partkey")
    left = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("row_id"), "p_size", "p_brand", F.row_number().over(window).alias("n"))
    right = part.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("path"), "p_size", "p_brand", F.row_number().over(window).alias("n"))
    return left.join(right, ["p_size", "p_brand", "n"]).select("row_id", "path")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(p_brand, 'unknown') AS brand FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey WHERE l_returnflag = 'R'
""")
def j41_queue_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue rows filled from the index, with a default."""
    index = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    queue = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return queue.join(index, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("p_brand", F.lit("unknown")).alias("brand"))


@query("""
SELECT doc_id, coalesce(s.size, d.n_chars) AS size, s.size IS NOT NULL AS staged FROM documents d LEFT JOIN (SELECT doc_id, n_chars * 2 AS size FROM documents WHERE doc_id % 3 = 0) s USING (doc_id)
""")
def j43_staged_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged values over stored ones, with their origin."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    staged = docs.filter("doc_id % 3 = 0").select("doc_id", (F.col("n_chars") * 2).alias("size"))
    return docs.join(staged, "doc_id", "left").select("doc_id", F.coalesce("size", "n_chars").alias("size"), F.col("size").isNotNull().alias("staged"))


@query("SELECT sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS toxic, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END)::BIGINT AS poor, count(*) AS n FROM labels")
def a12_conditional_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional sums of one table."""
    return table(spark, sf_dir, "labels").agg(
        F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality") == 0).alias("poor"), F.count(F.lit(1)).alias("n")
    )


@query("""
SELECT quality, toxic, count(*) AS n, count(DISTINCT CASE WHEN n_chars > 1000 THEN doc_id END) AS long FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2
""")
def a15_decision_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by class, with the pending entries of each."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("quality", "toxic").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("n_chars") > 1000, F.col("doc_id"))).alias("long")
    )


@query("""
WITH p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.source = b.source AS same FROM documents a JOIN documents b ON md5(a.text) = md5(b.text) AND a.doc_id < b.doc_id)
SELECT count(DISTINCT x) AS lefts, count(DISTINCT y) AS rights, count(DISTINCT CASE WHEN same THEN x END) AS same_source FROM p
""")
def a21_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sides of candidate pairs, under conditions."""
    docs = table(spark, sf_dir, "documents").select("source", F.md5(F.col("text").cast("binary")).alias("sha"))
    # Of n rows of one content, all but the last are left sides of a pair and all but the first right ones.
    sources = docs.groupBy("sha", "source").agg(F.count(F.lit(1)).alias("n"))
    contents = sources.groupBy("sha").agg((F.sum("n") - 1).alias("sides"), F.sum(F.col("n") - 1).alias("same"))
    return contents.agg(F.sum("sides").alias("lefts"), F.sum("sides").alias("rights"), F.sum("same").alias("same_source"))


@query("SELECT lang, source, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY 1, 2")
def a24_version_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A roll-up by two versions."""
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest"))


@query("""
WITH e AS (SELECT o_orderkey AS k FROM orders), a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 10)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unmatched' ELSE 'matched' END AS status FROM e FULL JOIN a ON e.k = a.k) GROUP BY 1
""")
def a28_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched, unmatched and missing records."""
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(True).alias("e"))
    actual = table(spark, sf_dir, "lineitem").filter("l_quantity > 10").select(F.col("l_orderkey").alias("k"), F.lit(True).alias("a")).distinct()
    status = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unmatched").otherwise("matched")
    return expected.join(actual, "k", "full").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-30')
  WHEN 2 THEN strftime(o_orderdate, '%Y-%-m-%-d') WHEN 3 THEN strftime(o_orderdate, '%Y%m%d') ELSE ' ' || strftime(o_orderdate, '%Y-%m-%d') END AS written FROM orders)
SELECT o_orderkey, regexp_full_match(written, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(written AS DATE) IS NOT NULL AS valid FROM t
""")
def f01_strict_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the exact form of a real date is a date: no 30 February, no missing zeros, no blanks."""
    forms = ["yyyy-MM-dd", "yyyy-MM-'30'", "yyyy-M-d", "yyyyMMdd", "' 'yyyy-MM-dd"]
    written = F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in forms]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(values.strict_date(written).isNotNull(), F.lit(False)).alias("valid"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (1, 5, 7, 9, 11) OR CAST(o_orderdate AS DATE) = DATE '1998-03-04' ORDER BY o_orderkey LIMIT 4")
def f05_ids_or_date_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen ids or a date, then the page that is asked for."""
    chosen = F.col("o_orderkey").isin(1, 5, 7, 9, 11) | (F.to_date("o_orderdate") == F.lit("1998-03-04").cast("date"))
    return table(spark, sf_dir, "orders").filter(chosen).select("o_orderkey").orderBy("o_orderkey").limit(4)


@query("SELECT event_id FROM events WHERE lower(trim(event_type)) IN ('purchase', 'click') AND contains(props, '\"k\": 1')")
def f13_decision_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision sets and evidence tokens."""
    decided = F.lower(F.trim("event_type")).isin("purchase", "click") & F.contains("props", F.lit('"k": 1'))
    return table(spark, sf_dir, "events").filter(decided).select("event_id")


@query("SELECT doc_id FROM documents WHERE length(trim(coalesce(source, ''))) > 0 OR length(trim(coalesce(text, ''))) > 0")
def f14_any_non_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At least one of the listed fields is not empty."""
    return table(spark, sf_dir, "documents").filter(filters.any_non_empty("source", "text")).select("doc_id")


@query("""
SELECT l_orderkey, bool_or(l_linenumber = 1) AND bool_and(l_quantity > 0 AND l_discount < 0.1) AS exportable FROM lineitem GROUP BY 1
""")
def f16_exportable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a primary row, all of whose rows are valid."""
    fine = F.bool_or(F.col("l_linenumber") == 1) & F.bool_and((F.col("l_quantity") > 0) & (F.col("l_discount") < 0.1))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(fine.alias("exportable"))


@query("SELECT page_id, regexp_matches(url, '^https://[^/]*\\.example\\.(org|net)(/|$)') AS allowed FROM pages")
def f19_allowed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secure URLs of listed domains."""
    host = F.coalesce(F.regexp_extract("url", r"^https://([^/]*)", 1), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(host.endswith(".example.org") | host.endswith(".example.net"), F.lit(False)).alias("allowed"))


@query("""
SELECT o_orderkey, 'current' AS run FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 10)
UNION ALL SELECT o_orderkey, 'previous' FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 10)
""")
def o11_merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest records of several runs in one list."""
    orders = table(spark, sf_dir, "orders")
    best = lambda s: orders.filter(F.col("o_orderstatus") == s).orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(10)
    return best("O").select("o_orderkey", F.lit("current").alias("run")).unionByName(best("F").select("o_orderkey", F.lit("previous").alias("run")))


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49.5")
def u03_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union and difference of id sets."""
    lines = table(spark, sf_dir, "lineitem")
    either = lines.filter(F.col("l_returnflag").isin("A", "R")).select("l_partkey").distinct()
    return either.join(lines.filter("l_quantity > 49.5").select("l_partkey"), "l_partkey", "left_anti")


@query("SELECT o_custkey, string_agg(o_orderpriority, ';' ORDER BY first) AS names FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) GROUP BY 1")
def u07_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct strings in order of first appearance."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"])
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_distinct(ordered), ";").alias("names"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN p_size WHEN p_retailprice > 1500 THEN p_retailprice ELSE 0 END AS v FROM part")
def x06_first_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first number above zero of several texts."""
    a = F.when(F.col("p_size") > 40, F.col("p_size").cast("string")).otherwise("-1")
    b = F.when(F.col("p_retailprice") > 1500, F.col("p_retailprice").cast("string")).otherwise("none")
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(values.first_positive(a, b), F.lit(0.0)).alias("v"))


@query("SELECT p_partkey, concat_ws(chr(10), nullif(p_name, ''), CASE WHEN p_size > 25 THEN p_brand END, p_type) AS body FROM part")
def x22_assembled_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body of the parts that are there."""
    body = F.concat_ws("\n", F.nullif(F.col("p_name"), F.lit("")), F.when(F.col("p_size") > 25, F.col("p_brand")), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", body.alias("body"))


@query("""
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice < 5000 THEN 'small' END, CASE WHEN o_orderstatus = 'P' THEN 'partial' END], lambda x: x IS NOT NULL), ';') AS issues,
  CASE WHEN o_orderstatus = 'P' THEN 'repair' WHEN o_totalprice < 5000 THEN 'skip' ELSE 'move' END AS action FROM orders
""")
def x27_classified_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of a row and the action that follows from them."""
    small, partial = F.col("o_totalprice") < 5000, F.col("o_orderstatus") == "P"
    issues = F.array_join(F.array_compact(F.array(F.when(small, "small"), F.when(partial, "partial"))), ";")
    action = F.when(partial, "repair").when(small, "skip").otherwise("move")
    return table(spark, sf_dir, "orders").select("o_orderkey", issues.alias("issues"), action.alias("action"))


@query("""
WITH n AS (SELECT p_partkey, lower(p_brand) AS base, row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_partkey) - 1 AS i FROM part)
SELECT p_partkey, CASE WHEN i = 0 THEN base ELSE base || '-' || i END AS name FROM n
""")
def x29_rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New names with suffixes for collisions."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_brand").alias("base"))
    numbered = ranking.occurrence(part, ["base"], [F.col("p_partkey")], "i")
    return numbered.select("p_partkey", F.when(F.col("i") == 0, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("i").cast("string"))).alias("name"))


@query("SELECT o_orderkey, sha256(o_custkey || '|' || o_orderkey) AS key FROM orders")
def x31_stable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that depend on nothing but their parts."""
    key = F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).cast("binary"), 256)
    return table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"))


@query("""
WITH s AS (SELECT l_orderkey AS k, count(*) AS lines, count(*) FILTER (l_returnflag = 'R') AS bad FROM lineitem GROUP BY 1)
SELECT count(*) AS entries, count(*) FILTER (bad > 0) AS blocked, max(lines) AS longest, count(*) FILTER (bad > 0) = 0 AS open FROM s
""")
def r45_gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an all-or-nothing gate looks at."""
    entries = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    blocked = F.count_if(F.col("bad") > 0)
    return entries.agg(F.count(F.lit(1)).alias("entries"), blocked.alias("blocked"), F.max("lines").alias("longest"), (blocked == 0).alias("open"))


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS latest, count(*) AS runs FROM events GROUP BY 1, 2")
def r29_latest_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run of each source."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"), F.count(F.lit(1)).alias("runs")
    )


@query("""
WITH h AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS reason FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT l.l_orderkey, l.l_partkey, count(*) AS n, max(reason) AS reason FROM lineitem l LEFT JOIN h USING (l_orderkey, l_partkey) GROUP BY 1, 2
""")
def r04_carried_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden reasons carried over by entry and content."""
    lines = table(spark, sf_dir, "lineitem")
    held = lines.filter("l_returnflag = 'R'").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("reason"))
    queue = lines.groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return queue.join(held, ["l_orderkey", "l_partkey"], "left")


@query("""
SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey
UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
""")
def r21_identity_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped identities; unresolved ones stay empty."""
    best = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(best, "c_custkey", "left")


@query("""
WITH a AS (SELECT vec_id, embedding AS e FROM embeddings), b AS (SELECT vec_id - 1 AS vec_id, embedding AS f FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(list_zip(e, f), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))) / len(e) + 0.15 * abs(len(e) - len(f)), 6) AS distance FROM a JOIN b USING (vec_id)
""")
def v03_descriptor_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared distances of neighbouring descriptors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    pairs = rows.join(other, "vec_id")
    one = F.array(F.lit(0.0))
    return pairs.select("vec_id", F.round(similarity.descriptor_distance((F.col("e"), F.col("f")), (one, one)), 6).alias("distance"))


@query("SELECT c_custkey, list_sort([c_custkey % 3, c_nationkey % 3]) = list_sort([(c_custkey + 1) % 3, c_nationkey % 3]) AS valid FROM customer")
def k23_valid_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a proposed order is a permutation of the present one."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", upsert.is_permutation(F.array(key % 3, nation % 3), F.array((key + 1) % 3, nation % 3)).alias("valid")
    )


@query("""
SELECT DISTINCT o_custkey, CASE WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS state FROM (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1)
""")
def j39_ambiguity_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by whether they name one value or several."""
    n = F.count_distinct("o_orderpriority")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.when(n == 1, "matched").otherwise("ambiguous").alias("state"))
