"""Aggregation and coverage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivolt.operators import temporal
from archivolt.plans._base import collector
from archivolt.session import table

QUERIES, ORACLES, query = collector()


def _month(column: str):
    return F.date_format(column, "yyyy-MM")


@query("SELECT strftime(l_shipdate, '%Y-%m') AS month, count(DISTINCT l_partkey) AS files FROM lineitem GROUP BY 1")
def a01_distinct_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct files of each month."""
    return table(spark, sf_dir, "lineitem").groupBy(_month("l_shipdate").alias("month")).agg(F.count_distinct("l_partkey").alias("files"))


@query("""
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT l_partkey) AS described FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE l_returnflag <> 'R' GROUP BY 1
""")
def a02_described_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct described files of each month of their entry."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    joined = table(spark, sf_dir, "orders").select("o_orderkey", _month("o_orderdate").alias("month")).join(lines, "o_orderkey")
    return joined.groupBy("month").agg(F.count_distinct("l_partkey").alias("described"))


@query("""
WITH i AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, count(DISTINCT l_partkey) AS indexed FROM lineitem GROUP BY 1),
d AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, count(DISTINCT l_partkey) AS described FROM lineitem WHERE l_returnflag <> 'R' OR l_linenumber > 2 GROUP BY 1)
SELECT coalesce(i.month, d.month) AS month, coalesce(indexed, 0) AS indexed, coalesce(described, 0) AS described,
       CASE WHEN indexed > 0 THEN round_even(coalesce(described, 0) / CAST(indexed AS DOUBLE), 4) END AS coverage,
       coalesce(indexed, 0) >= 20 AND coalesce(described, 0) / CAST(indexed AS DOUBLE) < 0.80 AS low
FROM i FULL JOIN d ON i.month = d.month
""")
def a03_month_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each month and the alert for at least 20 files under 80 percent. Both counts come from one scan."""
    described = (F.col("l_returnflag") != "R") | (F.col("l_linenumber") > 2)
    months = table(spark, sf_dir, "lineitem").groupBy(_month("l_shipdate").alias("month")).agg(
        F.count_distinct("l_partkey").alias("indexed"), F.count_distinct(F.when(described, F.col("l_partkey"))).alias("described")
    )
    share = F.col("described") / F.col("indexed")
    return months.select("month", "indexed", "described", F.bround(share, 4).alias("coverage"), ((F.col("indexed") >= 20) & (share < 0.80)).alias("low"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS targets FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def a04_targets_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of each month."""
    return table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").groupBy(_month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("targets"))


@query("""
SELECT o_orderkey, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_linenumber END) AS tags, count(DISTINCT CASE WHEN l_returnflag = 'N' THEN l_linenumber END) AS people
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_linenumber END) = 0
""")
def a05_counts_having_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several distinct counts per entry, for entries without any of one kind. Children are grouped before the join."""
    kinds = {"A": "tags", "N": "people", "R": "places"}
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        *[F.count_distinct(F.when(F.col("l_returnflag") == k, F.col("l_linenumber"))).alias(v) for k, v in kinds.items()]
    )
    joined = table(spark, sf_dir, "orders").select("o_orderkey").join(counts, "o_orderkey", "left").fillna(0)
    return joined.filter("places = 0").select("o_orderkey", "tags", "people")


@query("""
SELECT o_orderkey, count(DISTINCT l.l_linenumber) AS locations, sum(CASE WHEN l.l_returnflag = 'N' THEN 1 ELSE 0 END) AS exportable
FROM orders LEFT JOIN lineitem l ON l.l_orderkey = o_orderkey LEFT JOIN lineitem m ON m.l_orderkey = o_orderkey AND m.l_linenumber = 1
GROUP BY 1 HAVING sum(CASE WHEN l.l_returnflag = 'N' THEN 1 ELSE 0 END) = 0 OR count(l.l_orderkey) = 0
""")
def a06_fan_out_conditional_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries without an exportable location. The zero test does not depend on the fan-out of the media join."""
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count_distinct("l_linenumber").alias("locations"), F.count_if(F.col("l_returnflag") == "N").alias("exportable")
    )
    joined = table(spark, sf_dir, "orders").select("o_orderkey").join(own, "o_orderkey", "left").fillna(0)
    return joined.filter("exportable = 0")


@query("""
SELECT o_orderpriority, sum(CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 1 ELSE 0 END) AS with_return, count(*) AS n
FROM orders GROUP BY 1
""")
def a07_sum_of_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conditional sum over EXISTS: the flags of a grouped join."""
    flags = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("r", F.lit(1))
    joined = table(spark, sf_dir, "orders").join(flags, "o_orderkey", "left")
    return joined.groupBy("o_orderpriority").agg(F.count("r").alias("with_return"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS large FROM orders GROUP BY 1")
def a08_status_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distinct counts and conditional sums by status."""
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"), F.count_if(F.col("o_totalprice") > 200000).alias("large")
    )


@query("SELECT count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_orderkey END) AS a, count(DISTINCT CASE WHEN l_quantity > 30 THEN l_orderkey END) AS q FROM lineitem")
def a09_conditional_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts under conditions."""
    return table(spark, sf_dir, "lineitem").agg(
        F.count_distinct(F.when(F.col("l_returnflag") == "A", F.col("l_orderkey"))).alias("a"),
        F.count_distinct(F.when(F.col("l_quantity") > 30, F.col("l_orderkey"))).alias("q"),
    )


@query("""
SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks,
       count(*) FILTER (event_type = 'purchase') AS purchases, count(*) AS n FROM events GROUP BY 1
""")
def a10_counts_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column for each state."""
    states = {"view": "views", "click": "clicks", "purchase": "purchases"}
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        *[F.count_if(F.col("event_type") == k).alias(v) for k, v in states.items()], F.count(F.lit(1)).alias("n")
    )


@query("""
WITH h AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1)
SELECT month, n, lag(month) OVER (ORDER BY month) AS previous, lead(month) OVER (ORDER BY month) AS next FROM h
""")
def a11_month_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month histogram with neighbours; the window runs over one row per month."""
    months = table(spark, sf_dir, "orders").groupBy(_month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(F.lit(1)).orderBy("month")
    return months.select("month", "n", F.lag("month").over(order).alias("previous"), F.lead("month").over(order).alias("next"))


@query("""
SELECT count(*) AS rows, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n,
  (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 5)) AS long_orders FROM lineitem
""")
def a13_sums_with_grouped_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and a count of groups, from one grouping by entry."""
    per_order = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("c"), F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "N").alias("n")
    )
    return per_order.agg(F.sum("c").alias("rows"), F.sum("a").alias("a"), F.sum("n").alias("n"), F.count_if(F.col("c") > 5).alias("long_orders"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT CAST(l_shipdate AS DATE)) AS days FROM lineitem GROUP BY 1, 2")
def a14_role_and_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct days by two columns."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.to_date("l_shipdate")).alias("days")
    )


@query("""
WITH s AS (SELECT o_custkey, unnest(string_split(string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority), ';')) AS status FROM orders GROUP BY 1)
SELECT status, count(*) AS batches, min(o_custkey) AS first_batch FROM s GROUP BY 1
""")
def a16_exploded_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined status lists, exploded and counted, with the first batch of each."""
    joined = F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ";")
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(joined.alias("statuses"))
    return lists.select("o_custkey", F.explode(F.split("statuses", ";")).alias("status")).groupBy("status").agg(
        F.count(F.lit(1)).alias("batches"), F.min("o_custkey").alias("first_batch")
    )


@query("""
WITH a AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1),
b AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 AND o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT coalesce(a.p, b.p) AS p, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS n, round(100.0 * coalesce(b.n, 0) / greatest(coalesce(a.n, 0), coalesce(b.n, 0)), 3) AS percent
FROM a FULL JOIN b ON a.p = b.p
""")
def a17_prepared_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source against prepared ones, with a percentage."""
    orders = table(spark, sf_dir, "orders")
    a = orders.filter("o_orderkey % 3 = 0").groupBy(F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("x"))
    b = orders.filter("o_orderkey % 5 = 0 AND o_orderpriority <> '5-LOW'").groupBy(F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("y"))
    n = F.greatest("x", "y")
    return a.join(b, "p", "full").fillna(0).select("p", n.alias("n"), F.round(100.0 * F.col("y") / n, 3).alias("percent"))


@query("""
WITH b AS (SELECT o_orderpriority AS p, count(*) AS n, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
a AS (SELECT o_orderpriority AS p, count(*) AS n, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1)
SELECT p, a.n - coalesce(b.n, 0) AS dn, round(a.v - coalesce(b.v, 0), 2) AS dv FROM a LEFT JOIN b USING (p)
""")
def a18_snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference of two snapshots' counters; both come from one pass."""
    before = F.col("o_orderkey") % 2 == 0
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(
        F.count_if(~before).alias("dn"), F.round(F.sum(F.when(~before, F.col("o_totalprice")).otherwise(0.0)), 2).alias("dv")
    )


@query("""
SELECT CAST(l_shipdate AS DATE) AS day, count(DISTINCT l_orderkey) AS entries, count(*) FILTER (l_returnflag <> 'R') AS visible,
       count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS hidden,
       CASE WHEN count(*) FILTER (l_returnflag = 'N') > 0 THEN 'open' WHEN count(*) FILTER (l_returnflag = 'A') > 0 THEN 'answered' ELSE 'rejected' END AS status
FROM lineitem GROUP BY 1
""")
def a19_day_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day: entries, visible candidates, hidden keys, and a status by priority."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(
        F.count_distinct("l_orderkey").alias("entries"),
        F.count_if(flag != "R").alias("visible"),
        F.count_distinct(F.when(flag == "R", F.col("l_partkey"))).alias("hidden"),
        F.when(F.count_if(flag == "N") > 0, "open").when(F.count_if(flag == "A") > 0, "answered").otherwise("rejected").alias("status"),
    )


@query("""
WITH r AS (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_suppkey) AS rank, l_returnflag FROM lineitem),
q AS (SELECT l_partkey, min(CASE WHEN l_returnflag = 'N' THEN rank END) AS rank FROM r GROUP BY 1)
SELECT count(*) AS n_queries, round_even(avg((coalesce(rank, 99) <= 1)::INT), 4) AS recall_at_1, round_even(avg((coalesce(rank, 99) <= 5)::INT), 4) AS recall_at_5,
       round_even(avg((coalesce(rank, 99) <= 20)::INT), 4) AS recall_at_20 FROM q
""")
def a22_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the expected candidate at 1, 5 and 20."""
    from archivolt.operators.similarity import recall_at

    window = Window.partitionBy("l_partkey").orderBy("l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey")
    ranked = table(spark, sf_dir, "lineitem").withColumn("rank", F.row_number().over(window))
    best = ranked.groupBy("l_partkey").agg(F.min(F.when(F.col("l_returnflag") == "N", F.col("rank"))).alias("rank"))
    return recall_at(best, "rank", [1, 5, 20])


@query("""
SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS both,
       (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS unlabelled,
       (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS orphans
""")
def a23_set_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the intersection and both differences from one full join."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("d")).distinct()
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("l")).distinct()
    return docs.join(labels, "doc_id", "full").agg(
        F.count_if(F.col("d") & F.col("l")).alias("both"),
        F.count_if(F.col("d") & F.col("l").isNull()).alias("unlabelled"),
        F.count_if(F.col("l") & F.col("d").isNull()).alias("orphans"),
    )


@query("""
SELECT l_returnflag AS role, count(*) FILTER (l_linestatus = 'F') AS ready, count(*) FILTER (l_shipdate >= TIMESTAMP '1998-01-01') AS current,
       count(*) FILTER (l_shipdate < TIMESTAMP '1998-01-01') AS stale FROM lineitem GROUP BY 1
""")
def a25_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready, current and stale rows by role."""
    since = F.lit("1998-01-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("role")).agg(
        F.count_if(F.col("l_linestatus") == "F").alias("ready"),
        F.count_if(F.col("l_shipdate") >= since).alias("current"),
        F.count_if(F.col("l_shipdate") < since).alias("stale"),
    )


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def a26_count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by source."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("""
WITH m AS (SELECT strftime(l_shipdate, '%Y-%m') AS month FROM lineitem),
c AS (SELECT strftime(d, '%Y-%m') AS month FROM (SELECT unnest(generate_series(date_trunc('year', (SELECT min(l_shipdate) FROM lineitem)), date_trunc('year', (SELECT max(l_shipdate) FROM lineitem)) + INTERVAL 11 MONTH, INTERVAL 1 MONTH)) AS d))
SELECT month, 'missing' AS issue FROM c WHERE month NOT IN (SELECT month FROM m) UNION ALL SELECT month, 'duplicate' FROM m GROUP BY 1 HAVING count(*) > 1
""")
def a29_missing_and_duplicate_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of a generated calendar without a file, and months with several."""
    lines = table(spark, sf_dir, "lineitem")
    year = lambda c: F.trunc(c, "year")
    bounds = lines.agg(year(F.min("l_shipdate")).alias("first"), F.add_months(year(F.max("l_shipdate")), 11).alias("last"))
    months = lines.groupBy(_month("l_shipdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    missing = temporal.month_calendar(bounds, "first", "last").join(months, "month", "left_anti")
    return missing.withColumn("issue", F.lit("missing")).unionByName(months.filter("n > 1").select("month", F.lit("duplicate").alias("issue")))


@query("""
WITH a AS (SELECT l_partkey AS k, count(*) AS n, min(l_orderkey) AS t FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT a.k, CASE WHEN a.n = 1 AND b.n = 1 THEN a.t END AS text FROM a JOIN b USING (k)
""")
def a30_text_if_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value that is kept only where both sides have it once."""
    lines = table(spark, sf_dir, "lineitem")
    a = lines.filter("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("k")).agg(F.count(F.lit(1)).alias("x"), F.min("l_orderkey").alias("t"))
    b = lines.filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("k")).agg(F.count(F.lit(1)).alias("y"))
    return a.join(b, "k").select("k", F.when((F.col("x") == 1) & (F.col("y") == 1), F.col("t")).alias("text"))


@query("SELECT min(o_orderdate) AS first, max(o_orderdate) AS last, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")
def a31_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds, which the scan answers from file statistics where the source allows it."""
    return table(spark, sf_dir, "orders").agg(
        F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most")
    )


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, chr(31) ORDER BY o_orderpriority) AS names FROM orders GROUP BY 1")
def a32_joined_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names in order, joined by the unit separator."""
    names = F.array_join(F.sort_array(F.collect_set("o_orderpriority")), "\x1f")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(names.alias("names"))


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click,
       count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1
""")
def a34_outcomes_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day and outcome, pivoted over a fixed list of outcomes."""
    days = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return days.pivot("event_type", ["view", "click", "purchase"]).count().fillna(0)


@query("""
SELECT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING bool_and(l_quantity < 20)
""")
def f24_all_rows_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries all of whose rows are of low quality."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_and(F.col("l_quantity") < 20).alias("low"))
    return table(spark, sf_dir, "orders").join(lines.filter("low"), "o_orderkey", "left_semi").select("o_orderkey")


@query("SELECT l_orderkey, bool_or(l_quantity > 48 OR l_returnflag = 'R') AS accepted FROM lineitem GROUP BY 1")
def f25_any_row_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with at least one accepted row."""
    accepted = F.bool_or((F.col("l_quantity") > 48) | (F.col("l_returnflag") == "R"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(accepted.alias("accepted"))
