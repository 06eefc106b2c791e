"""Queries of whole runs of the search by dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.operators import search
from archivolt.plans._base import collector
from archivolt.session import table

QUERIES, ORACLES, query = collector()


def _run(spark: SparkSession, sf_dir: str) -> search.Run:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"), F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("entry"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("path"),
        F.col("l_partkey").alias("sha"),
        F.to_date("l_shipdate").alias("day"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_quantity").alias("quantity"),
    )
    confirmed = lines.filter("flag = 'A' AND quantity > 40").select("entry", "sha", "path")
    pending = lines.filter("flag = 'A' AND quantity > 45").select("entry", F.when(F.col("entry") % 2 == 0, F.col("sha")).alias("sha"), F.when(F.col("entry") % 2 == 1, F.col("path")).alias("path"))
    earlier = orders.select("entry", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k")).select("entry", ((F.col("entry") * 31 + F.col("k") * 97) % 200 + 1).alias("sha"), F.lit(None).cast("long").alias("path"))
    own = lines.select("entry", F.lit(None).cast("long").alias("sha"), "path")
    stored = orders.filter("entry % 17 = 0").select("entry", (F.col("entry") * 8 + 1).alias("path"), F.lit("maybe").alias("decision"))
    return search.date_search(
        orders.filter("o_orderstatus <> 'F'").select("entry", "day"),
        orders.filter("entry % 13 = 0").select("entry"),
        confirmed,
        pending,
        lines.select("path", "sha", "day", (F.col("flag") != "R").alias("preferred")),
        earlier.unionByName(own),
        stored,
    )


_RUN = """
WITH l AS (SELECT l_orderkey AS entry, l_orderkey * 8 + l_linenumber AS path, l_partkey AS sha, CAST(l_shipdate AS DATE) AS day, l_returnflag AS flag, l_quantity AS quantity FROM lineitem),
t AS (SELECT o_orderkey AS entry, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 13 <> 0 AND NOT EXISTS (SELECT 1 FROM l c WHERE c.entry = o_orderkey AND c.flag = 'A' AND c.quantity > 40
  AND NOT EXISTS (SELECT 1 FROM l p WHERE p.entry = c.entry AND p.flag = 'A' AND p.quantity > 45 AND CASE WHEN p.entry % 2 = 0 THEN p.sha = c.sha ELSE p.path = c.path END))),
j AS (SELECT DISTINCT (o_orderkey * 31 + k * 97) % 200 + 1 AS sha, o_orderkey AS entry FROM orders, range(20) r(k)),
n AS (SELECT t.entry, t.day, path, l.sha, min(abs(date_diff('day', t.day, l.day)))::INT AS dist, bool_or(flag <> 'R') AS good FROM t JOIN l ON l.day BETWEEN t.day - 3 AND t.day + 3 GROUP BY 1, 2, 3, 4),
s AS (SELECT o_orderkey AS entry, o_orderkey * 8 + 1 AS path FROM orders WHERE o_orderkey % 17 = 0),
m AS (SELECT n.*, EXISTS (SELECT 1 FROM j WHERE j.entry = n.entry AND j.sha = n.sha) OR EXISTS (SELECT 1 FROM l x WHERE x.entry = n.entry AND x.path = n.path) AS hidden, CASE WHEN dist <= 1 THEN dist ELSE 2 END AS tier FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.entry = n.entry AND s.path = n.path)),
a AS (SELECT *, min(CASE WHEN good THEN tier END) OVER (PARTITION BY entry) AS cut FROM m WHERE NOT hidden),
b AS (SELECT *, min(CASE WHEN good THEN dist END) OVER (PARTITION BY entry) AS near FROM a WHERE cut IS NULL OR tier <= cut),
o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY dist, entry) AS place FROM b WHERE near IS NULL OR dist <= near),
u AS (SELECT entry, path, dist AS day_distance, tier, '' AS decision FROM o WHERE place = 1 UNION ALL SELECT entry, path, NULL, NULL, 'maybe' FROM s WHERE entry IN (SELECT entry FROM t)),
q AS (SELECT t.entry, t.day, path, day_distance, tier, decision, path IS NULL AS placeholder FROM t LEFT JOIN u USING (entry)),
d AS (SELECT day, entries, candidates, coalesce(hidden, 0) AS hidden, CASE WHEN candidates > 0 THEN 'needs_choice' WHEN coalesce(hidden, 0) > 0 THEN 'all_candidates_rejected' ELSE 'no_external_candidates' END AS status
  FROM (SELECT day, count(DISTINCT entry) AS entries, count(path) AS candidates FROM q GROUP BY 1) LEFT JOIN (SELECT day, count(*) AS hidden FROM m WHERE hidden GROUP BY 1) USING (day)),
g AS (SELECT *, sum(fresh) OVER (ORDER BY day) AS batch FROM (SELECT *, CASE WHEN date_diff('day', lag(day) OVER (ORDER BY day), day) <= 3 THEN 0 ELSE 1 END AS fresh FROM d))
"""


@query(_RUN + "SELECT entry, day, path, day_distance, CAST(tier AS INT) AS tier, decision, placeholder FROM q")
def r01_date_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue of a run: candidates by date for entries without an original, decided rows, placeholders."""
    return _run(spark, sf_dir).queue


@query(_RUN + "SELECT * FROM d")
def r01_searched_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day of a run with its entries, candidates, hidden rows and status."""
    return _run(spark, sf_dir).days


@query(_RUN + """
SELECT 'B' || lpad(batch::BIGINT::VARCHAR, 3, '0') AS batch_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days, sum(entries)::BIGINT AS entries, sum(candidates)::BIGINT AS candidates,
  count(*) FILTER (candidates = 0) AS days_without, string_agg(DISTINCT status, ';' ORDER BY status) AS statuses FROM g GROUP BY batch
""")
def r01_search_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a run that lie at most three days apart, as batches."""
    return _run(spark, sf_dir).batches
