"""Samples with quotas, and search attempts matched to batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.operators import reconcile, reports, sampling
from archivolt.plans._base import collector
from archivolt.session import table

QUERIES, ORACLES, query = collector()

_WEIGHTS = {"rare": 30, "none": 10, "1-URGENT": 20, "2-HIGH": 15, "3-MEDIUM": 10, "4-NOT SPECIFIED": 9, "5-LOW": 6}


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 97 = 0 THEN 'rare' ELSE o_orderpriority END AS stratum, o_orderdate FROM orders),
w AS (SELECT *, 150 * w / 100.0::DOUBLE AS x FROM (VALUES (0, 'rare', 30), (1, 'none', 10), (2, '1-URGENT', 20), (3, '2-HIGH', 15), (4, '3-MEDIUM', 10), (5, '4-NOT SPECIFIED', 9), (6, '5-LOW', 6)) t(i, stratum, w)),
q AS (SELECT stratum, floor(x)::BIGINT + (row_number() OVER (ORDER BY x - floor(x) DESC, i) <= 150 - sum(floor(x)) OVER ())::INT AS k FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY stratum) AS n FROM o),
t AS (SELECT n.* FROM n JOIN q USING (stratum) WHERE k >= n OR (k = 1 AND i = n // 2) OR (k > 1 AND list_contains(list_transform(range(k), lambda j: round_even(j * (n - 1) / (k - 1)::DOUBLE, 0)::BIGINT), i))),
u AS (SELECT o.*, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n, 150 - (SELECT count(*) FROM t) AS k FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t))
SELECT o_orderkey, stratum, false AS refilled FROM t UNION ALL
SELECT o_orderkey, stratum, true FROM u WHERE k > 1 AND list_contains(list_transform(range(k), lambda j: round_even(j * (n - 1) / (k - 1)::DOUBLE, 0)::BIGINT), i)
""")
def w11_weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """150 orders by fixed weights of classes; one class is too small for its quota and one is empty, so the rest is refilled."""
    stratum = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 97 == 0), "rare").otherwise(F.col("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", stratum.alias("stratum"), "o_orderdate")
    picked = sampling.weighted_sample(rows, "stratum", _WEIGHTS, [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderkey", 150)
    return picked.select("o_orderkey", "stratum", "refilled")


#: First and last year, duration above and up to, longer edge at least and at most (0: any). The first and fifth overlap; none has the last.
_STRATA = (
    (1992, 1993, 0, 600, 0, 640),
    (1993, 1994, 600, 1200, 0, 0),
    (1994, 1995, 1200, 2400, 0, 0),
    (1995, 1996, 2400, 3600, 0, 0),
    (1992, 1993, 0, 600, 0, 0),
    (1997, 1998, 600, 1200, 0, 0),
    (1998, 2100, 1200, 2400, 1921, 0),
    (2020, 2100, 3600, 1e18, 0, 0),
)
_THIS_YEAR = 1998


@query("""
WITH v AS (SELECT o_orderkey AS id, year(o_orderdate) AS y, o_totalprice / 100 AS d, 320 + o_orderkey % 10 * 240 AS e, o_orderdate FROM orders),
s AS (SELECT * FROM (VALUES (0, 1992, 1993, 0, 600, 0, 640), (1, 1993, 1994, 600, 1200, 0, 0), (2, 1994, 1995, 1200, 2400, 0, 0), (3, 1995, 1996, 2400, 3600, 0, 0), (4, 1992, 1993, 0, 600, 0, 0), (5, 1997, 1998, 600, 1200, 0, 0), (6, 1998, 1998, 1200, 2400, 1921, 0)) t(k, a, b, lo, hi, least, most)),
r AS (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY abs(y - (a + b) / 2.0::DOUBLE), abs(d - least(hi, 600) / 2.0::DOUBLE), id) AS n FROM v JOIN s ON y BETWEEN a AND b AND d > lo AND d <= hi AND (least = 0 OR e >= least) AND (most = 0 OR e <= most)),
f AS (SELECT k, id FROM r WHERE n = 1 AND k <> 4 UNION ALL SELECT k, arg_min(id, n) FROM r WHERE k = 4 AND id NOT IN (SELECT id FROM r WHERE k = 0 AND n = 1) GROUP BY k),
w AS (SELECT id, i FROM (SELECT id, row_number() OVER (ORDER BY o_orderdate, id) - 1 AS i, count(*) OVER () AS n FROM v) WHERE list_contains(list_transform(range(8), lambda j: round_even(j * (n - 1) / 7.0::DOUBLE, 0)::BIGINT), i)),
x AS (SELECT id, row_number() OVER (ORDER BY i) AS place FROM w WHERE id NOT IN (SELECT id FROM f))
SELECT k AS stratum, id AS o_orderkey FROM f UNION ALL SELECT NULL, id FROM x WHERE place <= 8 - (SELECT count(*) FROM f)
""")
def w12_pilot_of_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of eight classes of year, duration and size, none twice; an empty class is filled from an even spread."""
    year, duration, edge = F.year("o_orderdate"), F.col("o_totalprice") / 100, 320 + F.col("o_orderkey") % 10 * 240
    strata = []
    for first, last, low, high, least, most in _STRATA:
        last = min(last, _THIS_YEAR)
        condition = year.between(first, last) & (duration > low) & (duration <= high)
        condition = condition & (edge >= least) if least else condition
        condition = condition & (edge <= most) if most else condition
        strata.append((condition, [F.abs(year - (first + last) / 2), F.abs(duration - min(high, 600) / 2)]))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return sampling.best_of_strata(orders, strata, "o_orderkey", [F.col("o_orderdate"), F.col("o_orderkey")], 8)


_ATTEMPTS = """
WITH o AS (SELECT o_custkey, o_orderkey % 2 = 0 AS even, o_orderpriority AS d, year(o_orderdate)::VARCHAR AS y FROM orders),
b AS (SELECT o_custkey AS batch_id, list_sort(list(DISTINCT d)) AS dates, list_sort(list(DISTINCT y)) AS ids, min(y) AS first, max(y) AS last, count(*) AS n FROM o WHERE NOT even GROUP BY 1),
a AS (SELECT o_custkey AS attempt_id, CASE WHEN o_custkey % 4 = 0 THEN list_sort(list(DISTINCT d)) ELSE [] END AS dates, CASE WHEN o_custkey % 4 <= 1 THEN list_sort(list(DISTINCT CASE WHEN o_custkey % 8 = 1 THEN y || 'x' WHEN o_custkey % 16 = 5 AND y = '1995' THEN 'z' ELSE y END)) ELSE [] END AS ids,
   CASE WHEN o_custkey % 4 <> 3 THEN min(y) END AS first, CASE WHEN o_custkey % 4 <> 3 THEN max(y) END AS last, CASE WHEN o_custkey % 4 <> 3 THEN count(*) END AS n FROM o WHERE even GROUP BY 1),
"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Batches and attempts of customers."""
    year = F.date_format("o_orderdate", "yyyy")
    orders = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 2 == 0).alias("even"), F.col("o_orderpriority").alias("d"), year.alias("y"))
    span = [F.min("y").alias("first"), F.max("y").alias("last"), F.count(F.lit(1)).alias("n")]
    batches = orders.filter("NOT even").groupBy(F.col("o_custkey").alias("batch_id")).agg(F.collect_set("d").alias("dates"), F.collect_set("y").alias("ids"), *span)
    c, none = F.col("o_custkey"), F.array().cast("array<string>")
    changed = F.when(c % 8 == 1, F.concat("y", F.lit("x"))).when((c % 16 == 5) & (F.col("y") == "1995"), "z").otherwise(F.col("y"))
    made = orders.filter("even").groupBy("o_custkey").agg(F.collect_set("d").alias("dates"), F.collect_set(changed).alias("ids"), *span)
    given = lambda x: F.when(c % 4 != 3, F.col(x)).alias(x)
    attempts = made.select(c.alias("attempt_id"), F.when(c % 4 == 0, F.col("dates")).otherwise(none).alias("dates"), F.when(c % 4 <= 1, F.col("ids")).otherwise(none).alias("ids"), given("first"), given("last"), given("n"))
    return batches, attempts


@query(_ATTEMPTS + """
m AS (SELECT attempt_id, 'dates' AS tier, min(batch_id) AS batch_id, count(batch_id) AS matches FROM a LEFT JOIN b ON a.dates = b.dates WHERE len(a.dates) > 0 GROUP BY 1
  UNION ALL SELECT attempt_id, 'ids', min(batch_id), count(batch_id) FROM a LEFT JOIN b ON a.ids = b.ids WHERE len(a.dates) = 0 AND len(a.ids) > 0 GROUP BY 1
  UNION ALL SELECT attempt_id, 'range', min(batch_id), count(batch_id) FROM a LEFT JOIN b ON a.first = b.first AND a.last = b.last AND a.n = b.n WHERE len(a.dates) = 0 AND len(a.ids) = 0 AND a.first IS NOT NULL GROUP BY 1),
v AS (SELECT a.attempt_id, arg_min(b.batch_id, (-len(list_intersect(a.ids, b.ids)), b.batch_id)) AS batch_id FROM m JOIN a USING (attempt_id) JOIN b ON len(list_intersect(a.ids, b.ids)) >= 0.5::DOUBLE * len(a.ids) WHERE tier = 'ids' AND matches = 0 GROUP BY 1)
SELECT attempt_id, CASE WHEN v.batch_id IS NOT NULL THEN 'overlap' ELSE tier END AS tier, coalesce(m.batch_id, v.batch_id) AS batch_id, CASE WHEN v.batch_id IS NOT NULL THEN 1 ELSE matches END AS matches FROM m LEFT JOIN v USING (attempt_id)
""")
def j36_attempts_to_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts matched by their dates, else by their ids, equal or for the most part, else by range and size."""
    batches, attempts = _sides(spark, sf_dir)
    return reconcile.attempts_to_batches(attempts, batches, 0.5)


@query(_ATTEMPTS + """
m AS (SELECT b.batch_id, attempt_id FROM b JOIN a ON CASE WHEN len(a.dates) > 0 THEN a.dates = b.dates WHEN len(a.ids) > 0 THEN a.ids = b.ids ELSE a.first = b.first AND a.last = b.last AND a.n = b.n END),
h AS (SELECT batch_id, count(*) AS attempts, max(attempt_id) AS latest FROM m GROUP BY 1)
SELECT batch_id, coalesce(attempts, 0) AS attempts, 'at ' || latest AS finished_at, CASE WHEN n % 5 = 0 THEN 'Review candidates' WHEN n % 5 = 1 THEN 'Try another folder or keep fallback' WHEN h.batch_id IS NULL THEN 'Choose folder' ELSE 'Try another folder' END AS step FROM b LEFT JOIN h USING (batch_id)
""")
def r31_attempt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches with the number of attempts made for them, when the last one ended, and what to do next."""
    batches, attempts = _sides(spark, sf_dir)
    ended = attempts.withColumn("finished_at", F.concat(F.lit("at "), F.col("attempt_id").cast("string")))
    found = reconcile.batch_attempts(batches, ended, "attempt_id", ["finished_at"]).join(batches.select("batch_id", "n"), "batch_id")
    step = reports.next_step((F.col("n") % 5 == 0).cast("int"), (F.col("n") % 5 == 1).cast("int"), F.lit(0), F.col("attempts"))
    return found.select("batch_id", "attempts", "finished_at", step.alias("step"))
