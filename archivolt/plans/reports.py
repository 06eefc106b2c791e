"""Queries of drivers and roll-ups: compositions of the operators, and what is reported about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivolt.functions import records
from archivolt.operators import filters, graph, ranking, reports, states, temporal, upsert
from archivolt.plans._base import collector
from archivolt.session import table
from archivolt.sources import files
from archivolt.storage import new_path

QUERIES, ORACLES, query = collector()


@query("""
WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus <> 'F'),
p AS (SELECT o_orderkey, l_partkey, l_returnflag <> 'R' AS good, abs(date_diff('day', d, CAST(l_shipdate AS DATE))) AS dist FROM t JOIN lineitem ON l_orderkey = o_orderkey WHERE abs(date_diff('day', d, CAST(l_shipdate AS DATE))) <= 30),
u AS (SELECT o_orderkey, l_partkey, min(dist) AS dist, bool_or(good) AS good FROM p GROUP BY 1, 2),
f AS (SELECT *, min(CASE WHEN good THEN dist END) OVER (PARTITION BY o_orderkey) AS cut FROM u),
k AS (SELECT * FROM f WHERE cut IS NULL OR dist <= cut),
a AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY dist, o_orderkey) AS n FROM k)
SELECT t.o_orderkey, count(l_partkey) AS candidates, count(l_partkey) = 0 AS placeholder FROM t LEFT JOIN (SELECT * FROM a WHERE n = 1) a USING (o_orderkey) GROUP BY 1
""")
def r01_search_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of the search: targets, files near their dates up to the first good distance, each file for one target."""
    targets = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    index = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", (F.col("l_returnflag") != "R").alias("good"), F.to_date("l_shipdate").alias("s"))
    gap = F.abs(F.datediff("s", "d"))
    near = targets.join(index, "o_orderkey").filter(gap <= 30).groupBy("o_orderkey", "l_partkey").agg(F.min(gap).alias("dist"), F.bool_or("good").alias("good"))
    kept = temporal.closest_until_preferred(near, ["o_orderkey"], F.col("dist"), F.col("good"), F.lit(False))
    own = ranking.single_assignment(kept, "l_partkey", [F.col("dist"), F.col("o_orderkey")]).filter("assigned")
    n = F.count("l_partkey")
    return targets.select("o_orderkey").join(own, "o_orderkey", "left").groupBy("o_orderkey").agg(n.alias("candidates"), (n == 0).alias("placeholder"))


@query("""
SELECT user_id % 10 AS run, count(*) AS targets, round_even(avg((value <= 25)::INT), 4) AS prefilter_recall, round_even(avg(CASE WHEN value <= 25 THEN (value <= 5)::INT END), 4) AS recall_of_shortlist, count(*) FILTER (value > 25) AS lost FROM events GROUP BY 1
""")
def r16_prefilter_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of matching runs: what the shortlist held, and what the ranking found of that."""
    held, hit = F.col("value") <= 25, F.col("value") <= 5
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("run")).agg(
        F.count(F.lit(1)).alias("targets"),
        F.bround(F.avg(held.cast("double")), 4).alias("prefilter_recall"),
        F.bround(F.avg(F.when(held, hit.cast("double"))), 4).alias("recall_of_shortlist"),
        F.count_if(~held).alias("lost"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '{"left":{"path":' || l_partkey || '},"right":{"path":' || l_suppkey || '},"score":' || CAST(round(l_quantity)::BIGINT AS VARCHAR) || '}' AS payload FROM lineitem""")
def r17_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs as JSON payloads."""
    side = lambda c: F.struct(F.col(c).alias("path"))
    payload = F.to_json(F.struct(side("l_partkey").alias("left"), side("l_suppkey").alias("right"), F.round("l_quantity").cast("long").alias("score")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", payload.alias("payload"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_size > l_quantity AND l_tax = 0 AND l_discount > 0 AS better_without_place, p_size >= 40 AS large FROM lineitem JOIN part ON p_partkey = l_partkey
""")
def r18_derived_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of matched pairs: the older one is larger but has no place, and the older one is very large."""
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    better = (F.col("p_size") > F.col("l_quantity")) & (F.col("l_tax") == 0) & (F.col("l_discount") > 0)
    return table(spark, sf_dir, "lineitem").join(known, "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", better.alias("better_without_place"), (F.col("p_size") >= 40).alias("large")
    )


@query("""
WITH m AS (SELECT l_orderkey, min(l_partkey) AS media FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O' AND l_quantity <= 45 GROUP BY 1)
SELECT o_orderkey, CASE WHEN media IS NOT NULL AND o_orderstatus <> 'P' THEN 'auto:' || media ELSE 'kept:' || o_orderpriority END AS decision FROM orders LEFT JOIN m ON l_orderkey = o_orderkey
""")
def r19_auto_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored originals; those that are beyond doubt are accepted where nobody has decided yet."""
    score = records.original_score(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.lit("low"), F.col("l_quantity") > 45)
    scored = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linestatus", score.alias("s"))
    sure = scored.filter("s.confidence = 'high' AND l_linestatus = 'O'").groupBy("o_orderkey").agg(F.concat(F.lit("auto:"), F.min("l_partkey").cast("string")).alias("decision"))
    stored = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("kept:"), "o_orderpriority").alias("decision"), "o_orderstatus")
    reviewed = stored.filter("o_orderstatus = 'P'").select("o_orderkey")
    open_ = sure.join(reviewed, "o_orderkey", "left_anti").join(stored.select("o_orderkey"), "o_orderkey", "left_semi")
    return upsert.keyed_upsert(stored.drop("o_orderstatus"), open_, ["o_orderkey"])


@query("""
SELECT 'urgent' AS name, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000
UNION ALL SELECT 'open', min(o_orderkey) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'cheap', min(o_orderkey) FROM orders WHERE o_totalprice < 5000
""")
def r20_pilot_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pilot: the first entry of each kind that is to be shown."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    price = F.col("o_totalprice")
    kinds = {"urgent": (F.col("o_orderpriority") == "1-URGENT") & (price > 300000), "open": F.col("o_orderstatus") == "O", "cheap": price < 5000}
    return states.first_per_predicate(rows, kinds, ["o_orderkey"]).select("name", "o_orderkey")


@query("""
SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
""")
def r24_rebuilt_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed rows of a CSV applied, and the queue of what is still without an answer."""
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    path = new_path(spark, "review")
    customers.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("yes").alias("decision")).write.option("header", True).csv(path)
    reviewed = files.csv_queue(spark, path, ["c_custkey", "decision"]).filter("decision = 'yes'").select(F.col("c_custkey").cast("long"))
    known = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    answered = upsert.keyed_upsert(known.distinct(), reviewed, ["c_custkey"])
    return customers.join(answered, "c_custkey", "left_anti")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'no_gps' WHEN c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 'unknown_entry' ELSE 'imported' END AS status, CASE WHEN c_custkey % 4 <> 0 AND c_custkey IN (SELECT o_custkey FROM orders) THEN round(c_nationkey + 0.25, 4) END AS latitude FROM customer
""")
def r25_sidecar_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of sidecars for known entries, with what became of each sidecar."""
    from archivolt.sources import media

    number = F.round(F.col("c_nationkey") + 0.25, 4).cast("string")
    xmp = F.concat(F.lit('<x xmlns:e="u" e:GPSLatitude="'), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(number), F.lit('"/>'))
    read = table(spark, sf_dir, "customer").select("c_custkey", F.try_element_at(media.sidecar_column(xmp, "GPSLatitude"), F.lit(1)).try_cast("double").alias("gps"))
    known = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("known")).distinct()
    status = F.when(F.col("gps").isNull(), "no_gps").when(F.col("known").isNull(), "unknown_entry").otherwise("imported")
    return read.join(known, "c_custkey", "left").select("c_custkey", status.alias("status"), F.when(status == "imported", F.col("gps")).alias("latitude"))


@query("""
WITH m AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0), e AS (SELECT l_orderkey, count(*) AS n, max(l_quantity) > 40 AS updates FROM lineitem GROUP BY 1)
SELECT coalesce(o_orderkey, l_orderkey) AS id, CASE WHEN l_orderkey IS NULL THEN 'missing' WHEN o_orderkey IS NULL THEN 'unmatched' WHEN updates THEN 'review' ELSE 'matched' END AS status FROM m FULL JOIN e ON l_orderkey = o_orderkey
""")
def r26_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a reconciliation report: matched, with updates to review, missing, unmatched."""
    manifest = table(spark, sf_dir, "orders").filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"), F.lit(True).alias("listed"))
    export = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.max("l_quantity") > 40).alias("updates"))
    status = F.when(F.col("updates").isNull(), "missing").when(F.col("listed").isNull(), "unmatched").when(F.col("updates"), "review").otherwise("matched")
    return manifest.join(export, "id", "full").select("id", status.alias("status"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def r27_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of a status column of a CSV."""
    path = new_path(spark, "statuses")
    table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")).write.option("header", True).csv(path)
    return files.csv_queue(spark, path, ["status"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'new/imported' WHEN o_orderkey % 3 = 0 THEN 'changed/re-imported' ELSE 'unchanged/skipped' END AS status,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 7 || ' links could not be attached' ELSE '' END AS warning FROM orders
""")
def r28_run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run changed against the state before, and warnings from the lines of its log."""
    after = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("size"))
    before = after.filter("o_orderkey % 10 <> 0").withColumn("size", F.when(F.col("o_orderkey") % 3 == 0, F.col("size") - 1).otherwise(F.col("size")))
    log = F.concat(F.lit("started\nentries: 1\nexternal_links: 0\n external_links : "), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") % 7).otherwise(-1).cast("string"))
    number = F.try_element_at(reports.key_values(log), F.lit("external_links")).try_cast("int")
    warning = F.when(number >= 0, F.concat(number.cast("string"), F.lit(" links could not be attached"))).otherwise("")
    return reports.snapshot_changes(before, after, "o_orderkey", ["size"]).select("o_orderkey", "status", warning.alias("warning"))


@query("""
WITH b AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') AS c, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1), a AS (SELECT o_orderkey, max(o_orderdate) AS latest, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT l_orderkey, latest, CASE WHEN c > 0 THEN 'Review candidates' WHEN r > 0 THEN 'Try another folder or keep fallback' WHEN n IS NULL THEN 'Choose folder' ELSE 'Try another folder' END AS step FROM b LEFT JOIN a ON o_orderkey = l_orderkey
""")
def r31_next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches with their latest attempt and what to do next."""
    flag = F.col("l_returnflag")
    batches = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(flag == "N").alias("c"), F.count_if(flag == "R").alias("r"))
    attempts = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.max("o_orderdate").alias("latest"), F.count(F.lit(1)).alias("n"))
    step = reports.next_step(F.col("c"), F.col("r"), F.lit(0), F.coalesce("n", F.lit(0)))
    return batches.join(attempts, "l_orderkey", "left").select("l_orderkey", "latest", step.alias("step"))


@query("""
WITH m AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders WHERE o_orderstatus = 'P'), l AS (SELECT o_custkey, list_sort(list_distinct(list(d))) AS ds FROM m GROUP BY 1)
SELECT o_custkey, array_to_string(ds[1 : 5], ', ') || CASE WHEN len(ds) > 5 THEN ' +' || (len(ds) - 5) || ' more' ELSE '' END AS missing FROM l
""")
def r32_missing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates without media of each package, the first five and how many more."""
    days = F.array_sort(F.collect_set(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(reports.first_and_more(days).alias("missing"))


@query("""
SELECT l_linestatus AS root, count(*) AS files, count(DISTINCT l_partkey) AS distinct_files, min(CAST(l_shipdate AS DATE)) AS first_day, max(CAST(l_shipdate AS DATE)) AS last_day, round_even(avg((l_returnflag = 'N')::INT), 4) AS current FROM lineitem GROUP BY 1
""")
def r33_index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of an index by root."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("root")).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_distinct("l_partkey").alias("distinct_files"),
        F.min(F.to_date("l_shipdate")).alias("first_day"),
        F.max(F.to_date("l_shipdate")).alias("last_day"),
        F.bround(F.avg((F.col("l_returnflag") == "N").cast("double")), 4).alias("current"),
    )


@query("""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding[1 : 6], lambda x: (x > 0)::INT) AS fp FROM embeddings),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.fp = b.fp AND a.vec_id <> b.vec_id),
c AS (SELECT x, least(x, min(y)) AS component FROM e GROUP BY 1)
SELECT component, count(*) AS size FROM c GROUP BY 1
""")
def r40_fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints made for candidates only, and the groups that share one within a bucket."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    several = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    print_ = F.array_join(F.transform(F.slice("embedding", 1, 6), lambda x: (x > 0).cast("int").cast("string")), "")
    marked = rows.join(several.select("label"), "label", "left_semi").select("vec_id", "label", print_.alias("fp"))
    # Equal fingerprints are one group, so each member links to the one before it.
    order = Window.partitionBy("label", "fp").orderBy("vec_id")
    edges = marked.select(F.col("vec_id").alias("src"), F.lag("vec_id").over(order).alias("dst")).filter("dst IS NOT NULL")
    return graph.connected_components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def r41_planned_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of fixed size: items whose preparation failed are replaced by the next ones."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    failed = rows.filter("o_orderkey % 3 = 0")
    return reports.planned_batch(rows, failed, "o_orderkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 40).select("o_orderkey")


@query("""
WITH p AS (SELECT o_custkey, count(*) AS orders, max(o_orderdate) AS latest FROM orders GROUP BY 1), t AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS tags FROM orders GROUP BY 1)
SELECT c_custkey, n_name AS place, coalesce(orders, 0) AS photos, latest, coalesce(tags, '') AS tags FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN p ON p.o_custkey = c_custkey LEFT JOIN t ON t.o_custkey = c_custkey
""")
def r42_entry_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with their place, photos and tags, gathered in one pass over the photos."""
    photos = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("latest"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ";").alias("t")
    )
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("place"))
    return table(spark, sf_dir, "customer").join(places, "c_nationkey").join(photos, "c_custkey", "left").select(
        "c_custkey", "place", F.coalesce("n", F.lit(0)).alias("photos"), "latest", F.coalesce("t", F.lit("")).alias("tags")
    )


@query("""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') END AS timestamp, CASE WHEN event_id % 2 = 0 THEN 'exif' WHEN event_id % 3 = 0 THEN 'filename' ELSE 'none' END AS source FROM events
""")
def r43_intake_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time proposed for a dropped file: of its metadata, else of its name, else none."""
    from archivolt.functions import values

    key = F.col("event_id")
    written = F.when(key % 2 == 0, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).otherwise("0000:00:00 00:00:00")
    name = F.when(key % 3 == 0, F.concat(F.date_format("ts", "yyyyMMdd"), F.lit(".jpg"))).otherwise("a.jpg")
    dated = F.date_format(F.try_element_at(values.filename_dates(name), F.lit(1)), "yyyy-MM-dd")
    found = reports.chosen_time({"exif": records.capture_text(written), "filename": dated})
    return table(spark, sf_dir, "events").select("event_id", found.alias("f")).select("event_id", "f.timestamp", "f.source")


@query("""
SELECT l_partkey AS path, min(CAST(l_shipdate AS DATE)) AS day, bool_or(l_returnflag = 'A') AS confirmed FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-03-31' GROUP BY 1
""")
def r11_descriptor_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of a scope of dates that a fingerprint run reads, each once, and whether a confirmed original is among them."""
    day = F.to_date("l_shipdate")
    scope = table(spark, sf_dir, "lineitem").filter(day.between(F.lit("1997-01-01").cast("date"), F.lit("1997-03-31").cast("date")))
    return scope.groupBy(F.col("l_partkey").alias("path")).agg(F.min(day).alias("day"), F.bool_or(F.col("l_returnflag") == "A").alias("confirmed"))


@query("""
SELECT c.vec_id, CASE WHEN s.vec_id IS NULL THEN 'missing' ELSE 'stale' END AS state FROM embeddings c LEFT JOIN (SELECT vec_id, label + (vec_id % 4 = 1)::INT AS v FROM embeddings WHERE vec_id % 3 <> 0) s ON s.vec_id = c.vec_id WHERE s.vec_id IS NULL OR s.v <> c.label
""")
def r12_index_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors that the band index lacks or holds in another version: a match may only start without any."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("version"))
    stored = rows.filter("vec_id % 3 <> 0").withColumn("version", F.col("version") + (F.col("vec_id") % 4 == 1).cast("int"))
    behind = filters.stale_rows(rows, stored, "vec_id", ["version"])
    held = stored.select("vec_id", F.lit(True).alias("held"))
    return behind.join(held, "vec_id", "left").select("vec_id", F.when(F.col("held").isNull(), "missing").otherwise("stale").alias("state"))
