"""Queries of state changes: enrichment, decisions, flags, work queues, sinks by partition, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivolt.functions import records
from archivolt.operators import filters, states, upsert
from archivolt.plans._base import collector
from archivolt.session import table
from archivolt.storage import new_path

QUERIES, ORACLES, query = collector()

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("""
WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'import' WHEN 1 THEN 'selected' WHEN 2 THEN 'skip' ELSE 'canonical_only' END AS action, o_orderkey % 6 = 0 AS deleted, o_orderpriority AS tag, o_totalprice FROM orders),
k AS (SELECT * FROM s WHERE action IN ('import', 'selected') AND NOT deleted),
e AS (SELECT o_orderkey AS id, -1.0 AS price FROM orders WHERE o_orderkey % 10 = 0)
SELECT 'entry' AS kind, CAST(o_orderkey AS VARCHAR) AS key, CAST(round(o_totalprice) AS BIGINT) AS value FROM k
UNION ALL SELECT 'entry', CAST(id AS VARCHAR), -1 FROM e WHERE id NOT IN (SELECT o_orderkey FROM k)
UNION ALL SELECT 'tag', CAST(o_orderkey AS VARCHAR) || '/' || tag, 1 FROM k
UNION ALL SELECT 'location', CAST(o_orderkey AS VARCHAR), 0 FROM k WHERE o_orderkey % 8 = 0
""")
def k02_staged_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected and not deleted staged records go into entries, tags and locations, each by its own key."""
    key = F.col("o_orderkey")
    action = F.element_at(F.array(*map(F.lit, ("import", "selected", "skip", ""))), (key % 4 + 1).cast("int"))
    orders = table(spark, sf_dir, "orders")
    taken = orders.filter(records.is_selected(records.action_of(action, F.lit(None).cast("string"))) & (key % 6 != 0))
    text = key.cast("string").alias("key")
    stored = orders.filter("o_orderkey % 10 = 0").select(text, F.lit(-1).cast("long").alias("value"))
    entries = upsert.keyed_upsert(stored, taken.select(text, F.round("o_totalprice").cast("long").alias("value")), ["key"])
    tags = taken.select(F.concat_ws("/", key.cast("string"), "o_orderpriority").alias("key"), F.lit(1).cast("long").alias("value"))
    places = taken.filter("o_orderkey % 8 = 0").select(text, F.lit(0).cast("long").alias("value"))
    kinds = [df.select(F.lit(kind).alias("kind"), "key", "value") for kind, df in (("entry", entries), ("tag", tags), ("location", places))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query("""
WITH i AS (SELECT o_custkey, o_orderpriority AS name, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders WHERE o_totalprice > 100000 GROUP BY 1, 2),
s AS (SELECT DISTINCT o_custkey, o_orderpriority AS name, 'stored' AS status FROM orders WHERE o_custkey % 3 = 0)
SELECT * FROM i UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.o_custkey = s.o_custkey AND i.name = s.name)
""")
def k03_enrichment_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of entries by their three-part key; of several incoming ones the latest counts."""
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "name")
    stored = rows.filter("o_custkey % 3 = 0").select("o_custkey", "name", F.lit("stored").alias("status")).distinct()
    incoming = rows.filter("o_totalprice > 100000").select("o_custkey", "name", F.col("o_orderstatus").alias("status"), "o_orderdate", "o_orderkey")
    return upsert.keyed_upsert(stored, states.latest_of(incoming, ["o_custkey", "name"], ["o_orderdate", "o_orderkey"]), ["o_custkey", "name"])


@query("""
WITH m AS (SELECT *, o_orderkey % 9 = 0 AS reviewed FROM orders)
SELECT o_orderkey, 'tag' AS kind, o_orderpriority AS value FROM m WHERE reviewed AND o_orderpriority <> '5-LOW'
UNION ALL SELECT o_orderkey, 'person', c_name FROM m JOIN customer ON c_custkey = o_custkey WHERE reviewed
UNION ALL SELECT o_orderkey, 'location', CAST(c_nationkey AS VARCHAR) FROM m JOIN customer ON c_custkey = o_custkey WHERE reviewed AND c_acctbal > 0
""")
def k04_reviewed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags, people and places that a reviewed export added, written back; the source's own tag is left out."""
    reviewed = table(spark, sf_dir, "orders").filter("o_orderkey % 9 = 0").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    edits = F.array_compact(
        F.array(
            F.when(F.col("o_orderpriority") != "5-LOW", F.struct(F.lit("tag").alias("kind"), F.col("o_orderpriority").alias("value"))),
            F.struct(F.lit("person").alias("kind"), F.col("c_name").alias("value")),
            F.when(F.col("c_acctbal") > 0, F.struct(F.lit("location").alias("kind"), F.col("c_nationkey").cast("string").alias("value"))),
        )
    )
    return reviewed.select("o_orderkey", F.explode(edits).alias("e")).select("o_orderkey", "e.kind", "e.value")


@query("""
WITH n AS (SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS fp, count(*) AS n FROM lineitem GROUP BY 1),
o AS (SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS fp FROM lineitem WHERE l_quantity > 3 GROUP BY 1)
SELECT coalesce(n.l_orderkey, o.l_orderkey) AS l_orderkey, n.l_orderkey IS NOT NULL AS active, o.fp IS NOT DISTINCT FROM n.fp AS order_kept FROM n FULL JOIN o ON o.l_orderkey = n.l_orderkey
""")
def k07_sync_with_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sync in which an entry keeps its custom order only if its photos are the same."""
    lines = table(spark, sf_dir, "lineitem")

    def prints(rows: DataFrame) -> DataFrame:
        listed = F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda x: x.cast("string")), ",")
        return rows.groupBy("l_orderkey").agg(listed.alias("fp"))

    stored = prints(lines.filter("l_quantity > 3")).select("l_orderkey", "fp", F.lit(True).alias("active"), F.lit(True).alias("reviewed"), F.lit("then").alias("updated_at"))
    synced = upsert.soft_delete_sync(stored, prints(lines), "l_orderkey", "fp", F.lit("now"))
    return synced.select("l_orderkey", "active", F.coalesce(F.col("updated_at") == "then", F.lit(False)).alias("order_kept"))


@query("""
SELECT o_custkey AS path, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_custkey % 4 <> 0
UNION ALL SELECT o_custkey, CAST(o_orderdate AS DATE) + 1 FROM orders WHERE o_custkey % 4 = 0 AND o_totalprice > 150000
""")
def k08_replaced_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of rewritten files taken out and put in anew; those of other files stay."""
    dates = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.to_date("o_orderdate").alias("day"), "o_totalprice")
    files = dates.filter("path % 4 = 0")
    fresh = files.filter("o_totalprice > 150000").select("path", F.date_add("day", 1).alias("day"))
    return states.replace_children(dates.select("path", "day"), fresh, files, ["path"])


_DECIDED = """
WITH q AS (SELECT l_orderkey, l_partkey, CASE l_returnflag WHEN 'A' THEN ' Select' WHEN 'R' THEN 'reject' ELSE CASE WHEN l_linestatus = 'O' THEN 'keep_fallback' ELSE '' END END AS decision FROM lineitem),
m AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS entry, CAST(l_partkey AS VARCHAR) AS content, CASE WHEN decision = 'keep_fallback' THEN 'fallback_reference' ELSE 'original_reference' END AS role,
  CASE WHEN decision = 'reject' THEN 'rejected' ELSE 'available' END AS status, CASE WHEN decision = 'reject' THEN 'rejected' ELSE 'confirmed' END AS review_status FROM q WHERE decision <> '')
"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    decision = F.when(flag == "A", " Select").when(flag == "R", "reject").when(F.col("l_linestatus") == "O", "keep_fallback").otherwise("")
    return states.decided_media(table(spark, sf_dir, "lineitem").withColumn("decision", decision), "l_orderkey", "l_partkey", "decision")


@query(_DECIDED + "SELECT sha256(entry || '|' || content || '|' || role) AS id, * FROM m")
def k13_decided_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of the queue as canonical rows with ids that a repeated decision meets again."""
    return _decided(spark, sf_dir)


@query(_DECIDED + """, d AS (SELECT entry, min((status, content)) AS best FROM m WHERE role = 'original_reference' AND status = 'available' GROUP BY 1)
SELECT CAST(l_orderkey AS VARCHAR) AS entry, coalesce(best[2], 'fallback') AS media, CASE WHEN best IS NULL THEN 'needs_review' ELSE 'confirmed' END AS review FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN d ON entry = CAST(l_orderkey AS VARCHAR)
""")
def k14_entry_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entry with its confirmed original, or its fallback where none is confirmed."""
    confirmed = _decided(spark, sf_dir).filter("role = 'original_reference' AND status = 'available'").groupBy("entry").agg(F.min("content").alias("best"))
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("entry")).distinct()
    review = F.when(F.col("best").isNull(), "needs_review").otherwise("confirmed")
    return entries.join(confirmed, "entry", "left").select("entry", F.coalesce("best", F.lit("fallback")).alias("media"), review.alias("review"))


@query(_DECIDED + "SELECT entry, content, role FROM m WHERE entry NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P')")
def k15_undone_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions less those of entries that were taken back."""
    undone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("string").alias("entry"))
    return states.undo(_decided(spark, sf_dir), undone, ["entry"]).select("entry", "content", "role")


@query("SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'v2' ELSE 'v1' END AS method, CASE WHEN vec_id % 2 = 0 THEN label + 100 ELSE label END AS value FROM embeddings")
def k16_persisted_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors kept in partitions by method; a new run replaces the partitions that it has and no others."""
    path = new_path(spark, "descriptors")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 2 == 0, "v2").otherwise("v1").alias("method"), F.col("label").alias("value"))
    states.overwrite_partitions(rows, path, ["method"])
    states.overwrite_partitions(rows.filter("method = 'v2'").withColumn("value", F.col("value") + 100), path, ["method"])
    return spark.read.parquet(path).select("vec_id", "method", "value")


@query("""
WITH q AS (SELECT DISTINCT l_orderkey, l_partkey, 'queued' AS origin FROM lineitem WHERE l_returnflag = 'N'), m AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 40 GROUP BY 1, 2)
SELECT * FROM q UNION ALL SELECT l_orderkey, l_partkey, 'match' FROM m WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.l_orderkey = m.l_orderkey AND q.l_partkey = m.l_partkey)
""")
def k17_matches_to_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches that the review queue does not hold yet are added to it."""
    lines, key = table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"]
    queue = lines.filter("l_returnflag = 'N'").select(*key, F.lit("queued").alias("origin")).distinct()
    matches = lines.filter("l_quantity > 40").select(*key, F.lit("match").alias("origin")).distinct()
    return queue.unionByName(matches.join(queue, key, "left_anti"))


@query("""
SELECT p_partkey, p_size, CASE WHEN p_partkey % 5 = 0 THEN 'keep' WHEN p_partkey % 3 = 0 THEN 'drop' ELSE '' END AS decision FROM part
""")
def k18_cached_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from a written cache, with stored decisions and newer ones over them."""
    path = new_path(spark, "candidates")
    table(spark, sf_dir, "part").select("p_partkey", "p_size").write.parquet(path)
    cached = spark.read.parquet(path)
    stored = cached.filter("p_partkey % 3 = 0").select("p_partkey", F.lit("drop").alias("decision"))
    staged = cached.filter("p_partkey % 5 = 0").select("p_partkey", F.lit("keep").alias("decision"))
    decided = upsert.staged_over_stored(stored, staged, ["p_partkey"], ["decision"])
    return cached.join(decided, "p_partkey", "left").select("p_partkey", "p_size", F.coalesce("decision", F.lit("")).alias("decision"))


@query("""
WITH i AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0)
SELECT o_orderkey, 'video' AS kind, 0 AS frame, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS version FROM orders
UNION ALL SELECT o_orderkey, 'frame', f, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END FROM orders, range(1, 4) r(f) WHERE f <= CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 3 END
""")
def k19_videos_and_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos upserted, and the frames of rewritten ones replaced as a whole."""
    videos = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("old").alias("version"))
    fresh = videos.filter("o_orderkey % 2 = 0").withColumn("version", F.lit("new"))
    cut = lambda df, n: df.select("o_orderkey", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("frame"), "version")
    frames = states.replace_children(cut(videos, 3), cut(fresh, 2), fresh, ["o_orderkey"])
    rows = upsert.keyed_upsert(videos, fresh, ["o_orderkey"]).select("o_orderkey", F.lit("video").alias("kind"), F.lit(0).alias("frame"), "version")
    return rows.unionByName(frames.select("o_orderkey", F.lit("frame").alias("kind"), "frame", "version"))


_FRAMES = """
WITH f AS (SELECT event_id, user_id, ts, value, event_type IN ('click', 'purchase') AS selected, false AS main, CASE event_type WHEN 'click' THEN 'queued' WHEN 'error' THEN 'error' ELSE 'not_queued' END AS status FROM events),
h AS (SELECT user_id, min(event_id) AS head FROM f WHERE selected AND user_id % 2 = 0 GROUP BY 1),
b AS (SELECT f.* REPLACE (coalesce(event_id = head, false) AS main) FROM f LEFT JOIN h USING (user_id))
"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of videos, of which half have a main frame."""
    kind = F.col("event_type")
    frames = table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "ts",
        "value",
        kind.isin("click", "purchase").alias("selected"),
        F.when(kind == "click", "queued").when(kind == "error", "error").otherwise("not_queued").alias("status"),
    )
    heads = frames.filter("selected AND user_id % 2 = 0").groupBy("user_id").agg(F.min("event_id").alias("head"))
    return frames.join(heads, "user_id", "left").withColumn("main", F.coalesce(F.col("event_id") == F.col("head"), F.lit(False))).drop("head")


@query(_FRAMES + """, c AS (SELECT b.*, CASE WHEN event_id % 10 = 0 THEN true WHEN event_id % 10 = 1 THEN false END AS wanted FROM b),
m AS (SELECT event_id, user_id, coalesce(wanted, selected) AS selected, CASE WHEN wanted = false THEN false ELSE main END AS main, CASE WHEN wanted = false AND status = 'queued' THEN 'not_queued' ELSE status END AS status, coalesce(wanted, false) AS fresh FROM c),
x AS (SELECT user_id, bool_or(main) AS has, min(CASE WHEN fresh THEN event_id END) AS first FROM m GROUP BY 1)
SELECT event_id, selected, main OR (NOT has AND coalesce(event_id = first, false)) AS main, status FROM m JOIN x USING (user_id)
""")
def k21_frame_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected and deselected frames; a video keeps at most one main frame and gains one with its first selection."""
    frames = _frames(spark, sf_dir)
    changes = frames.filter("event_id % 10 IN (0, 1)").select("event_id", (F.col("event_id") % 10 == 0).alias("wanted"))
    return states.apply_selection(frames, changes, "event_id", "user_id").select("event_id", "selected", "main", "status")


@query(_FRAMES + """, q AS (SELECT * REPLACE (CASE WHEN NOT selected AND status = 'queued' THEN 'not_queued' WHEN selected AND status IN ('not_queued', 'error') THEN 'queued' ELSE status END AS status) FROM b),
c AS (SELECT event_id FROM q WHERE status = 'queued' ORDER BY ts, event_id LIMIT 500),
r AS (SELECT * REPLACE (CASE WHEN event_id NOT IN (SELECT event_id FROM c) THEN status WHEN event_id % 4 = 0 THEN 'error' WHEN event_id % 4 = 1 THEN 'rendered' ELSE 'rendering' END AS status) FROM q)
SELECT event_id, CASE WHEN status = 'error' AND selected AND user_id % 3 = 0 THEN 'queued' ELSE status END AS status FROM r
""")
def k22_work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round of the work queue: queue, claim a batch, take results, requeue failures of accepted videos."""
    frames = _frames(spark, sf_dir).withColumn("error", F.lit(""))
    claimed = states.claim(states.queue_selected(frames), [F.col("ts"), F.col("event_id")], 500, "event_id")
    results = claimed.filter("event_id % 4 < 2").select("event_id", F.when(F.col("event_id") % 4 == 0, "no frame").alias("error"))
    accepted = table(spark, sf_dir, "events").filter("user_id % 3 = 0").select("user_id")
    return states.requeue_errors(states.finish(claimed, results, "event_id"), accepted, "user_id").select("event_id", "status")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'not_ready' WHEN p_partkey % 2 = 0 THEN 'ready' ELSE 'stale' END AS status, CASE WHEN p_partkey % 4 = 0 THEN 'missing' ELSE '' END AS reason FROM part WHERE p_partkey % 3 <> 1 OR p_partkey % 2 = 0
""")
def k33_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of derivatives after a run: ready ones replaced, failed ones marked with their reason."""
    parts = table(spark, sf_dir, "part").select("p_partkey")
    stored = parts.filter("p_partkey % 3 <> 1").select("p_partkey", F.lit("stale").alias("status"), F.lit("").alias("reason"))
    bad = F.col("p_partkey") % 4 == 0
    run = parts.filter("p_partkey % 2 = 0").select("p_partkey", F.when(bad, "not_ready").otherwise("ready").alias("status"), F.when(bad, "missing").otherwise("").alias("reason"))
    return upsert.keyed_upsert(stored, run, ["p_partkey"])


@query("""
WITH a AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'))
SELECT CAST(l_orderkey AS VARCHAR) || '/' || n AS id, l_orderkey AS parent, l_partkey AS media, CASE WHEN n = 1 THEN 'associated' ELSE 'subentry' END AS kind FROM a
""")
def k34_associated_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Further media of an entry: the first is associated with it, others become entries below it."""
    rows = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select("l_orderkey", "l_partkey").distinct()
    listed = states.numbered(rows, ["l_orderkey"], [F.col("l_partkey")], "n")
    return listed.select(
        F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("n").cast("string")).alias("id"),
        F.col("l_orderkey").alias("parent"),
        F.col("l_partkey").alias("media"),
        F.when(F.col("n") == 1, "associated").otherwise("subentry").alias("kind"),
    )


@query("""
SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS started_at, max(ts) AS heartbeat_at, count(*) FILTER (event_type = 'view') AS scanned, count(*) FILTER (event_type = 'purchase') AS matched, count(*) FILTER (event_type = 'error') AS errors,
  CASE WHEN bool_or(event_type = 'error' AND value > 90) THEN 'failed' ELSE 'finished' END AS status FROM events GROUP BY 1, 2
""")
def k35_run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with their start, last sign of life, counters and status."""
    kind = F.col("event_type")
    counters = {"scanned": kind == "view", "matched": kind == "purchase", "errors": kind == "error"}
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return states.run_ledger(rows, ["user_id", "day"], "ts", counters, (kind == "error") & (F.col("value") > 90))


@query("""
WITH i AS (SELECT o_orderkey AS item, o_custkey AS grp, CASE WHEN o_orderkey % 3 = 0 THEN 'rejected' ELSE 'accepted' END AS review, CASE WHEN o_orderstatus <> 'P' THEN 'problem' ELSE 'none' END AS state FROM orders),
c AS (SELECT o_custkey AS grp, min(o_orderkey) AS keeper FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1),
k AS (SELECT c.grp, any_value(keeper) AS keeper FROM i JOIN c USING (grp) WHERE state = 'problem' GROUP BY 1 HAVING count(*) > 1 AND bool_or(item = keeper))
SELECT item, grp, CASE WHEN state = 'problem' AND item = keeper AND review = 'rejected' THEN 'pending' WHEN state = 'problem' AND item <> keeper THEN 'rejected' ELSE review END AS review,
  CASE WHEN state = 'problem' AND item = keeper THEN 'keeper' WHEN state = 'problem' AND item <> keeper THEN 'auto_rejected' ELSE state END AS state, CASE WHEN state = 'problem' AND item <> keeper THEN keeper END AS duplicate_of
FROM i LEFT JOIN k USING (grp)
""")
def g03_resolved_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate groups that a person settled by naming their keeper."""
    orders = table(spark, sf_dir, "orders")
    items = orders.select(
        F.col("o_orderkey").alias("item"),
        F.col("o_custkey").alias("grp"),
        F.when(F.col("o_orderkey") % 3 == 0, "rejected").otherwise("accepted").alias("review"),
        F.when(F.col("o_orderstatus") != "P", "problem").otherwise("none").alias("state"),
    )
    choices = orders.filter("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("grp")).agg(F.min("o_orderkey").alias("keeper"))
    return states.resolve_groups(items, choices, "item", "grp")


@query("""
WITH c AS (SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'), p AS (SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25)
SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l_orderkey = c.l_orderkey AND (p.l_partkey = c.l_partkey OR p.l_suppkey = c.l_suppkey))
""")
def r03_pending_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed originals less those that a decision which is not applied yet rejects, by content or by path."""
    lines, keys = table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"]
    pending = lines.filter("l_returnflag = 'R' AND l_quantity > 25").select("l_orderkey", *keys)
    return filters.without_rejected(lines.filter("l_returnflag = 'A'").select("l_orderkey", *keys), pending, "l_orderkey", keys).distinct()


@query("""
SELECT l_orderkey, count(*) FILTER (l_linestatus = 'O') AS visible, count(*) FILTER (l_linestatus <> 'O' AND l_quantity <= 25) AS hidden, count(*) FILTER (l_linestatus <> 'O' AND l_quantity > 25) AS decided FROM lineitem GROUP BY 1
""")
def r06_visible_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible, hidden and decided candidates of each entry in one pass."""
    shown, large = F.col("l_linestatus") == "O", F.col("l_quantity") > 25
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(shown).alias("visible"), F.count_if(~shown & ~large).alias("hidden"), F.count_if(~shown & large).alias("decided")
    )


@query("""
WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 4 AS rounds FROM orders), w AS (SELECT *, CASE rounds WHEN 0 THEN 3 WHEN 1 THEN 7 WHEN 2 THEN 14 ELSE 30 END AS days FROM t),
c AS (SELECT l_orderkey AS o_orderkey, min(abs(date_diff('day', d, CAST(l_shipdate AS DATE)))) AS nearest FROM lineitem JOIN w ON o_orderkey = l_orderkey WHERE abs(date_diff('day', d, CAST(l_shipdate AS DATE))) <= days GROUP BY 1)
SELECT o_orderkey, nearest, CASE WHEN nearest IS NOT NULL THEN 'indexed_range_' || days WHEN rounds = 3 THEN 'manual_search_required' ELSE 'widen' END AS state FROM w LEFT JOIN c USING (o_orderkey)
""")
def r07_range_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from the index within the range that a target has reached, and what follows where there are none."""
    from archivolt.operators.temporal import widening_window

    rounds = F.col("o_orderkey") % 4
    targets = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), rounds.alias("rounds"), widening_window(rounds).alias("days"))
    index = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("s"))
    gap = F.abs(F.datediff("s", "d"))
    near = targets.join(index, "o_orderkey").filter(gap <= F.col("days")).groupBy("o_orderkey").agg(F.min(gap).alias("nearest"))
    state = F.when(F.col("nearest").isNotNull(), F.concat(F.lit("indexed_range_"), F.col("days").cast("string"))).when(F.col("rounds") == 3, "manual_search_required").otherwise("widen")
    return targets.join(near, "o_orderkey", "left").select("o_orderkey", "nearest", state.alias("state"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN '{"days":"7","message":"m","range":"30"}' WHEN c_custkey % 2 = 0 THEN '{"days":"3","message":"m"}' ELSE '{"days":"7","range":"30"}' END AS record
FROM customer WHERE (c_custkey % 2 = 0 OR c_custkey % 3 = 0) AND c_custkey % 5 <> 0
""")
def r08_state_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small JSON state by entry: fields put over those stored, and entries cleared."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit("3").alias("days"), F.lit("m").alias("message"), F.lit("30").alias("range"))
    stored = states.state_document(rows.filter("c_custkey % 2 = 0"), "c_custkey", ["days", "message"])
    new = states.state_document(rows.filter("c_custkey % 3 = 0").withColumn("days", F.lit("7")), "c_custkey", ["days", "range"])
    cleared = rows.filter("c_custkey % 5 = 0").select("c_custkey", F.lit(None).cast("string").alias("record"))
    changes = new.join(cleared, "c_custkey", "left_anti").unionByName(cleared)
    return states.merged_documents(stored, changes, "c_custkey")


@query("""
SELECT o_orderkey, coalesce(CAST(l_partkey AS VARCHAR), '') AS candidate, CASE WHEN l_partkey IS NOT NULL THEN 'candidate' WHEN o_orderstatus = 'P' THEN 'manual_search_required' ELSE 'no_candidate' END AS row_kind, '' AS review_decision, coalesce(l_quantity, 0) AS score
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45
""")
def r09_queue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the queue's schema with its defaults: candidates, or one placeholder for an entry without any."""
    found = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity")
    kind = F.when(F.col("l_partkey").isNotNull(), "candidate").when(F.col("o_orderstatus") == "P", "manual_search_required").otherwise("no_candidate")
    return table(spark, sf_dir, "orders").join(found, "o_orderkey", "left").select(
        "o_orderkey",
        F.coalesce(F.col("l_partkey").cast("string"), F.lit("")).alias("candidate"),
        kind.alias("row_kind"),
        F.lit("").alias("review_decision"),
        F.coalesce("l_quantity", F.lit(0.0)).alias("score"),
    )


@query("""
SELECT count(*) FILTER (c_custkey % 7 <> 0) AS scanned, count(*) FILTER (c_custkey % 7 <> 0 AND (c_custkey % 5 = 0 OR c_custkey % 11 = 0)) AS taken,
 count(*) FILTER (c_custkey % 7 <> 0 AND c_custkey % 6 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 11 <> 0) AS moved FROM customer
""")
def r10_index_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a run of the index: scanned, taken anew and moved files."""
    key = F.col("c_custkey")
    sha = F.sha1(key.cast("string").cast("binary"))
    files = table(spark, sf_dir, "customer")
    stored = files.filter("c_custkey % 11 <> 0").select(F.concat(F.lit("a/"), key.cast("string")).alias("path"), sha.alias("sha"), key.alias("size"), F.lit(1).alias("mtime"))
    new_path_ = F.concat(F.when(key % 6 == 0, "b/").otherwise("a/"), key.cast("string"))
    scanned = files.filter("c_custkey % 7 <> 0").select(
        new_path_.alias("path"), F.when(key % 5 == 0, F.lit("changed")).otherwise(sha).alias("sha"), key.alias("size"), F.when(key % 5 == 0, 2).otherwise(1).alias("mtime")
    )
    return states.index_run(stored, scanned, "path", ["sha", "size"], ["size", "mtime"])[1].select("scanned", "taken", "moved")


@query("""
SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR) || ':' || coalesce(CAST(p_size AS VARCHAR), '-'), ';' ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS results FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size % 2 = 0 GROUP BY 1
""")
def r13_results_by_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with the descriptors that are known, in order, as one list for each entry."""
    known = table(spark, sf_dir, "part").filter("p_size % 2 = 0").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    item = F.struct((-F.col("l_extendedprice")).alias("s"), "l_partkey", "l_suppkey", "l_linenumber", "p_size")
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat_ws(":", x["l_partkey"].cast("string"), F.coalesce(x["p_size"].cast("string"), F.lit("-"))))
    return table(spark, sf_dir, "lineitem").join(known, "l_partkey", "left").groupBy("l_orderkey").agg(F.array_join(listed, ";").alias("results"))


@query("""
WITH p AS (SELECT event_type AS slot, arg_max(event_id, (ts, event_id)) AS run FROM events GROUP BY 1)
SELECT slot, run, CAST(json_extract(props, '$.k') AS INTEGER) AS scope, user_id FROM p JOIN events ON event_id = run
""")
def r14_current_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pointer of each slot to its current run, with the scope read back from the run's JSON."""
    newest = F.max_by(F.struct("event_id", "props", "user_id"), F.struct("ts", "event_id"))
    runs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("slot")).agg(newest.alias("r"))
    return runs.select("slot", F.col("r.event_id").alias("run"), F.from_json("r.props", "k int")["k"].alias("scope"), "r.user_id")


@query("SELECT DISTINCT split_part(url, '/', 3) AS root FROM pages WHERE split_part(url, '/', 3) NOT IN (SELECT split_part(url, '/', 3) FROM pages WHERE page_id % 10 = 0)")
def r15_missing_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of candidates that are not there; a run starts only if there are none."""
    roots = table(spark, sf_dir, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("root"))
    return roots.select("root").distinct().join(roots.filter("page_id % 10 = 0").select("root"), "root", "left_anti")


@query("""
SELECT o_orderkey, o_orderkey % 3 = 0 AS cached, CASE WHEN o_orderkey % 3 = 0 THEN -1.0 ELSE round(o_totalprice * 2, 2) END AS value FROM orders
""")
def r34_descriptor_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values from a cache by path, size, time and method; others are computed."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderdate").alias("mtime"), F.lit("m1").alias("method"))
    key = ["o_orderkey", "mtime", "method"]
    third = rows.filter("o_orderkey % 3 = 0").select(*key, F.lit(-1.0).alias("value"))
    stale = rows.filter("o_orderkey % 3 = 1").select("o_orderkey", "mtime", F.lit("m0").alias("method"), F.lit(-2.0).alias("value"))
    found = states.cached_or_computed(rows, third.unionByName(stale), key, F.round(F.col("o_totalprice") * 2, 2), "value")
    return found.select("o_orderkey", "cached", "value")


@query("""
SELECT l_orderkey, count(*) AS photos, min(l_shipdate) AS first FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1 HAVING count(*) > 1 AND bool_or(l_quantity > 30)
""")
def r35_multiple_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the queue with several photos of which one is large."""
    return (
        table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'").groupBy("l_orderkey")
        .agg(F.count(F.lit(1)).alias("photos"), F.min("l_shipdate").alias("first"), F.bool_or(F.col("l_quantity") > 30).alias("large"))
        .filter("photos > 1 AND large").drop("large")
    )


@query("""
SELECT o_custkey AS photo, o_orderpriority AS person FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1, 2 UNION ALL SELECT o_custkey, 'only ' || min(o_orderpriority) FROM orders WHERE o_custkey % 3 = 0 AND o_totalprice > 200000 GROUP BY 1
""")
def r36_people_reimport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of photos that were tagged anew replace all that these photos had."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("photo"), F.col("o_orderpriority").alias("person"), "o_totalprice")
    held, tagged = rows.select("photo", "person").distinct(), rows.filter("photo % 3 = 0")
    fresh = tagged.filter("o_totalprice > 200000").groupBy("photo").agg(F.concat(F.lit("only "), F.min("person")).alias("person"))
    return states.replace_children(held, fresh, tagged, ["photo"])


@query("""
WITH u AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'include' WHEN o_orderkey % 4 = 1 THEN 'exclude' WHEN o_orderkey % 4 = 2 THEN 'maybe' END AS decision, o_orderkey % 7 AS rating FROM orders),
m AS (SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS media FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN decision IN ('include', 'exclude') AND rating <= 5 THEN decision ELSE 'undecided' END AS decision, CASE WHEN decision IN ('include', 'exclude') AND rating <= 5 THEN rating ELSE 0 END AS rating, coalesce(media, '') AS media FROM u LEFT JOIN m ON l_orderkey = o_orderkey
""")
def r37_reviewed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that are valid take effect, others change nothing; each entry with its media in order."""
    key = F.col("o_orderkey")
    wanted = F.element_at(F.array(F.lit("include"), F.lit("exclude"), F.lit("maybe"), F.lit(None).cast("string")), (key % 4 + 1).cast("int"))
    fine = F.coalesce(wanted.isin("include", "exclude") & (key % 7).between(0, 5), F.lit(False))
    entries = table(spark, sf_dir, "orders").select("o_orderkey", F.when(fine, wanted).otherwise("undecided").alias("decision"), F.when(fine, key % 7).otherwise(0).alias("rating"))
    item = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    media = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(item, lambda x: x["l_partkey"].cast("string")), ",").alias("media"))
    return entries.join(media, "o_orderkey", "left").select("o_orderkey", "decision", "rating", F.coalesce("media", F.lit("")).alias("media"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'out_of_range' WHEN o_orderkey % 3 = 0 THEN 'rotated' ELSE 'kept' END AS outcome, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0 THEN 90 ELSE 0 END AS rotation FROM orders
""")
def r38_guarded_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of dates and rotations that are refused outside their ranges."""
    key = F.col("o_orderkey")
    day = F.when(key % 5 == 0, "1850-01-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rotation = F.when(key % 3 == 0, 450).otherwise(0) % 360
    fine = records.memory_datetime(F.lit(""), day).isNotNull()
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(~fine, "out_of_range").when(rotation > 0, "rotated").otherwise("kept").alias("outcome"), F.when(fine, rotation).otherwise(0).alias("rotation")
    )


@query(_FRAMES + "SELECT event_id, CASE WHEN value >= 95 THEN 'too close to the end' ELSE 'no frame' END AS message, count(*) OVER (PARTITION BY user_id) AS of_video FROM b WHERE status = 'error'")
def r39_error_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed frames with a message by their place, and how many their video has."""
    failed = _frames(spark, sf_dir).filter("status = 'error'")
    return failed.select(
        "event_id", F.when(F.col("value") >= 95, "too close to the end").otherwise("no frame").alias("message"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("of_video")
    )
