"""Filter, set, graph and similarity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivolt.operators import filters, graph, matching, reconcile, similarity
from archivolt.plans._base import collector
from archivolt.session import table

QUERIES, ORACLES, query = collector()


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1996-02-29'")
def f02_month_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scope given as a month, expanded to its last day. The bounds are constants, so the filter reaches the scan."""
    from archivolt.functions.values import scope_bounds

    first, last = scope_bounds(F.lit("1996-02"))
    return table(spark, sf_dir, "orders").filter(F.to_date("o_orderdate").between(first, last)).select("o_orderkey")


@query("""
SELECT o_orderkey FROM orders o WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '3-MEDIUM') AND o_totalprice BETWEEN 1000 AND 150000
AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
""")
def f04_dynamic_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conjunction of the filters that are given, then an anti join."""
    chosen = filters.all_of(
        F.col("o_orderstatus") == "O", F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM"), F.col("o_totalprice").between(1000, 150000), None
    )
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").filter(chosen).join(returned, "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT page_id FROM pages WHERE url = 'http://thther.example.org' OR starts_with(url, 'http://thther.example.org/')")
def f06_under_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths equal to a root or below it."""
    return table(spark, sf_dir, "pages").filter(filters.under_path(F.col("url"), "http://thther.example.org/")).select("page_id")


@query("SELECT p_partkey FROM part WHERE starts_with(p_name, 'part_1')")
def f07_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal prefix."""
    return table(spark, sf_dir, "part").filter(F.col("p_name").startswith("part_1")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%t_1%' OR lower(p_brand) LIKE '%t_1%' OR lower(p_type) LIKE '%t_1%'")
def f08_search_with_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over three columns, with live wildcards."""
    return table(spark, sf_dir, "part").filter(filters.contains_term("T_1", "p_name", "p_brand", "p_type")).select("p_partkey")


@query("""
WITH d AS (SELECT l_partkey, list(CAST(l_shipdate AS DATE)) AS dates, list(DISTINCT strftime(l_shipdate, '%Y-%m')) AS months FROM lineitem GROUP BY 1)
SELECT l_partkey FROM d WHERE len(list_filter(dates, lambda x: abs(date_diff('day', x, DATE '1997-05-10')) <= 2)) > 0
""")
def f09_months_then_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cheap test by month before the exact window over an array of dates."""
    at = F.lit("1997-05-10").cast("date")
    lists = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.collect_set(F.to_date("l_shipdate")).alias("dates"), F.collect_set(F.date_format("l_shipdate", "yyyy-MM")).alias("months")
    )
    likely = F.arrays_overlap("months", F.array(F.date_format(F.date_sub(at, 2), "yyyy-MM"), F.date_format(F.date_add(at, 2), "yyyy-MM")))
    return lists.filter(likely & F.exists("dates", lambda d: F.abs(F.datediff(d, at)) <= 2)).select("l_partkey")


@query("""
WITH d AS (SELECT l_partkey, list(CAST(l_shipdate AS DATE)) FILTER (l_returnflag = 'N') AS cap, list(CAST(l_shipdate AS DATE)) FILTER (l_returnflag = 'R') AS fs FROM lineitem GROUP BY 1)
SELECT l_partkey FROM d WHERE CASE WHEN len(coalesce(cap, [])) > 0 THEN len(list_filter(cap, lambda x: abs(date_diff('day', x, DATE '1998-03-01')) <= 20)) > 0
  ELSE l_partkey % 4 <> 0 AND len(list_filter(coalesce(fs, []), lambda x: abs(date_diff('day', x, DATE '1998-03-01')) <= 20)) > 0 END
""")
def f10_capture_dates_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture dates win over filesystem dates, which count only without a date in the name."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.collect_list(F.when(F.col("l_returnflag") == "N", F.to_date("l_shipdate"))).alias("cap"),
        F.collect_list(F.when(F.col("l_returnflag") == "R", F.to_date("l_shipdate"))).alias("fs"),
    )
    at = F.lit("1998-03-01").cast("date")
    return lists.filter(filters.in_date_window(F.col("cap"), F.col("fs"), F.col("l_partkey") % 4 == 0, at, 20)).select("l_partkey")


@query("""
WITH t AS (SELECT l_orderkey, min((l_linenumber, l_partkey, l_suppkey)) AS t FROM lineitem GROUP BY 1)
SELECT l.l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l JOIN t USING (l_orderkey)
WHERE l_returnflag = 'A' OR (l_partkey <> t[2] AND l_suppkey <> t[3])
""")
def f11_not_the_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of an entry that are not its target by either key, except allowed ones."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    target = lines.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("t"))
    keys = ("l_partkey", "l_suppkey")
    fine = filters.not_the_target({k: F.col(k) for k in keys}, {k: F.col("t")[k] for k in keys}, F.col("l_returnflag") == "A")
    return lines.join(target, "l_orderkey").filter(fine).drop("t", "l_returnflag")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS
  (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_orderkey = l.l_orderkey AND (r.l_partkey = l.l_partkey OR r.l_suppkey = l.l_suppkey))
""")
def f12_without_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates not rejected before for their entry, by either key."""
    lines = table(spark, sf_dir, "lineitem")
    rejected = lines.filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_suppkey")
    left = filters.without_rejected(lines, rejected, "l_orderkey", ["l_partkey", "l_suppkey"])
    return left.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""
WITH m AS (SELECT l_partkey, min(CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 END) AS p FROM lineitem WHERE l_returnflag IN ('N', 'A') GROUP BY 1)
SELECT m.l_partkey, min(CAST(l_shipdate AS DATE)) AS day, CASE p WHEN 1 THEN 'N' ELSE 'A' END AS l_returnflag FROM m JOIN lineitem l ON l.l_partkey = m.l_partkey
 AND l.l_returnflag = CASE p WHEN 1 THEN 'N' ELSE 'A' END GROUP BY m.l_partkey, p
""")
def f22_best_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One date per file: the first source by priority, then the earliest."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", F.to_date("l_shipdate").alias("day"))
    return filters.best_date(rows, "l_partkey", "l_returnflag", "day", ["N", "A"])


@query("""
SELECT p_partkey FROM part WHERE NOT (p_partkey % 3 = 0 AND p_size = p_size - (CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END))
""")
def f23_stale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are new or whose stored version differs."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    stored = part.filter("p_partkey % 3 = 0").withColumn("p_size", F.col("p_size") - F.when(F.col("p_partkey") % 6 == 0, 1).otherwise(0))
    return filters.stale_rows(part, stored, "p_partkey", ["p_size", "p_brand"]).select("p_partkey")


@query("""
SELECT o_orderkey, 'primary' AS role FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT l_orderkey, 'associated' FROM lineitem WHERE l_quantity > 49
""")
def u01_union_of_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary and associated rows in one list."""
    primary = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", F.lit("primary").alias("role"))
    more = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("associated").alias("role"))
    return primary.unionByName(more)


@query("""
SELECT doc_id, 'left_only' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'right_only' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
""")
def u04_two_way_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of one side only, both ways."""
    return reconcile.set_differences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def u05_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys on both sides."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.filter("l_returnflag = 'A'").select("l_partkey").intersect(lines.filter("l_returnflag = 'R'").select("l_partkey"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def u06_first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rows where the first by an ordinal wins."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("""
SELECT sha, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, count(*) AS copies FROM (SELECT md5(text) AS sha, doc_id, n_chars FROM documents) GROUP BY 1
""")
def u09_best_of_equal_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per hash: the larger, then the earlier."""
    docs = table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("sha"), "doc_id", "n_chars")
    return docs.groupBy("sha").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"), F.count(F.lit(1)).alias("copies"))


_G01 = """
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey * 12 + month(o_orderdate) AS a, o_custkey * 7 + dayofweek(o_orderdate) + 1 AS b FROM orders),
n AS (SELECT a * 2 AS x, b * 2 + 1 AS y FROM e UNION SELECT b * 2 + 1, a * 2 FROM e),
r(x, y) AS (SELECT x, x FROM n UNION SELECT n.x, r.y FROM n JOIN r ON n.y = r.x),
c AS (SELECT x, min(y) AS component FROM r GROUP BY 1)
SELECT component, count(DISTINCT a) AS n_left, count(DISTINCT b) AS n_right, count(DISTINCT a) <> 1 OR count(DISTINCT b) <> 1 AS ambiguous
FROM e JOIN c ON c.x = e.a * 2 GROUP BY 1
"""


@query(_G01)
def g01_ambiguous_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of candidate pairs (a customer's months and weekdays); those that are not one to one are ambiguous."""
    cust = F.col("o_custkey")
    pairs = table(spark, sf_dir, "orders").select((cust * 12 + F.month("o_orderdate")).alias("a"), (cust * 7 + F.dayofweek("o_orderdate")).alias("b"))
    edges = pairs.select(matching.left_node("a").alias("src"), matching.right_node("b").alias("dst"))
    return matching.cluster_sides(graph.connected_components(edges))


@query("""
WITH RECURSIVE m AS (SELECT o_orderkey AS id, o_custkey || o_orderstatus AS bucket, o_totalprice AS q FROM orders),
e AS (SELECT a.id AS x, b.id AS y FROM m a JOIN m b ON a.bucket = b.bucket AND a.id <> b.id AND abs(a.q - b.q) <= 20000),
r(x, y) AS (SELECT x, x FROM e UNION SELECT e.x, r.y FROM e JOIN r ON e.y = r.x),
c AS (SELECT x AS id, min(y) AS component FROM r GROUP BY 1),
k AS (SELECT component, id, id % 7 = 0 AS keeper, id % 3 <> 0 AS pending, id % 11 = 0 AS edited FROM c)
SELECT component, count(*) AS size, count(*) FILTER (keeper) > 1 OR bool_or(edited AND NOT keeper) AS problem,
       CASE WHEN NOT (count(*) FILTER (keeper) > 1 OR bool_or(edited AND NOT keeper)) THEN coalesce(min(CASE WHEN keeper THEN id END), min(CASE WHEN pending THEN id END)) END AS keeper_id
FROM k GROUP BY 1 HAVING bool_or(pending) AND count(*) > 1
""")
def g02_duplicate_keepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate groups within buckets, with an elected keeper or a problem state."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus", F.col("o_totalprice").alias("q"))
    # Of values in order, each within the tolerance of the one before, neighbours link the group.
    order = Window.partitionBy("o_custkey", "o_orderstatus").orderBy("q", "id")
    near = rows.withColumns({"dst": F.lag("id").over(order), "p": F.lag("q").over(order)})
    edges = near.filter(F.col("q") - F.col("p") <= 20000)
    members = graph.connected_components(edges.select(F.col("id").alias("src"), "dst")).select(
        "component",
        F.col("node").alias("id"),
        (F.col("node") % 7 == 0).alias("keeper"),
        (F.col("node") % 3 != 0).alias("pending"),
        (F.col("node") % 11 == 0).alias("edited"),
    )
    return graph.elect_keepers(members, "component", "id", [F.col("id")])


_THREADS = """
WITH RECURSIVE t AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent, conv_id, turn, role, text FROM conversations),
r(id, root, depth) AS (SELECT id, id, 0 FROM t WHERE parent IS NULL OR parent NOT IN (SELECT id FROM t)
  UNION ALL SELECT t.id, r.root, r.depth + 1 FROM t JOIN r ON t.parent = r.id)
"""


@query(_THREADS + "SELECT DISTINCT id, root, depth FROM r")
def g04_thread_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topmost present ancestor of each post, by pointer doubling."""
    return graph.thread_roots(_posts(spark, sf_dir), "id", "parent")


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    identity = F.col("conv_id") * 1000 + F.col("turn")
    turns = table(spark, sf_dir, "conversations").select(
        identity.alias("id"), F.when(F.col("turn") > 0, identity - 1).alias("parent"), "role", F.length("text").alias("size")
    )
    return turns.groupBy("id").agg(F.min("parent").alias("parent"), F.min("role").alias("role"), F.min("size").alias("size"))


@query(_THREADS + """, p AS (SELECT id, min(role) AS role, min(length(text)) AS size FROM t GROUP BY 1), q AS (SELECT DISTINCT id, root FROM r)
SELECT root, count(*) AS posts, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, sum(size)::BIGINT AS chars,
       CASE WHEN count(*) = 1 THEN 'standalone' WHEN count(DISTINCT role) > 1 THEN 'conversation' ELSE 'thread' END AS kind
FROM q JOIN p USING (id) GROUP BY 1
""")
def g05_thread_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each thread as one entry with ordered members and a kind."""
    posts = _posts(spark, sf_dir)
    roots = graph.thread_roots(posts, "id", "parent").select("id", "root")
    n = F.count(F.lit(1))
    return roots.join(posts, "id").groupBy("root").agg(
        n.alias("posts"),
        F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"),
        F.sum("size").cast("long").alias("chars"),
        F.when(n == 1, "standalone").when(F.count_distinct("role") > 1, "conversation").otherwise("thread").alias("kind"),
    )


def _descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    gray = F.transform("embedding", lambda x: F.floor(F.least(F.greatest((x.cast("double") + 4) * 32, F.lit(0.0)), F.lit(255.0))).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", gray.alias("gray"))


_GRAY = """
WITH g AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(least(greatest((CAST(x AS DOUBLE) + 4) * 32, 0), 255))::INT) AS gray FROM embeddings)
"""


@query(_GRAY + """, d AS (SELECT a.vec_id AS target, b.vec_id AS path, list_sum(list_transform(list_zip(a.gray, b.gray), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS DOUBLE))) / 64 AS score FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round_even(score, 6), path) AS rank FROM d)
SELECT target, path, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3
""")
def j09_scoped_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest three candidates in scope; the scope is an equi-join key."""
    from archivolt.operators.ranking import rank_with_gap

    gray = _descriptors(spark, sf_dir)
    left = gray.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("target"), "label", F.col("gray").alias("x"))
    right = gray.select(F.col("vec_id").alias("path"), "label", F.col("gray").alias("y"))
    pairs = left.join(right, "label").filter("target <> path")
    scored = pairs.withColumn("score", similarity.mean_squared_error(F.col("x"), F.col("y")))
    ranked = rank_with_gap(scored, ["target"], F.col("score"), [F.col("path")]).filter("rank <= 3")
    return ranked.select("target", "path", F.round("score", 4).alias("score"), "rank")


@query(_GRAY + """, m AS (SELECT vec_id, gray, list_sum(gray) / 64.0 AS mean FROM g)
SELECT a.vec_id AS target, b.vec_id AS path, list_sum(list_transform(list_zip(a.gray, b.gray), lambda z: ((z[1] >= a.mean) <> (z[2] >= b.mean))::INT))::INT AS bits
FROM m a JOIN m b ON b.vec_id = a.vec_id + 1
""")
def v07_average_hash_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hamming distance of average hashes of neighbouring frames."""
    hashes = _descriptors(spark, sf_dir).select("vec_id", similarity.average_hash(F.transform("gray", lambda x: x.cast("double"))).alias("h"))
    other = hashes.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("k"))
    pairs = hashes.join(other, "vec_id")
    return pairs.select(F.col("vec_id").alias("target"), (F.col("vec_id") + 1).alias("path"), similarity.hamming(F.col("h"), F.col("k")).alias("bits"))
