"""Visual search queries: views of the vectors of ``embeddings`` as small pictures, their bands, votes and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.operators import bands, crops
from archivolt.plans._base import collector
from archivolt.session import table
from archivolt.storage import materialize, new_path

QUERIES, ORACLES, query = collector()


def _descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an 8 x 8 picture with three views: the whole, and its upper left and lower right quarter."""
    v = F.col("vec_id")
    gray = F.transform("embedding", lambda x: F.floor(F.least(F.greatest((x.cast("double") + 4) * 32, F.lit(0.0)), F.lit(255.0))))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(gray, lambda x: x.cast("double")).alias("gray"))
    square = lambda top, left: F.concat(*[F.slice("gray", (top + y) * 8 + left + 1, 4) for y in range(4)])
    mean = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)

    def view(name: str, values, third: int):
        colours = F.array(*[mean(F.slice(values, k * third + 1, third)) for k in range(3)])
        return F.struct(F.lit(name).alias("name"), values.alias("gray"), colours.alias("mean_rgb"))

    return rows.select(
        v.cast("string").alias("path"),
        (1000 + v).alias("byte_size"),
        (v * 10).alias("mtime_ns"),
        F.md5(v.cast("string").cast("binary")).alias("sha256"),
        (80 + v % 3 * 20).cast("int").alias("width"),
        F.lit(100).alias("height"),
        F.array(view("full", F.col("gray"), 21), view("square_0", square(0, 0), 5), view("square_1", square(4, 4), 5)).alias("views"),
        (v % 7 - 1).cast("double").alias("quality"),
    )


def _featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _descriptors(spark, sf_dir)
    return materialize(rows.withColumn("features", bands.features(F.col("views"))).drop("views"), "features")


_VIEWS = """
WITH g AS (SELECT vec_id, vec_id::VARCHAR AS path, list_transform(embedding, lambda x: floor(least(greatest((CAST(x AS DOUBLE) + 4) * 32, 0), 255))) AS gray, 80 + vec_id % 3 * 20 AS width, vec_id % 7 - 1 AS quality FROM embeddings),
s AS (SELECT vec_id, path, width, quality, 'full' AS view, 0 AS place, list_transform(list_transform(range(16), lambda k: k // 4 * 16 + k % 4 * 2 + 1), lambda a: (gray[a] + gray[a + 1] + gray[a + 8] + gray[a + 9]) / 4) AS grid, gray AS raw, 21 AS third FROM g
  UNION ALL SELECT vec_id, path, width, quality, 'square_' || q, q + 1, list_transform(range(16), lambda k: gray[(q * 4 + k // 4) * 8 + q * 4 + k % 4 + 1]), list_transform(range(16), lambda k: gray[(q * 4 + k // 4) * 8 + q * 4 + k % 4 + 1]), 5 FROM g, range(2) r(q)),
f AS (SELECT vec_id, path, width, quality, view, place, grid, list_transform(range(3), lambda k: list_sum(raw[k * third + 1 : k * third + third]) / third) AS rgb FROM s),
n AS (SELECT *, list_transform(grid, lambda x: floor(x / 32)::INT) AS gb, list_transform(rgb, lambda x: floor(x / 32)::INT) AS cb, list_transform(rgb, lambda x: round_even(x, 3)) AS colours FROM f),
b AS (SELECT DISTINCT vec_id, path, quality, view, x.n AS band_name, x.v AS band_value FROM (SELECT vec_id, path, quality, view, unnest([
    {'n': 'color', 'v': array_to_string(cb, '-')}, {'n': 'gray_tl', 'v': array_to_string(list_concat(gb[1:2], gb[5:6]), '-')}, {'n': 'gray_tr', 'v': array_to_string(list_concat(gb[3:4], gb[7:8]), '-')},
    {'n': 'gray_bl', 'v': array_to_string(list_concat(gb[9:10], gb[13:14]), '-')}, {'n': 'gray_br', 'v': array_to_string(list_concat(gb[11:12], gb[15:16]), '-')},
    {'n': 'orientation', 'v': CASE WHEN width = 100 THEN 'square' WHEN width > 100 THEN 'landscape' ELSE 'portrait' END || ':' || round_even(width / 100.0::DOUBLE * 10, 0)::INT}]) AS x FROM n)),
"""
_FIRST_HITS = "h AS (SELECT band_name, band_value, path, view FROM (SELECT *, row_number() OVER (PARTITION BY band_name, band_value ORDER BY path, view) AS place FROM b WHERE quality >= 0) WHERE place <= 60),"
_ALL_HITS = "h AS (SELECT band_name, band_value, path, view FROM b WHERE quality >= 0),"
_VOTES = f"{_VIEWS}\n{_FIRST_HITS}" + """
c AS (SELECT band_name, band_value, count(*) AS hits FROM h GROUP BY 1, 2),
t AS (SELECT DISTINCT vec_id AS target, band_name, band_value FROM b WHERE vec_id % 100 = 0),
v AS (SELECT target, path, count(*) AS votes, sum(1.0::DOUBLE / hits) AS rarity, min(hits) AS best_band, list(DISTINCT view) AS hit_views FROM t JOIN h USING (band_name, band_value) JOIN c USING (band_name, band_value) GROUP BY 1, 2)
"""
_SCORED = _VOTES + """,
l AS (SELECT target, path, votes, hit_views FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY votes DESC, round_even(rarity, 9) DESC, best_band, path) AS place FROM v) WHERE place <= 40),
d AS (SELECT l.target, l.path, votes, y.view, round(list_sum(list_transform(list_zip(x.grid, y.grid), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 16 + 0.15::DOUBLE * list_sum(list_transform(list_zip(x.colours, y.colours), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 3, 9) AS distance
  FROM l JOIN n x ON x.vec_id = target AND x.place = 0 JOIN n y ON y.path = l.path AND list_contains(hit_views, y.view)),
e AS (SELECT target, path, votes, min(distance) AS distance, arg_min(view, (distance, view)) AS best_view FROM d GROUP BY 1, 2, 3),
r AS (SELECT *, distance - 25 * votes AS score, row_number() OVER (PARTITION BY target ORDER BY round_even(distance - 25 * votes, 6), round_even(distance, 6), path) AS rank FROM e)
"""


@query(_VIEWS.rstrip().rstrip(",") + " SELECT path, view, band_name, band_value FROM b")
def v04_coarse_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six bands of each view: colours, four quadrants of a 4 x 4 grid, orientation with aspect."""
    return bands.bands_of(_featured(spark, sf_dir), "path")


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets, the bands of candidates of good quality, and their features, from a built index."""
    folder = new_path(spark, "band-index")
    bands.build_band_index(_descriptors(spark, sf_dir), folder).collect()
    bands.ensure_ready(spark, folder)
    featured = bands.band_features(spark, folder).filter("issue = ''")
    targets = featured.filter("CAST(path AS LONG) % 100 = 0").select(F.col("path").alias("target"), "width", "height", "features")
    wanted = featured.filter("quality >= 0")
    return targets, bands.band_rows(spark, folder).join(wanted.select("path"), "path", "left_semi"), wanted


@query(_VOTES + "SELECT target::VARCHAR AS target, path, votes, round(rarity, 6) AS rarity, best_band, array_to_string(list_sort(hit_views), ',') AS hit_views FROM v")
def j08_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped band hits with votes, rarity, the best band and the views that were hit."""
    targets, index, _ = _index(spark, sf_dir)
    found = bands.view_votes(bands.bands_of(targets, "target"), index, 60)
    return found.withColumns({"rarity": F.round("rarity", 6), "hit_views": F.array_join(F.sort_array("hit_views"), ",")})


@query(_SCORED + "SELECT target::VARCHAR AS target, path, votes, CAST(rank AS INT) AS place FROM r WHERE rank <= 5")
def w07_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five likeliest candidates: most votes and rarest bands first, then by distance less a share for each vote."""
    found = bands.shortlist(*_index(spark, sf_dir), size=5, cap=60)
    return found.select("target", "path", "votes", F.col("rank").alias("place"))


@query(_SCORED.replace(_FIRST_HITS, _ALL_HITS) + "SELECT target::VARCHAR AS target, path, CAST(floor(score * 1000 + 0.5::DOUBLE) AS BIGINT) AS score, CAST(floor(distance * 1000 + 0.5::DOUBLE) AS BIGINT) AS distance, best_view, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def j10_shortlist_then_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages: candidates by all hits of their bands, then the distance of the target to the nearest of the views that were hit; in thousandths."""
    found = bands.shortlist(*_index(spark, sf_dir), size=5, cap=None)
    # The score of the rank is rounded; a second rounding on it would lift what lies just below a half.
    exact = {"score": F.col("distance") - bands.VOTE_WEIGHT * F.col("votes"), "distance": F.col("distance")}
    milli = lambda c: F.floor(exact[c] * 1000 + 0.5).alias(c)
    return found.select("target", "path", milli("score"), milli("distance"), "best_view", "rank")


@query(_VIEWS.rstrip().rstrip(",") + """,
p AS (SELECT x.vec_id, y.view, y.place, round(list_sum(list_transform(list_zip(x.grid, y.grid), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 16 + 0.15::DOUBLE * list_sum(list_transform(list_zip(x.colours, y.colours), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 3, 9) AS distance
  FROM n x JOIN n y ON y.vec_id = x.vec_id + 1 WHERE CASE x.vec_id % 3 WHEN 0 THEN true WHEN 1 THEN y.view = 'square_1' ELSE true END)
SELECT vec_id::VARCHAR AS path, (vec_id + 1)::VARCHAR AS other, round(min(distance), 4) AS distance, arg_min(view, (distance, view)) AS best_view FROM p GROUP BY vec_id
""")
def v03_view_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least distance over the views of neighbouring pictures; a third of them prefers one view, a third one that is not there."""
    rows = _featured(spark, sf_dir).select(F.col("path").cast("long").alias("vec_id"), "features")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("features").alias("others"))
    liked = F.when(F.col("vec_id") % 3 == 1, F.array(F.lit("square_1"))).when(F.col("vec_id") % 3 == 2, F.array(F.lit("none")))
    pairs = rows.join(other, "vec_id").withColumn("liked", liked)
    found = bands.nearest_views(pairs, "features", "others", "liked")
    return found.select(F.col("vec_id").cast("string").alias("path"), (F.col("vec_id") + 1).cast("string").alias("other"), F.round("distance", 4).alias("distance"), "best_view")


@query("""
WITH e AS (SELECT vec_id, vec_id % 11 = 0 AS bad FROM embeddings),
r AS (SELECT 1 AS run, count(*) AS total, 0 AS reused, count(*) FILTER (NOT bad) AS indexed, count(*) FILTER (bad) AS errors FROM e WHERE vec_id % 3 <> 0
  UNION ALL SELECT 2, count(*), count(*) FILTER (NOT bad AND vec_id % 3 <> 0 AND vec_id % 4 <> 1), count(*) FILTER (NOT bad AND (vec_id % 3 = 0 OR vec_id % 4 = 1)), count(*) FILTER (bad) FROM e
  UNION ALL SELECT 3, count(*), count(*) FILTER (NOT bad), 0, count(*) FILTER (bad) FROM e)
SELECT run, total, reused, indexed, errors, (SELECT count(*) FROM e WHERE NOT bad AND (run > 1 OR vec_id % 3 <> 0)) AS held FROM r
""")
def r12_band_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs of the index: a part of the pictures, then all with some of them changed, then nothing new."""
    folder, v = new_path(spark, "band-index"), F.col("path").cast("long")
    rows = _descriptors(spark, sf_dir).withColumn("width", F.when(v % 11 == 0, 0).otherwise(F.col("width")))
    changed = rows.withColumn("mtime_ns", F.col("mtime_ns") + (v % 4 == 1).cast("long"))
    out = None
    for run, given in enumerate((rows.filter(v % 3 != 0), changed, changed), 1):
        counters = materialize(bands.build_band_index(given, folder), "counters")
        held = bands.band_features(spark, folder).filter("issue = ''").agg(F.count(F.lit(1)).alias("held"))
        part = materialize(counters.crossJoin(F.broadcast(held)).select(F.lit(run).alias("run"), "*"), "counters")  # one row each
        out = part if out is None else out.unionByName(part)
    return out


_QUEUE = """
WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: floor(least(greatest((CAST(x AS DOUBLE) + 4) * 32, 0), 255))::INT) AS gray FROM embeddings),
n AS (SELECT g.vec_id, g.gray, coalesce(o.gray, g.gray) AS other, CASE WHEN g.vec_id % 3 = 0 THEN 8 ELSE 14 END AS w, CASE WHEN g.vec_id % 3 = 0 THEN 8 ELSE 10 END AS h FROM g LEFT JOIN g o ON o.vec_id = g.vec_id + 1),
c AS (SELECT *, CASE WHEN w = 8 THEN 0 ELSE vec_id % 7 END AS ox, CASE WHEN w = 8 THEN 0 ELSE vec_id % 3 END AS oy FROM n),
i AS (SELECT vec_id, gray, w, h, list_transform(range(w * h), lambda k: CASE WHEN k % w BETWEEN ox AND ox + 7 AND k // w BETWEEN oy AND oy + 7
    THEN least(255, gray[(k // w - oy) * 8 + k % w - ox + 1] + (k * 7 + vec_id) % (1 + vec_id % 4 * 5)) ELSE other[(k * 5) % 64 + 1] END) AS px FROM c),
z AS (SELECT 8 AS w, unnest([8, 7, 6, 5, 4]) AS s UNION ALL SELECT 14, unnest([10, 9, 8, 7, 6])),
p AS (SELECT vec_id, gray, w, h, px, s, x, y, list_sum(list_transform(range(64), lambda k: (gray[k + 1] - px[(y + round_even((k // 8) * (s - 1) / 7.0::DOUBLE, 0)::INT) * w + x + round_even((k % 8) * (s - 1) / 7.0::DOUBLE, 0)::INT + 1]) ** 2)) / 64 AS score
  FROM i JOIN z USING (w), range(14) a(x), range(10) b(y) WHERE x <= w - s AND y <= h - s),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score, s DESC, y, x) AS place FROM p)
"""


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures that stand somewhere in a larger one, or in one of their own size, with more or less noise."""
    v = F.col("vec_id")
    gray = F.transform("embedding", lambda x: F.floor(F.least(F.greatest((x.cast("double") + 4) * 32, F.lit(0.0)), F.lit(255.0))).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", gray.alias("gray"))
    rows = rows.join(rows.select((v - 1).alias("vec_id"), F.col("gray").alias("_next")), "vec_id", "left").withColumn("other", F.coalesce("_next", "gray"))
    own = v % 3 == 0
    w, h = F.when(own, 8).otherwise(14), F.when(own, 8).otherwise(10)
    sized = rows.withColumns({"w": w, "h": h, "ox": F.when(own, 0).otherwise(v % 7), "oy": F.when(own, 0).otherwise(v % 3)})

    def pixel(k):
        x, y = k % F.col("w"), F.floor(k / F.col("w"))
        inside = x.between(F.col("ox"), F.col("ox") + 7) & y.between(F.col("oy"), F.col("oy") + 7)
        place = F.when(inside, (y - F.col("oy")) * 8 + x - F.col("ox") + 1).otherwise(1).cast("int")
        shown = F.element_at("gray", place) + (k * 7 + v) % (1 + v % 4 * 5)
        return F.when(inside, F.least(F.lit(255), shown)).otherwise(F.element_at("other", ((k * 5) % 64 + 1).cast("int"))).cast("int")

    pixels = F.transform(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1), pixel)
    return sized.select(
        "vec_id",
        F.struct(F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("gray").alias("gray")).alias("reference"),
        F.struct(F.col("w").alias("width"), F.col("h").alias("height"), pixels.alias("gray")).alias("candidate"),
    )


@query(_QUEUE + "SELECT vec_id, round(score, 4) AS score, x, y, s AS width, s AS height, CASE WHEN score <= 20 THEN 'high' WHEN score <= 200 THEN 'medium' ELSE 'low' END AS confidence FROM r WHERE place = 1")
def v05_crop_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first look of the crop search: the best window of each picture for its reference, of all sizes and places."""
    found = crops.found_crops(_searched(spark, sf_dir), n=8, refine=False)
    shown = found.select("vec_id", F.round("score", 4).alias("score"), *[F.col(c).cast("long").alias(c) for c in ("x", "y")], "width", "height", crops.confidence(F.col("score")).alias("confidence"))
    return shown


@query(_QUEUE + "SELECT vec_id, CASE WHEN score <= 20 THEN 'high' WHEN score <= 200 THEN 'medium' ELSE 'low' END AS confidence, score <= 0.01 AND w = 8 AND vec_id % 5 <> 0 AS hidden FROM r WHERE place = 1")
def v06_scored_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the queue scored by the crop search; undecided ones that are the export itself are hidden."""
    found = crops.found_crops(_searched(spark, sf_dir), n=8, refine=False)
    hidden = crops.equal_export(F.col("score"), F.col("candidate.width") == F.col("reference.width"), F.col("vec_id") % 5 == 0)
    return found.select("vec_id", crops.confidence(F.col("score")).alias("confidence"), hidden.alias("hidden"))


_BENCHMARK = _SCORED.replace("vec_id % 100 = 0", "vec_id % 20 = 0 AND vec_id % 60 <> 20").replace("place <= 40", "place <= 240") + """,
k AS (SELECT target, path, rank FROM r WHERE rank <= 30),
p AS (SELECT k.target, k.path, min(round(list_sum(list_transform(list_zip(x.grid, y.grid), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 16 + 0.15::DOUBLE * list_sum(list_transform(list_zip(x.colours, y.colours), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 3, 9)) AS distance
  FROM k JOIN n x ON x.vec_id = target JOIN n y ON y.path = k.path GROUP BY 1, 2),
w AS (SELECT target, path, row_number() OVER (PARTITION BY target ORDER BY round_even(distance, 6), path) AS place FROM p),
o AS (SELECT vec_id AS target, (CASE WHEN vec_id % 40 = 0 THEN vec_id + 1 ELSE vec_id END)::VARCHAR AS path, vec_id % 60 = 20 AS lost FROM g WHERE vec_id % 20 = 0),
z AS (SELECT o.target::VARCHAR AS target, o.path, coalesce(k.rank, 0)::INT AS prefilter_rank, coalesce(w.place, 0)::INT AS rank, CASE WHEN lost THEN '' WHEN w.place IS NOT NULL THEN 'hit' ELSE 'miss' END AS status,
  CASE WHEN w.place IS NOT NULL THEN '' WHEN lost THEN 'source_fingerprint_error' WHEN k.rank IS NULL THEN 'prefilter_miss' ELSE 'dense_ranker_miss' END AS error
  FROM o LEFT JOIN k ON k.target = o.target AND k.path = o.path LEFT JOIN w ON w.target = o.target AND w.path = o.path AND w.place <= 8)
"""


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every twentieth picture, whose original is itself or its neighbour; a third of them cannot be read."""
    _, index, featured = _index(spark, sf_dir)
    v = F.col("path").cast("long")
    every = _descriptors(spark, sf_dir).filter(v % 20 == 0)
    confirmed = every.select(F.col("path").alias("target"), F.when(v % 40 == 0, v + 1).otherwise(v).cast("string").alias("path"))
    targets = materialize(every.filter(v % 60 != 20).select(F.col("path").alias("target"), "width", "height", bands.features(F.col("views")).alias("features")), "targets")
    short = materialize(bands.shortlist(targets, index, featured, size=30, cap=60), "shortlist")
    return materialize(bands.benchmark_records(confirmed, targets, short, bands.dense_ranks(short, targets, featured, 8)), "records")


@query(_BENCHMARK + "SELECT * FROM z")
def r16_search_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each confirmed original its rank in the shortlist and in the dense ranking, and where it was lost."""
    return _benchmark(spark, sf_dir)


@query(_BENCHMARK + """
SELECT count(*) AS confirmed, count(*) FILTER (status = 'hit') AS hits, count(*) FILTER (error = 'source_fingerprint_error') AS source_fingerprint_error, count(*) FILTER (error = 'prefilter_miss') AS prefilter_miss, count(*) FILTER (error = 'dense_ranker_miss') AS dense_ranker_miss,
  round_even(count(*) FILTER (rank = 1) / count(*)::DOUBLE, 4) AS recall_at_1, round_even(count(*) FILTER (rank BETWEEN 1 AND 5) / count(*)::DOUBLE, 4) AS recall_at_5, round_even(count(*) FILTER (rank BETWEEN 1 AND 8) / count(*)::DOUBLE, 4) AS recall_at_n,
  round_even(count(*) FILTER (prefilter_rank BETWEEN 1 AND 5) / count(*)::DOUBLE, 4) AS prefilter_recall_at_5, round_even(count(*) FILTER (prefilter_rank BETWEEN 1 AND 30) / count(*)::DOUBLE, 4) AS prefilter_recall_at_30 FROM z
""")
def a22_search_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the ranking and of the shortlist before it, and misses by their reason."""
    return bands.benchmark_summary(_benchmark(spark, sf_dir), [5, 30], 8)
