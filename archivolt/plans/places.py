"""Queries on entries and photos of places: the nearest evidence in time, and photos that show the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.operators import photos, temporal
from archivolt.plans._base import collector
from archivolt.session import table
from archivolt.storage import materialize

QUERIES, ORACLES, query = collector()


@query("""
WITH t AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -user_id ELSE user_id END AS venue, ts FROM events WHERE event_type = 'purchase'),
c AS (SELECT event_id AS view_id, user_id AS venue, ts AS v_ts FROM events WHERE event_type = 'view'),
s AS (SELECT t.event_id, view_id, abs(epoch_us(ts) - epoch_us(v_ts)) AS gap, true AS same FROM t JOIN c USING (venue)),
o AS (SELECT t.event_id, view_id, abs(epoch_us(ts) - epoch_us(v_ts)) AS gap, false AS same FROM t, c WHERE t.event_id NOT IN (SELECT event_id FROM s)),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, view_id) AS n FROM (SELECT * FROM s UNION ALL SELECT * FROM o))
SELECT event_id, CASE WHEN same THEN view_id END AS location_view, view_id AS zone_view, gap / 1000000.0::DOUBLE AS seconds, CASE WHEN same THEN 'nearest-checkin-same-venue' ELSE 'nearest-checkin-by-time' END AS zone_source FROM r WHERE n = 1
""")
def j12_nearest_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tips take place and zone from the nearest visit to their venue; those whose venue has none take the zone of the nearest visit of all."""
    events = table(spark, sf_dir, "events")
    venue = F.when(F.col("event_id") % 5 == 0, -F.col("user_id")).otherwise(F.col("user_id")).alias("venue")
    tips = events.filter("event_type = 'purchase'").select("event_id", venue, "ts")
    visits = events.filter("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("venue"), "ts")
    found = temporal.nearest_with_fallback(tips, visits, ["venue"], "ts", "ts", "view_id", "event_id")
    same = F.col("same_key")
    return found.select(
        "event_id",
        F.when(same, F.col("nearest_view_id")).alias("location_view"),
        F.col("nearest_view_id").alias("zone_view"),
        "seconds",
        F.when(same, "nearest-checkin-same-venue").otherwise("nearest-checkin-by-time").alias("zone_source"),
    )


def _photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pictures of each vector, more or less alike: two that entries hold and two loose ones, within minutes at one place."""
    v, c = F.col("vec_id"), F.col("c")
    gray = F.transform("embedding", lambda x: F.floor(F.least(F.greatest((x.cast("double") + 4) * 32, F.lit(0.0)), F.lit(255.0))).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", gray.alias("gray"), F.explode(F.array(*map(F.lit, range(4)))).alias("c"))

    def noisy(x, j):
        return F.least(F.lit(255), x + ((v * 31 + j * 17 + c * 5) % (1 + (v + c) % 5)) * (c > 0).cast("int")).cast("int")

    made = rows.select(
        "vec_id",
        "c",
        (v * 4 + c).alias("photo_id"),
        (v * 1000 + F.element_at(F.array(F.lit(0), F.lit(30), 70 + (v % 3) * 40, 60 + (v % 5) * 20), c + 1)).alias("at"),
        F.transform("gray", noisy).alias("gray"),
        (100 + (v * 7 + c * 3) % 4).cast("long").alias("pixels"),
        (1000 + (v * 5 + c) % 3).cast("long").alias("size"),
        c.isin(0, 3).alias("explicit"),
    )
    text = F.array_join(F.transform("gray", lambda x: x.cast("string")), ",")
    quality = photos.quality_order(F.col("pixels"), F.col("explicit"), F.col("size"), F.col("photo_id"))
    return made.withColumns({"photo": F.struct(F.md5(text.cast("binary")).alias("digest"), photos.perceptual_hash(F.col("gray")).alias("hash")), "quality": quality})


def _paired(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs, loose photos and photos of entries."""
    made = materialize(_photos(spark, sf_dir), "photos")
    loose = made.filter("NOT explicit").select(F.col("photo_id").alias("loose_id"), F.col("vec_id").alias("place"), "at", "photo", F.col("c").alias("place_in_order"), "quality")
    held = made.filter("explicit").select(F.col("photo_id").alias("entry_id"), "photo_id", "at", "photo", "quality", "vec_id")
    entries = held.select("entry_id", F.col("vec_id").alias("place"), (F.col("at") + F.col("vec_id") % 7 * 10).alias("at"))
    return materialize(photos.pairs_in_window(loose, entries, held), "pairs"), loose, held


_PHOTOS = """
WITH RECURSIVE p AS (SELECT vec_id AS v, c, vec_id * 4 + c AS id, vec_id * 1000 + [0, 30, 70 + (vec_id % 3) * 40, 60 + (vec_id % 5) * 20][c + 1] AS tm,
    list_transform(list_transform(embedding, lambda x: floor(least(greatest((CAST(x AS DOUBLE) + 4) * 32, 0), 255))::INT), lambda x, j: least(255, x + CASE WHEN c > 0 THEN (vec_id * 31 + (j - 1) * 17 + c * 5) % (1 + (vec_id + c) % 5) ELSE 0 END)) AS gray,
    100 + (vec_id * 7 + c * 3) % 4 AS pixels, 1000 + (vec_id * 5 + c) % 3 AS size FROM embeddings, range(4) r(c)),
w AS (SELECT k, i, cos(pi() * (2 * i + 1) * k / 16) * sqrt(2.0 / 8) / CASE WHEN k = 0 THEN sqrt(2.0) ELSE 1 END AS t FROM range(8) a(k), range(8) b(i)),
g AS (SELECT id, i, j, gray[i * 8 + j + 1] AS g FROM p, range(8) a(i), range(8) b(j)),
h1 AS (SELECT id, k, j, sum(g * t) AS s FROM g JOIN w USING (i) GROUP BY 1, 2, 3),
h2 AS (SELECT id, h1.k, w.k AS l, round(sum(s * t), 6) AS s FROM h1 JOIN w ON w.i = h1.j GROUP BY 1, 2, 3),
md AS (SELECT id, median(s) AS m FROM h2 WHERE k + l > 0 GROUP BY 1),
hb AS (SELECT id, list((k + l > 0 AND s > m)::INT ORDER BY k, l) AS bits FROM h2 JOIN md USING (id) GROUP BY 1),
q AS (SELECT p.*, bits, (-pixels, (c NOT IN (0, 3))::INT, -size, id) AS quality, tm + CASE WHEN c IN (0, 3) THEN v % 7 * 10 ELSE 0 END AS entry_at FROM p JOIN hb USING (id)),
n AS (SELECT l.id AS loose_id, e.id AS entry_id, e.id AS photo_id, l.v, l.c, abs(l.tm - e.tm) AS gap, CASE WHEN l.gray = e.gray THEN 0 ELSE list_sum(list_transform(list_zip(l.bits, e.bits), lambda z: (z[1] <> z[2])::INT))::INT END AS distance, l.quality < e.quality AS better
  FROM q l JOIN q e ON l.v = e.v AND l.c IN (1, 2) AND e.c IN (0, 3) WHERE abs(l.tm - e.tm) <= 120 AND abs(l.tm - e.entry_at) <= 120),
m AS (SELECT * FROM n WHERE distance <= 2),
a AS (SELECT v, arg_min(m, (distance, gap, entry_id)) AS f FROM m WHERE c = 1 GROUP BY 1),
b AS (SELECT m.v, min(loose_id) AS loose_id, arg_min(m, (distance, gap, m.entry_id)) FILTER (a.f IS NULL OR NOT (a.f.better AND a.f.photo_id = m.photo_id)) AS f FROM m LEFT JOIN a ON a.v = m.v WHERE c = 2 GROUP BY 1)
"""


@query(_PHOTOS + "SELECT loose_id, entry_id, photo_id, distance, gap FROM m")
def j13_photo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose photos and photos of entries at their place within two minutes that show the same, by perceptual hash."""
    return _paired(spark, sf_dir)[0]


@query(_PHOTOS + """
SELECT f.loose_id, f.entry_id, f.photo_id, f.distance, f.better AS replaces FROM a UNION ALL SELECT loose_id, f.entry_id, f.photo_id, f.distance, f.better FROM b
""")
def j13_merged_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each loose photo with its best pair; the better photo stays, and one that replaced another is no target for later ones."""
    return photos.merged_photos(*_paired(spark, sf_dir))


@query(_PHOTOS + """
SELECT id AS photo_id, (SELECT string_agg(x::VARCHAR, '' ORDER BY o) FROM (SELECT unnest(bits) AS x, unnest(range(64)) AS o)) AS bits FROM q
""")
def v09_perceptual_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 bits of the low cosine coefficients of each picture."""
    bits = F.lpad(F.conv(F.hex("photo.hash"), 16, 2), 64, "0")
    return _photos(spark, sf_dir).select("photo_id", bits.alias("bits"))
