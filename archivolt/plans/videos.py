"""Queries on videos whose sampled frames come from the vectors of ``embeddings``: three copies of each, more or less alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.operators import frames, states
from archivolt.plans._base import collector
from archivolt.session import table
from archivolt.storage import materialize

QUERIES, ORACLES, query = collector()


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    gray = F.transform("embedding", lambda x: F.floor(F.least(F.greatest((x.cast("double") + 4) * 32, F.lit(0.0)), F.lit(255.0))).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", gray.alias("gray"), F.explode(F.array(*map(F.lit, range(3)))).alias("c"))
    return rows.withColumn("n", F.col("vec_id") * 3 + F.col("c")).withColumn("video_id", F.format_string("v%08d", "n"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame, pixels, user_captured."""
    last = F.when(F.col("c") == 2, 16 - F.col("vec_id") % 10).otherwise(16).cast("int")
    first = F.when(F.col("vec_id") % 5 == 0, 0).otherwise(1)
    rows = _base(spark, sf_dir).withColumn("frame", F.explode(F.sequence(first, last)))

    def pixel(x, j):
        noise = (F.col("vec_id") * 31 + F.col("frame") * 7 + j * 13) % (1 + (F.col("vec_id") * F.col("c")) % 6)
        spot = F.when((F.col("vec_id") % 9 == 0) & (F.col("c") == 1) & (F.col("frame") == 4) & (j == 0), 40).otherwise(0)
        return F.least(F.lit(255), F.greatest(F.lit(0), x + 3 * F.col("frame") + noise + spot)).cast("int")

    return rows.select("video_id", "frame", F.transform("gray", pixel).alias("pixels"), (F.col("frame") == 0).alias("user_captured"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c, v = F.col("n"), F.col("c"), F.col("vec_id")
    return _base(spark, sf_dir).filter("n % 29 <> 0").select(
        "video_id",
        F.when(v % 31 == 0, "").otherwise(F.concat(F.lit("t"), F.expr("vec_id div 4").cast("string"))).alias("capture_ts"),
        ((1000 + 10 * (v % 5) + 5 * c * (v % 7)) / F.lit(100.0)).alias("duration"),
        F.when(n % 4 == 0, "accepted").when(n % 4 == 1, "rejected").otherwise("pending").alias("review_status"),
        F.format_string("2024-02-%02d", (v * 7 + c * 5) % 28 + 1).alias("created_at"),
        (n % 17 == 0).cast("int").alias("edits"),
        F.when(n % 13 == 0, F.concat(F.lit("g"), (v % 2).cast("string"))).otherwise("").alias("group_id"),
        F.when(n % 13 == 0, "keeper").otherwise("").alias("duplicate_state"),
        F.lit("").alias("duplicate_of"),
        F.lit("not_triaged").alias("triage_status"),
        F.lit(3).alias("outputs"),
        F.when(n % 5 == 0, 0).otherwise(1).alias("fingerprint_version"),
    )


_VIDEOS = """
WITH RECURSIVE g AS (SELECT vec_id, c, vec_id * 3 + c AS n, format('v{:08d}', vec_id * 3 + c) AS video_id,
    list_transform(embedding, lambda x: floor(least(greatest((CAST(x AS DOUBLE) + 4) * 32, 0), 255))::INT) AS gray FROM embeddings, range(3) r(c)),
f AS (SELECT g.*, frame FROM g, range(17) r(frame) WHERE frame >= CASE WHEN vec_id % 5 = 0 THEN 0 ELSE 1 END AND frame <= CASE WHEN c = 2 THEN 16 - vec_id % 10 ELSE 16 END),
p AS (SELECT video_id, vec_id, c, frame, list_transform(gray, lambda x, j: least(255, greatest(0, x + 3 * frame + (vec_id * 31 + frame * 7 + (j - 1) * 13) % (1 + (vec_id * c) % 6)
    + CASE WHEN vec_id % 9 = 0 AND c = 1 AND frame = 4 AND j = 1 THEN 40 ELSE 0 END))::INT) AS px FROM f),
q AS (SELECT *, list_sum(px) AS total FROM p),
v AS (SELECT video_id, n, vec_id, c, CASE WHEN vec_id % 31 = 0 THEN '' ELSE 't' || vec_id // 4 END AS capture_ts, (1000 + 10 * (vec_id % 5) + 5 * c * (vec_id % 7)) / 100.0::DOUBLE AS duration,
    CASE WHEN n % 4 = 0 THEN 'accepted' WHEN n % 4 = 1 THEN 'rejected' ELSE 'pending' END AS review_status, format('2024-02-{:02d}', (vec_id * 7 + c * 5) % 28 + 1) AS created_at,
    (n % 17 = 0)::INT AS edits, CASE WHEN n % 13 = 0 THEN 'g' || vec_id % 2 ELSE '' END AS group_id, CASE WHEN n % 13 = 0 THEN 'keeper' ELSE '' END AS duplicate_state, n % 5 <> 0 AS had
  FROM g WHERE n % 29 <> 0),
"""

#: Pairs and figures of the videos that ``used`` names, and what follows from them.
_FIGURES = """
s AS (SELECT video_id, count(*) AS frames FROM q JOIN used USING (video_id) WHERE {kept} GROUP BY 1),
k AS (SELECT a.video_id AS x, b.video_id AS y FROM pairs JOIN s a ON a.video_id = pairs.x JOIN s b ON b.video_id = pairs.y),
d AS (SELECT x, y, a.frame, list_sum(list_transform(list_zip(a.px, b.px), lambda z: abs(z[1] - z[2]))) AS delta, list_max(list_transform(list_zip(a.px, b.px), lambda z: abs(z[1] - z[2]))) AS most,
    list_sum(list_transform(list_zip(a.px, b.px), lambda z: ((z[1] * 64 >= a.total) <> (z[2] * 64 >= b.total))::INT)) AS bits
  FROM k JOIN q a ON a.video_id = x JOIN q b ON b.video_id = y AND b.frame = a.frame WHERE {both}),
c AS (SELECT x, y, count(*) AS common, sum(delta) / (count(*) * 64.0) AS mean_delta, max(most) AS max_delta, sum(bits) / count(*)::DOUBLE AS mean_bits, max(bits) AS max_bits FROM d GROUP BY 1, 2),
m AS (SELECT c.*, common >= greatest(8, ceil(0.75 * greatest(a.frames, b.frames))) AND mean_delta <= 2 AND max_delta <= 32 AND mean_bits <= 1 AND max_bits <= 8 AS matches FROM c JOIN s a ON a.video_id = x JOIN s b ON b.video_id = y)
"""

_SETTLED = """,
e AS (SELECT x, y FROM m WHERE matches UNION SELECT y, x FROM m WHERE matches),
r(a, b) AS (SELECT x, x FROM e UNION SELECT e.x, r.b FROM e JOIN r ON e.y = r.a),
o AS (SELECT a AS video_id, min(b) AS component FROM r GROUP BY 1),
u AS (SELECT component, count(*) AS size, bool_or(review_status = 'pending') AS open, count(*) FILTER (duplicate_state = 'keeper') > 1 OR bool_or(edits > 0 AND duplicate_state <> 'keeper') OR count(DISTINCT nullif(group_id, '')) > 1 AS problem,
    CASE WHEN count(DISTINCT nullif(group_id, '')) = 1 THEN max(nullif(group_id, '')) ELSE min(video_id) END AS grp,
    coalesce(min(CASE WHEN duplicate_state = 'keeper' THEN (created_at, video_id) END)[2], min(CASE WHEN review_status = 'pending' THEN (created_at, video_id) END)[2]) AS keeper
  FROM o JOIN v USING (video_id) GROUP BY 1 HAVING count(*) > 1 AND bool_or(review_status = 'pending')),
z AS (SELECT v.* REPLACE (CASE WHEN grp IS NULL THEN duplicate_state WHEN problem THEN 'problem' WHEN v.video_id = keeper THEN 'keeper' ELSE 'auto_rejected' END AS duplicate_state,
    coalesce(grp, group_id) AS group_id, CASE WHEN grp IS NOT NULL AND NOT problem AND v.video_id <> keeper THEN 'rejected' ELSE review_status END AS review_status),
    CASE WHEN grp IS NOT NULL AND NOT problem AND v.video_id <> keeper THEN keeper ELSE '' END AS duplicate_of FROM v LEFT JOIN o USING (video_id) LEFT JOIN u USING (component))
"""
_NEAR = "pairs AS (SELECT a.video_id AS x, b.video_id AS y FROM v a JOIN v b ON a.capture_ts = b.capture_ts AND a.video_id < b.video_id AND abs(a.duration - b.duration) <= 0.25::DOUBLE WHERE a.capture_ts <> ''),"
_ALL_FRAMES = _FIGURES.format(kept="true", both="true")
_PREPARED = _FIGURES.format(kept="frame > 0 OR had", both="(a.frame > 0 OR b.frame > 0)")


@query(
    _VIDEOS
    + "used AS (SELECT video_id FROM g), pairs AS (SELECT a.video_id AS x, b.video_id AS y FROM g a JOIN g b ON a.vec_id = b.vec_id AND a.c < b.c),"
    + _ALL_FRAMES
    + "SELECT x AS video_id, y AS other_id, CAST(common AS INT) AS common, CAST(floor(mean_delta * common * 64 + 0.5) AS BIGINT) AS delta, CAST(max_delta AS INT) AS max_delta, CAST(floor(mean_bits * common + 0.5) AS BIGINT) AS bits, CAST(max_bits AS INT) AS max_bits, matches FROM m"
)
def v07_aligned_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies of each video compared by the frames that their packed fingerprints share."""
    packed = materialize(frames.pack_frames(_frames(spark, sf_dir), "video_id"), "fingerprints")
    ids = _base(spark, sf_dir).select("vec_id", "c", "video_id")
    left = ids.join(packed, "video_id")
    right = left.select("vec_id", F.col("c").alias("d"), F.col("video_id").alias("other_id"), F.col("fingerprint").alias("other"))
    pairs = left.join(right, "vec_id").filter("c < d").withColumn("figures", frames.compared(F.col("fingerprint"), F.col("other")))
    return pairs.select(
        "video_id",
        "other_id",
        "figures.common",
        F.floor(F.expr("figures.mean_delta * figures.common * 64 + 0.5")).alias("delta"),
        "figures.max_delta",
        F.floor(F.expr("figures.mean_bits * figures.common + 0.5")).alias("bits"),
        "figures.max_bits",
        "figures.matches",
    )


def _settled(videos: DataFrame) -> DataFrame:
    videos = materialize(videos, "videos")
    usable = videos.filter(f"fingerprint_version = {frames.FINGERPRINT_VERSION}")
    return frames.reconcile_duplicates(videos, frames.duplicate_components(usable))


_GROUP_COLUMNS = ["video_id", "review_status", "group_id", "duplicate_state", "duplicate_of"]


@query(_VIDEOS + "used AS (SELECT video_id FROM v)," + _NEAR + _ALL_FRAMES + _SETTLED + "SELECT video_id, review_status, group_id, duplicate_state, duplicate_of FROM z")
def g02_duplicate_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos of one capture time with durations within a quarter second and matching frames: a keeper, or a problem."""
    packed = frames.pack_frames(_frames(spark, sf_dir), "video_id")
    videos = _stored(spark, sf_dir).withColumn("fingerprint_version", F.lit(frames.FINGERPRINT_VERSION))
    return _settled(videos.join(packed, "video_id", "left")).select(*_GROUP_COLUMNS)


_BACKFILLED = (
    _VIDEOS
    + """near AS (SELECT a.video_id FROM v a WHERE a.capture_ts <> '' AND EXISTS (SELECT 1 FROM v b WHERE b.capture_ts = a.capture_ts AND b.video_id <> a.video_id AND abs(a.duration - b.duration) <= 0.25::DOUBLE)
      AND EXISTS (SELECT 1 FROM v b WHERE b.capture_ts = a.capture_ts AND b.review_status = 'pending')),
made AS (SELECT video_id FROM v JOIN near USING (video_id) JOIN q USING (video_id) WHERE NOT had AND frame > 0 GROUP BY 1 HAVING count(*) >= 8),
used AS (SELECT video_id, had FROM v WHERE had UNION SELECT video_id, false FROM made),"""
    + _NEAR
    + """q2 AS (SELECT q.* FROM q JOIN used USING (video_id) WHERE frame > 0 OR had),"""
    + _FIGURES.format(kept="frame > 0 OR had", both="true").replace("JOIN q a", "JOIN q2 a").replace("JOIN q b", "JOIN q2 b")
    + _SETTLED
)


@query(_BACKFILLED + "SELECT z.video_id, review_status, group_id, duplicate_state, duplicate_of, (had OR made.video_id IS NOT NULL)::INT AS fingerprint_version FROM z LEFT JOIN made USING (video_id)")
def r40_backfilled_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without a current fingerprint get one from their prepared frames; then groups are settled."""
    given = _frames(spark, sf_dir)
    packed = frames.pack_frames(given, "video_id")
    stored = _stored(spark, sf_dir).join(packed, "video_id", "left")
    stored = stored.withColumn("fingerprint", F.when(F.col("fingerprint_version") == frames.FINGERPRINT_VERSION, F.col("fingerprint")))
    return _settled(frames.backfilled(stored, given)).select(*_GROUP_COLUMNS, "fingerprint_version")


@query(_VIDEOS + "used AS (SELECT video_id FROM v)," + _NEAR + _ALL_FRAMES + _SETTLED + """
SELECT count(DISTINCT CASE WHEN duplicate_state <> '' THEN group_id END) AS duplicate_groups, count(DISTINCT CASE WHEN duplicate_state = 'problem' THEN group_id END) AS problem_groups,
  count(*) FILTER (duplicate_state = 'problem') AS problem_items, count(*) FILTER (duplicate_state = 'auto_rejected') AS auto_rejected FROM z
""")
def g02_duplicate_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the settled groups."""
    packed = frames.pack_frames(_frames(spark, sf_dir), "video_id")
    videos = _stored(spark, sf_dir).withColumn("fingerprint_version", F.lit(frames.FINGERPRINT_VERSION))
    return frames.duplicate_summary(_settled(videos.join(packed, "video_id", "left")))


_FLAGS = """
WITH h AS (SELECT user_id, min(event_id) AS head FROM events WHERE event_type IN ('click', 'purchase') AND user_id % 2 = 0 GROUP BY 1),
b AS (SELECT event_id, user_id, event_type IN ('click', 'purchase') AS selected, CASE WHEN event_type = 'click' THEN 'queued' WHEN event_type = 'error' THEN 'error' ELSE 'not_queued' END AS status,
    coalesce(event_id = head, false) AS main FROM events LEFT JOIN h USING (user_id)),
w AS (SELECT user_id, max(event_id) AS chosen FROM b WHERE user_id % 5 < 2 GROUP BY 1)
"""


@query(_FLAGS + """
SELECT event_id, selected AND NOT (user_id % 3 = 0 AND NOT main) AS selected, main, CASE WHEN user_id % 3 = 0 AND NOT main AND selected AND status = 'queued' THEN 'not_queued' ELSE status END AS status FROM b
""")
def k21_only_key_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the main frame of some videos are deselected; frames that waited to be rendered wait no more."""
    shown = _flagged(spark, sf_dir)
    wanted = shown.filter("user_id % 3 = 0").select("user_id").distinct()
    return states.deselect_all_but_main(shown, wanted, "user_id").select("event_id", "selected", "main", "status")


@query(_FLAGS + """
SELECT event_id, selected OR coalesce(event_id = chosen, false) AS selected, CASE WHEN chosen IS NULL THEN main ELSE event_id = chosen END AS main, status FROM b LEFT JOIN w USING (user_id)
""")
def k21_main_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame made the main one of its video is selected; no other frame of the video stays main."""
    shown = _flagged(spark, sf_dir)
    chosen = shown.filter("user_id % 5 < 2").groupBy("user_id").agg(F.max("event_id").alias("event_id")).select("event_id", "user_id")
    return states.set_main(shown, chosen, "event_id", "user_id").select("event_id", "selected", "main", "status")


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archivolt.plans.states import _frames as flagged

    return flagged(spark, sf_dir)
