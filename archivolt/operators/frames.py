"""Fingerprints of sampled video frames: packing, comparison of aligned frames, duplicate groups and their keepers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.operators.graph import connected_components
from archivolt.storage import materialize

# Fixed values of the comparison.
FRAME_BYTES = 64
LEAST_COMMON, COMMON_SHARE = 8, 0.75
MOST_MEAN_DELTA, MOST_DELTA = 2.0, 32
MOST_MEAN_BITS, MOST_BITS = 1.0, 8
DURATION_TOLERANCE = 0.25
FINGERPRINT_VERSION = 1

_RECORD = 2 + FRAME_BYTES


def pack_frames(frames: DataFrame, key: str, number: str = "frame", pixels: str = "pixels") -> DataFrame:
    """(key, fingerprint): for each frame in order its number in two bytes and its 64 gray values.

    The fingerprint is null where a number repeats or does not fit in 16 bits, or a frame has not 64 values from 0 to 255.
    """
    fits = (F.size(pixels) == FRAME_BYTES) & F.forall(pixels, lambda x: x.isNotNull() & x.between(0, 255)) & F.col(number).between(0, 65535)
    values = F.array_join(F.transform(pixels, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), "")
    record = F.struct(F.col(number).alias("n"), F.concat(F.lpad(F.hex(F.col(number).cast("long")), 4, "0"), values).alias("hex"))
    packed = frames.withColumn("_fits", F.coalesce(fits, F.lit(False))).groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col("_fits"), record))).alias("_records"),
        (F.bool_and("_fits") & (F.count_distinct(number) == F.count(F.lit(1)))).alias("_whole"),
    )
    joined = F.unhex(F.array_join(F.transform("_records", lambda r: r["hex"]), ""))
    return packed.select(key, F.when(F.col("_whole"), joined).alias("fingerprint"))


def _unpacked(payloads: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all payloads: row * 65536 + number of each frame in order, its pixels, then per row its frames (0: none that can be read)."""
    sizes = np.array([len(p) if p is not None else 0 for p in payloads], dtype=np.int64)
    counts = np.where(sizes % _RECORD == 0, sizes // _RECORD, 0)
    data = b"".join(bytes(p) for p, n in zip(payloads, counts, strict=True) if n)
    records = np.frombuffer(data, dtype=np.uint8).reshape(-1, _RECORD)
    rows = np.repeat(np.arange(len(counts)), counts)
    keys = (rows << 16) | (records[:, 0].astype(np.int64) << 8) | records[:, 1]
    order = np.argsort(keys, kind="stable")
    keys, rows, pixels = keys[order], rows[order], records[order, 2:]
    twice = np.unique(rows[1:][keys[1:] == keys[:-1]])
    counts[twice] = 0
    kept = ~np.isin(rows, twice)
    return keys[kept], rows[kept], pixels[kept], counts


def _bits(pixels: np.ndarray) -> np.ndarray:
    """Whether each value reaches the mean of its frame."""
    values = pixels.astype(np.int32)
    return values * FRAME_BYTES >= values.sum(axis=1, keepdims=True)


def compare(first: pd.Series, second: pd.Series) -> pd.DataFrame:
    """Figures of the frames that two fingerprints share, and whether they match; one pass of array operations a batch."""
    n = len(first)
    a_keys, _, a_pixels, a_counts = _unpacked(first)
    b_keys, _, b_pixels, b_counts = _unpacked(second)
    shared, i, j = np.intersect1d(a_keys, b_keys, assume_unique=True, return_indices=True)
    rows = shared >> 16
    common = np.bincount(rows, minlength=n)
    delta = np.abs(a_pixels[i].astype(np.int32) - b_pixels[j])
    bits = (_bits(a_pixels[i]) != _bits(b_pixels[j])).sum(axis=1)

    def largest(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n, dtype=np.int64)
        np.maximum.at(out, rows, values)
        return out

    some = np.maximum(common, 1)
    out = pd.DataFrame(
        {
            "common": common,
            "mean_delta": np.bincount(rows, delta.sum(axis=1), minlength=n) / (some * FRAME_BYTES),
            "max_delta": largest(delta.max(axis=1) if len(delta) else np.zeros(0, dtype=np.int64)),
            "mean_bits": np.bincount(rows, bits, minlength=n) / some,
            "max_bits": largest(bits),
        }
    )
    required = np.maximum(LEAST_COMMON, np.ceil(np.maximum(a_counts, b_counts) * COMMON_SHARE))
    out["matches"] = (
        (out["common"] >= required)
        & (out["mean_delta"] <= MOST_MEAN_DELTA)
        & (out["max_delta"] <= MOST_DELTA)
        & (out["mean_bits"] <= MOST_MEAN_BITS)
        & (out["max_bits"] <= MOST_BITS)
    )
    return out


def compare_slices(first: pd.Series, second: pd.Series, rows: int = 512) -> pd.DataFrame:
    """``compare`` of some rows at a time: its arrays are many times as large as the fingerprints of a batch."""
    parts = [compare(first.iloc[i : i + rows], second.iloc[i : i + rows]) for i in range(0, max(len(first), 1), rows)]
    return pd.concat(parts, ignore_index=True)


def compared(first: Column, second: Column) -> Column:
    """struct(common, mean_delta, max_delta, mean_bits, max_bits, matches) of two fingerprints."""
    kind = "common int, mean_delta double, max_delta int, mean_bits double, max_bits int, matches boolean"

    @F.pandas_udf(kind)
    def figures(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return compare_slices(a, b)

    return figures(first, second)


def hash_halves(fingerprint: Column) -> Column:
    """Each frame's number with each half of its hash, as text. Fingerprints that match share at least one: their hashes
    differ by one bit in the mean, so in some frame by one at most, and then one half is equal."""

    @F.pandas_udf("array<string>")
    def halves(payloads: pd.Series) -> pd.Series:
        keys, rows, pixels, _ = _unpacked(payloads)
        packed = np.packbits(_bits(pixels), axis=1).view(">u4") if len(keys) else np.zeros((0, 2), dtype=">u4")
        names = [f"{k & 0xFFFF}.{side}.{v}" for k, pair in zip(keys.tolist(), packed.tolist(), strict=True) for side, v in enumerate(pair)]
        stops = np.searchsorted(rows, np.arange(len(payloads) + 1)) * 2
        return pd.Series([names[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)])

    return halves(fingerprint)


def linked_components(members: DataFrame, rows: DataFrame, key: str, identity: str, payload: list[str], links: Column) -> DataFrame:
    """(node, component) of rows that ``links`` (a condition on a and b, structs of the payload) joins, asked only of rows that share a key.

    ``members`` has the id of a row for each of its keys, and ``rows`` the payload once for each id: it is laid beside
    distinct pairs, not beside keys. Each row is first held against the smallest row of each of its keys;
    only rows of a key that are then not in its largest component are held against all others of the key. So many rows
    that are alike cost a comparison each, and no link between components is lost.
    """
    listed = materialize(members.select(F.col(key).alias("key"), F.col(identity).alias("id")), "keyed")
    heads = listed.groupBy("key").agg(F.min("id").alias("b_id"))

    def links_of(both: DataFrame) -> DataFrame:
        """Rows may share many keys and are compared once."""
        pairs = both.filter("a_id <> b_id").select(F.least("a_id", "b_id").alias("src"), F.greatest("a_id", "b_id").alias("dst")).distinct()
        for end, name in (("src", "a"), ("dst", "b")):
            pairs = pairs.join(rows.select(F.col(identity).alias(end), F.struct(*payload).alias(name)), end)
        return pairs.filter(links).select("src", "dst")

    every = listed.select("key", F.col("id").alias("a_id"))
    found = materialize(links_of(every.join(heads, "key")), "star-links")
    near = connected_components(found)
    placed = listed.join(near.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = materialize(placed, "placed")
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    open_keys = placed.join(largest.select("key", F.col("most.component").alias("main")), "key")
    rest = open_keys.filter("component <> main").select("key", F.col("id").alias("a_id"), F.col("component").alias("a_part"))
    others = open_keys.select("key", F.col("id").alias("b_id"), F.col("component").alias("b_part"))
    more = links_of(rest.join(others, "key").filter("a_part <> b_part"))
    return connected_components(found.unionByName(more))


def duplicate_components(videos: DataFrame, tolerance: float = DURATION_TOLERANCE) -> DataFrame:
    """(node, component) of videos (video_id, capture_ts, duration, fingerprint) of one capture time whose durations are
    within the tolerance and whose fingerprints match. Ids are texts; a component's name is its smallest.

    Equal videos are one row that stands for all. Videos without a capture time or a
    fingerprint that can be read take no part.
    """
    own = ["capture_ts", "duration", "fingerprint"]
    usable = videos.filter("capture_ts <> '' AND length(fingerprint) > 0").select("video_id", *own)
    heads = usable.select(*own).distinct().withColumn("row", F.monotonically_increasing_id())
    heads = materialize(heads.withColumn("alike", compared(F.col("fingerprint"), F.col("fingerprint"))["matches"]), "distinct-videos")
    # A key is the hash of a half and its time: where two hashes meet by chance, the times are held against each other.
    halves = F.explode(hash_halves(F.col("fingerprint"))).alias("half")
    keyed = heads.filter("alike").select("row", "capture_ts", halves).select("row", F.xxhash64("capture_ts", "half").alias("key"))
    near = (F.col("a.capture_ts") == F.col("b.capture_ts")) & (F.abs(F.col("a.duration") - F.col("b.duration")) <= tolerance)
    linked = linked_components(keyed, heads, "key", "row", own, near & compared(F.col("a.fingerprint"), F.col("b.fingerprint"))["matches"])
    # A fingerprint of too few frames does not even match itself: its copies stay apart.
    members = usable.join(heads.filter("alike").select(*own, "row"), own).join(linked.withColumnRenamed("node", "row"), "row", "left")
    members = materialize(members.select("video_id", F.coalesce("component", "row").alias("part")), "members")
    names = members.groupBy("part").agg(F.min("video_id").alias("component"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return members.join(names, "part").select(F.col("video_id").alias("node"), "component")


def reconcile_duplicates(videos: DataFrame, components: DataFrame) -> DataFrame:
    """The videos after their duplicate groups were settled.

    A group without a pending video, or of one video, changes nothing. A group is a problem if it has several keepers, an
    edited video that is no keeper, or several old group ids: all its videos are then marked so. Otherwise the keeper, or
    else the first pending video by (created_at, video_id), stays, and the others are rejected as its duplicates.
    """
    held = components.select(F.col("node").alias("video_id"), "component")
    named = videos.select("video_id", "review_status", "created_at", "edits", "group_id", "duplicate_state").join(held, "video_id")
    keeper, pending = F.col("duplicate_state") == "keeper", F.col("review_status") == "pending"
    order = F.struct("created_at", "video_id")
    groups = (
        named.groupBy("component")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.bool_or(pending).alias("open"),
            F.count_if(keeper).alias("keepers"),
            F.bool_or((F.col("edits") > 0) & ~keeper).alias("edited"),
            F.count_distinct(F.when(F.col("group_id") != "", F.col("group_id"))).alias("old_groups"),
            F.max(F.when(F.col("group_id") != "", F.col("group_id"))).alias("old_group"),
            F.min("video_id").alias("least"),
            F.min(F.when(keeper, order)).alias("kept"),
            F.min(F.when(pending, order)).alias("first"),
        )
        .filter("size > 1 AND open")
        .select(
            "component",
            F.when(F.col("old_groups") == 1, F.col("old_group")).otherwise(F.col("least")).alias("_group"),
            ((F.col("keepers") > 1) | F.col("edited") | (F.col("old_groups") > 1)).alias("_problem"),
            F.coalesce("kept.video_id", "first.video_id").alias("_keeper"),
        )
    )
    marked = videos.join(held.join(groups, "component").drop("component"), "video_id", "left")
    grouped, problem = F.col("_group").isNotNull(), F.coalesce("_problem", F.lit(False))
    loses = grouped & ~problem & (F.col("video_id") != F.col("_keeper"))
    changes = {
        "duplicate_state": F.when(~grouped, F.col("duplicate_state")).when(problem, "problem").when(loses, "auto_rejected").otherwise("keeper"),
        "duplicate_of": F.when(~grouped, F.col("duplicate_of")).when(loses, F.col("_keeper")).otherwise(""),
        "group_id": F.coalesce("_group", "group_id"),
        "review_status": F.when(loses, "rejected").otherwise(F.col("review_status")),
        "triage_status": F.when(loses, "rejected").otherwise(F.col("triage_status")),
        "outputs": F.when(loses, F.lit(0)).otherwise(F.col("outputs")),
    }
    return marked.select(*[changes.get(c, F.col(c)).alias(c) for c in videos.columns])


def duplicate_summary(videos: DataFrame) -> DataFrame:
    """One row of counters of settled groups."""
    problem = F.col("duplicate_state") == "problem"
    return videos.agg(
        F.count_distinct(F.when(F.col("duplicate_state") != "", F.col("group_id"))).alias("duplicate_groups"),
        F.count_distinct(F.when(problem, F.col("group_id"))).alias("problem_groups"),
        F.count_if(problem).alias("problem_items"),
        F.count_if(F.col("duplicate_state") == "auto_rejected").alias("auto_rejected"),
    )


def fingerprint_candidates(videos: DataFrame, tolerance: float = DURATION_TOLERANCE) -> DataFrame:
    """video_id of videos with another of the same capture time within the tolerance of duration, where any of that time is pending.

    In order of duration a video has such another if and only if a neighbour is one.
    """
    from pyspark.sql.window import Window

    usable = videos.filter("capture_ts <> ''")
    # Distinct durations of a time are few rows, whatever the number of its videos.
    distinct = usable.groupBy("capture_ts", "duration").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("capture_ts").orderBy("duration")
    gaps = [F.abs(F.col("duration") - step("duration").over(order)) for step in (F.lag, F.lead)]
    near = distinct.withColumn("near", (F.col("n") > 1) | F.coalesce(gaps[0] <= tolerance, F.lit(False)) | F.coalesce(gaps[1] <= tolerance, F.lit(False)))
    pending = usable.filter("review_status = 'pending'").select("capture_ts").distinct()
    chosen = near.filter("near").select("capture_ts", "duration").join(pending, "capture_ts", "left_semi")
    return usable.join(chosen, ["capture_ts", "duration"], "left_semi").select("video_id")


def backfilled(videos: DataFrame, frames: DataFrame, count: int = 16) -> DataFrame:
    """Videos with fingerprints made from their first ``count`` prepared frames where a candidate lacks a current one.

    Fewer than eight frames give none; ``fingerprint_version`` tells whose are current.
    """
    lacking = videos.filter(f"fingerprint_version <> {FINGERPRINT_VERSION} OR fingerprint IS NULL OR length(fingerprint) = 0")
    wanted = lacking.join(fingerprint_candidates(videos), "video_id", "left_semi").select("video_id")
    own = frames.join(wanted, "video_id", "left_semi").filter("NOT user_captured")
    listed = own.groupBy("video_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("frame", "pixels"))), 1, count).alias("_f"))
    enough = listed.filter(F.size("_f") >= math.ceil(LEAST_COMMON)).select("video_id", F.explode("_f").alias("_f"))
    made = pack_frames(enough.select("video_id", "_f.frame", "_f.pixels"), "video_id").withColumnRenamed("fingerprint", "_made")
    held = videos.join(made, "video_id", "left")
    changes = {
        "fingerprint": F.coalesce("_made", "fingerprint"),
        "fingerprint_version": F.when(F.col("_made").isNotNull(), F.lit(FINGERPRINT_VERSION)).otherwise(F.col("fingerprint_version")),
    }
    return held.select(*[changes.get(c, F.col(c)).alias(c) for c in videos.columns])
