"""Reconciliation of two record sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_then_date(
    exported: DataFrame, manifest: DataFrame, export_id: str, manifest_id: str, export_ts: str, manifest_ts: str
) -> DataFrame:
    """One row per exported record and one per manifest record that none hit, with ``match_status``.

    An exported record takes the manifest record of its exact time, else the only
    one of its date. Later exported records on the same manifest record are
    duplicates. Times of several manifest records go to the smallest id.
    """
    by_time = manifest.groupBy(F.col(manifest_ts).alias("_ts")).agg(F.min(manifest_id).alias("_exact"))
    by_date = (
        manifest.groupBy(F.to_date(manifest_ts).alias("_date"))
        .agg(F.min(manifest_id).alias("_dated"), F.count(F.lit(1)).alias("_n"))
        .filter("_n = 1")
        .drop("_n")
    )
    found = (
        exported.select(export_id, F.col(export_ts).alias("_ts"), F.to_date(export_ts).alias("_date"))
        .join(by_time, "_ts", "left")
        .join(by_date, "_date", "left")
        .withColumn(manifest_id, F.coalesce("_exact", "_dated"))
    )
    order = Window.partitionBy(manifest_id).orderBy(F.col("_exact").isNull(), "_ts", export_id)
    status = (
        F.when(F.col(manifest_id).isNull(), "unmatched_export")
        .when(F.row_number().over(order) > 1, "duplicate_export_match")
        .when(F.col("_exact").isNotNull(), "matched_timestamp")
        .otherwise("matched_date")
    )
    matched = found.select(export_id, manifest_id, status.alias("match_status"))
    missing = manifest.join(matched.select(manifest_id), manifest_id, "left_anti").select(
        F.lit(None).cast(exported.schema[export_id].dataType).alias(export_id), manifest_id, F.lit("missing_from_export").alias("match_status")
    )
    return matched.unionByName(missing)


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys on one side only."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return (
        a.join(b, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right_only")))
    )


def compare_counts(expected: DataFrame, actual: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """Keys whose presence or counts differ, with an array of issues in the order of ``counts``."""
    joined = expected.select(key, *[F.col(c).alias(f"_e_{c}") for c in counts]).join(
        actual.select(key, *[F.col(c).alias(f"_a_{c}") for c in counts], F.lit(True).alias("_there")), key, "full"
    )
    missing = F.col("_there").isNull()
    extra = F.col(f"_e_{counts[0]}").isNull() & ~missing
    issues: list[Column] = [F.when(missing, "missing"), F.when(extra, "unexpected")]
    issues += [F.when(~missing & ~extra & (F.col(f"_e_{c}") != F.col(f"_a_{c}")), F.lit(f"{c}_differs")) for c in counts]
    return joined.select(key, F.array_compact(F.array(*issues)).alias("issues")).filter(F.size("issues") > 0)


def first_source_wins(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of sources in which an earlier one's row hides later ones with the same key. Keys are unique in a source."""
    stacked = None
    for i, source in enumerate(sources):
        part = source.withColumn("_source", F.lit(i))
        stacked = part if stacked is None else stacked.unionByName(part)
    window = Window.partitionBy(*key).orderBy("_source")
    return stacked.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n", "_source")


def unique_attachment(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str) -> DataFrame:
    """Pairs of keys that have exactly one row on either side; other shared keys have ``ambiguous`` set and no ids."""
    a = left.groupBy(*on).agg(F.min(left_id).alias(left_id), F.count(F.lit(1)).alias("_l"))
    b = right.groupBy(*on).agg(F.min(right_id).alias(right_id), F.count(F.lit(1)).alias("_r"))
    single = (F.col("_l") == 1) & (F.col("_r") == 1)
    return a.join(b, on).select(
        *on, F.when(single, F.col(left_id)).alias(left_id), F.when(single, F.col(right_id)).alias(right_id), (~single).alias("ambiguous")
    )


def infer_hour_offset(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, hours=range(-14, 15), share: float = 0.8) -> DataFrame:
    """The hour offset that makes most distinct left times equal right times; the lowest of equal ones, if enough agree.

    Enough: at least 2, and the given share of the smaller side. One row, or none.
    The offsets multiply the left times by a constant; the join is on equal times.
    """
    a, b = left.select(F.col(left_ts).alias("_t")).distinct(), right.select(F.col(right_ts).alias("_t")).distinct()
    shifted = a.select(
        F.explode(F.array(*[F.lit(h) for h in hours])).alias("offset_hours"), F.col("_t")
    ).withColumn("_t", F.timestamp_add("HOUR", F.col("offset_hours"), F.col("_t")))
    overlap = shifted.join(b, "_t").groupBy("offset_hours").agg(F.count(F.lit(1)).alias("overlap"))
    sizes = a.agg(F.count(F.lit(1)).alias("_n")).crossJoin(b.agg(F.count(F.lit(1)).alias("_m")))  # one row by one row
    best = overlap.agg(F.max(F.struct("overlap", (-F.col("offset_hours")).alias("_o"))).alias("_b"))
    return (
        best.crossJoin(sizes)
        .select((-F.col("_b._o")).alias("offset_hours"), F.col("_b.overlap").alias("overlap"), "_n", "_m")
        .filter(F.col("overlap") >= F.greatest(F.lit(2), F.floor(share * F.least("_n", "_m"))))
        .drop("_n", "_m")
    )


def _attempt_keys() -> tuple[Column, Column, dict[str, Column]]:
    """What an attempt is matched by (null: nothing), its key, and the key of each kind, which batches have all of."""
    as_set = lambda c: F.array_join(F.sort_array(F.array_distinct(F.array_compact(c))), "\u001f")
    some = lambda c: F.coalesce(F.size(F.array_compact(c)), F.lit(0)) > 0
    keys = {"dates": as_set("dates"), "ids": as_set("ids"), "range": F.to_json(F.struct("first", "last", "n"))}
    named = F.when(some("dates"), "dates").when(some("ids"), "ids").when(F.coalesce("first", "last", F.col("n").cast("string")).isNotNull(), "range")
    return named, F.when(some("dates"), keys["dates"]).when(some("ids"), keys["ids"]).otherwise(keys["range"]), keys


def batch_attempts(batches: DataFrame, attempts: DataFrame, order: str, shown: list[str]) -> DataFrame:
    """batch_id, attempts, and the columns ``shown`` of the last attempt by ``order`` of each batch.

    Sides are those of ``attempts_to_batches``. Attempts of one key are summed up before they meet the batches, so that
    nothing grows with the product of both.
    """
    named, key, keys = _attempt_keys()
    asked = attempts.withColumns({"tier": named, "key": key}).filter("tier IS NOT NULL")
    summed = asked.groupBy("tier", "key").agg(F.count(F.lit(1)).alias("n_asked"), F.max(F.struct(order, *shown)).alias("latest"))
    offered = batches.select("batch_id", F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), v.alias("key")) for t, v in keys.items()])).alias("k"))
    joined = offered.select("batch_id", "k.tier", "k.key").join(summed, ["tier", "key"], "left")
    out = joined.groupBy("batch_id").agg(F.coalesce(F.sum("n_asked"), F.lit(0)).alias("attempts"), F.max("latest").alias("latest"))
    return out.select("batch_id", "attempts", *[F.col("latest")[c].alias(c) for c in shown])


def attempts_to_batches(attempts: DataFrame, batches: DataFrame, least_overlap: float | None = None) -> DataFrame:
    """(attempt_id, tier, batch_id, matches): the batches that a search attempt was made for.

    Both sides have arrays ``dates`` and ``ids``, and ``first``, ``last`` and ``n``. An attempt with dates matches batches
    with the same set of dates, one with ids alone those with the same ids, any other those of equal first, last and n;
    one that names nothing has no row. ``matches`` counts them and ``batch_id`` is the smallest. With ``least_overlap``, an
    attempt by ids without an equal batch takes the batch that holds most of its ids, at least that share (tier overlap).
    Attempts without a batch have a null batch and no matches.
    """
    from archivolt.storage import materialize

    named, key, tiers = _attempt_keys()
    asked = attempts.withColumns({"tier": named, "key": key}).filter("tier IS NOT NULL")
    offered = batches.select("batch_id", F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), v.alias("key")) for t, v in tiers.items()])).alias("k"))
    known = offered.groupBy("k.tier", "k.key").agg(F.min("batch_id").alias("batch_id"), F.count(F.lit(1)).alias("matches"))
    found = asked.join(known, ["tier", "key"], "left").select("attempt_id", "tier", "ids", "batch_id", F.coalesce("matches", F.lit(0).cast("long")).alias("matches"))
    if least_overlap is None:
        return found.drop("ids")
    found = materialize(found, "attempts")
    held = F.sort_array(F.array_distinct(F.array_compact("ids")))
    # Attempts and batches of the same ids are one set each: where ids have few values, sets are few as well.
    # A batch that holds the share has one of the rarest ids, of which an attempt needs to ask only so many.
    asked = found.filter("tier = 'ids' AND matches = 0").select("attempt_id", held.alias("ids"))
    open_ = materialize(asked.select("ids").distinct().withColumn("ask", F.monotonically_increasing_id()), "asked-sets")
    index = batches.groupBy(held.alias("held")).agg(F.min("batch_id").alias("batch_id"))
    index = materialize(index, "held-sets")
    listed = index.select("batch_id", F.explode("held").alias("id"))
    rarity = listed.groupBy("id").agg(F.count(F.lit(1)).alias("batches"))
    asking = open_.select("ask", F.size("ids").alias("size"), F.explode("ids").alias("id")).join(rarity, "id", "left")
    place = F.row_number().over(Window.partitionBy("ask").orderBy(F.coalesce("batches", F.lit(0)), "id"))
    prefix = asking.withColumn("place", place).filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * least_overlap) + 1)
    pairs = prefix.join(listed, "id").select("ask", "batch_id").distinct()
    overlap = F.size(F.array_intersect("ids", "held"))
    shared = pairs.join(open_, "ask").join(index, "batch_id").withColumn("overlap", overlap).filter(F.col("overlap") >= F.size("ids") * least_overlap)
    best = shared.groupBy("ids").agg(F.min(F.struct((-F.col("overlap")).alias("less"), "batch_id")).alias("best"))
    better = found.join(asked.join(best, "ids").select("attempt_id", "best"), "attempt_id", "left")
    return better.select(
        "attempt_id",
        F.when(F.col("best").isNotNull(), "overlap").otherwise(F.col("tier")).alias("tier"),
        F.coalesce("batch_id", "best.batch_id").alias("batch_id"),
        F.when(F.col("best").isNotNull(), F.lit(1).cast("long")).otherwise(F.col("matches")).alias("matches"),
    )
