"""Date and time operators: tiered and flat interval joins, as-of matches, gap sessions, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_TIERS = ((0, 0), (1, 1), (2, 3))


def tier_of(distance: Column, tiers=DEFAULT_TIERS) -> Column:
    """Index of the first tier (lowest, highest day distance) that holds the distance; null beyond all."""
    out = F.lit(None).cast("int")
    for index, (low, high) in reversed(list(enumerate(tiers))):
        out = F.when(distance.between(low, high), index).otherwise(out)
    return out


def date_window_join(
    targets: DataFrame,
    candidates: DataFrame,
    target_date: str,
    candidate_date: str,
    days: int,
    on: list[str] | None = None,
) -> DataFrame:
    """Pairs whose dates differ by at most ``days``, with ``day_distance``.

    Days are dealt to spans of 2*days+1, of which a target asks at most two and a candidate is in one, so the join
    is an equi-join on (span, keys) that adaptive execution splits if one is hot. It is a merge join, for the planner does
    not know of the rows that the spans add and could send them all to the driver. Null dates match nothing. ``on``
    names further equal columns.
    """
    on = list(on or [])
    span = lambda day: F.floor(F.unix_date(day) / (2 * days + 1))
    asked = F.array_distinct(F.array(span(F.date_sub(F.col(target_date), days)), span(F.date_add(F.col(target_date), days))))
    spread = targets.withColumn("_span", F.explode(asked))
    right = candidates.withColumn("_span", span(F.col(candidate_date)))
    return (
        spread.hint("merge")
        .join(right, ["_span", *on])
        .withColumn("day_distance", F.abs(F.datediff(F.col(candidate_date), F.col(target_date))))
        .filter(F.col("day_distance") <= days)
        .drop("_span")
    )


def tier_cut(pairs: DataFrame, target_key: list[str], preferred: Column, tiers=DEFAULT_TIERS) -> DataFrame:
    """Keep each target's pairs up to the first tier that has a preferred candidate, else all of them.

    Adds ``tier``. Pairs beyond the last tier go.
    """
    tiered = pairs.withColumn("tier", tier_of(F.col("day_distance"), tiers)).filter(F.col("tier").isNotNull())
    window = Window.partitionBy(*target_key)
    return (
        tiered.withColumn("_last", F.min(F.when(preferred, F.col("tier"))).over(window))
        .filter(F.col("_last").isNull() | (F.col("tier") <= F.col("_last")))
        .drop("_last")
    )


def tiered_interval_join(
    targets: DataFrame,
    candidates: DataFrame,
    target_key: list[str],
    target_date: str,
    candidate_date: str,
    preferred: Column,
    on: list[str] | None = None,
    tiers=DEFAULT_TIERS,
) -> DataFrame:
    """Date join that widens tier by tier and stops at the first with a preferred candidate."""
    pairs = date_window_join(targets, candidates, target_date, candidate_date, max(high for _, high in tiers), on)
    return tier_cut(pairs, target_key, preferred, tiers)


def closest_until_preferred(pairs: DataFrame, target_key: list[str], distance: Column, preferred: Column, always: Column) -> DataFrame:
    """Keep each target's pairs up to the smallest distance that has a preferred candidate.

    Rows with ``always`` stay; a target without a preferred candidate keeps all.
    """
    window = Window.partitionBy(*target_key)
    return (
        pairs.withColumn("_limit", F.min(F.when(preferred, distance)).over(window))
        .filter(F.col("_limit").isNull() | (distance <= F.col("_limit")) | F.coalesce(always, F.lit(False)))
        .drop("_limit")
    )


def nearest_match(
    left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, right_id: str, left_id: str
) -> DataFrame:
    """(left_id, right_id, seconds) of the nearest row in time with equal keys, before or after.

    Both sides are laid out once by key and time; the last row before and the
    first row after come from two running windows, so no pairs are formed. Of
    equal times the smallest id counts, of equal distances the smaller id.
    """
    one = right.filter(F.col(right_ts).isNotNull()).groupBy(*on, F.col(right_ts).alias("_ts")).agg(F.min(right_id).alias("_id"))
    marks = one.select(*on, "_ts", F.lit(0).alias("_side"), F.lit(None).cast(left.schema[left_id].dataType).alias("_left"), F.struct("_ts", "_id").alias("_hit"))
    asks = left.select(
        *on, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.col(left_id).alias("_left"), F.lit(None).cast(marks.schema["_hit"].dataType).alias("_hit")
    )
    base = Window.partitionBy(*on)
    back = base.orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = base.orderBy(F.col("_ts").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = (
        marks.unionByName(asks)
        .withColumn("_before", F.last("_hit", ignorenulls=True).over(back))
        .withColumn("_after", F.last("_hit", ignorenulls=True).over(ahead))
        .filter("_side = 1 AND _left IS NOT NULL")
    )

    def option(side: str) -> Column:
        gap = F.abs(F.unix_micros(F.col("_ts").cast("timestamp")) - F.unix_micros(F.col(f"{side}._ts").cast("timestamp")))
        return F.when(F.col(side).isNotNull(), F.struct(gap.alias("gap"), F.col(f"{side}._id").alias("id")))

    return seen.select(
        *on, F.col("_left").alias(left_id), F.array_min(F.array_compact(F.array(option("_before"), option("_after")))).alias("_best")
    ).select(*on, left_id, F.col("_best.id").alias(f"nearest_{right_id}"), (F.col("_best.gap") / 1_000_000).alias("seconds"))


def gap_sessions(rows: DataFrame, key: list[str], order: str, largest_gap: int, name: str = "session") -> DataFrame:
    """Number sessions from 1: a new one starts where the gap in days to the row before exceeds ``largest_gap``."""
    window = Window.partitionBy(*key).orderBy(order)
    fresh = F.coalesce(F.datediff(F.col(order), F.lag(order).over(window)) > largest_gap, F.lit(True)).cast("int")
    return rows.withColumn("_fresh", fresh).withColumn(
        name, F.sum("_fresh").over(window.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_fresh")


def month_calendar(bounds: DataFrame, first: str, last: str, name: str = "month") -> DataFrame:
    """All months from the first to the last date, as yyyy-MM."""
    return bounds.select(
        F.explode(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))).alias("_m")
    ).select(F.date_format("_m", "yyyy-MM").alias(name))


def widening_window(step: Column, steps=(3, 7, 14, 30)) -> Column:
    """The window in days after so many rejected rounds; the last step stays."""
    out = F.lit(steps[-1])
    for i, days in reversed(list(enumerate(steps))):
        out = F.when(step <= i, days).otherwise(out)
    return out


def nearest_overall(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, right_id: str, left_id: str, ranges: int = 0) -> DataFrame:
    """(left_id, nearest_right_id, seconds) of the row of ``right`` nearest in time, before or after, without any key.

    Times of both sides are dealt to ranges, each a task. A window inside a range finds the neighbours there; the last row
    before and the first row after a range (one row for each range, put together on the driver) are known to it as well.
    Each time is laid out once, so rows of one time do not gather. Of equal times the smallest id counts, of equal
    distances the smaller id. Left rows without a time, or without any right row, have no match.
    """
    from archivolt.storage import materialize

    spark = left.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    marks = right.filter(F.col(right_ts).isNotNull() & F.col(right_id).isNotNull()).groupBy(micros(right_ts).alias("at")).agg(F.min(right_id).alias("id"))
    asks = left.filter(F.col(left_ts).isNotNull()).select(micros(left_ts).alias("at")).distinct()
    kind = marks.schema["id"].dataType
    both = marks.select("at", F.struct("at", "id").alias("hit")).unionByName(asks.join(marks, "at", "left_anti").select("at", F.lit(None).cast(marks.select(F.struct("at", "id").alias("h")).schema["h"].dataType).alias("hit")))
    dealt = materialize(both.repartitionByRange(ranges, "at").withColumn("part", F.spark_partition_id()), "ranges")
    edges = dealt.groupBy("part").agg(F.max("hit").alias("last"), F.min("hit").alias("first")).orderBy("part").collect()
    carried, before = [], None
    for edge in edges:
        carried.append([edge.part, before, None])
        before = edge.last or before
    after = None
    for edge, row in zip(reversed(edges), reversed(carried), strict=True):
        row[2] = after
        after = edge.first or after
    hit = dealt.schema["hit"].dataType.simpleString()
    known = spark.createDataFrame([tuple(r) for r in carried], f"part int, `_last` {hit}, `_first` {hit}")
    # Both frames run: one from each row to the end would be read anew for each row.
    within, ahead = Window.partitionBy("part").orderBy("at"), Window.partitionBy("part").orderBy(F.col("at").desc())
    seen = (
        dealt.withColumn("_b", F.last("hit", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_a", F.last("hit", ignorenulls=True).over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
        .join(known, "part")
    )

    def option(found: Column) -> Column:
        return F.when(found.isNotNull(), F.struct(F.abs(F.col("at") - found["at"]).alias("gap"), found["id"].cast(kind).alias("id")))

    best = F.array_min(F.array_compact(F.array(option(F.coalesce("_b", "_last")), option(F.coalesce("_a", "_first")))))
    answers = seen.select("at", best.alias("best"))
    return (
        left.select(left_id, micros(left_ts).alias("at"))
        .join(answers, "at", "left")
        .select(left_id, F.col("best.id").alias(f"nearest_{right_id}"), (F.col("best.gap") / 1_000_000).alias("seconds"))
    )


def nearest_with_fallback(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, right_id: str, left_id: str, ranges: int = 0) -> DataFrame:
    """Of each left row the nearest right row with equal keys, else the nearest of all: (left_id, nearest_right_id, seconds, same_key).

    A null key equals none.
    """
    from archivolt.storage import materialize

    own = nearest_match(left.dropna(subset=on), right.dropna(subset=on), on, left_ts, right_ts, right_id, left_id).drop(*on)
    own = materialize(own.filter(F.col(f"nearest_{right_id}").isNotNull()), "same-key")
    rest = left.join(own.select(left_id), left_id, "left_anti")
    other = nearest_overall(rest, right, left_ts, right_ts, right_id, left_id, ranges)
    return own.withColumn("same_key", F.lit(True)).unionByName(other.withColumn("same_key", F.lit(False)))
