"""The search by dates as one plan of named stages: targets, files near their dates, what was rejected, tiers, one owner a file, queue."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivolt.operators import filters, temporal
from archivolt.operators.sampling import numbered_in_order
from archivolt.storage import materialize

CONTENT = ["sha", "path"]


@dataclass
class Run:
    """The tables of a run, and the rows that each stage has, those of pairs of targets and files counted by their days."""

    queue: DataFrame
    days: DataFrame
    batches: DataFrame
    counters: dict[str, int] = field(default_factory=dict)


def _same(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join on equal values, null being equal to null, that keeps the columns of the left side once."""
    other = right.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return left.join(other, same, how).drop(*[f"_on_{c}" for c in on])


def targets(entries: DataFrame, settled: DataFrame, confirmed: DataFrame, pending: DataFrame) -> DataFrame:
    """entry, day of entries whose fallback is not settled and that have no confirmed original but such as a decision that
    is not applied yet rejects, by content or by path."""
    standing = filters.without_rejected(confirmed, pending, "entry", CONTENT)
    return entries.join(settled, "entry", "left_anti").join(standing.select("entry"), "entry", "left_anti").select("entry", "day")


def date_search(
    entries: DataFrame,
    settled: DataFrame,
    confirmed: DataFrame,
    pending: DataFrame,
    files: DataFrame,
    rejected: DataFrame,
    stored: DataFrame,
    tiers=temporal.DEFAULT_TIERS,
    largest_gap: int = 3,
) -> Run:
    """A run of the search.

    ``entries`` has entry and day; ``settled`` entry; ``confirmed``, ``pending`` and ``rejected`` entry, sha and path;
    ``files`` path, sha, day and preferred; ``stored`` entry, path and decision, rows of the queue that a person decided.
    Files within the tiers of a target's day are candidates unless rejected for it. Of an entry's candidates those up to the
    first tier, and in it the first distance, with a preferred one stay; a file stays with its nearest entry. Decided rows
    of targets stay as they are, whatever the search finds; an entry without a row has a placeholder.

    Targets and files never meet as pairs, which would be as many as the product of both on each day. What a target may take
    depends on how many preferred files lie at each distance of its day, less those it may not have; a file goes to the
    first of the targets that ask its day at the least distance, or, if some may not have it, to the first one left. Only pairs
    that are rejected or decided are rows.
    """
    reach = max(high for _, high in tiers)
    tier = [next((i for i, (low, high) in enumerate(tiers) if low <= d <= high), None) for d in range(reach + 1)]
    offsets = F.explode(F.array(*[F.lit(o) for o in range(-reach, reach + 1)]))

    def at_days(rows: DataFrame, file_day: str) -> DataFrame:
        """Rows at each day within reach of their own, with the distance."""
        return rows.withColumn("_o", offsets).withColumns({"day": F.date_add(file_day, F.col("_o")), "dist": F.abs("_o")}).drop("_o")

    wanted = materialize(targets(entries, settled, confirmed, pending), "targets")
    asking = wanted.dropna(subset=["day"]).distinct()
    good = F.coalesce("preferred", F.lit(False))
    dated = files.filter(F.col("day").isNotNull()).select("path", "sha", good.alias("good"), F.col("day").alias("file_day"))
    held = dated.groupBy("path", "sha").agg(
        F.min("file_day").alias("file_day"), F.max("file_day").alias("_last"), F.bool_or("good").alias("good")
    )
    held = materialize(held, "files")
    single = held.filter("file_day = _last").drop("_last")
    # Of a file with several days the nearest one within reach counts, and all of those for being preferred.
    several = _same(dated, held.filter("file_day <> _last").select("path", "sha"), ["path", "sha"], "left_semi")

    def nearest(rows: DataFrame, *key: str) -> DataFrame:
        return rows.groupBy(*key, "day", "path", "sha").agg(F.min("dist").alias("dist"), F.bool_or("good").alias("good"))

    several = materialize(nearest(at_days(several, "file_day")), "files-of-several-days")
    per_day = single.groupBy("file_day", "good").agg(F.count(F.lit(1)).alias("n"))
    lone = several.groupBy("day", "dist", "good").agg(F.count(F.lit(1)).alias("n"))
    slots = at_days(per_day, "file_day").select("day", "dist", "good", "n").unionByName(lone)
    at = lambda d, more=True: F.coalesce(F.sum(F.when((F.col("dist") == d) & more, F.col("n"))), F.lit(0))
    sizes = slots.groupBy("day").agg(*[at(d).alias(f"n{d}") for d in range(reach + 1)], *[at(d, F.col("good")).alias(f"good{d}") for d in range(reach + 1)])
    sizes = materialize(sizes, "sizes")

    # Pairs of a target and a file within its reach that is rejected for it or stands in a row that was decided.
    mine = stored.select("entry", "path", "decision")
    no, yes = F.lit(False), F.lit(True)
    by_path = rejected.select("entry", "path", yes.alias("hidden"), no.alias("kept")).unionByName(mine.select("entry", "path", no.alias("hidden"), yes.alias("kept")))
    by_path = by_path.dropna(subset=["path"]).groupBy("entry", "path").agg(F.bool_or("hidden").alias("hidden"), F.bool_or("kept").alias("kept"))
    by_path = by_path.join(asking, "entry").join(dated, "path").withColumn("dist", F.abs(F.datediff("file_day", "day"))).filter(F.col("dist") <= reach)
    marks = [F.bool_or("hidden").alias("hidden"), F.bool_or("kept").alias("kept")]
    of_pair = [F.min("dist").alias("dist"), F.bool_or("good").alias("good"), *marks]
    pair = ["entry", "day", "path", "sha"]
    by_path = by_path.groupBy(*pair).agg(*of_pair)
    refused = rejected.select("entry", "sha").dropna().distinct()
    refused_shas = refused.select("sha").distinct()
    near = at_days(single.join(refused_shas, "sha", "left_semi"), "file_day").select("day", "path", "sha", "dist", "good")
    near = near.unionByName(several.join(refused_shas, "sha", "left_semi").select("day", "path", "sha", "dist", "good"))
    near = materialize(near, "refused-files")
    by_sha = asking.join(refused, "entry").join(near, ["sha", "day"]).withColumns({"hidden": yes, "kept": no})
    barred = materialize(by_path.unionByName(by_sha.select(*by_path.columns)).groupBy(*pair).agg(*of_pair), "barred")

    n = F.col("n")
    lost = barred.filter("good").withColumn("n", F.lit(1)).groupBy("entry", "day").agg(*[at(d).alias(f"lost{d}") for d in range(reach + 1)])
    left = asking.join(sizes, "day", "left").join(lost, ["entry", "day"], "left")
    some = [F.coalesce(F.bool_or(F.col(f"good{d}") - F.coalesce(f"lost{d}", F.lit(0)) > 0), no).alias(f"has{d}") for d in range(reach + 1)]
    usable = [d for d in range(reach + 1) if tier[d] is not None]
    cut = F.array_min(F.array(*[F.when(F.col(f"has{d}"), F.lit(tier[d])) for d in usable]))
    within = lambda d: F.col("_cut").isNull() | (F.lit(tier[d]) <= F.col("_cut"))
    limit = F.array_min(F.array(*[F.when(F.col(f"has{d}") & within(d), F.lit(d)) for d in usable]))
    kept = F.array(*[F.when(within(d) & (F.col("_limit").isNull() | (F.lit(d) <= F.col("_limit"))), F.lit(d)) for d in usable])
    takes = left.groupBy("entry").agg(*some).withColumn("_cut", cut).withColumn("_limit", limit).select("entry", F.explode(F.array_compact(kept)).alias("dist"))
    takes = takes.join(asking, "entry").select("day", "dist", "entry")
    order = numbered_in_order(takes, [F.col("day"), F.col("dist"), F.col("entry")], ["day", "dist"])
    order = materialize(order.select("day", "dist", "entry", "_i"), "order")

    # Of the targets that may not have a file those at the head of the order are passed over.
    stops = barred.select(*pair, "dist").join(order, ["entry", "day", "dist"])
    place = F.row_number().over(Window.partitionBy("path", "sha", "day", "dist").orderBy("_i")) - 1
    passed = stops.withColumn("_place", place).groupBy("path", "sha", "day", "dist").agg(F.count_if(F.col("_i") == F.col("_place")).alias("_i"))
    passed = materialize(passed.join(order, ["day", "dist", "_i"], "left").select("path", "sha", "day", "dist", F.col("entry").alias("other"), yes.alias("_passed")), "passed")
    heads = materialize(order.filter("_i = 0").select("day", "dist", "entry"), "heads")
    best = F.min(F.struct("dist", "entry")).alias("best")
    of_day = at_days(heads.select(F.col("day").alias("asked"), F.col("dist").alias("at"), "entry"), "asked").filter("dist = at")
    of_day = materialize(of_day.groupBy(F.col("day").alias("file_day")).agg(best), "owners-of-days")
    touched = passed.select("path", "sha").distinct()
    plain = _same(single, touched, ["path", "sha"], "left_anti").join(of_day, "file_day").select("path", "best")
    closer = at_days(_same(single, touched, ["path", "sha"], "left_semi"), "file_day").select("path", "sha", "day", "dist")
    closer = closer.unionByName(several.select("path", "sha", "day", "dist"))
    closer = _same(closer, passed, ["path", "sha", "day", "dist"], "left").join(heads, ["day", "dist"], "left")
    closer = closer.withColumn("entry", F.when(F.col("_passed"), F.col("other")).otherwise(F.col("entry"))).filter("entry IS NOT NULL")
    owned = plain.unionByName(closer.select("path", F.struct("dist", "entry").alias("best"))).groupBy("path").agg(F.min("best").alias("best"))
    tier_at = F.array(*[F.lit(t).cast("int") for t in tier])
    found = owned.select(F.col("best.entry").alias("entry"), "path", F.col("best.dist").alias("day_distance"), F.get(tier_at, F.col("best.dist")).alias("tier"), F.lit("").alias("decision"))
    found = materialize(found, "owned")
    decided = mine.join(wanted.select("entry"), "entry", "left_semi").select("entry", "path", F.lit(None).cast("int").alias("day_distance"), F.lit(None).cast("int").alias("tier"), "decision")
    both = found.unionByName(decided)
    rows = wanted.join(both, "entry", "left").withColumn("placeholder", F.col("path").isNull())
    queue = materialize(rows, "queue")

    # Pairs are counted by days, not made.
    raw = at_days(dated.groupBy("file_day").agg(F.count(F.lit(1)).alias("n")), "file_day").groupBy("day").agg(F.sum("n").alias("n"))
    total = lambda t, by: (t.agg(F.sum(by)).first()[0] or 0)
    of = lambda t, *by: t.groupBy(*by).agg(F.count(F.lit(1)).alias("m"))
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dist"), F.col(f"n{d}").alias("n")) for d in range(reach + 1)])).alias("s")
    at_distance = sizes.select("day", each).select("day", "s.*")
    counters = {
        "targets": wanted.count(),
        "near": total(of(wanted, "day").join(raw, "day"), n * F.col("m")),
        "candidates": total(of(asking, "day").join(at_distance, "day"), n * F.col("m")) - barred.filter("kept").count(),
        "closest": total(of(order, "day", "dist").join(at_distance, ["day", "dist"]), n * F.col("m")) - stops.count(),
        "owned": found.count(),
        "queue": queue.count(),
    }

    hidden = barred.filter("hidden AND NOT kept").groupBy("day").agg(F.count(F.lit(1)).alias("hidden"))
    days = queue.groupBy("day").agg(F.count_distinct("entry").alias("entries"), F.count("path").alias("candidates")).join(hidden, "day", "left")
    hides = F.coalesce("hidden", F.lit(0).cast("long"))
    status = F.when(F.col("candidates") > 0, "needs_choice").when(hides > 0, "all_candidates_rejected").otherwise("no_external_candidates")
    days = materialize(days.select("day", "entries", "candidates", hides.alias("hidden"), status.alias("status")), "days")
    # A row for each day: a short list, whatever the number of entries.
    sessions = temporal.gap_sessions(days.withColumn("_all", F.lit(1)), ["_all"], "day", largest_gap, "batch")
    batches = sessions.groupBy("batch").agg(
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count(F.lit(1)).alias("days"),
        F.sum("entries").alias("entries"),
        F.sum("candidates").alias("candidates"),
        F.count_if(F.col("candidates") == 0).alias("days_without"),
        F.array_join(F.sort_array(F.collect_set("status")), ";").alias("statuses"),
    )
    batches = batches.select(F.format_string("B%03d", F.col("batch")).alias("batch_id"), *[c for c in batches.columns if c != "batch"])
    return Run(queue, days, batches, counters)
