"""Ranking, top-k, sampling and single assignment. Every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.storage import materialize


def rank_with_gap(rows: DataFrame, key: list[str], score: Column, order: list[Column], digits: int = 6) -> DataFrame:
    """``rank`` by the score rounded half to even, then ``order``; ``gap_to_best`` in the score."""
    rounded = F.bround(score, digits)
    return rows.withColumns(
        {
            "rank": F.row_number().over(Window.partitionBy(*key).orderBy(rounded, *order)),
            "gap_to_best": score - F.min(score).over(Window.partitionBy(*key)),
        }
    )


def first_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return top_k(rows, key, order, 1)


def top_k(rows: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; the limit reaches the window, which keeps k rows per partition before its shuffle."""
    window = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= k).drop("_n")


def likely_candidates(rows: DataFrame, key: list[str], score: str, order: list[Column], k: int, least_group: int) -> DataFrame:
    """Rank scored rows of groups with more than ``least_group`` rows; rank at most k is likely. Null scores stay unranked."""
    window = Window.partitionBy(*key)
    scored = F.col(score).isNotNull()
    rank = F.row_number().over(window.orderBy(F.col(score).asc_nulls_last(), *order))
    large = F.count(F.lit(1)).over(window) > least_group
    return rows.withColumns(
        {
            "visual_rank": F.when(scored & large, rank),
            "likely": F.coalesce(F.when(scored & large, rank <= k), F.lit(False)),
        }
    )


def single_assignment(rows: DataFrame, candidate: str, order: list[Column]) -> DataFrame:
    """Each candidate stays with the first of its rows; adds ``assigned``."""
    window = Window.partitionBy(candidate).orderBy(*order)
    return rows.withColumn("assigned", F.row_number().over(window) == 1)


def spread_sample(rows: DataFrame, key: list[str], order: list[Column], k: Column) -> DataFrame:
    """k rows of each ordered group at even steps from first to last; indices round half to even.

    Groups of at most k rows stay whole. Indices are computed per row from its
    number and the group's size, so nothing is collected.
    """
    window = Window.partitionBy(*key)
    numbered = rows.withColumns(
        {
            "_i": F.row_number().over(window.orderBy(*order)) - 1,
            "_n": F.count(F.lit(1)).over(window),
            "_k": k.cast("int"),
        }
    )
    wanted = F.when(F.col("_k") <= 0, F.array().cast("array<bigint>")).when(F.col("_k") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.col("_k") - 1, F.lit(0))),
            lambda j: F.bround(j * (F.col("_n") - 1) / F.greatest(F.col("_k") - 1, F.lit(1)), 0).cast("long"),
        )
    )
    chosen = (F.col("_n") <= F.col("_k")) | F.array_contains(wanted, F.col("_i").cast("long"))
    return numbered.filter(chosen).drop("_i", "_n", "_k")


def largest_remainder(sizes: DataFrame, stratum: str, weight: Column, total: int) -> DataFrame:
    """(stratum, quota): shares of ``total`` by weight, the rest to the largest remainders, ties by stratum.

    One row per stratum; a window over all of them is a window over a short list.
    """
    everything = Window.partitionBy(F.lit(1))
    exact = F.lit(total) * weight / F.sum(weight).over(everything)
    parts = sizes.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    rest = F.lit(total) - F.sum("_floor").over(everything)
    place = F.row_number().over(everything.orderBy((F.col("_exact") - F.col("_floor")).desc(), stratum))
    return parts.withColumn("quota", (F.col("_floor") + F.when(place <= rest, 1).otherwise(0)).cast("int")).drop("_exact", "_floor")


def stratified_sample(rows: DataFrame, stratum: str, order: list[Column], total: int) -> DataFrame:
    """A spread sample of each stratum with quotas in proportion to the strata's sizes."""
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))
    quotas = largest_remainder(sizes, stratum, F.col("_size"), total).select(stratum, "quota")
    return spread_sample(rows.join(quotas, stratum), [stratum], order, F.col("quota"))


def chunk_list(rows: DataFrame, key: list[str], order: list[Column], size: int) -> DataFrame:
    """Cut ordered groups into parts of ``size``: adds ``part``, ``parts`` and ``place`` in the part, from 1."""
    window = Window.partitionBy(*key)
    i = F.row_number().over(window.orderBy(*order)) - 1
    return rows.withColumns(
        {
            "part": (F.floor(i / size) + 1).cast("int"),
            "parts": F.ceil(F.count(F.lit(1)).over(window) / size).cast("int"),
            "place": (i % size + 1).cast("int"),
        }
    )


def occurrence(rows: DataFrame, content: list[str], order: list[Column], name: str = "occurrence") -> DataFrame:
    """Number the rows of equal content from 0."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*content).orderBy(*order)) - 1)


def bounded_top(rows: DataFrame, key: list[str], order: list[Column], k: int, spread: Column, parts: int = 64) -> DataFrame:
    """The first k rows of each key, cut in parts of a key before the key as a whole, so that no task sorts a hot one.

    ``spread`` deals the rows of a key to parts; it should tell them apart.
    """
    part = F.pmod(F.xxhash64(spread), F.lit(parts))
    first = F.row_number().over(Window.partitionBy(*key, "_part").orderBy(*order))
    again = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    cut = rows.withColumn("_part", part).withColumn("_n", first).filter(F.col("_n") <= k).drop("_part")
    return cut.withColumn("_n", again).filter(F.col("_n") <= k).drop("_n")


def agreed_pick(rows: DataFrame, key: list[str], priority: Column, values: list[str]) -> DataFrame:
    """Per key the values of the first priority, or none if any row's values are null or not close to them.

    Close: within 1e-6, or 1e-9 of the larger magnitude. Ties of priority go to the smallest values. The values
    farthest from the picked ones are the least and the largest, which combine before the shuffle.
    """
    ends = [f(F.col(v)).alias(f"_{n}_{v}") for v in values for n, f in (("low", F.min), ("high", F.max))]
    picked = rows.groupBy(*key).agg(
        F.min_by(F.struct(*values), F.struct(priority, *values)).alias("_p"), *ends, F.bool_and(F.concat(*values).isNotNull()).alias("_given")
    )
    close = F.col("_given")
    for v in values:
        for end in (F.col(f"_low_{v}"), F.col(f"_high_{v}")):
            b = F.col("_p")[v]
            close = close & (F.abs(end - b) <= F.greatest(F.lit(1e-6), 1e-9 * F.greatest(F.abs(end), F.abs(b))))
    return picked.filter(close).select(*key, *[F.col("_p")[v].alias(v) for v in values])


def spaced_top_k(rows: DataFrame, key: str, index: str, score: str, k: int, least_gap: int) -> DataFrame:
    """Greedy best k of each group whose indices lie at least ``least_gap`` apart; higher scores first, then lower index.

    One round per place: a grouped maximum, which combines before the shuffle, and a join that drops what is too near.
    """
    left, picks = rows.select(key, F.col(index).cast("long").alias(index), score), None
    for place in range(k):
        best = left.groupBy(key).agg(F.max_by(index, F.struct(score, -F.col(index))).alias("_best"))
        best = materialize(best, "picks")
        found = best.select(key, F.lit(place).alias("place"), F.col("_best").alias(index))
        picks = found if picks is None else picks.unionByName(found)
        left = left.join(best, key).filter(F.abs(F.col(index) - F.col("_best")) >= least_gap).drop("_best")
    return picks


def unique_names(rows: DataFrame, identity: str, options: list[Column]) -> DataFrame:
    """Give each row the first of its options that no other row shares at that level, else the last one.

    Names taken at an earlier level are not given again at a later one, except as the last option.
    """
    left, given = rows.select(identity, *[o.alias(f"_o{i}") for i, o in enumerate(options)]), None
    for i in range(len(options)):
        last = i == len(options) - 1
        n = F.count(F.lit(1)).over(Window.partitionBy(f"_o{i}"))
        level = left.withColumn("_n", n)
        if given is not None and not last:
            level = level.join(given.select(F.col("name").alias(f"_o{i}"), F.lit(True).alias("_taken")).distinct(), f"_o{i}", "left")
        else:
            level = level.withColumn("_taken", F.lit(None).cast("boolean"))
        free = F.lit(True) if last else (F.col("_n") == 1) & F.col("_taken").isNull()
        done = level.filter(free).select(identity, F.col(f"_o{i}").alias("name"), F.lit(i).alias("level"))
        given = done if given is None else given.unionByName(done)
        left = left.join(done.select(identity), identity, "left_anti")
    return given
