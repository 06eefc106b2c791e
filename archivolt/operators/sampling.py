"""Samples of ordered sets with fixed shares: spread within strata, refilled where a stratum is short, and best of strata without reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.operators.ranking import bounded_top
from archivolt.storage import materialize


def numbered_in_order(rows: DataFrame, order: list[Column], key: list[str] | None = None, ranges: int = 0) -> DataFrame:
    """Adds ``_i``, the place of a row in the order from 0, and ``_n``, the number of rows, of each key or of all.

    Rows are dealt to ranges of the order; places inside a range are offset by the rows of the ranges before. No task
    holds a key or the whole table, however few keys there are. The order must end in a unique column.
    """
    key = key or []
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*(key or [F.lit(1)]))  # a row for each range
    offsets = sizes.select(
        *key,
        "_part",
        F.coalesce(F.sum("_rows").over(before.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_rows").over(before).alias("_n"),
    )
    inside = F.row_number().over(Window.partitionBy(*key, "_part").orderBy(*order)) - 1
    numbered = dealt.withColumn("_inside", inside).join(offsets, [*key, "_part"])
    return numbered.withColumn("_i", F.col("_inside") + F.col("_before")).drop("_inside", "_before", "_part")


def spread_places(n: int, k: int) -> list[int]:
    """Places of k of n ordered rows at even steps from first to last, rounded half to even; of one the middle."""
    if k <= 0 or n <= 0:
        return []
    if k >= n:
        return list(range(n))
    return [n // 2] if k == 1 else sorted({round(j * (n - 1) / (k - 1)) for j in range(k)})


def shares(weights: dict[str, float], total: int) -> dict[str, int]:
    """Largest-remainder quotas of ``total``; of equal remainders the first name."""
    whole = sum(weights.values())
    exact = {name: total * w / whole for name, w in weights.items()}
    out = {name: int(x) for name, x in exact.items()}
    rest = sorted(weights, key=lambda name: -(exact[name] - out[name]))
    for name in rest[: total - sum(out.values())]:
        out[name] += 1
    return out


def _at(numbered: DataFrame, places: dict[str | None, list[int]], key: str | None) -> DataFrame:
    """Rows at the given places; there are as many as the sample has."""
    spark = numbered.sparkSession
    listed = [(name, i) for name, held in places.items() for i in held]
    if key is None:
        return numbered.join(spark.createDataFrame([(i,) for _, i in listed], "_i long"), "_i", "left_semi")
    return numbered.join(spark.createDataFrame(listed, f"`{key}` string, _i long"), [key, "_i"], "left_semi")


def weighted_sample(rows: DataFrame, stratum: str, weights: dict[str, float], order: list[Column], identity: str, total: int) -> DataFrame:
    """``total`` rows: each stratum's quota spread over its rows, and what short strata lack spread over all rows not taken.

    Adds ``refilled``. Strata without a weight only serve to refill. An error where there are fewer rows than ``total``.
    """
    numbered = materialize(numbered_in_order(rows, order, [stratum]), "numbered")
    held = {r[stratum]: r["_n"] for r in numbered.filter(F.col(stratum).isin(list(weights))).select(stratum, "_n").distinct().collect()}
    places = {name: spread_places(held.get(name, 0), quota) for name, quota in shares(weights, total).items()}
    taken = materialize(_at(numbered, places, stratum).select(*rows.columns), "taken")
    lacking = total - sum(map(len, places.values()))
    if not lacking:
        return taken.withColumn("refilled", F.lit(False))
    unused = rows.join(taken.select(identity), identity, "left_anti")
    n = unused.count()
    if n < lacking:
        raise ValueError("the sample is larger than the table")
    refill = _at(numbered_in_order(unused, order), {None: spread_places(n, lacking)}, None).select(*rows.columns)
    return taken.withColumn("refilled", F.lit(False)).unionByName(refill.withColumn("refilled", F.lit(True)))


def best_of_strata(rows: DataFrame, strata: list[tuple[Column, list[Column]]], identity: str, order: list[Column], total: int) -> DataFrame:
    """(stratum, identity): of each stratum, a condition and an order, its first row that no stratum before took; where strata
    are empty, rows of an even spread over all in ``order`` that are not taken fill up to ``total`` (stratum null).

    A stratum needs at most as many first rows as there are strata, which is all that reaches the driver. An error where
    the spread does not fill up.
    """
    spark = rows.sparkSession
    kinds = [F.struct(F.lit(i).alias("stratum"), F.array(*[c.cast("double") for c in key]).alias("by")) for i, (_, key) in enumerate(strata)]
    fitting = F.array_compact(F.array(*[F.when(condition, kind) for (condition, _), kind in zip(strata, kinds, strict=True)]))
    listed = rows.select(identity, F.explode(fitting).alias("s")).select(identity, "s.stratum", "s.by")
    first = bounded_top(listed, ["stratum"], [F.col("by"), F.col(identity)], len(strata), F.col(identity))
    taken: dict = {}
    for r in sorted(first.collect(), key=lambda r: (r.stratum, r.by, r[identity])):
        if r.stratum not in taken and r[identity] not in taken.values():
            taken[r.stratum] = r[identity]
    out: list[tuple] = sorted(taken.items())
    if len(out) < total:
        numbered = materialize(numbered_in_order(rows.select("*"), order), "numbered")
        spread = _at(numbered, {None: spread_places(numbered.count(), total)}, None)
        for r in sorted(spread.select(identity, "_i").collect(), key=lambda r: r["_i"]):
            if len(out) < total and r[identity] not in taken.values():
                out.append((None, r[identity]))
    if len(out) < total:
        raise ValueError(f"only {len(out)} rows can be selected")
    return spark.createDataFrame(out, f"stratum int, {identity} {dict(rows.dtypes)[identity]}")
