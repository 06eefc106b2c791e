"""Roll-ups of runs, attempts, packages and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_values(text: Column) -> Column:
    """A map of the lines ``key: value`` of a log, the last of a key."""
    pairs = F.filter(
        F.transform(F.split(text, "\n"), lambda line: F.struct(F.trim(F.regexp_extract(line, r"^\s*([A-Za-z0-9_ ]+?)\s*:\s*(.*)$", 1)).alias("k"), F.trim(F.regexp_extract(line, r"^\s*([A-Za-z0-9_ ]+?)\s*:\s*(.*)$", 2)).alias("v"))),
        lambda p: p["k"] != "",
    )
    last = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"])) == 0)
    return F.map_from_entries(last)


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, versions: list[str]) -> DataFrame:
    """Rows after a run with ``status``: new/imported, changed/re-imported or unchanged/skipped."""
    old = before.select(key, *[F.col(v).alias(f"_{v}") for v in versions], F.lit(True).alias("_there"))
    same = F.lit(True)
    for v in versions:
        same = same & F.col(v).eqNullSafe(F.col(f"_{v}"))
    status = F.when(F.col("_there").isNull(), "new/imported").when(same, "unchanged/skipped").otherwise("changed/re-imported")
    return after.join(old, key, "left").select(*after.columns, status.alias("status"))


def next_step(candidates: Column, rejected: Column, equal: Column, attempts: Column) -> Column:
    """What a person should do with a batch."""
    again = F.lit("Try another folder or keep fallback")
    return F.when(candidates > 0, "Review candidates").when((rejected > 0) | (equal > 0), again).when(attempts == 0, "Choose folder").otherwise("Try another folder")


def first_and_more(values: Column, n: int = 5) -> Column:
    """The first values of a list, and how many more there are."""
    shown = F.array_join(F.slice(values, 1, n), ", ")
    return F.when(F.size(values) > n, F.concat(shown, F.lit(" +"), (F.size(values) - n).cast("string"), F.lit(" more"))).otherwise(shown)


def planned_batch(ranked: DataFrame, failed: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n of a ranking that did not fail: those that failed are replaced by the next in line."""
    return ranked.join(failed.select(key), key, "left_anti").orderBy(*order).limit(n)


def chosen_time(options: dict[str, Column]) -> Column:
    """Struct of timestamp and source: the first given of several, in order."""
    source = F.coalesce(*[F.when(c.isNotNull(), n) for n, c in options.items()])
    return F.struct(F.coalesce(*options.values()).alias("timestamp"), F.coalesce(source, F.lit("none")).alias("source"))
