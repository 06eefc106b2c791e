"""Predicates, as columns that are combined with & and reach the scan where they can."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(*predicates: Column | None) -> Column:
    """The conjunction of the given predicates; true for none."""
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


def any_non_empty(*columns: str) -> Column:
    """Whether any column holds more than blanks."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.length(F.trim(c)) > 0, F.lit(False)) for c in columns])


def under_path(path: Column, root: str) -> Column:
    """The path itself or below it; wildcards of LIKE have no meaning here."""
    clean = root.rstrip("/")
    return (path == clean) | path.startswith(clean + "/")


def contains_term(term: str, *columns: str) -> Column:
    """Case-insensitive search over columns in which % and _ of the term are wildcards."""
    pattern = f"%{term.lower()}%"
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).like(pattern), F.lit(False)) for c in columns])


def contains_text(term: str, *columns: str) -> Column:
    """The same with the term taken literally."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False)) for c in columns])


def in_date_window(capture: Column, filesystem: Column, name_has_date: Column, target: Column, days: int) -> Column:
    """Capture dates decide; filesystem dates only where there is none and the name holds no date."""

    def near(dates: Column) -> Column:
        return F.coalesce(F.exists(dates, lambda d: F.abs(F.datediff(d, target)) <= days), F.lit(False))

    has_capture = F.coalesce(F.size(capture) > 0, F.lit(False))
    return F.when(has_capture, near(capture)).otherwise(~name_has_date & near(filesystem))


def not_the_target(candidate: dict[str, Column], target: dict[str, Column], allowed: Column) -> Column:
    """Whether a candidate differs from its target in every key, or is allowed. Null keys do not make them equal."""
    same = reduce(lambda a, b: a | b, [F.coalesce(candidate[k] == target[k], F.lit(False)) for k in candidate])
    return allowed | ~same


def without_rejected(candidates: DataFrame, rejected: DataFrame, entry: str, keys: list[str]) -> DataFrame:
    """Candidates that no earlier rejection of their entry names by any key: one anti join per key instead of an OR."""
    for key in keys:
        named = rejected.filter(F.col(key).isNotNull()).select(entry, key).distinct()
        candidates = candidates.join(named, [entry, key], "left_anti")
    return candidates


def best_date(rows: DataFrame, key: str, source: str, date: str, priority: list[str]) -> DataFrame:
    """(key, date, source) of the first source by priority, then the earliest date."""
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(source))
    known = rows.filter(F.col(source).isin(priority) & F.col(date).isNotNull())
    return known.groupBy(key).agg(F.min(F.struct(place.alias("p"), F.col(date).alias("d"), F.col(source).alias("s"))).alias("m")).select(
        key, F.col("m.d").alias(date), F.col("m.s").alias(source)
    )


def stale_rows(current: DataFrame, stored: DataFrame, key: str, versions: list[str]) -> DataFrame:
    """Current rows that are not stored with equal versions: what an incremental run has to process."""
    return current.join(stored.select(key, *versions), [key, *versions], "left_anti")


def triage(
    items: DataFrame,
    frames: DataFrame,
    key: str,
    *,
    first: str | None = None,
    last: str | None = None,
    date: str = "date",
    statuses: list[str] | None = None,
    status: str = "status",
    term: str | None = None,
    texts: tuple[str, ...] = (),
    least: float | None = None,
    most: float | None = None,
    amount: str = "amount",
    skip: list | None = None,
    with_frames: bool | None = None,
    without: Column | None = None,
) -> DataFrame:
    """Items that meet all of the filters that are given; ``without`` leaves out items that have such a frame.

    Filters of columns come first and reach the scan; those that ask for frames are semi and anti joins.
    """
    kept = items.filter(
        all_of(
            F.col(date) >= first if first else None,
            F.col(date) <= last if last else None,
            F.col(status).isin(statuses) if statuses else None,
            contains_text(term, *texts) if term else None,
            F.col(amount) >= least if least is not None else None,
            F.col(amount) <= most if most is not None else None,
            ~F.col(key).isin(skip) if skip else None,
        )
    )
    if with_frames is not None:
        kept = kept.join(frames.select(key), key, "left_semi" if with_frames else "left_anti")
    if without is not None:
        kept = kept.join(frames.filter(without).select(key), key, "left_anti")
    return kept
