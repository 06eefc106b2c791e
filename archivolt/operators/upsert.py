"""Keyed upserts and state changes, as DataFrame to DataFrame functions.

Plain Parquet tables have no MERGE; each function returns the new state of the
whole table, to be written to a new folder or partition. With a table format
that merges, the same keys and conditions go into its statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_upsert(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``incoming`` replace or join those of ``current``. Keys are unique on both sides."""
    return current.join(incoming, key, "left_anti").unionByName(incoming.select(current.columns))


def guarded_upsert(current: DataFrame, incoming: DataFrame, key: list[str], keep_current: Column) -> DataFrame:
    """As ``keyed_upsert``, but rows of ``current`` with ``keep_current`` are never overwritten."""
    guarded = current.filter(keep_current)
    return keyed_upsert(current, incoming.join(guarded, key, "left_anti"), key)


def soft_delete_sync(current: DataFrame, incoming: DataFrame, key: str, fingerprint: str, now: Column) -> DataFrame:
    """State of a review table after a full sync.

    Keys that are gone become inactive. A changed fingerprint takes the new row,
    resets ``reviewed`` and sets ``updated_at``; an unchanged one keeps both.
    Both tables have key and fingerprint; ``current`` also active, reviewed, updated_at.
    """
    old, new = current.alias("o"), incoming.alias("n")
    there, here = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    same = there & here & F.col(f"o.{fingerprint}").eqNullSafe(F.col(f"n.{fingerprint}"))
    extra = [c for c in current.columns if c not in (key, fingerprint, "active", "reviewed", "updated_at")]
    return old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(
        F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key),
        F.when(here, F.col(f"n.{fingerprint}")).otherwise(F.col(f"o.{fingerprint}")).alias(fingerprint),
        *[(F.when(here, F.col(f"n.{c}")) if c in incoming.columns else F.when(here, F.col(f"o.{c}"))).otherwise(F.col(f"o.{c}")).alias(c) for c in extra],
        here.alias("active"),
        F.when(same | ~here, F.coalesce(F.col("o.reviewed"), F.lit(False))).otherwise(False).alias("reviewed"),
        F.when(same | ~here, F.col("o.updated_at")).otherwise(now).alias("updated_at"),
    )


def moved_rows(current: DataFrame, scanned: DataFrame, path: str, content: list[str]) -> DataFrame:
    """(old_path, new_path) of new paths whose content a vanished path had; the k-th old pairs with the k-th new one."""
    gone = current.join(scanned.select(path), path, "left_anti").select(*content, F.col(path).alias("old_path"))
    fresh = scanned.join(current.select(path), path, "left_anti").select(*content, F.col(path).alias("new_path"))
    gone = gone.withColumn("_n", F.row_number().over(Window.partitionBy(*content).orderBy("old_path")))
    fresh = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(*content).orderBy("new_path")))
    return gone.join(fresh, [*content, "_n"]).select("old_path", "new_path")


def relink_paths(rows: DataFrame, moves: DataFrame, path: str) -> DataFrame:
    """Dependent rows with moved paths renamed."""
    renamed = moves.select(F.col("old_path").alias(path), F.col("new_path").alias("_new"))
    return rows.join(renamed, path, "left").withColumn(path, F.coalesce("_new", path)).drop("_new").select(rows.columns)


def prune_unseen(current: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose keys were seen."""
    return current.join(seen.select(*key), key, "left_semi")


def outermost_roots(roots: DataFrame, root: str) -> DataFrame:
    """(root, outermost): each root with its shortest ancestor among the roots, itself included.

    Ancestors come from the parts of the root's own path, so the join is an equi-join.
    """
    parts = F.split(F.col(root), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))
    spread = roots.select(F.col(root), F.explode(ancestors).alias("_a"))
    known = roots.select(F.col(root).alias("_a")).distinct()
    return spread.join(known, "_a").groupBy(root).agg(F.min_by("_a", F.length("_a")).alias("outermost"))


def guarded_transition(rows: DataFrame, status: str, allowed: dict[str, list[str]], wanted: Column) -> DataFrame:
    """Set ``status`` to ``wanted`` where the present status allows it; adds ``changed``."""
    may = F.lit(False)
    for present, targets in allowed.items():
        may = may | ((F.col(status) == present) & wanted.isin(targets))
    return rows.withColumn("changed", F.coalesce(may, F.lit(False))).withColumn(status, F.when(F.col("changed"), wanted).otherwise(F.col(status)))


def staged_over_stored(stored: DataFrame, staged: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Stored rows with staged values where there are any; staged-only keys are added."""
    new = staged.select(*key, *[F.col(v).alias(f"_{v}") for v in values])
    return stored.join(new, key, "full").select(*key, *[F.coalesce(f"_{v}", v).alias(v) for v in values])


def is_permutation(current: Column, proposed: Column) -> Column:
    """Whether a proposed order holds exactly the current elements."""
    return F.array_sort(current) == F.array_sort(proposed)
