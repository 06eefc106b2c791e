"""State changes of review tables: decisions, flags, work queues, child rows and ledgers.

Like ``upsert``, each function takes the present state and returns the new state of the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.operators.upsert import keyed_upsert, moved_rows, relink_paths


def latest_of(incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by an order: what an upsert takes of several."""
    rest = [c for c in incoming.columns if c not in key]
    picked = incoming.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*key, *[F.col("_r")[c].alias(c) for c in rest]).select(incoming.columns)


def replace_children(children: DataFrame, incoming: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """Child rows with those of the given parents taken out and put in anew."""
    return children.join(parents.select(*key).distinct(), key, "left_anti").unionByName(incoming.select(children.columns))


#: What each decision makes of a candidate: role, status, review status.
DECISIONS = {
    "select": ("original_reference", "available", "confirmed"),
    "reject": ("original_reference", "rejected", "rejected"),
    "keep_fallback": ("fallback_reference", "available", "confirmed"),
}


def decided_media(queue: DataFrame, entry: str, content: str, decision: str) -> DataFrame:
    """Canonical rows (id, entry, content, role, status, review_status) of the decided rows of a queue; others give none.

    The id is a digest of entry, content and role, so a decision that is taken again meets its own row.
    """
    table = F.create_map(*[x for d, v in DECISIONS.items() for x in (F.lit(d), F.array(*map(F.lit, v)))])
    held = queue.withColumn("_d", F.try_element_at(table, F.lower(F.trim(F.col(decision))))).filter("_d IS NOT NULL")
    names = [F.col("_d")[i].alias(n) for i, n in enumerate(("role", "status", "review_status"))]
    rows = held.select(F.col(entry).cast("string").alias("entry"), F.col(content).cast("string").alias("content"), *names).distinct()
    return rows.select(F.sha2(F.concat_ws("|", "entry", "content", "role").cast("binary"), 256).alias("id"), *rows.columns)


def undo(rows: DataFrame, undone: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose decision was not taken back."""
    return rows.join(undone.select(*key).distinct(), key, "left_anti")


def resolve_groups(items: DataFrame, choices: DataFrame, item: str, group: str) -> DataFrame:
    """Groups settled by a chosen keeper, as rows with ``review``, ``state`` and ``duplicate_of``.

    ``choices`` has group and keeper. Only groups in the state ``problem`` of at least two members that hold their
    keeper are settled: it is taken back from rejection, all others are rejected as its duplicates.
    """
    open_ = items.filter("state = 'problem'").join(choices, group)
    fine = open_.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.bool_or(F.col(item) == F.col("keeper")).alias("_held")).filter("_n > 1 AND _held")
    settled = choices.join(fine.select(group), group, "left_semi").withColumnRenamed("keeper", "_keeper")
    joined = items.join(settled, group, "left")
    mine = (F.col("state") == "problem") & F.col("_keeper").isNotNull()
    keeper = mine & (F.col(item) == F.col("_keeper"))
    return joined.select(
        *[c for c in items.columns if c not in ("review", "state")],
        F.when(keeper & (F.col("review") == "rejected"), "pending").when(mine & ~keeper, "rejected").otherwise(F.col("review")).alias("review"),
        F.when(keeper, "keeper").when(mine, "auto_rejected").otherwise(F.col("state")).alias("state"),
        F.when(mine & ~keeper, F.col("_keeper")).alias("duplicate_of"),
    )


def apply_selection(frames: DataFrame, changes: DataFrame, frame: str, parent: str) -> DataFrame:
    """Frames with ``selected``, ``main`` and ``status`` after changes (frame, wanted).

    A deselected frame is no main frame and leaves the queue. A parent without a main frame takes the first of its
    newly selected ones, so that it never has two.
    """
    joined = frames.join(changes, frame, "left")
    off, on = F.col("wanted") == F.lit(False), F.coalesce(F.col("wanted"), F.lit(False))
    moved = joined.select(
        *[c for c in frames.columns if c not in ("selected", "main", "status")],
        F.coalesce("wanted", "selected").alias("selected"),
        F.when(off, False).otherwise(F.col("main")).alias("main"),
        F.when(off & (F.col("status") == "queued"), "not_queued").otherwise(F.col("status")).alias("status"),
        on.alias("_new"),
    )
    heads = moved.groupBy(parent).agg(F.bool_or("main").alias("_has"), F.min(F.when(F.col("_new"), F.col(frame))).alias("_first"))
    first = (~F.col("_has")) & (F.col(frame) == F.col("_first"))
    return moved.join(heads, parent).withColumn("main", F.col("main") | F.coalesce(first, F.lit(False))).select(frames.columns)


def queue_selected(frames: DataFrame) -> DataFrame:
    """Selected frames that wait or failed are queued; queued ones that are no longer selected are not."""
    status = F.col("status")
    leave, enter = ~F.col("selected") & (status == "queued"), F.col("selected") & status.isin("not_queued", "error")
    return frames.withColumn("status", F.when(leave, "not_queued").when(enter, "queued").otherwise(status))


def claim(frames: DataFrame, order: list[Column], limit: int, key: str) -> DataFrame:
    """The first ``limit`` queued frames become ``rendering``; the list of claimed keys is as short as the limit."""
    claimed = frames.filter("status = 'queued'").orderBy(*order).limit(limit).select(key, F.lit(True).alias("_claimed"))
    held = frames.join(claimed, key, "left")
    return held.withColumn("status", F.when(F.col("_claimed"), "rendering").otherwise(F.col("status"))).drop("_claimed")


def finish(frames: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Rendering frames with a result (key, error) are ``rendered``, or ``error`` with the message; others stay."""
    held = frames.join(results.select(key, F.col("error").alias("_error"), F.lit(True).alias("_done")), key, "left")
    done = F.col("_done") & (F.col("status") == "rendering")
    return held.select(
        *[c for c in frames.columns if c not in ("status", "error")],
        F.when(done & F.col("_error").isNull(), "rendered").when(done, "error").otherwise(F.col("status")).alias("status"),
        F.when(done, F.coalesce(F.substring("_error", 1, 500), F.lit(""))).otherwise(F.col("error")).alias("error"),
    ).select(frames.columns)


def deselect_all_but_main(frames: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """Frames of the given parents that are not the main one are deselected, and leave the queue if they were selected."""
    held = frames.join(parents.select(parent, F.lit(True).alias("_named")).distinct(), parent, "left")
    goes = F.col("_named").isNotNull() & ~F.col("main") & F.col("selected")
    status = F.when(goes & (F.col("status") == "queued"), "not_queued").otherwise(F.col("status"))
    return held.withColumns({"status": status, "selected": F.col("selected") & ~goes}).select(frames.columns)


def set_main(frames: DataFrame, chosen: DataFrame, key: str, parent: str) -> DataFrame:
    """The chosen frames (key, parent; one for a parent) become selected and main; no other frame of their parents stays main."""
    held = frames.join(chosen.select(parent, F.col(key).alias("_chosen")), parent, "left")
    here = F.coalesce(F.col(key) == F.col("_chosen"), F.lit(False))
    return held.withColumns({"selected": F.col("selected") | here, "main": F.when(F.col("_chosen").isNull(), F.col("main")).otherwise(here)}).select(frames.columns)


def requeue_errors(frames: DataFrame, accepted: DataFrame, parent: str) -> DataFrame:
    """Failed frames that are still selected and whose parent is accepted go back to the queue."""
    held = frames.join(accepted.select(parent, F.lit(True).alias("_accepted")).distinct(), parent, "left")
    again = (F.col("status") == "error") & F.col("selected") & F.col("_accepted").isNotNull()
    return held.withColumns({"error": F.when(again, "").otherwise(F.col("error")), "status": F.when(again, "queued").otherwise(F.col("status"))}).select(frames.columns)


def run_ledger(events: DataFrame, run: list[str], at: str, counters: dict[str, Column], failed: Column) -> DataFrame:
    """One row per run: its start, last sign of life, counters and status."""
    return events.groupBy(*run).agg(
        F.min(at).alias("started_at"),
        F.max(at).alias("heartbeat_at"),
        *[F.count_if(c).alias(n) for n, c in counters.items()],
        F.when(F.bool_or(failed), "failed").otherwise("finished").alias("status"),
    )


def index_run(stored: DataFrame, scanned: DataFrame, path: str, content: list[str], versions: list[str]) -> tuple[DataFrame, DataFrame]:
    """The index after a scan, and one row of counters.

    Rows with equal versions are skipped, vanished paths whose content turned up elsewhere move, changed and new paths
    are taken, and paths that the scan did not see go.
    """
    moves = moved_rows(stored, scanned, path, content)
    moved = relink_paths(stored, moves, path)
    fresh = scanned.join(moved.select(path, *versions), [path, *versions], "left_anti")
    state = keyed_upsert(moved, fresh, [path]).join(scanned.select(path), path, "left_semi")
    gone = moved.join(scanned.select(path), path, "left_anti")
    parts = [df.agg(F.count(F.lit(1)).alias(n)) for n, df in (("scanned", scanned), ("taken", fresh), ("moved", moves), ("pruned", gone))]
    counters = parts[0]
    for part in parts[1:]:
        counters = counters.crossJoin(F.broadcast(part))  # one row each
    return state, counters.withColumn("skipped", F.col("scanned") - F.col("taken"))


def state_document(entries: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, record) with the given fields as JSON text, nulls left out."""
    return entries.select(key, F.to_json(F.struct(*fields)).alias("record"))


def merged_documents(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Flat JSON records with the fields of the changes put over those stored; changes with a null record clear their key."""
    kind = "map<string,string>"
    both = stored.join(changes.select(key, F.col("record").alias("_new"), F.lit(True).alias("_here")), key, "full")
    old, new = F.coalesce(F.from_json("record", kind), F.create_map().cast(kind)), F.from_json("_new", kind)
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    merged = F.when(F.col("_here").isNull(), F.col("record")).otherwise(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, new))))))
    return both.filter("_here IS NULL OR _new IS NOT NULL").select(key, merged.alias("record"))


def first_per_predicate(rows: DataFrame, predicates: dict[str, Column], order: list[str]) -> DataFrame:
    """(name, and the columns) of the first row by the order that each predicate holds for; rows may serve several."""
    parts = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in predicates.items()]))
    named = rows.select(*rows.columns, F.explode(parts).alias("name"))
    picked = named.groupBy("name").agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"))
    return picked.select("name", *[F.col("_r")[c].alias(c) for c in rows.columns])


def cached_or_computed(rows: DataFrame, cache: DataFrame, key: list[str], value: Column, name: str) -> DataFrame:
    """Rows with a value from the cache where its key (with all versions) is held, else computed anew; adds ``cached``."""
    held = rows.join(cache.select(*key, F.col(name).alias("_held"), F.lit(True).alias("_there")), key, "left")
    known = F.coalesce("_there", F.lit(False))
    return held.select(*rows.columns, F.when(known, F.col("_held")).otherwise(value).alias(name), known.alias("cached"))


def overwrite_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write rows so that only the partitions which they have are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def numbered(rows: DataFrame, key: list[str], order: list[Column], name: str = "place") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
