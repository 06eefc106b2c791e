"""Graph operators: connected components and thread roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.storage import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) of every node of an edge, where the component is its smallest reachable node.

    Each round every node goes to the neighbour that comes first in an order drawn anew, or stays if it comes first itself;
    what went to one place is one node of the next round. About half the nodes are left each time, so all rounds
    together cost a few times the first, and their number is logarithmic for long chains as well. All joins have plain
    shuffled sides, which adaptive execution splits if one node has many edges or one component many members. Rounds are
    cut by tables in the shared folder; nothing but whether edges are left reaches the driver.
    Null ends and loops are ignored. Nodes without an edge are absent.
    """

    def distinct_pairs(x, y) -> DataFrame:
        return materialize(x.select(F.least(*y).alias("a"), F.greatest(*y).alias("b")).distinct(), "edges")

    left, levels = distinct_pairs(edges.filter(F.col(src) != F.col(dst)), (src, dst)), []
    for number in range(max_rounds):
        drawn = lambda c: F.xxhash64(c, F.lit(number))  # noqa: B023, E731
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = ends.groupBy("a").agg(F.min(drawn("b")).alias("least"), F.min_by("b", drawn("b")).alias("b"))
        goes = F.when(drawn("a") < F.col("least"), F.col("a")).otherwise(F.col("b"))
        levels.append(materialize(first.select(F.col("a").alias("node"), goes.alias("head")), "heads"))
        moved = left
        for end in ("a", "b"):
            moved = moved.join(levels[-1].select(F.col("node").alias(end), F.col("head").alias(f"{end}_head")), end)
        new = distinct_pairs(moved.filter("a_head <> b_head"), ("a_head", "b_head"))
        discard(left)
        left = new
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    passed, found = [left, *levels], levels.pop()
    while levels:
        further = found.select(F.col("node").alias("head"), F.col("head").alias("further"))
        found = levels.pop().join(further, "head", "left").select("node", F.coalesce("further", "head").alias("head"))
    found = materialize(found, "heads")
    least = found.groupBy("head").agg(F.min("node").alias("component"))
    out = materialize(found.join(least, "head").select("node", "component"), "components")
    for table in (*passed, found):
        discard(table)
    return out


def thread_roots(rows: DataFrame, identity: str, parent: str, max_rounds: int = 64) -> DataFrame:
    """(identity, root, depth): the topmost ancestor that is present.

    Pointers double each round, so a thread of n levels needs log2(n) rounds. A
    parent that is absent ends the thread. A cycle never ends and is an error.
    """
    from archivolt.storage import materialize

    known = rows.select(F.col(identity).alias("_p"))
    links = rows.select(F.col(identity), F.col(parent).alias("_p")).join(known, "_p", "left_semi")
    state = rows.select(identity).join(links, identity, "left").select(
        identity, F.coalesce("_p", identity).alias("root"), F.when(F.col("_p").isNull(), 0).otherwise(1).alias("depth")
    )
    state = materialize(state, "threads")
    total = state.count()
    for round_ in range(max_rounds):
        up = state.select(F.col(identity).alias("root"), F.col("root").alias("_up"), F.col("depth").alias("_more"))
        new = materialize(
            state.join(up, "root").select(identity, F.col("_up").alias("root"), (F.col("depth") + F.col("_more")).alias("depth")), "threads"
        )
        moved = new.join(state.select(identity, F.col("root").alias("_r")), identity).filter("root <> _r").limit(1).count()
        state = new
        if not moved:
            return state
        if 2**round_ > total:
            break
    raise ValueError("a thread has a cycle")


def elect_keepers(members: DataFrame, component: str, identity: str, order: list) -> DataFrame:
    """Per component the keeper: an existing one if single, else the first pending by ``order``.

    Members have booleans keeper, pending and edited. A component is a problem if it
    has several keepers, an edited member that is no keeper, or no keeper while any
    member was edited. Components without a pending member are left out.
    """
    keepers = F.count_if("keeper")
    return (
        members.groupBy(component)
        .agg(
            F.count(F.lit(1)).alias("size"),
            keepers.alias("n_keepers"),
            F.bool_or(F.col("edited") & ~F.col("keeper")).alias("_edited_other"),
            F.bool_or("pending").alias("_any_pending"),
            F.min(F.when(F.col("keeper"), F.col(identity))).alias("_kept"),
            F.min_by(F.when(F.col("pending"), F.col(identity)), F.when(F.col("pending"), F.struct(*order))).alias("_first"),
        )
        .filter("_any_pending AND size > 1")
        .select(
            component,
            "size",
            ((F.col("n_keepers") > 1) | F.col("_edited_other")).alias("problem"),
            F.when((F.col("n_keepers") > 1) | F.col("_edited_other"), None).otherwise(F.coalesce("_kept", "_first")).alias("keeper_id"),
        )
    )
