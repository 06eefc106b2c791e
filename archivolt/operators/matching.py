"""Matching by several keys at once, with additive evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of each kind of evidence that two media files are the same.
EVIDENCE_POINTS = {
    "exact_hash_size_match": 100,
    "normalized_stem_match": 35,
    "capture_timestamp_within_tolerance": 30,
    "duration_within_tolerance": 25,
    "dimensions_match": 20,
    "capture_date_match": 15,
    "orientation_match": 8,
    "extension_match": 5,
    "gps_presence_match": 3,
    "source_root_match": 2,
}


def any_key_pairs(left: DataFrame, right: DataFrame, rules: Sequence[Sequence[tuple[Column, Column]]], left_id: str, right_id: str) -> DataFrame:
    """Distinct (left_id, right_id) that agree on all keys of at least one rule.

    Each rule is one equi-join on its keys, so an OR of conditions never becomes
    a nested loop; array keys are exploded. Null keys match nothing. Ids must
    have different names.
    """
    found = None
    for number, rule in enumerate(rules):
        names = [f"_k{number}_{i}" for i in range(len(rule))]

        def keyed(df: DataFrame, side: int, identity: str, rule=rule, names=names) -> DataFrame:
            out = df.select(identity, *[pair[side].alias(n) for pair, n in zip(rule, names, strict=True)])
            for name, kind in out.dtypes[1:]:
                if kind.startswith("array"):
                    out = out.withColumn(name, F.explode(F.array_distinct(name)))
            return out

        pairs = keyed(left, 0, left_id).join(keyed(right, 1, right_id), names).select(left_id, right_id)
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def additive_score(evidence: dict[str, Column], points: dict[str, int] = EVIDENCE_POINTS) -> tuple[Column, Column]:
    """(score, reasons): the points of the evidence that holds, and its names in order."""
    score, reasons = F.lit(0), []
    for name, holds in evidence.items():
        given = F.coalesce(holds, F.lit(False))
        score = score + F.when(given, points[name]).otherwise(0)
        reasons.append(F.when(given, name))
    return score, F.array_compact(F.array(*reasons))


def accept(scored: DataFrame, threshold: int, anchors: Sequence[str]) -> DataFrame:
    """Pairs that reach the threshold and hold at least one anchor among their reasons."""
    held = F.arrays_overlap("reasons", F.array(*[F.lit(a) for a in anchors]))
    return scored.filter((F.col("score") >= threshold) & held)


def cluster_sides(components: DataFrame) -> DataFrame:
    """Per component its numbers of left and right members, and whether it is ambiguous (not one to one).

    ``components`` has a row (node, component) for each node, named as in ``left_node`` and ``right_node``.
    """
    right = F.col("node") % 2 != 0
    return (
        components.groupBy("component")
        .agg(F.count_if(~right).alias("n_left"), F.count_if(right).alias("n_right"))
        .withColumn("ambiguous", (F.col("n_left") != 1) | (F.col("n_right") != 1))
    )


def left_node(name: str) -> Column:
    return F.col(name).cast("long") * 2


def right_node(name: str) -> Column:
    return F.col(name).cast("long") * 2 + 1


def unique_bipartite_matching(edges: DataFrame, group: str, left: str, right: str) -> DataFrame:
    """(group, left, right) of the perfect matching of each group, if it has exactly one.

    A bipartite graph with exactly one perfect matching has a node with one edge, and what is left without the two
    nodes of that edge has one again; so taking such edges until none is left finds it, in linear time, or there is
    none or several, and the group gives no row.
    """
    import pyarrow as pa

    def solve(pairs: list[dict]) -> list[dict]:
        near: dict = {}
        for pair in pairs:
            for x, y in ((("a", pair["a"]), ("b", pair["b"])), (("b", pair["b"]), ("a", pair["a"]))):
                near.setdefault(x, set()).add(y)
        single, out = [x for x, ys in near.items() if len(ys) == 1], []
        while single:
            x = single.pop()
            if x not in near or len(near[x]) != 1:
                continue
            (y,) = near.pop(x)
            out.append({x[0]: x[1], y[0]: y[1]})
            for z in near.pop(y) - {x}:
                near[z].discard(y)
                if len(near[z]) == 1:
                    single.append(z)
                elif not near[z]:
                    return []
        return [] if near else out

    grouped = edges.groupBy(group).agg(F.collect_set(F.struct(F.col(left).alias("a"), F.col(right).alias("b"))).alias("pairs"))
    kinds = dict(grouped.dtypes)

    def run(batches):
        for batch in batches:
            kind = batch.schema.field(1).type
            solved = pa.array([solve(x) for x in batch.column(1).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), solved], [group, "pairs"])

    matched = grouped.mapInArrow(run, f"{group} {kinds[group]}, pairs {kinds['pairs']}")
    return matched.select(group, F.explode("pairs").alias("p")).select(group, F.col("p.a").alias(left), F.col("p.b").alias(right))
