"""Operator 13: exact top-k by inner product with a dual-tree search over cover trees.

Vectors are rounded down to integers after scaling. Equal vectors are one node that keeps its k + 1 smallest ids, for no
more of them can be returned. The top of a cover tree over a bounded sample gives cells; a cell's nodes are cut to shards of
bounded size, and each shard is a cover tree of its own: every node covers its points within a radius, and its children
are a net of them by farthest-first traversal, so that their centres are at least their radius apart; the node's own centre
is one of them. Queries of a cell form groups, which are trees likewise.

A pair of a group of queries around p within r and data around c within s has no product above <p, c> + |p| s + |c| r + r s.
Pairs of nodes are taken by that bound, the highest first, and left out where it is below the worst (k + 1)-th score of the
group's queries. Each group is first searched in a shard of its own cell; the scores found there are its bounds for all
other cells (whose centres, radii and numbers of shards are broadcast, at most ``SAMPLE_VALUES`` numbers) and, inside them, for pairs of nodes.
Groups that ask a shard are dealt to buckets, so that no task holds all groups.

Scores are exact: products in double precision where no sum can reach 2^53, in whole numbers elsewhere. Sums beyond 64 bits
stay at the border.

Defined cases: rows with a null id, and vectors that are null, empty, or hold null or non-finite components, take no part.
Vectors of different lengths are not compared. Rows that repeat an id, with one vector or several, are candidates each for
itself, and a query for each row; a query leaves out its own row alone. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.llm._io import map_rows, materialize
from archivolt.operators.ranking import top_k

K = 10
SCALE = 1024
#: Components of the sample whose tree gives the cells, and the most cells of one length of vectors.
SAMPLE_VALUES, MAX_CELLS = 2_000_000, 1024
#: Components of a shard and of a group of queries.
SHARD_VALUES, GROUP_VALUES = 1 << 19, 1 << 14
#: Groups that one task searches in one shard.
BUCKET_GROUPS = 64
#: Points of a leaf of data and of queries, children of a node, and how much smaller than its parent's radius a child's aims to be.
LEAF, QUERY_LEAF, CHILDREN, BASE = 96, 16, 12, 1.6
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


@dataclass
class Tree:
    """Points in the order of the leaves; node i holds points lo[i] to hi[i] and the nodes first[i] to last[i] as children."""

    order: np.ndarray
    centers: np.ndarray
    norms: np.ndarray
    radii: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    last: np.ndarray


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """A cover tree of distinct points (rows in double precision)."""
    order = np.arange(len(points))
    center, radius, lo, hi, first, last = [0], [0.0], [0], [len(points)], [0], [0]
    at = 0
    while at < len(center):
        start, stop = lo[at], hi[at]
        own = order[start:stop]
        x = points[own]
        nearest = np.linalg.norm(x - points[center[at]], axis=1)
        radius[at] = float(nearest.max())
        if len(own) > leaf and radius[at] > 0:
            # Farthest-first: the next centre is the point farthest from all before it.
            chosen, home = [center[at]], np.zeros(len(own), dtype=np.int64)
            while len(chosen) < CHILDREN and nearest.max() > radius[at] / BASE or len(chosen) < 2:
                new = int(np.argmax(nearest))
                distance = np.linalg.norm(x - x[new], axis=1)
                closer = distance < nearest
                closer[new] = True
                home[closer], nearest = len(chosen), np.minimum(nearest, distance)
                nearest[new] = 0.0
                chosen.append(int(own[new]))
            arranged = np.argsort(home, kind="stable")
            order[start:stop] = own[arranged]
            stops = start + np.cumsum(np.bincount(home, minlength=len(chosen)))
            first[at] = len(center)
            for c, a, b in zip(chosen, [start, *stops[:-1].tolist()], stops.tolist(), strict=True):
                if b > a:
                    center.append(c)
                    radius.append(0.0)
                    lo.append(a)
                    hi.append(b)
                    first.append(0)
                    last.append(0)
            last[at] = len(center)
        at += 1
    centers = points[np.array(center)]
    arrays = (np.array(v) for v in (radius, lo, hi, first, last))
    return Tree(order, centers, np.linalg.norm(centers, axis=1), *arrays)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two tables of whole numbers."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < 1 << 52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, _LEAST, _MOST).astype(np.int64)


def search(queries: np.ndarray, asks: Tree, data: np.ndarray, index: Tree, least: np.ndarray, worst: np.ndarray, k: int):
    """For each query the k best rows of ``data``, at least as good as ``worst``: numbers and scores, -1 where there are fewer.

    ``least`` orders rows of equal score. ``queries``, ``worst`` and the result are in the given order, not the tree's.
    """
    n = len(queries)
    at = np.full((n, k), -1, dtype=np.int64)
    score = np.full((n, k), _LEAST, dtype=np.int64)
    bound = worst[asks.order].copy()  # in the tree's order, as are the rows below
    x, y, name = queries[asks.order], data[index.order], least[index.order]
    slack = 1e-9 * float(asks.norms.max() + asks.radii[0]) * float(index.norms.max() + index.radii[0]) + 1e-6

    def most(q, r) -> np.ndarray:
        return asks.centers[q] @ index.centers[r].T + asks.norms[q] * index.radii[r] + index.norms[r] * asks.radii[q] + asks.radii[q] * index.radii[r] + slack

    todo = [(-float(most(0, 0)), 0, 0)]
    while todo:
        ahead, q, r = heapq.heappop(todo)
        lowest = float(bound[asks.lo[q] : asks.hi[q]].min())
        if -ahead < lowest:
            continue
        q_leaf, r_leaf = asks.first[q] == asks.last[q], index.first[r] == index.last[r]
        if q_leaf and r_leaf:
            a, b = asks.lo[q], index.lo[r]
            products = _products(x[a : asks.hi[q]], y[b : index.hi[r]])
            good = products >= bound[a : asks.hi[q], None]
            for i in np.flatnonzero(good.any(axis=1)).tolist():
                new = np.flatnonzero(good[i])
                scores = np.concatenate([score[a + i], products[i, new]])
                rows = np.concatenate([at[a + i], b + new])
                keep = np.lexsort((np.where(rows < 0, _MOST, name[rows]), -scores.clip(min=_LEAST + 1)))[:k]
                score[a + i], at[a + i] = scores[keep], rows[keep]
                if rows[keep[-1]] >= 0:
                    bound[a + i] = max(bound[a + i], scores[keep[-1]])
        elif not r_leaf and (q_leaf or index.radii[r] >= asks.radii[q]):
            children = np.arange(index.first[r], index.last[r])
            bounds = most(q, children)
            for c, value in zip(children.tolist(), bounds.tolist(), strict=True):
                if value >= lowest:
                    heapq.heappush(todo, (-value, q, c))
        else:
            for c in range(asks.first[q], asks.last[q]):
                heapq.heappush(todo, (-float(most(c, r)), c, r))
    back = np.empty(n, dtype=np.int64)
    back[asks.order] = np.arange(n)
    rows = np.where(at < 0, -1, index.order[at])
    return rows[back], score[back]


def _finite() -> Column:
    given = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce(given & finite, F.lit(False))


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, point of the rows that take part."""
    point = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.filter(_finite()).select(F.col("vec_id").cast("long"), point.alias("point"))


def _matrix(points: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = points.combine_chunks() if isinstance(points, pa.ChunkedArray) else points
    return np.asarray(flat.flatten(), dtype=np.int64).reshape(-1, dim)


def _cells(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Centres by dimension: the widest-held nodes at the top of the sample's cover tree. Other dimensions have one cell."""
    shape = nodes.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
    if not shape.n:
        return {}
    held = nodes.select("dim", "point").orderBy(F.xxhash64("node"), "node").limit(max(1, SAMPLE_VALUES // shape.dim)).toArrow()
    dims = np.asarray(held["dim"])
    out = {}
    for dim in np.unique(dims).tolist():
        x = _matrix(held["point"].filter(pa.array(dims == dim)), dim).astype(np.float64)
        wanted = int(np.clip(shape.n * dim // SHARD_VALUES, 1, MAX_CELLS))
        tree = build(x, leaf=max(1, len(x) // (4 * wanted)))
        cells, waiting = [], [(-len(x), 0)]
        while waiting and len(waiting) + len(cells) < wanted:
            _, node = heapq.heappop(waiting)
            if tree.first[node] == tree.last[node]:
                cells.append(node)
            for c in range(tree.first[node], tree.last[node]):
                heapq.heappush(waiting, (int(tree.lo[c] - tree.hi[c]), c))
        out[dim] = tree.centers[sorted(cells + [i for _, i in waiting])]
    return out


def _placed(nodes: DataFrame, cells: dict[int, np.ndarray]) -> DataFrame:
    """Adds cell, and the distance to its centre."""
    shared = nodes.sparkSession.sparkContext.broadcast(cells)
    names = [*nodes.columns, "cell", "distance"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields), "cell int, distance double"])

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims = np.asarray(batch.column(names.index("dim")))
        cell, distance = np.zeros(len(dims), dtype=np.int32), np.zeros(len(dims))
        for dim in np.unique(dims).tolist():
            own = np.flatnonzero(dims == dim)
            centers = shared.value.get(dim)
            if centers is not None:
                x = _matrix(batch.column(names.index("point")).take(pa.array(own)), dim).astype(np.float64)
                cell[own] = np.argmin((centers**2).sum(axis=1) - 2 * (x @ centers.T), axis=1)
                distance[own] = np.linalg.norm(x - centers[cell[own]], axis=1)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(distance)], names)

    return map_rows(nodes, place, schema, rows=4096)


def _dealt(rows: DataFrame, values: int, name: str) -> DataFrame:
    """Adds a part of the cell that holds about ``values`` components."""
    sizes = rows.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) * F.col("dim") / F.lit(values)).cast("int").alias("parts"))
    return rows.join(materialize(sizes, name), ["dim", "cell"]).withColumn(name, F.pmod(F.xxhash64("node"), F.greatest("parts", F.lit(1))).cast("int"))


def _shard(group: pa.Table) -> pa.Table:
    dim = group["dim"][0].as_py()
    points = _matrix(group["point"], dim)
    tree = build(points.astype(np.float64))
    held = pickle.dumps((points, tree, group["node"].to_numpy(), group["ids"].to_pylist()))
    return pa.table({"dim": pa.array([dim], pa.int32()), "cell": group["cell"][:1], "part": group["part"][:1], "shard": pa.array([held], pa.binary())})


def _query_group(group: pa.Table) -> pa.Table:
    dim = group["dim"][0].as_py()
    points = _matrix(group["point"], dim)
    tree = build(points.astype(np.float64), QUERY_LEAF)
    held = pickle.dumps((points, tree, group["node"].to_numpy()))
    return pa.table({"dim": pa.array([dim], pa.int32()), "cell": group["cell"][:1], "team": group["team"][:1], "parts": group["parts"][:1], "asks": pa.array([held], pa.binary())})


_FOUND = "query long, node long, score long, ids array<long>"


def _searched(teams: DataFrame, shards: DataFrame, k: int) -> DataFrame:
    """Rows of ``_FOUND`` for teams (with worst, the bounds of their queries) in the shards of their keys."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        query, node, score, ids = [], [], [], []
        for held in right["shard"].to_pylist()[:1]:
            data, index, names, every = pickle.loads(held)
            least = np.array([i[0] for i in every], dtype=np.int64)
            for asks, worst in zip(left["asks"].to_pylist(), left["worst"].to_pylist(), strict=True):
                points, tree, numbers = pickle.loads(asks)
                bounds = np.full(len(points), _LEAST, dtype=np.int64) if worst is None else np.frombuffer(worst, dtype="<i8")
                rows, scores = search(points, tree, data, index, least, bounds, k)
                some = np.nonzero(rows >= 0)
                query.append(numbers[some[0]])
                node.append(names[rows[some]])
                score.append(scores[some])
                ids += [every[i] for i in rows[some].tolist()]
        columns = [np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in (query, node, score)]
        return pa.table([*map(pa.array, columns), pa.array(ids, pa.list_(pa.int64()))], names=["query", "node", "score", "ids"])

    keys = ["dim", "cell", "part", "bucket"]
    return teams.groupBy(*keys).cogroup(shards.groupBy(*keys)).applyInArrow(run, _FOUND)


def _numbered(asking: DataFrame, placed: DataFrame) -> DataFrame:
    """node, vec_id, times of the rows that ask. A merge join: the size of the points' files, a tenth of that of the points,
    is what the planner goes by, and it would send all of them to the driver."""
    own = asking.groupBy("point", "vec_id").agg(F.count(F.lit(1)).alias("times"))
    return own.join(placed.select("point", "node").hint("merge"), "point").select("node", "vec_id", "times")


def _at_shards(pairs: DataFrame, shards: DataFrame) -> DataFrame:
    """The shards, once for each bucket of teams that asks them, under columns of their own; no shard reaches the driver."""
    keys = ["dim", "cell", "part", "bucket"]
    asked = pairs.select(*[F.col(c).alias(f"asked_{c}") for c in keys]).distinct()
    here = shards.select(*[F.col(c).alias(f"held_{c}") for c in keys[:3]], "shard").hint("merge")
    both = asked.join(here, [F.col(f"asked_{c}") == F.col(f"held_{c}") for c in keys[:3]])
    return both.select(*[F.col(f"asked_{c}").alias(c) for c in keys], "shard")


def _wanted(teams: DataFrame, cells: dict[int, np.ndarray], radii: dict[tuple[int, int], float], last_parts: dict[tuple[int, int], int]) -> DataFrame:
    """Adds asked: the shards, but the one searched first, of cells that may hold a row as good as the worst of a team's queries."""
    shared = teams.sparkSession.sparkContext.broadcast((cells, radii, last_parts))
    names = teams.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in teams.schema.fields), "asked array<struct<cell:int,part:int>>"])

    def ask(batch: pa.RecordBatch) -> pa.RecordBatch:
        centers_of, radius_of, last_of = shared.value
        out = []

        def shards_of(dim: int, asked: list[int], home: tuple[int, int]) -> list[dict]:
            parts = ((c, p) for c in asked for p in range(last_of.get((dim, c), -1) + 1))
            return [{"cell": c, "part": p} for c, p in parts if (c, p) != home]

        for dim, cell, home, asks, worst in zip(*(batch.column(names.index(c)).to_pylist() for c in ("dim", "cell", "home", "asks", "worst")), strict=True):
            centers = centers_of.get(dim)
            if centers is None:
                out.append(shards_of(dim, [0], (cell, home)))
                continue
            tree, lowest = pickle.loads(asks)[1], float(np.frombuffer(worst, dtype="<i8").min())
            radius = np.array([radius_of.get((dim, i), -1.0) for i in range(len(centers))])
            norms = np.linalg.norm(centers, axis=1)
            most = centers @ tree.centers[0] + norms * tree.radii[0] + (tree.norms[0] + tree.radii[0]) * radius
            most += 1e-9 * (norms + radius) * (tree.norms[0] + tree.radii[0]) + 1e-6
            out.append(shards_of(dim, np.flatnonzero((radius >= 0) & (most >= lowest)).tolist(), (cell, home)))
        kind = pa.list_(pa.struct([("cell", pa.int32()), ("part", pa.int32())]))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*names, "asked"])

    return map_rows(teams, ask, schema)


def _bounds(teams: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Adds worst: for each query of a team the k-th score found so far."""
    kth = found.groupBy("team_key").agg(F.collect_list(F.struct("query", "worst")).alias("known"))
    names = [*teams.columns, "worst"]

    def fill(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for asks, known in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("asks", "known")), strict=True):
            numbers = pickle.loads(asks)[2]
            scores = {x["query"]: x["worst"] for x in known or ()}
            out.append(np.array([scores.get(q, _LEAST) for q in numbers.tolist()], dtype="<i8").tobytes())
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names[:-1]), pa.array(out, pa.binary())], names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in teams.schema.fields), "worst binary"])
    return map_rows(teams.join(kth, "team_key", "left"), fill, schema)


def top_rows(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which ``is_query`` (a condition on vec_id) holds, its k best others."""
    rows = scaled(vectors, scale)
    kept = top_k(rows, ["point"], [F.col("vec_id")], k + 1)
    nodes = kept.groupBy("point").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("point")), "points")
    cells = _cells(nodes)
    placed = materialize(_placed(nodes, cells), "placed")
    radii = {(r.dim, r.cell): r.radius for r in placed.groupBy("dim", "cell").agg(F.max("distance").alias("radius")).collect()}

    dealt = _dealt(placed, SHARD_VALUES, "part")
    shards = materialize(dealt.groupBy("dim", "cell", "part").applyInArrow(_shard, "dim int, cell int, part int, shard binary"), "shards")

    queries = materialize(_numbered(rows.filter(F.coalesce(is_query, F.lit(False))), placed), "queries")
    asking = placed.join(queries.select("node").distinct(), "node", "left_semi")
    teams = _dealt(asking.withColumn("members", F.lit(1)), GROUP_VALUES, "team").drop("parts")
    parts = shards.groupBy("dim", "cell").agg(F.max("part").alias("parts"))
    last_parts = {(r.dim, r.cell): r.parts for r in parts.collect()}
    teams = teams.join(parts, ["dim", "cell"])
    teams = teams.groupBy("dim", "cell", "team").applyInArrow(_query_group, "dim int, cell int, team int, parts int, asks binary")
    # A team is first searched in one shard of its cell.
    own = F.pmod(F.xxhash64("team"), F.col("parts") + 1).cast("int")
    teams = materialize(teams.withColumns({"home": own, "team_key": F.monotonically_increasing_id()}).drop("parts"), "teams")

    buckets = max(1, -(-teams.count() // BUCKET_GROUPS))
    bucket = F.pmod(F.xxhash64("team_key"), F.lit(buckets)).cast("int").alias("bucket")

    first = teams.select("dim", "cell", F.col("home").alias("part"), bucket, "asks", F.lit(None).cast("binary").alias("worst"))
    seeds = materialize(_searched(first, _at_shards(first, shards), k + 1), "seeds")
    worst = seeds.groupBy("query").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("worst")).filter("worst IS NOT NULL")
    members = _members(teams)
    bounded = _bounds(teams, worst.join(members, "query"), k + 1)
    wanted = materialize(_wanted(bounded, cells, radii, last_parts), "bounded-teams")
    second = wanted.withColumn("other", F.explode("asked")).select("dim", "other.cell", "other.part", bucket, "asks", "worst")
    more = materialize(_searched(second, _at_shards(second, shards), k + 1), "found")

    best = top_k(seeds.unionByName(more), ["query"], [F.col("score").desc(), F.col("ids")[0], F.col("node")], k + 1)
    own_place = F.array_position("ids", F.col("vec_id"))
    others = F.when(
        (F.col("query") == F.col("node")) & (own_place > 0),
        F.concat(F.slice("ids", F.lit(1), (own_place - 1).cast("int")), F.slice("ids", (own_place + 1).cast("int"), F.size("ids"))),
    ).otherwise(F.col("ids"))
    listed = best.join(queries.withColumnRenamed("node", "query"), "query").select(F.col("vec_id").alias("query_id"), "query", "times", "score", F.explode(others).alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("query", "query_id").orderBy(F.col("score").desc(), "vec_id"))
    ranked = listed.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k)
    repeated = ranked.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return repeated.select("query_id", "rank", "vec_id", "score")


def _members(teams: DataFrame) -> DataFrame:
    """query, team_key."""

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers = [pickle.loads(x)[2] for x in batch.column(1).to_pylist()]
        keys = np.repeat(np.asarray(batch.column(0)), [len(x) for x in numbers])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(numbers)), pa.array(keys)], ["query", "team_key"])

    return map_rows(teams.select("team_key", "asks"), spread, "query long, team_key long")
