"""Operator 4: near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors of a label are one node with a weight and a number of its own. Centroids are fitted on a bounded sample;
every node is indexed in its nearest cell and looks for others in all cells whose border is near enough. For x in cell
c and y in cell d, the distances of both to the plane between c and d add up to at most |x - y|, so one of them is at
most half of that: with a reach of sqrt((1 - threshold) / 2) every pair is found, whatever the number of cells. That
bound is met only by a step straight across the border. A step in any of n directions alike crosses it by its length
over sqrt(n - 1) in the mean, so the reach is cut to ``SIGMAS`` times that, with n taken for each label and cell on its
own, from at most ``LOCAL_SAMPLE`` of its nodes: it is the participation ratio of the steps between those that differ by
about as much as two vectors at the threshold do, or of their covariance where hardly any two link. Where n is small, or
nodes lie too close to tell, nothing is cut. None of this depends on the size of the table. ``sigmas=None`` keeps the exact bound.

Within a cell, queries and indexed nodes are dealt to blocks of about ``BLOCK`` rows; each pair of blocks is one matrix
product. A pair that both sides would find is counted once for each. Groups leave a task as trees of bounded fan-out
and sums of links, never as all pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label
or id, link with nothing: n_links 0, their own component, kept. Vectors of different lengths never link. Rows that
repeat an id, with one vector or several, with one label or several, are vectors of their own and count as links if
they are alike. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.llm._io import map_rows, materialize
from archivolt.operators.graph import connected_components
from archivolt.operators.ranking import top_k

THRESHOLD = 0.93
#: Standard deviations of the way that two vectors at the threshold differ across a border, within which cells are asked.
SIGMAS = 3.0
#: Nodes of a label and cell that tell how they spread, and pairs at the threshold's distance that suffice.
LOCAL_SAMPLE, LEAST_STEPS = 192, 8
BLOCK = 512
#: Vectors per cell and label that the number of cells aims at, and the most cells.
CELL_ROWS = 512
MAX_CELLS = 4096
#: Components of all sampled vectors together: 4 million are 32 MB on the driver.
SAMPLE_VALUES = 4_000_000
ITERATIONS = 8
FAN_OUT = 16


def can_link() -> Column:
    """Never null."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    given = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return F.coalesce(given & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def usable(docs: DataFrame) -> DataFrame:
    """vec_id, label, dim, embedding of the rows that can link."""
    rows = docs.filter(can_link()).select(F.col("vec_id").cast("long"), "label", "embedding")
    return rows.withColumn("dim", F.size("embedding"))


def _unit(rows: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    x = np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, dim)
    # Scaling by the largest component first keeps squares of extreme values finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def ratio(steps: np.ndarray) -> float:
    """Participation ratio of vectors: in how many directions they go alike."""
    spread = np.linalg.eigvalsh(steps.T @ steps)
    return float(spread.sum() ** 2 / max((spread**2).sum(), 1e-300))


def directions(x: np.ndarray, threshold: float) -> float:
    """In how many directions rows alike step that are nearly as far apart as the threshold allows, or, where hardly any
    two link, in how many they spread; 1 where rows link but lie too close to tell."""
    i, j = np.triu_indices(len(x), 1)
    apart, far = (2 - 2 * (x @ x.T))[i, j], 2 - 2 * threshold
    if (apart <= far).sum() < min(LEAST_STEPS, max(1.0, len(i) / 4)):
        return ratio(x - x.mean(axis=0)) if len(x) > 1 else 1.0
    steps = (apart > far / 4) & (apart <= far)
    return ratio(x[i[steps]] - x[j[steps]]) if steps.sum() >= LEAST_STEPS else 1.0


def fit_cells(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Unit centroids by dimension, fitted on a sample taken by hash of the id; a dimension without any has one cell."""
    shape = nodes.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels"), F.max("dim").alias("dim")).first()
    if not shape.n:
        return {}
    wanted = int(np.clip(round(shape.n / (shape.labels * CELL_ROWS)), 1, MAX_CELLS))
    sample = nodes.select("embedding", "dim", "node").orderBy(F.xxhash64("node"), "node").limit(max(1, SAMPLE_VALUES // shape.dim))
    held = sample.toArrow()
    dims = np.asarray(held["dim"])
    out = {}
    for dim in np.unique(dims):
        x = _unit(held["embedding"].filter(pa.array(dims == dim)), int(dim))
        k = min(wanted, len(x))
        rng = np.random.default_rng(7)
        centers = x[rng.choice(len(x), k, replace=False)]
        for _ in range(ITERATIONS):
            nearest = np.argmax(x @ centers.T, axis=1)
            sums = np.zeros_like(centers)
            np.add.at(sums, nearest, x)
            norms = np.linalg.norm(sums, axis=1)
            moved = norms > 0
            centers[moved] = sums[moved] / norms[moved, None]
        out[int(dim)] = centers
    return out


def _by_dim(nodes: DataFrame, name: str, kind: str, value) -> DataFrame:
    """Adds a column: ``value`` of the unit vectors of one dimension, and of the batch's rows that have it, as a list."""
    names = nodes.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields), f"{name} {kind}"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims = np.asarray(batch.column(names.index("dim")))
        out: list = [None] * batch.num_rows
        for dim in np.unique(dims):
            own = pa.array(np.flatnonzero(dims == dim))
            part = batch.take(own)
            for i, x in zip(own.to_pylist(), value(_unit(part.column(names.index("embedding")), int(dim)), int(dim), part), strict=True):
                out[i] = x
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32() if kind == "int" else pa.list_(pa.int32()))], [*names, name])

    return map_rows(nodes, run, schema, rows=1024)


def _spreads(homed: DataFrame, threshold: float) -> DataFrame:
    """label, dim, cell, spread."""
    sample = top_k(homed, ["label", "dim", "cell"], [F.xxhash64("node"), F.col("node")], LOCAL_SAMPLE)

    def spread(group: pa.Table) -> pa.Table:
        x = _unit(group["embedding"], group["dim"][0].as_py())
        return pa.table({"label": group["label"][:1], "dim": group["dim"][:1], "cell": group["cell"][:1], "spread": pa.array([directions(x, threshold)])})

    label = dict(homed.dtypes)["label"]
    return sample.groupBy("label", "dim", "cell").applyInArrow(spread, f"label {label}, dim int, cell int, spread double")


def _assign(nodes: DataFrame, cells: dict[int, np.ndarray], threshold: float, sigmas: float | None) -> DataFrame:
    """Adds probes: the cell of a node, then all others whose border is near enough."""
    shared = nodes.sparkSession.sparkContext.broadcast(cells)
    bound = float(np.sqrt(max(0.0, 1 - threshold) / 2))

    def home(x: np.ndarray, dim: int, _) -> list[int]:
        centers = shared.value.get(dim)
        return [0] * len(x) if centers is None else np.argmax(x @ centers.T, axis=1).tolist()

    def near(x: np.ndarray, dim: int, rows: pa.RecordBatch) -> list[np.ndarray]:
        centers = shared.value.get(dim)
        home = np.asarray(rows.column(rows.schema.get_field_index("cell")))
        if centers is None:
            return [np.zeros(1, dtype=np.int32)] * len(x)
        spread = np.asarray(rows.column(rows.schema.get_field_index("spread")))
        reach = bound * np.minimum(1.0, sigmas / np.sqrt(np.maximum(spread - 1, 1e-9))) if sigmas is not None else np.full(len(x), bound)
        closeness = x @ centers.T
        used, place = np.unique(home, return_inverse=True)
        # Unit centroids c and d are sqrt(2 - 2 c.d) apart; the margin is far above the error of the products.
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * (centers[used] @ centers.T)))[place]
        own = np.arange(len(x))
        inside = closeness[own, home][:, None] - closeness <= reach[:, None] * apart + 1e-9
        inside[own, home] = False
        return [np.append(h, np.flatnonzero(row)).astype(np.int32) for h, row in zip(home, inside, strict=True)]

    homed = _by_dim(nodes, "cell", "int", home)
    if sigmas is None or not cells or max(map(len, cells.values())) == 1:
        homed = homed.withColumn("spread", F.lit(1.0))
    else:
        homed = materialize(homed, "homes")
        homed = homed.join(materialize(_spreads(homed, threshold), "spreads"), ["label", "dim", "cell"])
    return _by_dim(homed, "probes", "array<int>", near).select(*nodes.columns, "probes")


def _local_groups(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component label of each row and column of a bipartite matrix; labels are row numbers, -1 without a link."""
    n, m = linked.shape
    rows = np.where(linked.any(axis=1), np.arange(n), n)
    while True:
        columns = np.where(linked, rows[:, None], n).min(axis=0, initial=n)
        new = np.minimum(rows, np.where(linked, columns[None, :], n).min(axis=1, initial=n))
        if (new == rows).all():
            break
        rows = new
    return np.where(rows == n, -1, rows), np.where(columns == n, -1, columns)


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    """Links of one pair of blocks: rows (a, b, n) say that a gains n links, or, with n null, that a and b connect."""
    query = table.filter(pc.field("asks"))
    index = table.filter(~pc.field("asks"))
    dim = table["dim"][0].as_py()
    out_a, out_b, out_n = [], [], []
    if query.num_rows and index.num_rows:
        ids, others = (t["node"].to_numpy() for t in (query, index))
        weight, other_weight = (t["weight"].to_numpy() for t in (query, index))
        linked = _unit(query["embedding"], dim) @ _unit(index["embedding"], dim).T >= threshold
        linked &= ids[:, None] != others[None, :]
        if linked.any():
            home = np.array([p[0] for p in query["probes"].to_pylist()])
            finds_back = np.array([[h in p for p in map(set, index["probes"].to_pylist())] for h in np.unique(home)])
            finds_back = finds_back[np.searchsorted(np.unique(home), home)]
            gained = linked @ other_weight
            lent = (linked & ~finds_back).T @ weight
            for names, sums in ((ids, gained), (others, lent)):
                some = np.flatnonzero(sums)
                out_a += names[some].tolist()
                out_n += sums[some].tolist()
            out_b += [None] * len(out_a)
            rows, columns = _local_groups(linked)
            members: dict[int, set[int]] = {}
            for labels, names in ((rows, ids), (columns, others)):
                for label, name in zip(labels.tolist(), names.tolist(), strict=True):
                    if label >= 0:
                        members.setdefault(label, set()).add(name)
            for group in map(sorted, members.values()):
                for i in range(1, len(group)):
                    out_a.append(group[i])
                    out_b.append(group[(i - 1) // FAN_OUT])
                    out_n.append(None)
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64()), "n": pa.array(out_n, pa.int64())})


def _blocks(placed: DataFrame, block: int) -> DataFrame:
    """Rows of both roles, dealt to pairs of blocks within (label, dim, cell)."""
    roles = placed.withColumn(
        "role",
        F.explode(
            F.concat(
                F.array(F.struct(F.element_at("probes", 1).alias("cell"), F.lit(False).alias("asks"))),
                F.transform("probes", lambda c: F.struct(c.alias("cell"), F.lit(True).alias("asks"))),
            )
        ),
    ).select(
        "label",
        "dim",
        F.col("role.cell").alias("cell"),
        F.col("role.asks").alias("asks"),
        "node",
        "weight",
        # Of those who ask only the cell they live in is needed.
        F.when(F.col("role.asks"), F.slice("probes", 1, 1)).otherwise(F.col("probes")).alias("probes"),
        "embedding",
    )
    sizes = placed.select("label", "dim", F.explode("probes").alias("cell"), F.col("probes")[0].alias("home"))
    sizes = materialize(
        sizes.groupBy("label", "dim", "cell").agg(
            F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("asking"),
            F.ceil(F.count_if(F.col("cell") == F.col("home")) / F.lit(block)).cast("int").alias("indexed"),
        ),
        "cell-sizes",
    ).filter("indexed > 0")
    own, other = F.when(F.col("asks"), F.col("asking")), F.when(F.col("asks"), F.col("indexed"))
    return (
        roles.join(sizes, ["label", "dim", "cell"])
        .withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce(own, F.col("indexed"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.col("asking")) - 1)))
        .withColumn("q", F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")))
        .withColumn("i", F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")))
        .drop("own", "other", "asking", "indexed")
    )


def groups(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, sigmas: float | None = SIGMAS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = usable(vectors)
    # The numbers are drawn once, for the table is written; ids may repeat on different vectors.
    nodes = materialize(
        rows.groupBy("label", "dim", "embedding")
        .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    placed = materialize(_assign(nodes.drop("least"), fit_cells(nodes), threshold, sigmas), "cells")
    compared = _blocks(placed, block).groupBy("label", "dim", "cell", "q", "i")
    found = materialize(compared.applyInArrow(lambda t: _compare(t, threshold), "a long, b long, n long"), "links")
    counts = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    components = connected_components(found.filter("n IS NULL"), "a", "b")
    members = materialize(
        nodes.join(counts, "node", "left")
        .join(components, "node", "left")
        .select(
            "label",
            "dim",
            "embedding",
            "least",
            (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component"),
        ),
        "members",
    )
    lowest = members.groupBy("component").agg(F.min("least").alias("component_id"))
    named = members.join(lowest, "component").select("label", "dim", "embedding", "n_links", "component_id")
    linked = rows.join(named, ["label", "dim", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = vectors.filter(~can_link()).select(
        F.col("vec_id").cast("long"),
        F.lit(0).cast("long").alias("n_links"),
        F.col("vec_id").cast("long").alias("component_id"),
    )
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
