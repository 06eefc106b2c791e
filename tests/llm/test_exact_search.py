import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivolt.llm import exact_search as E

SCHEMA = "vec_id long, embedding array<float>, label int, score string, node string"


def table_of(spark, rows, parts=4, kind="float"):
    return spark.createDataFrame([(i, v, 1, "s", "n") for i, v in rows], SCHEMA.replace("float", kind)).repartition(parts)


def brute(rows, k=10):
    usable = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, x) in enumerate(usable):
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for other, (i, y) in enumerate(usable) if other != at and len(y) == len(x))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def found(vectors, k=10):
    return sorted(tuple(r) for r in E.top_rows(vectors, F.col("vec_id") % 100 == 0, k).collect())


def f32(rng, dim, spread=1.0):
    return [float(np.float32(rng.gauss(0, spread))) for _ in range(dim)]


@pytest.fixture(params=[None, 64], ids=["large", "small"])
def small(request, monkeypatch):
    """Shards, groups and buckets of a few rows, so that every step of the search takes part."""
    if request.param:
        monkeypatch.setattr(E, "SHARD_VALUES", 1200)
        monkeypatch.setattr(E, "GROUP_VALUES", 48)
        monkeypatch.setattr(E, "BUCKET_GROUPS", 2)


def test_against_brute_force(spark, small):
    rng = random.Random(2)
    centers = [f32(rng, 8) for _ in range(6)]
    rows = [(i, [c + float(np.float32(rng.gauss(0, 0.1))) for c in rng.choice(centers)]) for i in range(1500)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert found(table_of(spark, rows)) == brute(rows)


def test_odd_rows_ties_and_copies(spark, small):
    rng = random.Random(3)
    same = f32(rng, 8)
    rows = [(i, same) for i in range(0, 900)]  # copies that hold most rows
    rows += [(1000 + i, f32(rng, 8)) for i in range(300)]
    rows += [(2000 + i, [0.25 * rng.randrange(-2, 3) for _ in range(8)]) for i in range(300)]  # ties
    rows += [(5000, same), (5000, same), (5000, f32(rng, 8)), (5100, [0.0] * 8), (5200, [1.0, 2.0]), (5201, [2.0, 2.0]), (5300, [1.0] * 3)]
    rows += [(None, same), (6000, None), (6100, []), (6200, [None] + same[1:]), (6300, [float("nan")] + same[1:]), (6400, [float("inf")] + same[1:])]
    assert found(table_of(spark, rows)) == brute(rows)


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(50 * i, [float(rng.randrange(-1 << 18, 1 << 18)) + rng.random() for _ in range(5)]) for i in range(60)]
    assert found(table_of(spark, rows, kind="double")) == brute(rows)


def test_few_rows_and_none(spark):
    assert found(table_of(spark, [(100, [1.0, 2.0])])) == []
    assert found(table_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 1.0])])) == []
    assert found(table_of(spark, [])) == []
    rows = [(100 * i, [float(i), 1.0]) for i in range(4)]
    assert found(table_of(spark, rows)) == brute(rows)


def test_trees_cover_and_separate():
    rng = np.random.default_rng(5)
    points = np.unique(np.round(rng.normal(size=(3000, 5)) * 100), axis=0)
    tree = E.build(points, leaf=16)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for i in range(len(tree.lo)):
        own = points[tree.order[tree.lo[i] : tree.hi[i]]]
        assert np.linalg.norm(own - tree.centers[i], axis=1).max() <= tree.radii[i] + 1e-9
        children = np.arange(tree.first[i], tree.last[i])
        if len(children):
            assert (tree.lo[children[0]], tree.hi[children[-1]]) == (tree.lo[i], tree.hi[i])
            assert (tree.centers[children[0]] == tree.centers[i]).all()
            apart = np.linalg.norm(tree.centers[children][:, None] - tree.centers[children][None], axis=2)
            assert apart[np.triu_indices(len(children), 1)].min() >= tree.radii[children].max() - 1e-9


def test_nodes_are_left_out():
    """Clusters far apart: most products are never made."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(40, 16)) * 1000
    data = np.unique(np.round(centers[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 16)) * 10), axis=0).astype(np.int64)
    queries = data[::10]
    made = []
    plain = E._products
    try:
        E._products = lambda a, b: (made.append(len(a) * len(b)), plain(a, b))[1]
        rows, scores = E.search(queries, E.build(queries.astype(float), E.QUERY_LEAF), data, E.build(data.astype(float)), np.arange(len(data)), np.full(len(queries), E._LEAST), 10)
    finally:
        E._products = plain
    every = queries @ data.T
    assert (scores == -np.sort(-every, axis=1)[:, :10]).all()
    assert sum(made) < 0.25 * every.size


def test_no_points_or_shards_are_broadcast(spark):
    """Files of points are a tenth of their size in memory: by their files, the planner took them for small."""
    placed = spark.range(400).select(F.array(F.col("id")).alias("point"), F.col("id").alias("node"))
    asking = placed.select("point", F.col("node").alias("vec_id"))
    shards = spark.range(4).select(*[F.col("id").cast("int").alias(c) for c in ("dim", "cell", "part")], F.lit(b"x").alias("shard"))
    pairs = shards.drop("shard").withColumn("bucket", F.lit(0))
    for joined in (E._numbered(asking, placed), E._at_shards(pairs, shards)):
        assert joined.count() > 0
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
