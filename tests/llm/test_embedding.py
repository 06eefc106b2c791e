import numpy as np
import pytest

from archivolt.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, kept string, node long"


def brute(rows):
    good = []
    for i, e, label in rows:
        if i is not None and label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            x = np.array(e, dtype=np.float32).astype(np.float64)
            good.append((i, label, x / np.linalg.norm(x)))
    n, parent = [0] * len(good), list(range(len(good)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            if good[a][1] == good[b][1] and len(good[a][2]) == len(good[b][2]) and good[a][2] @ good[b][2] >= 0.93:
                n[a] += 1
                n[b] += 1
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    lowest = {}
    for a in range(len(good)):
        lowest[find(a)] = min(lowest.get(find(a), 10**9), good[a][0])
    out = [(g[0], n[a], lowest[find(a)]) for a, g in enumerate(good)]
    held = {g[0] for g in good}
    return sorted(map(repr, out)), held


@pytest.mark.parametrize("block", [512, 7])
def test_links_and_components_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for c in range(30):
        center = rng.normal(size=8)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((i, [float(x) for x in center + 0.12 * rng.normal(size=8)], c % 3))
            i += 1
    rows += [(1000 + k, rows[0][1], 0) for k in range(5)] + [(2000, [2 * x for x in rows[0][1]], 0)]
    rows += [(3000, rows[0][1][:4], 0), (3001, rows[0][1][:4], 0)]
    # One id on like vectors of one label, and of two.
    rows += [(3002, rows[0][1], 0), (3002, [x + 0.01 for x in rows[0][1]], 0), (3002, rows[0][1], 1), (3003, [x + 0.02 for x in rows[0][1]], 1)]
    odd = [(4000, None, 0), (4001, [], 0), (4002, [0.0] * 8, 0), (4003, [None] + rows[0][1][1:], 0), (4004, [float("nan")] * 8, 0), (4005, [float("inf")] * 8, 0), (4006, rows[0][1], None), (None, rows[0][1], 0)]
    table = spark.createDataFrame([(*r, "k", 1) for r in rows + odd], SCHEMA).repartition(3)
    found = E.groups(table, block=block).collect()
    wanted, held = brute(rows)
    assert sorted(repr((r.vec_id, r.n_links, r.component_id)) for r in found if r.vec_id in held) == wanted
    rest = [r for r in found if r.vec_id not in held]
    assert len(rest) == len(odd) and all(r.n_links == 0 and r.kept and r.component_id == r.vec_id for r in rest)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found if r.vec_id is not None)


def near_pairs(n=1500, dim=32, seed=5):
    """Vectors without clusters, half of them with a neighbour at a cosine of just 0.93."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.normal(size=(n, dim))
    u -= (u * x).sum(axis=1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    both = np.concatenate([x, 0.9301 * x + np.sqrt(1 - 0.9301**2) * u])
    return [(i, [float(v) for v in row], 0) for i, row in enumerate(both)]


def test_every_link_is_found_with_the_exact_bound(spark, monkeypatch):
    monkeypatch.setattr(E, "CELL_ROWS", 16)
    rows = near_pairs(500)
    found = E.groups(spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA), sigmas=None).collect()
    wanted, _ = brute(rows)
    assert sum(r.n_links for r in found) >= 1000
    assert sorted(repr((r.vec_id, r.n_links, r.component_id)) for r in found) == wanted


@pytest.mark.parametrize("cell_rows", [300, 30, 6])
def test_recall_and_probes_hold_at_every_number_of_cells(spark, monkeypatch, cell_rows):
    """10, 100 and 500 cells: nearly all pairs just at the threshold are found, by asking in few cells."""
    monkeypatch.setattr(E, "CELL_ROWS", cell_rows)
    rows = near_pairs()
    table = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)
    found = sum(r.n_links for r in E.groups(table).collect()) / 2
    assert 0.98 * 1500 <= found <= 1500
    nodes = table.selectExpr("label", "32 AS dim", "embedding", "vec_id AS node")
    assert E._assign(nodes, E.fit_cells(nodes), 0.93, E.SIGMAS).selectExpr("avg(size(probes)) AS mean").first()[0] < 12


def test_empty_table(spark):
    assert E.groups(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("cell_rows", [256, 32, 8])
def test_labels_of_unlike_shape_lose_no_links(spark, monkeypatch, cell_rows):
    """One label on a circle among one that spreads in all directions: 26, 211 and 844 cells."""
    rng = np.random.default_rng(11)
    angle = rng.uniform(0, 2 * np.pi, 1500)
    circle = np.zeros((1500, 64))
    circle[:, 0], circle[:, 1] = np.cos(angle), np.sin(angle)
    circle += rng.normal(scale=0.01, size=circle.shape)
    spread = rng.normal(size=(12_000, 64))
    x = np.concatenate([circle, spread]).astype(np.float32)
    rows = [(i, v.tolist(), int(i >= 1500)) for i, v in enumerate(x)]
    monkeypatch.setattr(E, "CELL_ROWS", cell_rows)
    found = E.groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(8)).filter("vec_id < 1500").agg({"n_links": "sum"}).first()[0]
    unit = x[:1500].astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    wanted = int((unit @ unit.T >= E.THRESHOLD).sum()) - 1500
    assert found <= wanted
    assert found >= 0.99 * wanted, found / wanted
