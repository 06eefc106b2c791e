"""Samples with quotas and refills, best of strata without reuse, attempts matched to batches."""

import random

import pytest
from pyspark.sql import functions as F

from archivolt.operators import reconcile, sampling


def spread(rows, k):
    n = len(rows)
    if k <= 0:
        return []
    if k >= n:
        return rows
    return [rows[n // 2]] if k == 1 else [rows[round(j * (n - 1) / (k - 1))] for j in range(k)]


def test_places_across_ranges(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(4), rng.choice("ab") if i % 3 else "a") for i in range(500)]
    table = spark.createDataFrame(rows, "id int, x int, k string").repartition(7)
    for key in ([], ["k"]):
        found = {r.id: (r._i, r._n) for r in sampling.numbered_in_order(table, [F.col("x").desc(), F.col("id")], key, 6).collect()}
        for name in "ab" if key else [None]:
            own = sorted((r for r in rows if name in (None, r[2])), key=lambda r: (-r[1], r[0]))
            assert all(found[r[0]] == (i, len(own)) for i, r in enumerate(own))


@pytest.mark.parametrize("total", [1, 10, 37, 60])
def test_weighted_samples_against_the_plain_rule(spark, total):
    weights = {"a": 5, "b": 3, "short": 8, "empty": 4}
    rows = [(i, "short" if i in (3, 40) else "abo"[i % 3], (i * 7) % 50) for i in range(80)]
    table = spark.createDataFrame(rows, "id int, s string, x int").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    exact = {s: total * w / 20 for s, w in weights.items()}
    quotas = {s: int(x) for s, x in exact.items()}
    for s in sorted(weights, key=lambda s: -(exact[s] - quotas[s]))[: total - sum(quotas.values())]:
        quotas[s] += 1
    taken = {r[0] for s in weights for r in spread([r for r in ordered if r[1] == s], quotas[s])}
    refill = {r[0] for r in spread([r for r in ordered if r[0] not in taken], total - len(taken))}
    found = sampling.weighted_sample(table, "s", weights, [F.col("x"), F.col("id")], "id", total).collect()
    assert {r.id for r in found if not r.refilled} == taken and {r.id for r in found if r.refilled} == refill and len(found) == total


def test_a_sample_larger_than_the_table(spark):
    table = spark.createDataFrame([(1, "a", 1)], "id int, s string, x int")
    with pytest.raises(ValueError, match="larger"):
        sampling.weighted_sample(table, "s", {"a": 1}, [F.col("id")], "id", 2)


def test_strata_do_not_share_rows_and_are_filled(spark):
    table = spark.createDataFrame([(i, i) for i in range(30)], "id int, x int").repartition(3)
    near = lambda m: [F.abs(F.col("x") - m)]
    strata = [(F.col("x") < 20, near(10)), (F.col("x") < 15, near(10)), (F.col("x") > 99, near(0)), (F.col("x") < 12, near(10))]
    found = [tuple(r) for r in sampling.best_of_strata(table, strata, "id", [F.col("x")], 6).collect()]
    # 10, then 9 before 11 by id, then 11; an even spread of six rows (0, 6, 12, 17, 23, 29) fills up.
    assert found == [(0, 10), (1, 9), (3, 11), (None, 0), (None, 6), (None, 12)]
    with pytest.raises(ValueError, match="only 2"):
        sampling.best_of_strata(table.filter("id < 2"), strata, "id", [F.col("x")], 6)


def test_attempts_against_the_plain_rule(spark):
    rng = random.Random(4)
    some = lambda letters, most: [rng.choice(letters) for _ in range(rng.randrange(0, most))]
    batches = [(i, some("ab", 4), some("pqrst", 6), rng.choice((None, "1")), "2", rng.randrange(3)) for i in range(40)]
    attempts = [(i, some("ab", 3) if i % 3 == 0 else [], some("pqrstz", 6) if i % 3 < 2 else None, rng.choice((None, "1")), rng.choice((None, "2")), rng.choice((None, 0, 1))) for i in range(120)]
    schema = "_id int, dates array<string>, ids array<string>, first string, last string, n int"
    A, B = (spark.createDataFrame(rows, schema.replace("_id", name)) for rows, name in ((attempts, "attempt_id"), (batches, "batch_id")))
    for least in (None, 0.6):
        found = {r.attempt_id: (r.tier, r.batch_id, r.matches) for r in reconcile.attempts_to_batches(A, B, least).collect()}
        for i, dates, ids, *span in attempts:
            ids = ids or []
            if not dates and not ids and all(x is None for x in span):
                assert i not in found
                continue
            tier, hits = ("dates", [b[0] for b in batches if set(b[1]) == set(dates)]) if dates else ("ids", [b[0] for b in batches if set(b[2]) == set(ids)]) if ids else ("range", [b[0] for b in batches if list(b[3:]) == span])
            wanted = (tier, min(hits, default=None), len(hits))
            shared = [(-len(set(b[2]) & set(ids)), b[0]) for b in batches if len(set(b[2]) & set(ids)) >= (least or 9) * len(set(ids))]
            if least and tier == "ids" and not hits and shared:
                wanted = ("overlap", min(shared)[1], 1)
            assert found[i] == wanted, i


def test_attempts_of_batches_against_the_plain_rule(spark):
    rng = random.Random(6)
    some = lambda letters, most: [rng.choice(letters) for _ in range(rng.randrange(0, most))]
    batches = [(i, some("ab", 4), some("pq", 4), rng.choice((None, "1")), "2", rng.randrange(2)) for i in range(40)]
    attempts = [(i, some("ab", 3) if i % 3 == 0 else [], some("pq", 4) if i % 3 < 2 else None, rng.choice((None, "1")), rng.choice((None, "2")), rng.choice((None, 0, 1)), f"t{i}") for i in range(90)]
    schema = "_id int, dates array<string>, ids array<string>, first string, last string, n int"
    A = spark.createDataFrame(attempts, schema.replace("_id", "attempt_id") + ", roots string")
    found = {r.batch_id: (r.attempts, r.roots) for r in reconcile.batch_attempts(spark.createDataFrame(batches, schema.replace("_id", "batch_id")), A, "attempt_id", ["roots"]).collect()}
    for b in batches:
        hits = []
        for i, dates, ids, *span, roots in attempts:
            if dates or ids or any(x is not None for x in span):
                if set(dates) == set(b[1]) if dates else set(ids) == set(b[2]) if ids else span == list(b[3:]):
                    hits.append((i, roots))
        assert found[b[0]] == (len(hits), max(hits)[1] if hits else None), b


def test_attempts_meet_sets_of_ids_not_batches(spark):
    """Ids of few values in many batches: attempts and batches of one set meet once."""
    batches = spark.createDataFrame([(i, ["d"], ["p", "q", "r"], "1", "2", 0) for i in range(3000)], "batch_id int, dates array<string>, ids array<string>, first string, last string, n int")
    attempts = spark.createDataFrame([(i, [], ["q", "p", "z"], None, None, None) for i in range(3000)], "attempt_id int, dates array<string>, ids array<string>, first string, last string, n int")
    found = reconcile.attempts_to_batches(attempts, batches, 0.5)
    assert found.filter("tier = 'overlap' AND batch_id = 0 AND matches = 1").count() == 3000
    # The pairs are made from the tables of sets; before, from nine million pairs of attempts and batches.
    assert any("/held-sets-" in path for path in found.inputFiles())
