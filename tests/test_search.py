"""Runs of the search by dates."""

import datetime

from archivolt.operators import search

DAY = datetime.date(2024, 5, 10)


def at(n):
    return DAY + datetime.timedelta(days=n)


def run(spark, entries, files, **more):
    pair = "entry long, sha long, path long"
    rows = lambda name, schema: spark.createDataFrame(more.get(name, []), schema)
    return search.date_search(
        spark.createDataFrame([(i, at(n)) for i, n in entries], "entry long, day date"),
        rows("settled", "entry long"),
        rows("confirmed", pair),
        rows("pending", pair),
        spark.createDataFrame([(p, s, at(n), good) for p, s, n, good in files], "path long, sha long, day date, preferred boolean"),
        rows("rejected", pair),
        rows("stored", "entry long, path long, decision string"),
    )


def queue(done):
    return sorted((r.entry, r.path, r.day_distance, r.decision, r.placeholder) for r in done.queue.collect())


def test_targets_lack_an_original_that_stands(spark):
    confirmed = [(2, 20, 200), (3, 30, 300), (4, 40, 400), (5, 50, 500)]
    pending = [(3, 30, None), (4, None, 400), (5, 51, 501)]
    done = run(spark, [(i, 0) for i in range(1, 7)], [], settled=[(6,)], confirmed=confirmed, pending=pending)
    assert queue(done) == [(i, None, None, None, True) for i in (1, 3, 4)]
    assert done.counters == {"targets": 3, "near": 0, "candidates": 0, "closest": 0, "owned": 0, "queue": 3}


def test_tiers_rejections_and_owners(spark):
    files = [(100, 1, 0, False), (101, 2, 1, True), (102, 3, 2, True), (103, 4, -3, True), (104, 5, 9, True), (105, 6, 0, True), (106, 7, 20, True), (107, 8, 22, True), (108, 9, 40, False)]
    rejected = [(1, 6, None), (3, None, 106)]
    done = run(spark, [(1, 0), (2, 1), (3, 20), (4, 40), (5, 60)], files, rejected=rejected)
    # 105 is rejected for entry 1 and goes to entry 2; 101 is nearer to entry 2; 100 is not preferred, so the next tier is asked.
    assert queue(done) == [(1, 100, 0, "", False), (2, 101, 0, "", False), (3, 107, 2, "", False), (4, 108, 0, "", False), (5, None, None, None, True)]
    found = {r.day: (r.entries, r.candidates, r.hidden, r.status) for r in done.days.collect()}
    assert found == {at(0): (1, 1, 1, "needs_choice"), at(1): (1, 1, 0, "needs_choice"), at(20): (1, 1, 1, "needs_choice"), at(40): (1, 1, 0, "needs_choice"), at(60): (1, 0, 0, "no_external_candidates")}
    batches = [(r.batch_id, r.days, r.entries, r.candidates, r.days_without, r.statuses) for r in sorted(done.batches.collect())]
    assert batches == [("B001", 2, 2, 2, 0, "needs_choice"), ("B002", 1, 1, 1, 0, "needs_choice"), ("B003", 1, 1, 1, 0, "needs_choice"), ("B004", 1, 1, 0, 1, "no_external_candidates")]
    assert done.counters["targets"] == 5 and done.counters["queue"] == 5


def test_decided_rows_stay_and_rejected_days_are_told(spark):
    files = [(100, 1, 0, True), (101, 2, 0, True)]
    done = run(spark, [(1, 0), (2, 9)], files, stored=[(1, 100, "later"), (9, 101, "maybe")], rejected=[(1, 2, None)])
    assert queue(done) == [(1, 100, None, "later", False), (2, None, None, None, True)]
    done = run(spark, [(1, 0)], files, rejected=[(1, 2, None), (1, None, 100)])
    assert [(r.candidates, r.hidden, r.status) for r in done.days.collect()] == [(0, 2, "all_candidates_rejected")]


def test_no_entries(spark):
    done = run(spark, [], [(1, 1, 0, True)])
    assert queue(done) == [] and done.batches.count() == 0


def test_pairs_are_not_made(spark):
    """Targets and files of one day: as many pairs as their product are counted, and every file has the first target left."""
    n = 300
    files = [(1000 + i, i % 7, 0, i % 2 == 0) for i in range(n)]
    rejected = [(e, 3, None) for e in range(5)] + [(0, None, 1001)]
    done = run(spark, [(e, 0) for e in range(n)], files, rejected=rejected)
    owner = {p: next(e for e in range(n) if not (s == 3 and e < 5 or e == 0 and p == 1001)) for p, s, _, _ in files}
    assert {r.path: r.entry for r in done.queue.collect() if r.path} == owner
    hidden = 5 * sum(s == 3 for _, s, _, _ in files) + 1
    assert done.counters["near"] == done.counters["candidates"] == n * n and done.counters["closest"] == n * n - hidden
    assert [r.hidden for r in done.days.collect()] == [hidden]


def test_files_of_several_days_and_without_content(spark):
    files = [(1, None, -3, True), (1, None, 1, False), (2, None, 0, False), (2, None, 9, True)]
    done = run(spark, [(5, 0), (6, 9)], files, rejected=[(5, None, 2)])
    # File 1 is preferred at one of its days and nearest at the other.
    assert queue(done) == [(5, 1, 1, "", False), (6, 2, 0, "", False)]
