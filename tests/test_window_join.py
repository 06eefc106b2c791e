"""Pairs of dates within a window."""

import datetime

from archivolt.operators import temporal

DAY = datetime.date(1969, 12, 20)


def test_window_pairs_equal_all_pairs_and_are_not_broadcast(spark):
    at = lambda n: DAY + datetime.timedelta(days=n)
    left = [(i, i % 2, at(i)) for i in range(40)] + [(99, 0, None)]
    right = [(i, i % 2, at(3 * i % 50)) for i in range(40)] + [(99, 0, None)]
    a = spark.createDataFrame(left, "a long, k long, d date")
    b = spark.createDataFrame(right, "b long, k long, f date")
    for days in (0, 3, 14):
        found = temporal.date_window_join(a, b, "d", "f", days, ["k"])
        wanted = sorted((x, y, abs((d - f).days)) for x, k, d in left for y, m, f in right if d and f and k == m and abs((d - f).days) <= days)
        assert sorted((r.a, r.b, r.day_distance) for r in found.collect()) == wanted
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "sequence(" not in plan
