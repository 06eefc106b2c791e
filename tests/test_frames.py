"""Fingerprints of frames, duplicate groups and their keepers."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from archivolt.operators import frames as V

VIDEO = "video_id string, capture_ts string, duration double, review_status string, created_at string, edits int, group_id string, duplicate_state string, duplicate_of string, triage_status string, outputs int, fingerprint binary, fingerprint_version int"


def packed(samples):
    return b"".join(n.to_bytes(2, "big") + bytes(p) for n, p in sorted(samples))


def flat(value, numbers=range(1, 17)):
    return packed([(n, [value] * 64) for n in numbers])


def plain(a, b):
    """The rule, frame by frame."""

    def frames(p):
        if not p or len(p) % 66:
            return {}
        out = [(int.from_bytes(p[i : i + 2], "big"), p[i + 2 : i + 66]) for i in range(0, len(p), 66)]
        return dict(out) if len(dict(out)) == len(out) else {}

    x, y = frames(a), frames(b)
    both = x.keys() & y.keys()
    if len(both) < max(8, -(-3 * max(len(x), len(y)) // 4)):
        return False
    deltas = [abs(p - q) for n in both for p, q in zip(x[n], y[n])]
    bits = [sum((p * 64 >= sum(x[n])) != (q * 64 >= sum(y[n])) for p, q in zip(x[n], y[n])) for n in both]
    return sum(deltas) / len(deltas) <= 2 and max(deltas) <= 32 and sum(bits) / len(bits) <= 1 and max(bits) <= 8


def noisy(rng, base, most, numbers):
    return packed([(n, [min(255, max(0, v + rng.randrange(-most, most + 1))) for v in base[n]]) for n in numbers])


def test_packing_and_what_has_none(spark):
    rows = [("a", n, [n] * 64) for n in (3, 1, 2)] + [("b", 1, [0] * 64), ("b", 1, [0] * 64), ("c", 1, [0] * 63), ("d", 70000, [0] * 64), ("e", 1, [256] + [0] * 63), ("f", 1, [None] + [0] * 63), ("g", 1, None)]
    found = {r.k: r.fingerprint for r in V.pack_frames(spark.createDataFrame(rows, "k string, frame int, pixels array<int>"), "k").collect()}
    assert bytes(found.pop("a")) == packed([(n, [n] * 64) for n in (1, 2, 3)])
    assert set(found.values()) == {None} and len(found) == 6


def test_comparison_against_the_plain_rule():
    rng = random.Random(1)
    base = {n: [rng.randrange(256) for _ in range(64)] for n in range(20)}
    prints = [flat(0), flat(1), flat(255), flat(0, range(1, 8)), flat(0, range(1, 9)), b"", b"x" * 65, packed([(1, [0] * 64), (1, [0] * 64)] * 5), None]
    prints += [noisy(rng, base, most, range(start, stop)) for most in (0, 1, 2, 3, 4, 5, 40) for start, stop in ((0, 16), (4, 20), (0, 12), (8, 16))]
    pairs = [(a, b) for a in prints for b in prints]
    found = V.compare(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]))
    assert found["matches"].tolist() == [plain(a, b) for a, b in pairs]
    assert 0 < found["matches"].sum() < len(pairs)
    assert len(V.compare(pd.Series([], dtype=object), pd.Series([], dtype=object))) == 0


def videos_of(spark, rows):
    full = [
        (v, ts, d, r.get("review", "pending"), r.get("at", "2024"), r.get("edits", 0), r.get("group", ""), r.get("state", ""), "", "not_triaged", 3, p, 1)
        for v, ts, d, p, r in rows
    ]
    return spark.createDataFrame(full, VIDEO)


def settled(spark, rows):
    videos = videos_of(spark, rows)
    done = V.reconcile_duplicates(videos, V.duplicate_components(videos))
    return {r.video_id: r for r in done.collect()}, V.duplicate_summary(done).first()


def brute(rows):
    """Components by all pairs."""
    parent = {v: v for v, *_ in rows}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, (v, ts, d, p, _) in enumerate(rows):
        for w, us, e, q, _ in rows[:i]:
            if ts and ts == us and abs(d - e) <= 0.25 and plain(p, q):
                a, b = sorted((root(v), root(w)))
                parent[b] = a
    groups = {}
    for v in parent:
        groups.setdefault(root(v), []).append(v)
    return sorted((v, min(g)) for g in groups.values() if len(g) > 1 for v in g)


def test_components_against_all_pairs(spark):
    rng = random.Random(2)
    base = [{n: [rng.randrange(256) for _ in range(64)] for n in range(16)} for _ in range(5)]
    rows = []
    for i in range(160):
        kind = rng.randrange(5)
        p = noisy(rng, base[kind], rng.choice((0, 0, 1, 2, 3)), range(rng.choice((0, 0, 2)), 16))
        rows.append((f"v{i:03d}", rng.choice(("t1", "t1", "t1", "t2", "")), 10 + 0.125 * rng.randrange(0, 5), p, {}))
    rows += [(f"w{i:03d}", "t3", 1.0, flat(7), {}) for i in range(40)] + [("x1", "t3", 1.0, flat(7, range(4)), {}), ("x2", "t3", 1.0, flat(7, range(4)), {}), ("x3", "t3", 1.0, None, {})]
    # A chain in steps that only neighbours are near enough for.
    rows += [(f"y{i:03d}", "t4", 2.0, flat(2 * i), {}) for i in range(30)]
    found = sorted((r.node, r.component) for r in V.duplicate_components(videos_of(spark, rows)).collect())
    assert found == brute(rows)


def test_untouched_copies_are_rejected(spark):
    rows = [("video-first", "t", 23.4, flat(0), {"at": "1"}), ("video-copy", "t", 23.4, flat(1), {"at": "2"}), ("video-different", "t", 23.4, flat(255, range(1, 17)), {"at": "3"})]
    rows[2] = ("video-different", "t", 23.4, packed([(n, [255, 0] * 32) for n in range(1, 17)]), {"at": "3"})
    found, summary = settled(spark, rows)
    assert (found["video-first"].duplicate_state, found["video-first"].review_status) == ("keeper", "pending")
    copy = found["video-copy"]
    assert (copy.duplicate_state, copy.review_status, copy.triage_status, copy.outputs, copy.duplicate_of) == ("auto_rejected", "rejected", "rejected", 0, "video-first")
    assert found["video-different"].duplicate_state == ""
    assert tuple(summary) == (1, 0, 0, 1)


@pytest.mark.parametrize(
    ("rows", "states"),
    [
        ([{"edits": 0}, {"edits": 1}], ["problem", "problem"]),
        ([{"state": "keeper", "edits": 2}, {}], ["keeper", "auto_rejected"]),
        ([{"state": "keeper"}, {"state": "keeper"}, {}], ["problem"] * 3),
        ([{"group": "a"}, {"group": "b"}, {}], ["problem"] * 3),
        ([{"review": "accepted"}, {"review": "rejected"}], ["", ""]),
        ([{"review": "accepted"}, {"review": "pending", "at": "9"}], ["auto_rejected", "keeper"]),
    ],
)
def test_keepers_and_problems(spark, rows, states):
    found, _ = settled(spark, [(f"v{i}", "t", 1.0, flat(5), r) for i, r in enumerate(rows)])
    assert [found[f"v{i}"].duplicate_state for i in range(len(rows))] == states


def test_backfill_serves_candidates_only(spark):
    videos = videos_of(spark, [("old", "t", 1.0, None, {}), ("new", "t", 1.2, flat(5), {}), ("far", "t", 9.0, None, {}), ("other", "u", 1.0, None, {})])
    videos = videos.withColumn("fingerprint_version", F.when(F.col("fingerprint").isNull(), 0).otherwise(1))
    given = spark.createDataFrame([(v, n, [5] * 64, n == 0) for v in ("old", "far", "other") for n in range(20)], "video_id string, frame int, pixels array<int>, user_captured boolean")
    found = {r.video_id: r for r in V.backfilled(videos, given).collect()}
    assert {v: r.fingerprint_version for v, r in found.items()} == {"old": 1, "new": 1, "far": 0, "other": 0}
    assert bytes(found["old"].fingerprint) == flat(5)


def test_empty(spark):
    assert V.duplicate_components(videos_of(spark, [])).count() == 0


def test_fingerprints_are_not_laid_beside_each_key(spark, monkeypatch):
    written = {}
    keep = V.materialize
    monkeypatch.setattr(V, "materialize", lambda df, name: written.setdefault(name, df.columns) and keep(df, name))
    V.duplicate_components(videos_of(spark, [(f"v{i}", "t", 1.0, flat(i), {}) for i in range(3)]))
    assert written["keyed"] == ["key", "id"] and written["placed"] == ["id", "key", "component"]


def test_memory_of_a_comparison_does_not_grow_with_the_batch():
    import tracemalloc

    payload = packed([(n, [(n * 7 + i) % 256 for i in range(64)]) for n in range(16)])
    peaks = {}
    for n in (1_000, 4_000):
        rows = pd.Series([payload, packed([(1, [3] * 64)]), None, payload] * (n // 4))
        tracemalloc.start()
        found = V.compare_slices(rows, rows)
        peaks[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        pd.testing.assert_frame_equal(found, V.compare(rows, rows))
    assert peaks[4_000] < 1.5 * peaks[1_000]
