import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from archivolt.llm import simhash_dedup as S


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return find


def test_against_brute_force(docs_of, odd_rows):
    rng = random.Random(2)
    rows = list(odd_rows)
    for d in range(100, 160):
        base = [f"w{rng.randrange(200)}" for _ in range(rng.randrange(1, 400))]
        for k in range(3):
            copy = list(base)
            if k and rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = "CHANGED"
            rows.append((d * 10 + k, " ".join(copy), "en", "s"))
    prints = {(d, t): fingerprint(t) for d, t, *_ in rows}
    ids = [(d, f) for (d, _), f in prints.items() if d is not None]
    find = components([(a, b) for a, f in ids for b, g in ids if (f ^ g).bit_count() <= 3])
    lowest = {}
    for d, f in ids:
        lowest[f] = min(lowest.get(f, 10**9), find(d))
    wanted = sorted((repr(d), f"{prints[d, t]:016x}", repr(lowest.get(prints[d, t]))) for d, t, *_ in rows)
    found = S.components(docs_of(rows))
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in found.collect()) == wanted


def test_near_groups_follow_the_similarity_of_shingles(docs_of, odd_rows):
    rng = random.Random(7)
    rows, families = list(odd_rows), {}
    for d in range(100, 140):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))]
        for k in range(4):
            copy = list(base)
            for _ in range(len(base) // 150 if k else 0):  # few edits: similarity well over 0.8
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(99)}"
            rows.append((d * 10 + k, " ".join(copy), "en", "s"))
            families[d * 10 + k] = d * 10
    groups = {r.doc_id: r.component for r in S.near_groups(docs_of(rows)).collect()}
    assert sum(groups[d] == families[d] for d in families) >= 0.98 * len(families)
    assert all(families.get(groups[d]) == families[d] for d in families)  # nothing strange joins a family
    assert groups[4] == 4 and groups[6] == 5 and groups[3] == 1  # copies, and texts without words
    kept = S.keep_one(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and ids.count(4) == 1 and 6 not in ids and {1, 5, 7} <= set(ids)


def test_expected_distance_falls_with_similarity():
    assert S.expected_distance(0.95) < S.expected_distance(0.8) < S.WIDE_BITS // 4


def test_near_groups_against_brute_force_around_the_similarity(docs_of):
    rng = random.Random(9)
    rows = []
    for d in range(60):  # chains of texts, each with a changed stretch: neighbours lie between 0.65 and 0.95
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for k in range(3):
            rows.append((d * 10 + k, " ".join(words), "en", "s"))
            n, at = rng.choice((5, 10, 30, 40)), rng.randrange(150)
            words[at : at + n] = [f"w{rng.randrange(5000)}" for _ in range(n)]
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t, *_ in rows for w in [t.split()]}
    alike = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    find = components(alike)
    groups = {r.doc_id: r.component for r in S.near_groups(docs_of(rows)).collect()}
    assert all(find(d) == find(c) for d, c in groups.items())  # no clean document is lost
    assert sum(groups[d] == find(d) for d in groups) >= 0.97 * len(groups)


def test_all_pairs_are_compared_across_chunks():
    rng = np.random.default_rng(3)
    sets, base = [], np.arange(100, dtype=np.uint64)
    for k in range(12):  # each alike to its neighbours alone
        sets.append((base + np.uint64(10 * k)).tobytes())
    alone = components(S._alike(sets, list(range(12)), [True] * 12, "alone", 0.8))
    assert {alone(i) for i in range(12)} == {0}
    assert S._alike(sets[::2], list(range(6)), [True] * 6, "alone", 0.8) == []
    inside = [bool(x) for x in rng.integers(0, 2, 12)]
    links = S._alike(sets, list(range(12)), inside, "pair", 0.8)
    for side in (True, False):
        part = [i for i in range(12) if inside[i] is side]
        links += S._alike([sets[i] for i in part], part, [True] * len(part), "alone", 0.8)
    assert {components(links)(i) for i in range(12)} == {0}
    assert S._alike([b"", sets[0]], [0, 1], [True, True], "alone", 0.8) == []


def test_slices_find_as_many_pairs_at_every_width():
    rng = np.random.default_rng(6)
    flips = rng.random((4000, S.WIDE_BITS)) < 0.1515  # bits that differ at a similarity of 0.8
    for width in (16, 18, 20, 22):
        shared = (~flips[:, S._slices(width)].any(axis=2)).any(axis=1)
        assert shared.mean() > 0.95


def test_large_shards_are_cut_without_losing_links(spark):
    rng = np.random.default_rng(4)
    center = int(rng.integers(1, 1 << 62))
    values = sorted({center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (700, 2))})
    find = components([(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and (a ^ b).bit_count() <= 3])
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    distinct = spark.createDataFrame(list(zip(signed, range(len(values)))), "fingerprint long, node long")
    from archivolt.operators.graph import connected_components

    found = connected_components(S.links(distinct, shard=64))
    got = {r.node: r.component for r in found.collect()}
    assert all(got.get(i, i) == find(i) for i in range(len(values)))


@pytest.mark.parametrize("bits", [2, 3])
def test_a_hot_group_is_held_against_its_smallest_member(spark, bits):
    """Near copies of one value, and chains of values that hang on to them at the radius."""
    rng = np.random.default_rng(5)
    center = int(rng.integers(1, 1 << 62))
    flip = lambda v, n: v ^ int(np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64)))
    values = {center} | {flip(center, bits) for _ in range(600)}
    for _ in range(20):
        v = center
        for _ in range(4):
            v = flip(v, 3)
            values.add(v)
    values = [center, *sorted(values - {center})]
    find = components([(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and (a ^ b).bit_count() <= 3])
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    rows = spark.createDataFrame(list(zip([7] * len(values), signed, range(len(values)))), "key long, fingerprint long, node long")
    from archivolt.operators.graph import connected_components

    dealt, tied = S._dealt(rows, 64, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    assert dealt.filter("searcher >= 0").count() == 0 and tied.count() > 50 and dealt.count() < 8 * len(values)
    got = {r.node: r.component for r in connected_components(S._shard_links(rows, 3, 64)).collect()}
    assert all(got.get(i, i) == find(i) for i in range(len(values)))


def test_a_hot_group_of_texts_is_verified_as_a_whole(docs_of):
    """Groups far beyond a chunk: copies of one text, with chains of texts that are alike only to one of them."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(9000)}"
    base, rows = [word() for _ in range(160)], []
    for k in range(150):
        copy = list(base)
        if k:
            copy[rng.randrange(160)] = word()
        rows.append((k, " ".join(copy), "en", "s"))
    for c in range(6):
        text = list(base)
        for k in range(4):
            at = rng.randrange(140)
            text[at : at + 12] = [word() for _ in range(12)]
            rows.append((1000 + 10 * c + k, " ".join(text), "en", "s"))
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t, *_ in rows for w in [t.split()]}
    find = components([(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    groups = {r.doc_id: r.component for r in S.near_groups(docs_of(rows), shard=16).collect()}
    assert all(find(d) == find(c) for d, c in groups.items())
    assert sum(groups[d] == find(d) for d in groups) >= 0.97 * len(groups)


def test_tree_finds_exactly_the_near_values():
    rng = np.random.default_rng(0)
    values = [int(v) & 0xFFFFF for v in rng.integers(0, 1 << 20, 500)]
    tree = S.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.within(q, 3)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 3]


def test_stand_ins_keep_the_groups():
    rng = np.random.default_rng(1)
    for spread in (2, 6, 12):
        values = sorted({int(np.bitwise_or.reduce(1 << rng.integers(0, 40, spread))) for _ in range(300)})
        for radius in (3, 8):
            find = components([(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and (a ^ b).bit_count() <= radius])
            got = S._search(values, list(range(len(values))), [True] * len(values), "alone", radius)
            same = components(got)
            assert all(same(i) == find(i) for i in range(len(values)))
            inside = [i % 3 == 0 for i in range(len(values))]
            parts = []
            for keep in (True, False):
                part = [i for i, x in enumerate(inside) if x is keep]
                parts += S._search([values[i] for i in part], part, [True] * len(part), "alone", radius)
            apart = components(parts + S._search(values, list(range(len(values))), inside, "pair", radius))
            assert all(apart(i) == find(i) for i in range(len(values)))
            across = components([(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if inside[i] and not inside[j] and (a ^ b).bit_count() <= radius])
            star = components(S._search(values, list(range(len(values))), inside, "star", radius))
            assert all(star(i) == across(i) for i in range(len(values)))


def test_fewer_links_keep_the_groups(spark):
    rng = random.Random(8)
    edges = [(max(a, b), min(a, b)) for a, b in ((rng.randrange(200), rng.randrange(200)) for _ in range(150)) if a != b]
    left = [(r.src, r.dst) for r in S._fewer(spark.createDataFrame(edges, "src long, dst long")).collect()]
    before, after = components(edges), components(left)
    assert all(before(i) == after(i) for i in range(200)) and all(a > b for a, b in left)


def test_empty_table(docs_of):
    assert S.components(docs_of([])).count() == 0 and S.keep_one(docs_of([])).count() == 0
    assert S.components(docs_of([(1, "a b", "en", "s")])).select(F.col("component_id")).first()[0] == 1
