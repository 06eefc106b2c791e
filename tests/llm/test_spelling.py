import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from archivolt.llm import spelling as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        others = [o for o in counts if near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (form, n, len(others), counts[form] if form else None)
    rows = []
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, n_near, form_n))
    return sorted(rows)


def occurrences(rows, damage):
    found = Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if damage and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


@pytest.fixture(scope="module")
def rows(odd_rows):
    rng = random.Random(8)
    stems = ["straßenlärm", "colouring", "Colouring", "ÀÉcolour", "analyse", "favourite", "mississippi", "aaaaaaa"]
    out = list(odd_rows)
    for d in range(60):
        words = []
        for _ in range(40):
            w = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1 :]])
            words.append(w)
        out.append((100 + d, " ".join(words) + ",mississippi" * 9, "en", "s"))
    return out


@pytest.mark.parametrize("damage", [None, 7])
def test_against_brute_force(spark, docs_of, rows, damage):
    counts = occurrences(rows, damage)
    assert any(f for _, f, *_ in brute(counts))
    assert sorted(tuple(r) for r in S.variants(docs_of(rows), damage).collect()) == brute(counts)


def test_many_passes_and_sheets_give_the_same(spark, docs_of, rows, monkeypatch):
    monkeypatch.setattr(S, "SHEET_WORDS", 4)
    monkeypatch.setattr(S, "PASS_WORDS", 12)
    monkeypatch.setattr(S, "TASK_WORDS", 8)
    counts = occurrences(rows, None)
    assert len(counts) > 32
    assert sorted(tuple(r) for r in S.variants(docs_of(rows)).collect()) == brute(counts)


def test_edits_have_the_keys_of_their_words():
    letters = np.array([ord(c) for c in "abcé"])
    for word in ("abcabc", "aabbcc", "éa"):
        codes = np.array([[ord(c) for c in word]])
        seen = set()
        for i, letter, rows, sums in S.edits(codes, letters):
            for s in sums[: len(rows)]:
                other = word[:i] + (chr(letter) if letter >= 0 else "") + word[i + 1 :]
                assert other not in seen and near(word, other)
                seen.add(other)
                own = np.array([[ord(c) for c in other]])
                assert S._terms(own).sum(axis=1, dtype=np.uint64)[0] == s


def test_chains_lead_to_one_root(spark):
    words = ["abcdefgh"[: 6 + i % 3] + "x" * (i // 3) for i in range(9)]
    counts = {w: 6**i for i, w in enumerate(sorted(set(words)))}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(tuple(r) for r in S.group(table).collect()) == brute(counts)


def test_empty_tables(spark, docs_of):
    assert S.variants(docs_of([])).count() == 0
    assert S.variants(docs_of([(1, "too few words here", "en", "s")])).count() == 0
