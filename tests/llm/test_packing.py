import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from archivolt.llm import packing as P  # noqa: E402


@pytest.fixture(scope="module")
def plain():
    return tokenizers.Tokenizer.from_file(P.tokenizer_path())


def ids_of(plain, text):
    return np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def check(rows, found, plain, capacity=2048):
    wanted = defaultdict(int)
    for d, t, *_ in rows:
        ids = ids_of(plain, t)
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            wanted[d, k // capacity, k, len(part), zlib.crc32(part.tobytes())] += 1
    got = defaultdict(int)
    bins = defaultdict(list)
    for r in found:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == wanted
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_and_places(docs_of, odd_rows, plain):
    rng = random.Random(9)
    rows = list(odd_rows) + [(100 + d, " ".join("abcdefgh"[: rng.randrange(1, 8)] for _ in range(rng.randrange(0, 1500))), "en", "s") for d in range(150)]
    rows += [(900 + d, "same words here", "en", "s") for d in range(300)]  # one length many times
    used = check(rows, P.pack_documents(docs_of(rows)).collect(), plain)
    total = sum(len(ids_of(plain, t)) for _, t, *_ in rows)
    assert used <= -(-total // 2048) + 1


def test_ranks_over_many_groups_of_buckets(docs_of, monkeypatch):
    monkeypatch.setattr(P, "RANK_GROUP", 3)
    monkeypatch.setattr(P, "BUCKET_GROUP", 4)
    rows = [(d, "same words" + " here" * (d % 3), "en", "s") for d in range(400)]
    cut = P.pieces(docs_of(rows))
    ranked = P._ranked(cut, cut.groupBy("length").count().withColumnRenamed("count", "n")).collect()
    ranks = defaultdict(list)
    for r in ranked:
        ranks[r.length].append(r["rank"])
    assert len(ranks) == 3 and all(sorted(x) == list(range(len(x))) for x in ranks.values())


def test_words_have_the_ids_of_their_text(plain):
    rng = random.Random(3)
    parts = ["a", "B", "é", "É", "́", "1", "٣", "'s", ".", ",", "<|endoftext|>", "<|ENDOFTEXT|>", " ", " ", "\x1c", "\x85", "İ", "Σ", "中", "🙂", "\n", " ", "<|", "\x00"]
    words = P.WordTokenizer(P.tokenizer_path(), limit=500)
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 14)))
        assert words.encode(text.encode()) == np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_constraint_holds(rule):
    rng = random.Random(1)
    histogram = defaultdict(int)
    for _ in range(500):
        histogram[rng.randrange(1, 100)] += 1
    caps = P.Capacities(tokens=100, documents=4, attention=5000, weights=(1.0, 0.5, 0.5), rule=rule)
    with pytest.raises(ValueError):
        P.plan_packing({90: 1}, caps)
    small = {k: n for k, n in histogram.items() if k * k <= 5000}
    plan = P.plan_packing(small, caps)
    placed, bins = defaultdict(int), defaultdict(list)
    table = plan.table.to_dict("records")
    for length, n in small.items():
        own = [r for r in table if r["length"] == length]
        for rank in range(n):
            row = max((r for r in own if r["rank_start"] <= rank), key=lambda r: r["rank_start"])
            within = rank - row["rank_start"]
            bins[row["sequence"] + within // row["per_bin"]].append(length)
            placed[length] += 1
    assert placed == small and len(bins) == plan.sequences
    for held in bins.values():
        assert sum(held) <= 100 and len(held) <= 4 and sum(x * x for x in held) <= 5000


def test_empty_table(docs_of):
    assert P.pack_documents(docs_of([])).count() == 0
