import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tokenizers")
pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")

from archivolt.llm import token_alignment as T  # noqa: E402

PARTS = ["a", "b", "the", " ", "  ", "\n", "\r", "\t", "\n\n", "\r\n", ".", "!", "'s", "é", "漢", "🙂", "\xa0", " ", "\x00", "\x1c", " w", "23", "<s>", "<|endoftext|>", "ﬁ", "{", "}", ");", "\x85", "　", "́", "▁"]


@pytest.fixture(scope="module")
def known():
    return T.Aligner(T.tokenizer_path(T.LEFT), T.tokenizer_path(T.RIGHT))


def plain(known, text):
    """Groups of a whole text by the two tokenizers and the bytes of their tokens, or None."""
    if not text:
        return None
    a = known.left.encode(" " + text, add_special_tokens=False).ids
    b = known.right.encode(text)
    sides = [[known.left_bytes[i] for i in a], [known.right_bytes[i] for i in b]]
    if any(b"".join(side) != (" " + text).encode() for side in sides):
        return None
    ends = [np.cumsum([len(x) for x in side]).tolist() for side in sides]
    out, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
        out.append((a[i:x], b[j:y]))
        i, j = x, y
    return out


def spelling(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def brute(known, rows):
    every = [(d, plain(known, t)) for d, t, *_ in rows]
    counts, best = Counter(), defaultdict(int)
    for _, groups in every:
        counts.update({(a, b) for x, y in groups or () for a in x for b in y})
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for d, groups in every:
        links = [(a, b) for x, y in groups or () for a in x for b in y]
        sizes = [sum(len(g[k]) for g in groups or ()) for k in (0, 1)]
        digest = hashlib.sha256(spelling(groups).encode()).hexdigest() if groups else ""
        out.append((d, *sizes, len(groups or ()), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(out, key=str)


def test_segments_are_as_the_whole_text(known):
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 14)))
        segments = known.segments(" " + text)
        assert "".join(segments) == " " + text
        numbers = known.look_up(segments)
        wanted = plain(known, text)
        if wanted is None:
            assert (known.sizes[numbers, 0] < 0).any(), text
        else:
            assert b";".join(known.texts[i] for i in numbers).decode() == spelling(wanted), text


def test_documents_against_brute_force(spark, docs_of, odd_rows, known, monkeypatch):
    rng = random.Random(5)
    words = ["lorem", "ipsum", "dolor,", "sité", "ament\n", "x" * 40, "!!!!!", "12345678", "漢字漢字", "\n\n", "don't"]
    rows = list(odd_rows) + [(100 + d, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))), "en", "s") for d in range(80)]
    rows += [(300 + d, "every one of these is the same text", "en", "s") for d in range(60)]
    rows += [(400, "a▁b", "en", "s"), (401, "y" * 5000, "en", "s"), (402, "ab" * 3000 + " " + "🙂" * 800, "en", "s")]
    found = T.align_documents(docs_of(rows, 5), with_groups=True).collect()
    assert sorted((tuple(r)[:-1] for r in found), key=str) == brute(known, rows)
    for r in found:
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")


def test_pair_counts(spark, docs_of, known):
    rows = [(d, "one two" if d % 3 else "one three", "en", "s") for d in range(30)]
    counts = Counter()
    for _, t, *_ in rows:
        counts.update({(a, b) for x, y in plain(known, t) for a in x for b in y})
    found = {(r.a, r.b): (r.n, r.best) for r in T.pair_counts(docs_of(rows)).collect()}
    assert {p: n for p, (n, _) in found.items()} == dict(counts)
    assert all(best == (n == max(m for (a, _), (m, _) in found.items() if a == p[0])) for p, (n, best) in found.items())


def test_empty_table(docs_of):
    assert T.align_documents(docs_of([])).count() == 0


def test_runs_and_frames(monkeypatch):
    monkeypatch.setattr(T, "FRAME_RECORDS", 50)
    rng = np.random.default_rng(3)
    runs, counts = [], Counter()
    for _ in range(7):
        keys = np.unique((rng.zipf(1.3, 600).clip(max=1 << 30) << T._PLACE) | rng.integers(0, 5000, 600))
        links = rng.integers(1, 1 << 18, len(keys))
        run = T.write_run(keys, links)
        back = list(T.read_run(run))
        pairs = np.concatenate([np.repeat(p, n) for p, n, _, _ in back])
        assert ((pairs << T._PLACE) | np.concatenate([d for _, _, d, _ in back])).tolist() == keys.tolist()
        assert np.concatenate([m for *_, m in back]).tolist() == links.tolist()
        assert all(p[0] > q[-1] for (q, *_), (p, *_) in zip(back, back[1:]))
        counts.update((keys >> T._PLACE).tolist())
        runs.append(run)
    merged = [(p, n) for ps, ns in T.merge_counts(runs) for p, n in zip(ps.tolist(), ns.tolist())]
    assert merged == sorted(counts.items())


def test_a_small_cache_and_small_runs(spark, docs_of, known, monkeypatch):
    monkeypatch.setattr(T, "_aligners", {(T.tokenizer_path(T.LEFT), T.tokenizer_path(T.RIGHT)): known})
    known.make_room()
    monkeypatch.setattr(known, "limit", 5)
    known.look_up(["aa", " bb", " bb", " cc", " dd", " ee", " ff"])
    known.make_room()
    assert list(known.known) == [" bb"] or not known.known
    numbers = known.look_up([" bb", " cc"])
    assert [known.texts[i].decode() for i in numbers] == [spelling(plain(known, "bb")), spelling(plain(known, "cc"))]
