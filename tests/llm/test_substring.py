import hashlib
import random
import re

from archivolt.llm import substring_dedup as S


def brute(rows, window=50):
    texts = {}
    for d, t, *_ in rows:
        texts.setdefault((d, t), re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    first = {}
    for (d, _), w in texts.items():
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, d), d)
    out = {}
    for (d, t), w in texts.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d, t] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return sorted((repr(d), *out[d, t]) for d, t, *_ in rows)


def found(df):
    return sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_shared_passages_against_brute_force(docs_of):
    rng = random.Random(1)
    word = lambda n=400: f"w{rng.randrange(n)}"
    passages = [[word() for _ in range(rng.choice((49, 50, 51, 80, 200)))] for _ in range(8)]
    rows = []
    for d in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += [word() for _ in range(rng.randrange(0, 90))]
            p = rng.choice(passages)
            a = rng.randrange(0, 30)
            parts += p[a:] if rng.random() < 0.5 else p
        rows.append((d, " ".join(parts), "en", "s"))
    rows += [(500, rows[3][1], "en", "s"), (501, "a " * 300, "en", "s"), (502, "a " * 260, "en", "s"), (503, "b c " * 200, "en", "s")]
    assert found(S.dedup_documents(docs_of(rows))) == brute(rows)


def test_passages_repeated_in_their_second_document_against_brute_force(docs_of):
    rng = random.Random(5)
    run = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows = []
    for d in range(0, 60, 2):
        p, s, t = run(60), run(60), run(60)
        rows += [(d, " ".join(p), "en", "s"), (d + 1, " ".join((s + p + t) * 2), "en", "s")]
        if d % 6 == 0:  # two rows of one doc_id, which hold the same block
            rows += [(d + 1, " ".join(s + p + t + ["end"]), "en", "s")]
    assert found(S.dedup_documents(docs_of(rows))) == brute(rows)


def test_odd_rows_and_clashing_ids(docs_of, odd_rows):
    rows = [*odd_rows, (6, " ".join(f"w{i % 97}" for i in range(3, 200)), "en", "z")]
    assert found(S.dedup_documents(docs_of(rows))) == brute(rows)


def test_empty_table(docs_of):
    assert S.dedup_documents(docs_of([])).count() == 0


def test_factors_cover_the_removed_words(docs_of):
    passage = " ".join(f"p{i}" for i in range(120))
    rows = [(1, "x y " + passage, "en", "s"), (2, passage + " tail", "en", "s")]
    second = S.parse(docs_of(rows), with_text=True).filter("doc_id = 2").first()
    assert [(f.start, f.length, f.ref_doc, f.ref_start) for f in second.factors] == [(0, 120, 1, 2)]
    assert second.kept_text == "tail"
