"""Language identification, decontamination, personal data, line dedup and quality on small tables."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from archivolt.llm import decontaminate, language_id, line_dedup, pii, quality


# -- language ---------------------------------------------------------------------------------------------------

VOICES = {"en": "the and of thing with that house river", "fr": "le la les été garçon où maison rivière", "de": "der die das über straße häuser fluß"}


def sentences(n, seed=0):
    rng = random.Random(seed)
    return [(d, " ".join(rng.choice(VOICES[lang].split()) for _ in range(rng.randrange(3, 40))), lang, "s") for d in range(n) for lang in [rng.choice(list(VOICES))]]


def test_language_of_held_out_documents(docs_of, odd_rows):
    rows = sentences(300)
    found = {r.doc_id: r for r in language_id.language_of_documents(docs_of(rows)).collect()}
    wrong = sum(found[d].lang_pred != lang for d, _, lang, _ in rows if found[d].held_out)
    assert sum(r.held_out for r in found.values()) > 40 and wrong <= 2
    odd = language_id.language_of_documents(docs_of(rows + [(1000 + i, *r[1:]) for i, r in enumerate(odd_rows)])).collect()
    assert len(odd) == 310
    assert {r.doc_id: r.lang_pred for r in odd if r.doc_id in (1000, 1001, 1002)} == {1000: "und", 1001: "und", 1002: "und"}
    assert all(0 <= r.score <= 1 for r in odd)


def test_language_without_labels_or_rows(docs_of):
    assert [r.lang_pred for r in language_id.language_of_documents(docs_of([(1, "hello", None, None)])).collect()] == ["und"]
    assert language_id.language_of_documents(docs_of([])).count() == 0


def test_pieces_hold_every_gram_once(monkeypatch):
    text = "Hello  wörld, 12 of piéces " * 40
    whole = Counter(g for b in language_id._grams(text) if b is not None for g in b.tolist())
    monkeypatch.setattr(language_id, "PIECE", 7)
    assert Counter(g for b in language_id._grams(text) if b is not None for g in b.tolist()) == whole


def plain_grams(text):
    """Buckets of the 2- and 3-grams of a text, one character at a time."""
    spaced = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    codes = [ord(c) for c in " " + re.sub(" +", " ", " " + spaced + " ").strip(" ") + " "]
    out = []
    for order, multipliers in language_id._MULTIPLIERS.items():
        for k in range(len(codes) - order + 1):
            mixed = 0
            for c, m in zip(codes[k : k + order], multipliers, strict=True):
                mixed = (mixed ^ c) * m % 2**32
            mixed = (mixed ^ mixed >> 15) * 0x2C1B3C6D % 2**32
            out.append(mixed >> 32 - language_id.BUCKET_BITS)
    return out


def brute_language(rows):
    """Plain multinomial naive Bayes with the smoothing of the operator."""
    counts, docs = defaultdict(Counter), Counter()
    for d, t, lang, _ in rows:
        if None not in (d, t, lang) and zlib.crc32(str(d).encode()) % 4 != 2:
            docs[lang] += 1
            counts[lang].update(plain_grams(t) if any(unicodedata.category(c)[0] == "L" for c in t) else ())
    out = []
    for d, t, *_ in rows:
        if t is None or not docs or not any(unicodedata.category(c)[0] == "L" for c in t):
            out.append((repr(d), "und", 0.0))
            continue
        grams, total = Counter(plain_grams(t)), {}
        for lang in sorted(docs):
            size = sum(counts[lang].values()) + language_id.SMOOTHING * 2**language_id.BUCKET_BITS
            total[lang] = math.log(docs[lang] / sum(docs.values())) + sum(n * math.log((counts[lang][g] + language_id.SMOOTHING) / size) for g, n in grams.items())
        best = max(total, key=total.get)
        out.append((repr(d), best, 1 / sum(math.exp(x - total[best]) for x in total.values())))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [256, 2])
def test_language_against_plain_naive_bayes(docs_of, odd_rows, monkeypatch, block):
    """Also with more languages than one block holds."""
    monkeypatch.setattr(language_id, "BLOCK_CLASSES", block)
    rows = sentences(120, 5) + [(1000 + i, *r[1:]) for i, r in enumerate(odd_rows)] + [(None, "the house", "de", "s")]
    rows += [(2000 + i, "the der les " * 3, f"x{i % 3}", "s") for i in range(12)] + [(2100, "1 2 3", "digits", "s")]
    found = language_id.language_of_documents(docs_of(rows)).collect()
    got, wanted = sorted(((repr(r.doc_id), r.lang_pred, r.score) for r in found), key=repr), brute_language(rows)
    assert [g[:2] for g in got] == [w[:2] for w in wanted]
    assert all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, wanted, strict=True))


def test_identify_keeps_clashing_columns_apart(docs_of):
    docs = docs_of(sentences(40))
    out = language_id.identify(docs, language_id.fit(docs))
    assert out.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"] and out.count() == 40


# -- decontamination ----------------------------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_contamination(rows, items):
    windows, lengths = defaultdict(set), set()
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        if n:
            lengths.add(n)
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(i)
    out = []
    for d, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                ids = windows.get(tuple(w[k : k + n]))
                if ids:
                    found |= ids
                    hit.update(range(k, k + n))
        named = sorted(str(i) for i in found if i is not None)
        out.append((repr(d), len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_contamination_against_brute_force(spark, docs_of, odd_rows, monkeypatch):
    rng = random.Random(3)
    word = lambda: f"k{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.choice((0, 1, 2, 5, 9, 10, 11, 30))))) for i in range(25)]
    items += [(3, items[4][1]), (None, " ".join(f"n{i}" for i in range(12))), (90, None), (91, "A-b C_d!e é1 f g h i j k l")]
    rows = list(odd_rows)
    for d in range(100, 180):
        parts = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(0, 4)
            parts += w[a:]
        rows.append((d, " ".join(parts).upper() if d % 2 else ", ".join(parts), "en", "s"))
    rows += [(160, rows[-20][1], "en", "s"), (160, "k1 k2 and more", "en", "s"), (None, rows[-3][1], "en", "s")]
    rows += [(300, "x a b c d E é1 F g h i j k l", "en", "s"), (301, " ".join(f"n{i}" for i in range(12)), "en", "s")]
    benchmark = spark.createDataFrame([(*i, 1, "d") for i in items], "item_id long, text string, n int, doc_id string")
    wanted = brute_contamination(rows, items)
    for bits in (26, 8):  # a filter that tells, and one that lets nearly all through
        monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
        found = decontaminate.contamination(docs_of(rows), benchmark).collect()
        assert sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found) == wanted
    docs = docs_of(rows)
    marked = decontaminate.mark(docs, benchmark)
    assert set(docs.columns) <= set(marked.columns) and marked.count() == len(rows)
    assert sorted((repr(r.doc_id), sum(h.end - h.start for h in r.hits)) for r in marked.collect()) == sorted((d, n) for d, _, n, *_ in wanted)
    clean = decontaminate.without_hits(docs, benchmark)
    assert clean.columns == docs.columns and sorted(repr(r.doc_id) for r in clean.collect()) == sorted(d for d, _, n, *_ in wanted if not n)


def test_contamination_of_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.contamination(docs_of([(1, "a b", "en", "s")]), none).collect()] == [False]
    assert decontaminate.contamination(docs_of([]), none).count() == 0


# -- personal data ------------------------------------------------------------------------------------------------

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and pii._luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], x[2]))


@settings(max_examples=1500, deadline=None)
@given(st.text("ab1 90.@+-()%25é", max_size=40))
def test_base_spans_are_those_of_the_patterns(text):
    base, every = pii.find_spans(text)
    assert base == brute_spans(text) and set(base) <= set(every)


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("write john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("x john at example dot com y", "email", "john at example dot com"),
        ("a jоhn@example.com b", "email", "jоhn@example.com"),
        ("call plus one five five five one two three four five six seven!", "phone", "plus one five five five one two three four five six seven"),
        ("ip one nine two dot one six eight dot zero dot one x", "ip", "one nine two dot one six eight dot zero dot one"),
        ("at １９２.168.0.1 is", "ip", "１９２.168.0.1"),
        ("card 4111​1111 1111 1111 end", "card", "4111​1111 1111 1111"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    spans = pii.find_spans(text)[1]
    assert (kind, found) in {(pii.KINDS[k], text[a:b]) for a, b, k in spans}


@pytest.mark.parametrize("text", ["meet me at example.com for a dot", "look at one two three", "one, two and 3.4.5", "at [dot] com"])
def test_plain_prose_is_left_alone(text):
    assert pii.find_spans(text) == ([], [])


def test_detect_and_redact(docs_of, odd_rows):
    rows = [*odd_rows, (9, "é a@b.co and +1 (743) 555-3824", "en", "s")]
    found = [r for r in pii.detect(docs_of(rows)).collect()]
    assert len(found) == len(rows)
    row = next(r for r in found if r.doc_id == 9)
    assert (row.n_email, row.n_phone, row.spans) == (1, 1, "email:2:8,phone:13:30")
    assert row.base_sha256 == hashlib.sha256(row.spans.encode()).hexdigest()
    assert {r.text for r in pii.redact(docs_of(rows)).collect() if r.doc_id == 9} == {"é <email> and <phone>"}
    assert pii.detect(docs_of([])).count() == 0


# -- lines --------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    """Lines in a pair of neighbouring lines with letters that stands before."""

    def pairs(text):
        lines = text.split("\n")
        written = [i for i, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        return [(i, j, tuple(lines[i : j + 1])) for i, j in zip(written, written[1:], strict=False)]

    first = {}
    for d, t, *_ in rows:
        if d is not None and t is not None:
            for i, _, c in pairs(t):
                first[c] = min(first.get(c, (d, i)), (d, i))
    out = []
    for d, t, *_ in rows:
        lines = [] if t is None else t.split("\n")
        gone = {k for i, j, c in (pairs(t) if t is not None and d is not None else ()) if first[c] < (d, i) for k in range(i, j + 1)}
        kept = None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((repr(d), len(lines), len(gone), kept))
    return sorted(out, key=repr)


def test_line_chunks_against_brute_force(docs_of, odd_rows):
    rng = random.Random(6)
    shared = [[f"shared {b} {i}" for i in range(rng.randrange(3, 15))] for b in range(5)]
    rows = list(odd_rows)
    for d in range(100, 160):
        part = rng.choice(shared)
        at = rng.randrange(len(part))
        lines = [f"own {d} {i}" for i in range(rng.randrange(0, 6))] + part[at:] + [f"end {rng.randrange(4)}"] * rng.randrange(0, 3)
        lines += ["", " "] * rng.randrange(0, 3) + [f"more {d}"] + part[: rng.randrange(4)]
        rows.append((d, "\n".join(lines), "en", "s"))
    for d in range(160, 175):  # a passage of two lines only, on other lines of every document; blank lines between them
        rows.append((d, f"a {d}\n\ntwo lines\n\t\nin all\n\nb {d}\n\n\nb {d}", "en", "s"))
    docs = docs_of(rows)
    found = line_dedup.dedup_lines(docs)
    assert set(docs.columns) <= set(found.columns)
    got = sorted(((repr(r.doc_id), r.n_lines, r.n_removed, r.text) for r in found.collect()), key=repr)
    assert got == brute_lines(rows) and sum(r[2] for r in got) > 50
    assert line_dedup.dedup_documents(docs_of([])).count() == 0


# -- quality ------------------------------------------------------------------------------------------------------


def test_quality_finds_bad_words_and_follows_sites(spark, docs_of, odd_rows):
    rng = random.Random(8)
    rows, labels = [(10_000 + i, *r[1:]) for i, r in enumerate(odd_rows)], []
    for d in range(600):
        bad = rng.random() < 0.2
        body = [f"w{rng.randrange(300)}" for _ in range(40)] + (["awful"] if bad else [])
        rng.shuffle(body)
        rows.append((d, " ".join(body), "en", f"s{d % 5}"))
        if d % 2:
            labels.append((d, 1, int(bad)))
    table = spark.createDataFrame([*labels, (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = quality.score(docs_of(rows), table).collect()
    assert len(found) == len(rows)
    marked = {d for d, t, *_ in rows if d is not None and "awful" in (t or "").split()}
    unlabelled = [r for r in found if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 2 == 0]
    wrong = [r.doc_id for r in unlabelled if r.kept == (r.doc_id in marked)]
    assert len(wrong) <= 3
    assert all(0 <= r.p_toxic <= 1 for r in found)


def brute_quality(rows, labels):
    """The two probabilities of each row, by loops over plain numbers."""
    known = defaultdict(lambda: [[], []])
    for d, *values in labels:
        for t, v in enumerate(values):
            if d is not None and v is not None:
                known[d][t].append(v)
    label = {d: (min(q) if q else None, max(x) if x else None) for d, (q, x) in known.items()}
    half = lambda d: zlib.crc32(str(d).encode()) % 2
    held = [set(quality.buckets((t or "").encode()).tolist()) for _, t, *_ in rows]
    sites = [(s or "", f"{s or ''}/{lang or ''}") for _, _, lang, s in rows]
    out = [[] for _ in rows]
    for t in (0, 1):
        mine = [(i, label[r[0]][t], half(r[0])) for i, r in enumerate(rows) if r[0] in label and label[r[0]][t] is not None]

        def ratios(part):
            n, count = [0, 0], [Counter(), Counter()]
            for i, y, _ in part:
                n[y] += 1
                count[y].update(held[i])
            out = {}
            for b in count[0] | count[1]:
                common = (count[0][b] + count[1][b] + 0.5) / (max(sum(n), 1) + 1)
                rate = [(count[y][b] + 1) / (n[y] + 1 / common) for y in (0, 1)]
                plain = [max(x, 1) for x in n]
                spread = math.sqrt(common * (1 - min(common, 1 - 1e-9)) * (1 / plain[0] + 1 / plain[1]))
                if min(n) > 0 and abs(count[1][b] / plain[1] - count[0][b] / plain[0]) >= 4 * spread:
                    out[b] = math.log(rate[1] / rate[0])
            return out

        tables = [ratios([m for m in mine if m[2] == h]) for h in (0, 1)] + [ratios(mine)]
        evidence = lambda i, table: max(-50.0, min(50.0, sum(tables[table].get(b, 0.0) for b in held[i])))
        k, n = Counter(), Counter()
        for i, y, _ in mine:
            for site in ("", *sites[i]):
                k[site] += y
                n[site] += 1
        hosts, paths = {h for h, _ in sites}, set(sites)
        share = (k[""] + 0.5) / (n[""] + 1)

        def strength(groups):
            excess = sum((k[g] - n[g] * p) ** 2 - n[g] * p * (1 - p) for g, p in groups if n[g] > 1)
            scale = sum(n[g] * (n[g] - 1) * p * (1 - p) for g, p in groups if n[g] > 1)
            return 1 / min(max(excess / scale, 1e-3), 0.5) - 1 if scale else 10.0

        a = strength([(h, share) for h in hosts])
        host = {h: (k[h] + a * share) / (n[h] + a) for h in hosts}
        a = strength([(p, host[h]) for h, p in paths])
        path = {p: (k[p] + a * host[h]) / (n[p] + a) for h, p in paths}
        bins = Counter((max(-400, min(400, math.floor(evidence(i, 1 - h) / 0.25 + 0.5))), y) for i, y, h in mine)
        table = pd.DataFrame([(b * 0.25, y, w, math.log(share / (1 - share))) for (b, y), w in bins.items()], columns=["x", "y", "w", "offset"])
        slope, intercept = quality._fit(table)
        for i, (r, (_, p)) in enumerate(zip(rows, sites, strict=True)):
            own = r[0] in label and label[r[0]][t] is not None
            z = math.log(path[p] / (1 - path[p])) + slope * evidence(i, 1 - half(r[0]) if own else 2) + intercept
            out[i].append(1 / (1 + math.exp(-z)))
    return sorted((repr(r[0]), *map(float, x)) for r, x in zip(rows, out, strict=True))


def test_quality_against_plain_empirical_bayes(spark, docs_of):
    rng = random.Random(11)
    rows, labels = [], []
    for d in range(500):
        host = rng.randrange(6)
        bad, good = rng.random() < 0.1 + 0.1 * host, rng.random() < 0.6
        body = [f"w{rng.randrange(80)}" for _ in range(20)] + ["awful"] * bad + ["fine"] * good
        rows.append((d, " ".join(body), rng.choice(["en", "de", None]), f"s{host}"))
        if rng.random() < 0.7:
            labels.append((d, int(good), None if rng.random() < 0.1 else int(bad)))
    rows += [(3, "a second text awful", "en", "s9"), (900, None, "en", "s1"), (None, "awful " * 3 + "x" * 200 + "Y" * 5, "en", "s1")]
    labels += [(4, 0, 1), (4, 1, 0), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = quality.score(docs_of(rows), table).collect()
    got = sorted((repr(r.doc_id), r.p_quality, r.p_toxic) for r in found)
    wanted = brute_quality(rows, labels)
    assert [g[0] for g in got] == [w[0] for w in wanted]
    assert max(abs(x - y) for g, w in zip(got, wanted, strict=True) for x, y in zip(g[1:], w[1:], strict=True)) < 1e-9
    assert len({round(g[2], 6) for g in got}) > 10


def test_shapes_take_whole_words():
    assert set(quality.buckets(b"A" * 70 + b"b" * 3 + b"!")) != set(quality.buckets(b"A" * 70 + b"b" * 3))


def test_quality_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    row = quality.score(docs_of([(1, "a b", "en", "s")]), none).first()
    assert (row.p_quality, row.p_toxic, row.kept) == (0.5, 0.5, True)
    assert quality.score(docs_of([]), none).count() == 0
