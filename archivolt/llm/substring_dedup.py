"""Operator 2: duplicate passages by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller id. Its text is
indexed in blocks that content alone delimits: each window of ``window`` words
has an anchor, the k-gram of smallest hash inside it, and a block is a maximal
run of windows with one anchor. Equal passages are therefore cut into equal
blocks wherever they stand.

1. ``blocks``: one row per block with its anchor, a 64-bit key of its words and its place; anchor
   and key together are 128 bits of its content.
2. ``index_blocks``: a grouped minimum keeps, for each distinct block, its first place in the corpus.
3. ``boundary_phrases``: where documents share an anchor inside different blocks, factors end inside a
   block. Each such block is opened in the first document that holds it, at all its places there; the windows in
   it are indexed one by one.
4. ``factors``: every document is parsed greedily from left to right. A factor starts at the first window
   found in the reference and is extended while the next one continues at the same place of the reference;
   else the parse goes on with the next window of the reference, which is the check at factor boundaries.
   Factors hold at least ``window`` words, so each is a duplicate span.

Every grouping is a combinable minimum, so a passage in a third of all documents is one partial row per task.

Defined cases: a null text has no words; documents of fewer than ``window`` words have no window; a null
doc_id neither gives nor loses words; rows with the same doc_id do not count as smaller than each other and
are parsed one by one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm import _hashing as H
from archivolt.llm._io import map_rows, materialize, text_groups

WINDOW = 50
ANCHOR = 8
SPACE = bytes([9, 10, 11, 12, 13, 32])
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACE)] = False
SEPARATOR = b"\n"


def _documents(texts: list[bytes]):
    """(row, word keys) of each text, hashed in groups."""
    for start, end in text_groups(texts):
        group = texts[start:end]
        keys, starts, _ = H.word_keys(SEPARATOR.join(group), IS_WORD)
        offsets = np.cumsum([0] + [len(t) + 1 for t in group])
        cuts = np.searchsorted(starts, offsets)
        for i in range(len(group)):
            yield start + i, keys[cuts[i] : cuts[i + 1]]


def _binary(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def versioned(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text that tells rows of one doc_id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.hash(text).alias("version"))


def _cut(keys: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, windows, anchor and key of the blocks of at least ``window`` word keys."""
    grams = H.mix(H.Sequences(keys, H.SEQUENCE_MULTIPLIERS[0]).every(anchor))
    place = H.window_minimum(grams, window - anchor + 1)
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    ends = np.append(starts[1:], len(place))
    key = H.mix(H.Sequences(keys, H.SEQUENCE_MULTIPLIERS[1]).key(starts, ends + window - 1))
    return starts, ends - starts, grams[place[starts]], key


def blocks(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, version, start (first window), windows, anchor, key of every block of every document with an id."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = []
        for row, keys in _documents(_binary(batch, 1)):
            if len(keys) < window:
                continue
            starts, *rest = _cut(keys, window, anchor)
            parts.append((np.full(len(starts), row), starts, *rest))
        if not parts:
            return None
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                *(batch.column(k).take(pa.array(columns[0])) for k in (0, 2)),
                pa.array(columns[1].astype(np.int32)),
                pa.array(columns[2].astype(np.int16)),
                *(pa.array(c.view(np.int64)) for c in columns[3:]),
            ],
            ["doc_id", "version", "start", "windows", "anchor", "key"],
        )

    rows = versioned(docs).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return map_rows(rows, run, "doc_id long, version int, start int, windows short, anchor long, key long")


def index_blocks(found: DataFrame) -> DataFrame:
    """Each distinct block with its first place (ref_doc, ref_start) and the largest doc_id that holds it."""
    return (
        found.groupBy("anchor", "key")
        .agg(
            F.min(F.struct("doc_id", "version", "start")).alias("first"),
            F.max("doc_id").alias("last_doc"),
        )
        .select(
            "anchor",
            "key",
            F.col("first.doc_id").alias("ref_doc"),
            F.col("first.start").alias("ref_start"),
            "last_doc",
        )
    )


def _window_rows(opened: DataFrame, window: int, anchor: int) -> DataFrame:
    """doc_id, version, start, key1, key2 of each window in the blocks that a document is asked (by key) to open."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        asked = batch.column(3)
        parts = []
        for row, keys in _documents(_binary(batch, 1)):
            if len(keys) < window:
                continue
            starts, sizes, _, key = _cut(keys, window, anchor)
            wanted = np.isin(key.view(np.int64), asked[row].values.to_numpy(zero_copy_only=False))
            start = np.flatnonzero(np.repeat(wanted, sizes))  # blocks tile the windows
            pair = [H.mix(H.Sequences(keys, m).key(start, start + window)) for m in H.SEQUENCE_MULTIPLIERS]
            parts.append((np.full(len(start), row), start, *pair))
        if not parts:
            return None
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                *(batch.column(k).take(pa.array(columns[0])) for k in (0, 2)),
                pa.array(columns[1].astype(np.int32)),
                *(pa.array(c.view(np.int64)) for c in columns[2:]),
            ],
            ["doc_id", "version", "start", "key1", "key2"],
        )

    return map_rows(opened, run, "doc_id long, version int, start int, key1 long, key2 long")


def boundary_phrases(docs: DataFrame, index: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, version, start, windows, ref_doc, ref_start of windows at factor boundaries that the reference holds.

    Blocks that differ but share their anchor may agree in some of their windows. Each of them is opened at all
    its places in the rows of its first doc_id; a window's first place is the minimum over all of them.
    """
    shared = (
        index.groupBy("anchor")
        .agg(F.min("ref_doc").alias("lowest"), F.max("last_doc").alias("highest"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) & (F.col("lowest") < F.col("highest")))
        .select("anchor")
    )
    opened = (
        index.join(shared, "anchor", "left_semi")
        .groupBy(F.col("ref_doc").alias("doc_id"))
        .agg(F.collect_list("key").alias("asked"))
    )
    texts = versioned(docs).join(opened, "doc_id").select("doc_id", "text", "version", "asked")
    windows = materialize(_window_rows(texts, window, anchor), "windows")
    firsts = windows.groupBy("key1", "key2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("last"))
    firsts = firsts.filter(F.col("first.doc_id") < F.col("last")).drop("last")
    return (
        windows.join(firsts, ["key1", "key2"])
        .filter(F.col("doc_id") > F.col("first.doc_id"))
        .select(
            "doc_id",
            "version",
            "start",
            F.lit(1).cast("short").alias("windows"),
            F.col("first.doc_id").alias("ref_doc"),
            F.col("first.start").alias("ref_start"),
        )
    )


def phrases(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """All stretches of windows that the reference of their document holds, with the place there.

    A document that repeats a block gets its rows for each place. Copies of an opened block in documents after
    its first are found whole in the index; the windows that only the opened copies share with a smaller document
    belong to every later copy too, and those copies are covered as a whole.
    """
    found = materialize(blocks(docs, window, anchor), "blocks")
    index = materialize(index_blocks(found), "block-index")
    repeated = index.filter(F.col("ref_doc") < F.col("last_doc")).select("anchor", "key", "ref_doc", "ref_start")
    whole = (
        found.join(repeated, ["anchor", "key"])
        .filter(F.col("doc_id") > F.col("ref_doc"))
        .select("doc_id", "version", "start", "windows", "ref_doc", "ref_start")
    )
    return whole.unionByName(boundary_phrases(docs, index, window, anchor))


def greedy_factors(starts: np.ndarray, windows: np.ndarray, ref_docs: np.ndarray, ref_starts: np.ndarray, window: int = WINDOW):
    """Factors (start, length, ref_doc, ref_start) of one document from its phrases, left to right.

    At each window the phrase that reaches furthest is taken; it is extended by following phrases that
    continue at the same distance in the same reference document.
    """
    order = np.lexsort((-windows, starts))
    out: list[list[int]] = []
    for i in order:
        start, reach, ref, at = int(starts[i]), int(starts[i] + windows[i]), int(ref_docs[i]), int(ref_starts[i])
        if out:
            last = out[-1]
            covered = last[0] + last[1] - window + 1
            if reach <= covered:
                continue
            if start <= covered and ref == last[2] and at - start == last[3] - last[0]:
                last[1] = reach - last[0] + window - 1
                continue
            skip = max(0, covered - start)
            start, at = start + skip, at + skip
        out.append([start, reach - start + window - 1, ref, at])
    return out


FACTORS = "array<struct<start:int,length:int,ref_doc:long,ref_start:int>>"


def parse(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, factors and, on request, the kept text of every row."""
    found = (
        phrases(docs, window, anchor)
        .groupBy("doc_id", "version")
        .agg(F.collect_list(F.struct("start", "windows", "ref_doc", "ref_start")).alias("phrases"))
    )
    rows = versioned(docs).join(found, ["doc_id", "version"], "left")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "factors", *(["kept_text"] if with_text else [])]
    phrase_type = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors " + FACTORS
    factor_type = pa.list_(
        pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())])
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(2)
        flat = lists.flatten()
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        fields = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(4)]
        rows = []
        for row, text in enumerate(_binary(batch, 1)):
            words = text.split()
            end = ends[row]
            begin = ends[row - 1] if row else 0
            factors = greedy_factors(*(f[begin:end] for f in fields), window) if end > begin else []
            kept, at = [], 0
            for start, length, *_ in factors:
                if start > at:
                    kept += words[at:start]
                at = max(at, start + length)
            kept = kept + words[at:] if factors else words
            joined = b" ".join(kept)
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), factors, joined))
        n_words, n_removed, digests, factors, texts = zip(*rows, strict=True)
        columns = [
            batch.column(0),
            pa.array(n_words, pa.int64()),
            pa.array(n_removed, pa.int64()),
            pa.array(digests, pa.string()),
            pa.array([[dict(zip(("start", "length", "ref_doc", "ref_start"), f, strict=True)) for f in x] for x in factors], factor_type),
        ]
        if with_text:
            columns.append(pa.array([t.decode("utf-8") for t in texts], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names)

    return map_rows(rows.select("doc_id", "text", "phrases"), run, phrase_type + (", kept_text string" if with_text else ""))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The digest of the query: doc_id, n_words, n_removed, kept_sha256, and the factors."""
    return parse(docs)
