"""Operator 6: benchmark decontamination by winnowing.

Words hash to 64 bits; k-grams of words hash over them. Of every ``WINDOW - GRAM + 1`` consecutive k-grams the
smallest hash is kept (with its leftmost place), so any stretch of ``WINDOW`` words keeps exactly one fingerprint, the
same one wherever it stands: each shared stretch of at least ``WINDOW`` words shares a kept fingerprint. The
fingerprints of texts and items are joined; every hit is extended over the windows that keep it, which are compared
by 128 bits of their words, and neighbouring windows make up the full shared stretch. Items shorter than a window are
one k-gram and one window of their own length.

Both sides of a join are rows that shuffle, or that the planner broadcasts by its own check of their size; neither
texts nor items are gathered anywhere. Before they are shuffled, fingerprints of texts pass a filter of 2^26 bits
(8 MB whatever the benchmark) that holds those of the items; what it lets through wrongly ends in the join.

Defined cases: a null or wordless text has no hits; a null or wordless item has no windows; rows with equal
item_id count as one item, and a null item_id is reported nowhere but its words are hit; repeated rows are
marked alike, and rows that share a doc_id each by its own text; extra columns of either table are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm import _hashing as H
from archivolt.llm._io import join_by_text, map_rows, materialize, merged_stretches, text_groups, version

WINDOW = 10
GRAM = 5
#: Bits of the filter that holds the benchmark's fingerprints.
FILTER_BITS = 26
_SEPARATORS = [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[_SEPARATORS] = False
SEPARATOR = b" "


def word_hashes(texts: list[bytes]):
    """(row, word hashes, starts, ends) of each text; ends and starts are byte offsets in the text."""
    for start, end in text_groups(texts):
        group = [t.lower() for t in texts[start:end]]
        keys, starts, ends = H.word_keys(SEPARATOR.join(group), IS_WORD)
        offsets = np.cumsum([0] + [len(t) + 1 for t in group])
        cuts = np.searchsorted(starts, offsets)
        for i in range(len(group)):
            own = slice(cuts[i], cuts[i + 1])
            yield start + i, keys[own], starts[own] - offsets[i], ends[own] - offsets[i]


def _grams(keys: np.ndarray, width: int) -> np.ndarray:
    return H.mix(H.Sequences(keys, H.SEQUENCE_MULTIPLIERS[0]).every(width))


def winnow(keys: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Kept fingerprints in order, and how many consecutive windows keep each."""
    grams = _grams(keys, gram)
    place = H.window_minimum(grams, window - gram + 1)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return grams[place[first]], np.diff(np.append(first, len(place)))


def _window_keys(keys: np.ndarray, starts: np.ndarray, length: int) -> list[np.ndarray]:
    """128 bits of each window, as two arrays."""
    return [H.mix(H.Sequences(keys, m).key(starts, starts + length)) for m in H.SEQUENCE_MULTIPLIERS]


def _signed(columns: list[list[np.ndarray]]) -> list[pa.Array]:
    return [pa.array(np.concatenate(c).view(np.int64)) for c in columns]


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """item_id, n, gram, key1, key2 of every window of every item: its words, its kept fingerprint, its content."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows, lengths, columns = [], [], [[], [], []]
        for row, keys, _, _ in word_hashes(batch.column(1).cast(pa.binary()).to_pylist()):
            n = min(len(keys), window)
            if not n:
                continue
            prints = np.repeat(*winnow(keys, window, gram)) if n == window else _grams(keys, n)
            rows.append(np.full(len(prints), row))
            lengths.append(np.full(len(prints), n, dtype=np.int32))
            for held, new in zip(columns, (prints, *_window_keys(keys, np.arange(len(prints)), n)), strict=True):
                held.append(new)
        if not rows:
            return None
        ids = batch.column(0).take(pa.array(np.concatenate(rows)))
        return pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(lengths)), *_signed(columns)], ["item_id", "n", "gram", "key1", "key2"])

    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return map_rows(items, run, "item_id long, n int, gram long, key1 long, key2 long").distinct()


def _filter(prints: DataFrame) -> np.ndarray:
    """One bit for each value of the first bits of a fingerprint; at most 2^(FILTER_BITS - 6) rows reach the driver."""
    bit = F.shiftrightunsigned("gram", 64 - FILTER_BITS)
    words = (
        prints.select(F.shiftright(bit, 6).alias("word"), bit.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
        .toPandas()
    )
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    out[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _passes(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    place = grams >> np.uint64(65 - (len(bits) * 64).bit_length())
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def text_windows(docs: DataFrame, prints: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, version, n_words of every row, and n, gram, start, key1, key2 of its windows that pass the filter.

    n_words stands on one line of each row of ``docs``; lines without a window have a null n.
    """
    lengths = sorted(r.n for r in prints.select("n").distinct().collect())  # at most ``window`` values
    shared = docs.sparkSession.sparkContext.broadcast(_filter(prints))

    def windows(keys: np.ndarray, n: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and fingerprints of the windows of n words that pass."""
        if n < window:
            grams = _grams(keys, n)
            starts = np.flatnonzero(_passes(bits, grams))
            return starts, grams[starts]
        kept, size = winnow(keys, window, gram)
        passed = _passes(bits, kept)
        return (np.flatnonzero(np.repeat(passed, size)), np.repeat(kept[passed], size[passed])) if passed.any() else (np.empty(0, np.int64), kept[:0])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = shared.value
        rows, counts, others = [np.arange(batch.num_rows)], np.zeros(batch.num_rows, dtype=np.int64), [[] for _ in range(5)]
        for row, keys, _, _ in word_hashes([t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]):
            counts[row] = len(keys)
            for n in lengths:
                if len(keys) < n:
                    break
                starts, grams = windows(keys, n, bits)
                if len(starts):
                    rows.append(np.full(len(starts), row))
                    found = np.full(len(starts), n), grams.view(np.int64), starts, *(k.view(np.int64) for k in _window_keys(keys, starts, n))
                    for held, new in zip(others, found, strict=True):
                        held.append(new)
        rows = np.concatenate(rows)
        more = len(rows) - batch.num_rows
        place = pa.array(rows)
        given = [pa.concat_arrays([pa.nulls(batch.num_rows, pa.int64()), pa.array(np.concatenate(c) if c else np.empty(0, np.int64))]) for c in others]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(place), batch.column(1).take(place), pa.concat_arrays([pa.array(counts), pa.nulls(more, pa.int64())]), *given],
            ["doc_id", "version", "n_words", "n", "gram", "start", "key1", "key2"],
        )

    rows = docs.select(F.col("doc_id").cast("long"), version(F.col("text")).alias("version"), F.col("text").cast("string"))
    return map_rows(rows, run, "doc_id long, version long, n_words long, n long, gram long, start long, key1 long, key2 long")


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, version, n_words of every row; doc_id, version, hits, items of what is hit.

    ``hits`` are disjoint stretches of words, ``items`` sorted item ids.
    """
    held = materialize(benchmark_windows(benchmark, window, gram), "benchmark-windows")
    prints = materialize(held.select(F.col("n").cast("long"), "gram").distinct(), "benchmark-prints")
    seen = materialize(text_windows(docs, prints, window, gram), "text-windows")
    shared = seen.filter("n IS NOT NULL").drop("n_words").join(prints, ["n", "gram"], "left_semi")
    held = held.withColumn("n", F.col("n").cast("long"))
    content = ["n", "key1", "key2"]
    document = ["doc_id", "version"]
    same = materialize(shared.join(held.select(*content).distinct(), content, "left_semi"), "shared-windows")
    hits = (
        merged_stretches(same.withColumn("end", F.col("start") + F.col("n")), document)
        .groupBy(*document)
        .agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias("hits"))
    )
    items = (
        same.select(*document, *content)
        .join(held.select(*content, "item_id").filter("item_id IS NOT NULL").distinct(), content)
        .select(*document, "item_id")
        .distinct()
        .groupBy(*document)
        .agg(F.array_sort(F.collect_list("item_id")).alias("items"))
        .withColumnsRenamed({"doc_id": "d", "version": "v"})
    )
    both = hits.join(items, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    found = both.select(*document, "hits", F.coalesce("items", F.array().cast("array<long>")).alias("items"))
    return seen.filter("n_words IS NOT NULL").select(*document, "n_words"), materialize(found, "hits")


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The columns of ``docs`` with ``hits`` (disjoint stretches of words) and ``items`` (sorted item ids).

    Columns of ``docs`` by these names are replaced.
    """
    _, found = occurrences(docs, benchmark, window, gram)
    marked = join_by_text(docs.drop("hits", "items"), found, "left")
    return marked.withColumns(
        {
            "hits": F.coalesce("hits", F.array().cast("array<struct<start:int,end:int>>")),
            "items": F.coalesce("items", F.array().cast("array<long>")),
        }
    )


def without_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark."""
    _, found = occurrences(docs, benchmark, window, gram)
    return join_by_text(docs, found, "left_anti")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    counted, found = occurrences(docs, benchmark)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, h: total + (h["end"] - h["start"]))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    sums = found.select(
        F.col("doc_id").alias("d"), F.col("version").alias("v"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), listed.alias("items")
    )
    joined = counted.join(sums, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
