"""Operator 12: spelling variants of a vocabulary through Bloom-guided neighbourhoods.

Two words are near if one inserted, deleted or replaced code point makes one of the other. Of each word those edits are
generated that leave each pair to be found once: its distinct deletions (the longer word finds the shorter), and its
replacements by a larger letter of the vocabulary. Nearly all of them are no words. They are probed against Bloom filters
of the vocabulary, one for each length (a long shard in several sheets), made of blocks of 256 bits with a bit in each of
eight lanes; only the positives are spelt out and shuffled to an exact join with the vocabulary, which removes what is
no word. Hashes of edits come from that of their word by arithmetic on arrays.

The filters are broadcast in passes of at most ``PASS_WORDS`` words, 2 bytes each (32 MB), whatever the vocabulary: a larger
one takes more passes, each of which reads the vocabulary again and asks for its own lengths and sheets only.

A word's form is its most frequent near word if that has at least ``ratio`` times its occurrences. Frequencies grow along
forms, so they end; roots follow by pointer jumping, in a number of rounds that grows with the logarithm of the chain.

Defined cases: null texts hold no words; rows with equal doc_id count each for itself; a null doc_id is written as an empty
text where occurrences are damaged; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.llm._hashing import SEQUENCE_MULTIPLIERS, U64, mix, powers
from archivolt.llm._io import discard, map_rows, materialize

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Words of a sheet of a length's filter, of a pass, and of a block of 256 bits.
SHEET_WORDS, PASS_WORDS, BLOCK_WORDS = 1 << 22, 1 << 24, 16
#: Words whose edits one task probes, and edits that are hashed at once.
TASK_WORDS, EDITS = 1 << 15, 1 << 21
#: Odd multipliers, one for each lane of a block.
LANES = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint32)


def occurrences(docs: DataFrame, damage: int | None = None) -> DataFrame:
    """word: every run of letters of every text, A-Z lower-cased. With ``damage``, an occurrence whose crc32 of
    ``<doc_id>:<run>`` is divisible by it lacks the code point whose place is that number modulo the length."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"),
    )
    word = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = runs.filter(F.length("run") >= LEAST_LENGTH).select("id", word.alias("word"))
    if damage is None:
        return runs.select("word")
    h = F.crc32(F.concat_ws(":", "id", "word"))
    at = (h % F.length("word")).cast("int")
    lacking = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, F.length("word")))
    return runs.select(F.when(h % damage == 0, lacking).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.length("word") >= least_length) & (F.col("n") >= least_count))


def _values(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(U64) + U64(0x51ED270B5AE1D49D)) | U64(1)


def _terms(codes: np.ndarray) -> np.ndarray:
    """Of words of one length (rows of code points): each letter's part of the word's sum."""
    return _values(codes) * powers(SEQUENCE_MULTIPLIERS[0], codes.shape[1])[0]


def _key(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums + U64(length * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


@dataclass
class Sheets:
    """What a pass asks for: of each length, how many sheets it has, and the blocks of those that are in the pass."""

    sheets: dict[int, int]
    blocks: dict[tuple[int, int], np.ndarray]

    def holds(self, keys: np.ndarray, length: int) -> np.ndarray:
        """Places of keys that may be words of this length."""
        found = []
        sheet = (keys >> U64(3)) % U64(self.sheets.get(length, 1))
        for (other, k), blocks in self.blocks.items():
            if other == length:
                at = np.flatnonzero(sheet == k) if self.sheets[length] > 1 else np.arange(len(keys))
                low = (keys[at] & U64(0xFFFFFFFF)).astype(np.uint32)
                block = block_of(keys[at], len(blocks))
                for lane, multiplier in enumerate(LANES):
                    stay = np.flatnonzero((blocks[block, lane] >> (low * multiplier >> np.uint32(27))) & np.uint32(1))
                    at, low, block = at[stay], low[stay], block[stay]
                found.append(at)
        return np.sort(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((keys >> U64(32)) * U64(blocks) >> U64(32)).astype(np.int64)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of one length, and their code points."""
    sizes = np.array([len(w) for w in words])
    for length in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == length)
        step = max(1, EDITS // (length * 32))
        for start in range(0, len(own), step):
            part = own[start : start + step]
            codes = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le"), dtype="<u4")
            yield part, codes.reshape(len(part), length)


def edits(codes: np.ndarray, letters: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(place, letter or -1 for a deletion, rows, sums) of the edits of words of one length."""
    n, length = codes.shape
    up, down = powers(SEQUENCE_MULTIPLIERS[0], length + 1)
    terms = _terms(codes)
    sums = terms.sum(axis=1, dtype=U64)
    before = np.zeros(n, dtype=U64)
    values = _values(letters)
    for i in range(length):
        after = sums - before - terms[:, i]
        rows = np.flatnonzero(codes[:, i] != codes[:, i - 1]) if i else np.arange(n)
        yield i, -1, rows, (before + after * down[1])[rows]
        rest = sums - terms[:, i]
        for letter, value in zip(letters.tolist(), values * up[i], strict=True):
            rows = np.flatnonzero(codes[:, i] < letter)
            if len(rows):
                yield i, letter, rows, rest[rows] + value
        before = before + terms[:, i]


def _filters(words: DataFrame, lengths: dict[int, int]) -> Iterator[Sheets]:
    """The passes. Bits of a block are united by Spark; the driver gets the blocks of one pass."""
    sheets = {length: max(1, -(-n // SHEET_WORDS)) for length, n in lengths.items()}
    size = {length: max(1, -(-n // (sheets[length] * BLOCK_WORDS))) for length, n in lengths.items()}

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for part, codes in _by_length(batch.column(0).to_pylist()):
            length = codes.shape[1]
            keys = _key(_terms(codes).sum(axis=1, dtype=U64), length)
            bits = np.uint32(1) << ((keys & U64(0xFFFFFFFF)).astype(np.uint32)[:, None] * LANES >> np.uint32(27))
            sheet = (keys >> U64(3)) % U64(sheets[length])
            out.append((np.full(len(part), length), sheet.astype(np.int64), block_of(keys, size[length]), bits.astype("<u4").view("<i8")))
        length, sheet, block, lanes = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (length, sheet, block, *lanes.T)], ["length", "sheet", "block", "l0", "l1", "l2", "l3"])

    placed = map_rows(words.select("word"), place, "length long, sheet long, block long, l0 long, l1 long, l2 long, l3 long", rows=1 << 16)
    united = placed.groupBy("length", "sheet", "block").agg(*[F.bit_or(f"l{i}").alias(f"l{i}") for i in range(4)])
    passes: list[list[tuple[int, int]]] = []
    held = 0
    for length, k in ((length, k) for length in sorted(lengths) for k in range(sheets[length])):
        words_in = -(-lengths[length] // sheets[length])
        if not passes or held + words_in > PASS_WORDS:
            passes.append([])
            held = 0
        passes[-1].append((length, k))
        held += words_in
    if len(passes) > 1:
        united = materialize(united, "filters")
    for wanted in passes:
        chosen = [(F.col("length") == a) & (F.col("sheet") == b) for a, b in wanted]
        got = (united.filter(functools.reduce(Column.__or__, chosen)) if len(passes) > 1 else united).toArrow()
        blocks = {(a, b): np.zeros((size[a], 8), dtype="<u4") for a, b in wanted}
        at = [got[c].to_numpy() for c in ("length", "sheet", "block")]
        lanes = np.stack([got[f"l{i}"].to_numpy() for i in range(4)], axis=1).astype("<i8").view("<u4").reshape(-1, 8) if len(got) else np.zeros((0, 8), dtype="<u4")
        for a, b in wanted:
            own = np.flatnonzero((at[0] == a) & (at[1] == b))
            blocks[a, b][at[2][own]] = lanes[own]
        yield Sheets({a: sheets[a] for a, _ in wanted}, blocks)


def _positives(words: DataFrame, letters: np.ndarray, sheets: Sheets) -> DataFrame:
    """word, n, other: edits of words that a filter of the pass holds."""
    shared = words.sparkSession.sparkContext.broadcast(sheets)

    def ask(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        held, names = shared.value, batch.column(0).to_pylist()
        asked = {length for length, _ in held.blocks}
        row, other = [], []
        for part, codes in _by_length(names):
            length = codes.shape[1]
            for i, letter, rows, sums in edits(codes, letters) if {length, length - 1} & asked else ():
                size = length - (letter < 0)
                for k in rows[held.holds(_key(sums, size), size)].tolist() if size in asked else ():
                    word = names[part[k]]
                    row.append(int(part[k]))
                    other.append(word[:i] + (chr(letter) if letter >= 0 else "") + word[i + 1 :])
        n = batch.column(1).take(pa.array(row, pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), n, pa.array(other, pa.string())], ["word", "n", "other"])

    return map_rows(words.select("word", "n"), ask, "word string, n long, other string", rows=1 << 14)


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n of every two near words, once."""
    letters = F.explode(F.array_distinct(F.split("word", ""))).alias("letter")
    known = words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    # One row for each length, and one for each letter that words are written with.
    lengths = {r.length: r.n for r in known.collect()}
    used = np.array(sorted(ord(r.letter) for r in words.select(letters).distinct().collect() if r.letter), dtype=np.uint32)
    words = words.repartition(max(1, -(-sum(lengths.values()) // TASK_WORDS)), "word")
    found = [_positives(words, used, sheets) for sheets in _filters(words, lengths)]
    exact = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    if not found:
        return words.select("word", "n").join(exact, F.col("word") == F.col("other")).filter(F.lit(False))
    positives = found[0]
    for more in found[1:]:
        positives = positives.unionByName(more)
    return positives.join(exact, "other").select("word", "n", "other", "other_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form."""
    state = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialize(
            state.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots"
        )
        discard(state)
        state = new
        if state.filter("moved").limit(1).count() == 0:
            return state.select("word", "root")


def group(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of distinct words and their occurrences."""
    words = materialize(words.select("word", "n"), "vocabulary")
    pairs = materialize(near_pairs(words), "near-words")
    both = pairs.select("word", "other", "other_n").unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))

    def likeliest() -> Column:
        return F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other")))

    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), likeliest().alias("best"))
    formed = words.join(near, "word", "left").withColumn("fits", -F.col("best.less") >= F.col("n") * ratio)
    formed = materialize(
        formed.select(
            "word",
            F.when(F.col("fits"), F.col("best.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(F.col("fits"), -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, damage: int | None = None) -> DataFrame:
    """The grouping of the vocabulary of texts."""
    return group(vocabulary(occurrences(docs, damage)))
