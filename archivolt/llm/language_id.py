"""Operator 1: language identification by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of all labelled rows inside the tasks and adds them up by (language, bucket) in one grouped sum,
a table of languages x buckets entries whatever the corpus. It is read in blocks of at most ``BLOCK_CLASSES`` languages,
so that the matrix of log probabilities that is broadcast has a fixed bound: a few languages are one block and one pass
over the texts; each further block is one more pass, which carries the best language so far and the sum of posteriors.

A batch of texts is scored as a sparse matrix, one row of n-gram counts per text, by one product with the matrix of log
probabilities, in pieces of bounded size.

Defined cases: a null text or one without a letter is ``und`` with score 0; with no labelled row at all every document
is ``und``; a null language never trains; of languages that score alike the first by name is taken; repeated rows are
scored alike; whole texts count, in pieces of bounded size.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.llm._io import map_rows, materialize, unused

UNKNOWN = "und"
BUCKET_BITS = 15
ORDERS = (2, 3)
SMOOTHING = 0.1
#: Languages of one block: 256 x 2^15 doubles are 64 MB.
BLOCK_CLASSES = 256
#: Doubles of one piece of a sparse product.
PRODUCT_SIZE = 1 << 21
PIECE = 1 << 18
_MULTIPLIERS = {2: (0x9E3779B1, 0x85EBCA77), 3: (0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)}


@functools.cache
def _letters() -> np.ndarray:
    """Per code point: 2 for letters, 1 for marks, else 0."""
    kinds = (unicodedata.category(chr(c))[0] for c in range(0x110000))
    return np.fromiter(({"L": 2, "M": 1}.get(k, 0) for k in kinds), dtype=np.int8, count=0x110000)


def _grams(text: str | None):
    """Buckets of the n-grams of a text, piece by piece; nothing for a text without a letter.

    Lower case; each run of characters that are neither letters nor marks is one space, ends included.
    A piece starts with the last codes of the one before, and only n-grams that end in its new part count.
    """
    if not text:
        return
    lap = max(ORDERS) - 1
    tail, seen = np.full(1, 32, np.uint32), False
    for start in range(0, len(text), PIECE):
        codes = np.frombuffer(text[start : start + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = _letters()[codes]
        seen = seen or bool((kinds == 2).any())
        end = [np.full(1, 32, np.uint32)] if start + PIECE >= len(text) else []
        joined = np.concatenate([tail, np.where(kinds > 0, codes, np.uint32(32)), *end])
        space = joined == 32
        stay = np.ones(len(joined), bool)
        stay[1:] = ~(space[1:] & space[:-1])
        stay[: len(tail)] = True
        joined = joined[stay]
        yield np.concatenate([b[max(0, len(tail) - order + 1) :] for order, b in zip(ORDERS, _buckets(joined))])
        tail = joined[-lap:]
    if not seen:
        yield None


def _buckets(codes: np.ndarray) -> list[np.ndarray]:
    """The bucket of each n-gram, by its start, for each order."""
    out = []
    for order in ORDERS:
        n = len(codes) - order + 1
        mixed = np.zeros(max(n, 0), dtype=np.uint32)
        if n > 0:
            for k, multiplier in enumerate(_MULTIPLIERS[order]):
                mixed = (mixed ^ codes[k : k + n]) * np.uint32(multiplier)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
        out.append((mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int64))
    return out


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row, bucket, count) of the texts that have a letter, in order, and which those are."""
    rows, columns, values, seen = [], [], [], np.zeros(len(texts), dtype=bool)
    for i, text in enumerate(texts):
        counts = None
        for grams in _grams(text):
            if grams is None:
                counts = None
            else:
                new = np.bincount(grams, minlength=1 << BUCKET_BITS)
                counts = new if counts is None else counts + new
        if counts is not None:
            seen[i] = True
            used = np.flatnonzero(counts)
            rows.append(np.full(len(used), i))
            columns.append(used)
            values.append(counts[used])
    joined = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, columns, values))
    return (*joined, seen)


@dataclass(frozen=True)
class Block:
    """Part of the model: some languages with their columns of the matrix."""

    languages: list[str]
    log_prior: np.ndarray
    log_matrix: np.ndarray  # buckets x languages

    def totals(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """Log joint probability of n texts and each language: the sparse matrix of counts times the log matrix."""
        out = np.tile(self.log_prior, (n, 1))
        step = max(1, PRODUCT_SIZE // max(len(self.languages), 1))
        for start in range(0, len(rows), step):
            part = slice(start, start + step)
            first = np.flatnonzero(np.append(True, np.diff(rows[part]) != 0))
            out[rows[part][first]] += np.add.reduceat(values[part, None] * self.log_matrix[columns[part]], first, axis=0)
        return out

    def best(self, texts: list[str | None]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Best language of each text, its log joint probability, and the sum of all relative to it; None without a letter."""
        rows, columns, values, seen = gram_counts(texts)
        totals = self.totals(rows, columns, values, len(texts))
        at = totals.argmax(axis=1)
        top = totals[np.arange(len(texts)), at]
        labels = [self.languages[k] if s else None for k, s in zip(at.tolist(), seen.tolist(), strict=True)]
        return labels, top, np.exp(totals - top[:, None]).sum(axis=1)


@dataclass(frozen=True)
class LanguageModel:
    """A table of n-gram counts (block, lang, bucket, n; bucket -1 counts rows) and the languages by block."""

    counts: DataFrame
    blocks: list[list[str]]
    rows: int

    def block(self, number: int) -> Block:
        """One block, of at most BLOCK_CLASSES x (2^BUCKET_BITS + 1) counts."""
        languages = self.blocks[number]
        held = self.counts.filter(F.col("block") == number).select("lang", "bucket", "n").toPandas()
        place = held["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64)
        bucket, n = held["bucket"].to_numpy(), held["n"].to_numpy()
        counts = np.full((1 << BUCKET_BITS, len(languages)), SMOOTHING)
        gram = bucket >= 0
        np.add.at(counts, (bucket[gram], place[gram]), n[gram])
        rows_of = np.zeros(len(languages))
        rows_of[place[~gram]] = n[~gram]
        return Block(languages, np.log(rows_of / max(self.rows, 1)), np.log(counts / counts.sum(axis=0, keepdims=True)))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", where: Column | None = None) -> LanguageModel:
    """Learn from every row with a language (and ``where``, if given). The names of the languages reach the driver."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = (rows.filter(where) if where is not None else rows).select(
        F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    )

    def count(batches):
        totals: dict[str, list] = {}

        def spell():
            for language, (counts, n) in totals.items():
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([language] * (len(used) + 1), pa.string()),
                        pa.array(np.append(used, -1).astype(np.int32)),
                        pa.array(np.append(counts[used], n)),
                    ],
                    ["lang", "bucket", "n"],
                )
            totals.clear()

        for batch in batches:
            for value, language in zip(batch.column(0), batch.column(1)):
                held = totals.setdefault(language.as_py(), [np.zeros(1 << BUCKET_BITS, np.int64), 0])
                held[1] += 1
                for grams in _grams(value.as_py()):
                    if grams is not None:
                        held[0] += np.bincount(grams, minlength=1 << BUCKET_BITS)
                if len(totals) > BLOCK_CLASSES:
                    yield from spell()
        yield from spell()

    counted = rows.mapInArrow(count, "lang string, bucket int, n long")
    summed = materialize(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "gram-counts")
    named = sorted((r.lang, r.n) for r in summed.filter("bucket = -1").select("lang", "n").collect())
    languages = [x for x, _ in named]
    blocks = [languages[i : i + BLOCK_CLASSES] for i in range(0, len(languages), BLOCK_CLASSES)]
    number = F.create_map(*[F.lit(x) for k, block in enumerate(blocks) for x in (block[0], k)]) if blocks else None
    if len(blocks) > 1:
        firsts = F.array(*[F.lit(block[0]) for block in blocks])
        at = F.element_at(F.filter(firsts, lambda x: x <= F.col("lang")), -1)
        summed = summed.withColumn("block", F.element_at(number, at))
    else:
        summed = summed.withColumn("block", F.lit(0))
    return LanguageModel(summed, blocks, sum(n for _, n in named))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) with ``lang_pred`` and ``score``; those two replace columns of their names."""
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(unused("text_", docs)))
    fields = source.schema.fields
    state = [unused(x, docs) for x in ("best_", "top_", "sum_")]
    scored = source.withColumns({x: F.lit(None).cast(t) for x, t in zip(state, ("string", "double", "double"), strict=True)})
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"{state[0]} string, {state[1]} double, {state[2]} double"])
    for number in range(len(model.blocks)):
        scored = map_rows(scored, _scorer(docs.sparkSession.sparkContext.broadcast(model.block(number)), len(kept)), schema)
    best, _, total = (F.col(f"`{x}`") for x in state)
    return scored.select(
        *[F.col(f"`{c}`") for c in kept], F.coalesce(best, F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(1 / total, F.lit(0.0)).alias("score")
    )


def _scorer(shared, at_text: int):
    """A step that takes (..., text, best, top, sum) and adds the languages of one block; the last three are null before the first."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        labels, top, total = shared.value.best(batch.column(at_text).to_pylist())
        before = batch.column(at_text + 1).to_pylist()
        old_top, old_total = (
            batch.column(at_text + k).fill_null(v).to_numpy(zero_copy_only=False) for k, v in ((2, -np.inf), (3, 0.0))
        )
        higher = np.maximum(top, old_top)
        total = total * np.exp(top - higher) + old_total * np.exp(old_top - higher)
        names = [b if b is not None and o >= t else x for x, t, b, o in zip(labels, top.tolist(), before, old_top.tolist(), strict=True)]
        blank = np.array([x is None for x in names], dtype=bool)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[: at_text + 1], pa.array(names, pa.string()), pa.array(higher, mask=blank), pa.array(total, mask=blank)],
            batch.schema.names,
        )

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that never trains: crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def language_of_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. Rows of the held-out fold never train; a null doc_id
    is in no fold and does not train."""
    model = fit(docs, where=~held_out())
    flagged = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return identify(flagged, model, keep=["doc_id", "held_out"])
