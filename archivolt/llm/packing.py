"""Operator 5: vector best-fit packing of tokenised documents into training sequences.

A piece needs tokens, one document place and attention cost (the square of its length); a sequence has a
capacity of each. All three needs follow from the length, so the histogram of lengths, at most ``capacity``
rows whatever the corpus, describes the whole packing problem. The driver runs best fit decreasing on it, in
batches of equal pieces over groups of equally filled sequences: the group is chosen by the norm of what would
be left, or by the weighted dot product of the need and what is left, among those where every constraint holds.

The plan says which ranks of a length go where. Pieces get their rank within their length without gathering a
length in one task: lengths are cut into buckets by hash, ranked inside, and offset by the counts of the buckets
before, in groups of buckets that are offset likewise. One search in the broadcast plan places a piece.

With the default capacities the document places and the attention cost of a sequence never bind: pieces have at least
one token, and squares of lengths add up to at most the square of their sum. They take part in the score alone; smaller
capacities do bind and are kept for every sequence.

Tokens come from a cache of white-space words per Python worker: the tokenizer never joins text across white
space, so a text's ids are those of its words. Ids are counted and digested in the task; they are not shuffled.

Defined cases: a null text is an empty document (its end id alone); a text longer than the capacity is cut
into full pieces and a rest; rows with equal or null doc_id are packed each for itself; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.llm._io import map_rows, materialize

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: Words kept by a worker's cache, about 150 MB.
CACHE_WORDS = 700_000
#: Pieces of one length that are ranked together.
RANK_GROUP = 128
#: Buckets of one length whose counts are added up together: at 10^12 pieces of one length, 2 million groups.
BUCKET_GROUP = 4096
_PUNCTUATION = (b",", b".")


class WordTokenizer:
    """Ids of texts as little-endian 32-bit bytes, through a cache of the ids of their words."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.cache: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes]) -> None:
        """Encode words as one text, which costs half of encoding each, and cut its ids at the words' places."""
        texts = [w.decode("utf-8") for w in words]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4")
        places = np.fromiter((start for start, _ in found.offsets), dtype=np.int64, count=len(ids))
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        cuts = np.searchsorted(places, starts).tolist()
        data = ids.tobytes()
        self.cache.update((w, data[4 * a : 4 * b]) for w, a, b in zip(words, cuts[:-1], cuts[1:], strict=True))

    def encode(self, text: bytes) -> bytes:
        """The tokenizer lowers letters itself; a text that may hold its special tokens keeps its case."""
        words = (text if b"<|" in text else text.lower()).split()
        if len(self.cache) > self.limit:
            self.cache.clear()
        missing = set(words).difference(self.cache)
        if missing:
            ended = [w for w in missing if w.endswith(_PUNCTUATION) and w[:-1].isalpha()]
            bases = {w[:-1] for w in ended}.difference(self.cache) | missing.difference(ended)
            self._learn(sorted(bases.union(_PUNCTUATION)))
            self.cache.update((w, self.cache[w[:-1]] + self.cache[w[-1:]]) for w in ended)
        return b"".join(map(self.cache.__getitem__, words))


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker and file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, on request, the ids of every piece of every row."""
    path = path or tokenizer_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = tokenizer(path).encode
        row, piece, start, length, crc, ids = [], [], [], [], [], []
        step = 4 * capacity
        for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
            data = encode(text or b"") + END_ID.to_bytes(4, "little")
            for k, at in enumerate(range(0, len(data), step)):
                part = data[at : at + step]
                row.append(i)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids.append(np.frombuffer(part, dtype="<i4"))
        columns = [
            batch.column(0).take(pa.array(row, pa.int64())),
            pa.array(piece, pa.int32()),
            *(pa.array(x, pa.int64()) for x in (start, length, crc)),
        ]
        if with_ids:
            columns.append(pa.array(ids, pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


@dataclass(frozen=True)
class Capacities:
    """What a sequence holds, and how much each kind of room counts in the choice of one."""

    tokens: int = CAPACITY
    documents: int = CAPACITY
    attention: int = CAPACITY**2
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"  # or "dot"

    def need(self, length: int) -> np.ndarray:
        return np.array([length, 1, length * length], dtype=np.int64)

    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], dtype=np.int64)


@dataclass
class Plan:
    """Ranges of ranks by length: where each starts, its first sequence, pieces per sequence, place in it."""

    table: pd.DataFrame  # length, rank_start, sequence, per_bin, offset
    sequences: int


def plan_packing(histogram: dict[int, int], capacities: Capacities | None = None) -> Plan:
    """Vector best fit decreasing on a histogram of lengths.

    A group stands for ``size`` sequences that hold the same pieces. Placing a run of equal pieces fills each
    sequence of the chosen group with as many as fit before the next, as placing them one at a time would.
    """
    capacities = capacities or Capacities()
    limits = capacities.limits()
    scale = np.sqrt(np.array(capacities.weights)) / limits
    room = np.empty((64, 3), dtype=np.int64)
    size, filled = np.zeros(64, dtype=np.int64), [()] * 64
    count = 0
    closed: list[tuple[int, tuple]] = []

    def add(left: np.ndarray, bins: int, held: tuple) -> None:
        nonlocal count, room, size, filled
        if count == len(size):
            room, size, filled = np.concatenate([room, room]), np.concatenate([size, size]), filled + filled
        room[count], size[count], filled[count] = left, bins, held
        count += 1

    for length in sorted(histogram, reverse=True):
        n, need = histogram[length], capacities.need(length)
        if (need > limits).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities")
        while n:
            fits = np.flatnonzero((room[:count] >= need).all(axis=1) & (size[:count] > 0))
            if len(fits):
                if capacities.rule == "norm":
                    score = (((room[fits] - need) * scale) ** 2).sum(axis=1)
                else:
                    score = -((room[fits] * scale) @ (need * scale))
                at = int(fits[np.argmin(score)])
                left, bins, held = room[at].copy(), int(size[at]), filled[at]
            else:
                at, left, held = -1, limits.copy(), ()
                bins = -(-n // int((limits // need).min()))
            each = min(int((left // need).min()), n)
            full = min(bins, n // each)
            if at >= 0:
                size[at] = bins - full
            add(left - each * need, full, (*held, (length, each)))
            n -= full * each
            if 0 < n < each and full < bins:
                if at >= 0:
                    size[at] -= 1
                add(left - n * need, 1, (*held, (length, n)))
                n = 0
        keep = (size[:count] > 0) & (room[:count, 0] > 0)
        for i in np.flatnonzero((size[:count] > 0) & ~keep):
            closed.append((int(size[i]), filled[i]))
        if keep.sum() < count:
            stay = np.flatnonzero(keep)
            filled[: len(stay)] = [filled[i] for i in stay]
            room[: len(stay)], size[: len(stay)] = room[stay], size[stay]
            count = len(stay)
    groups = closed + [(int(size[i]), filled[i]) for i in range(count) if size[i] > 0]

    rows, ranks, sequence = [], dict.fromkeys(histogram, 0), 0
    for bins, held in groups:
        offset = 0
        for length, each in held:
            rows.append((length, ranks[length], sequence, each, offset))
            ranks[length] += bins * each
            offset += length * each
        sequence += bins
    table = pd.DataFrame(rows, columns=["length", "rank_start", "sequence", "per_bin", "offset"]).astype(np.int64)
    return Plan(table.sort_values(["length", "rank_start"]).reset_index(drop=True), sequence)


def _ranked(cut: DataFrame, histogram: DataFrame) -> DataFrame:
    """Each piece's rank within its length, from 0, ranked in buckets of about RANK_GROUP pieces."""
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(RANK_GROUP))).cast("long")
    dealt = cut.join(F.broadcast(histogram.select("length", buckets.alias("buckets"))), "length").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets"))
    )
    group = F.floor(F.col("bucket") / F.lit(BUCKET_GROUP))
    sizes = dealt.groupBy("length", group.alias("group"), "bucket").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialize(sizes, "bucket-sizes")

    def so_far(column: str, *keys: str) -> Column:
        before = Window.partitionBy(*keys).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(before), F.lit(0))

    groups = sizes.groupBy("length", "group").agg(F.sum("n").alias("n"))
    groups = groups.select("length", "group", so_far("group", "length").alias("outside"))
    offsets = (
        sizes.withColumn("inside", so_far("bucket", "length", "group"))
        .join(groups, ["length", "group"])
        .select("length", "bucket", (F.col("inside") + F.col("outside")).alias("before"))
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (
        dealt.withColumn("place", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "bucket"])
        .withColumn("rank", F.col("place") + F.col("before"))
        .drop("place", "before", "bucket", "buckets")
    )


def assign(cut: DataFrame, capacities: Capacities | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (any columns with doc_id, piece, length, ids_crc32)."""
    # At most one row per length up to the capacity of tokens.
    counted = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    spark = cut.sparkSession
    histogram = spark.createDataFrame(counted, "length long, n long") if counted else spark.createDataFrame([], "length long, n long")
    plan = plan_packing({row.length: row.n for row in counted}, capacities)
    shared = spark.sparkContext.broadcast({c: plan.table[c].to_numpy() for c in plan.table.columns})
    ranked = _ranked(cut, histogram)
    kept = [f for f in ranked.schema.fields if f.name != "rank"]
    at_length, at_rank = ranked.columns.index("length"), ranked.columns.index("rank")
    names = [f.name for f in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "sequence_id long", "offset long"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (batch.column(k).to_numpy() for k in (at_length, at_rank))
        rows = shared.value
        # lengths and ranks in one sorted key: ranks stay below 2^47
        at = np.searchsorted((rows["length"] << 47) | rows["rank_start"], (length << 47) | rank, "right") - 1
        within = rank - rows["rank_start"][at]
        per_bin = rows["per_bin"][at]
        sequence = rows["sequence"][at] + within // per_bin
        offset = rows["offset"][at] + (within % per_bin) * length
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return map_rows(ranked, run, schema, rows=1 << 16)


def pack_documents(docs: DataFrame, path: str | None = None, capacities: Capacities | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    capacities = capacities or Capacities()
    cut = materialize(pieces(docs, path, capacities.tokens), "pieces")
    return assign(cut, capacities).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
