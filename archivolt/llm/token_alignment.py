"""Operator 11: alignment of two tokenizers, with pair counts by external spill counting.

A text is cut at byte offsets where tokens of both sides end; tokens between two such cuts are a group, and every pair of
tokens of a group is a link. The count of a pair of ids is the number of documents that hold it linked.

One pass over the texts writes, for each document, its figures, and, for all documents of a task, records (pair, document,
links): sorted runs of bounded size, dealt by the low bits of the left id (radix) and compressed with zstd in frames. The
runs of 16 neighbouring tasks and one radix meet in one group, whose k-way merge over frames (a heap holds the last pair
of each run's frame) counts each pair; these counts are summed over the groups, and the left id's highest count is a window
over at most as many rows as the right side has ids. Each group then gets the totals of its own pairs back and streams
its runs once more, in order of the left id, to add up what every document receives. A frequent pair thus never meets in
one task: each group holds its records of 16 tasks only.

Tokens come from a cache of segments per Python worker. A segment starts at a space or line feed after a character that
is not white space, where no token of either side goes on: the left side splits there before it merges, and the right
side's vocabulary has no piece across. Whether that holds is looked up when a vocabulary is read; where it does not, a text
is one segment.

Defined cases: a text that is null, empty, or whose tokens of either side do not spell it (a character that a side
normalises, or bytes that are not UTF-8) has no tokens: zeros and an empty groups text. Rows with equal or null doc_id are
documents of their own. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.llm._io import materialize

LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Segments kept by a worker's cache, about 100 MB; their characters; characters of a longer text that are cut at once.
CACHE_SEGMENTS = 300_000
CACHE_CHARACTERS = 1 << 24
CHUNK = 1 << 20
#: Characters of a batch; records of a run before it is written, but for one document's; records of a frame.
BATCH = 1 << 21
RUN_RECORDS = 1 << 20
FRAME_RECORDS = 1 << 15
#: Radix parts of the left ids, and neighbouring tasks whose runs are merged together.
RADIX = 32
MERGED_TASKS = 16
#: Bits of a document's place in its run, and of a right id in a pair.
_PLACE, _SIDE = 24, 20

_WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_OTHER = _WHITE.replace("\\n", "").replace(" ", "")
_SEGMENT = re.compile(f"\\n(?=[^{_WHITE}])|[{_WHITE}]*[^{_WHITE}]+(?:[{_OTHER}][{_WHITE}]*[^{_WHITE}]+)*(?:[{_OTHER}][{_WHITE}]*)?|[{_WHITE}]+")
#: Beyond these letters the two libraries may hold to different versions of Unicode.
_FAR = re.compile("[^\\x00-\u024f]")
_CUT = re.compile(f"(?<=[^{_WHITE}]) ")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, others follow from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, and what is known of the segments seen: groups text, sizes, and distinct pairs with their links."""

    def __init__(self, left: str, right: str, limit: int = CACHE_SEGMENTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.left = Tokenizer.from_file(left)
        self.left.encode_special_tokens = True
        letters = _byte_letters()
        entries = self.left.get_vocab(with_added_tokens=False)
        left_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            left_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.right = sentencepiece.SentencePieceProcessor(model_file=right)
        pieces = [self.right.id_to_piece(i) for i in range(self.right.vocab_size())]
        right_bytes = [
            bytes([int(p[3:5], 16)]) if self.right.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        if len(left_bytes) >> (63 - _SIDE - _PLACE) or len(pieces) >> _SIDE:
            raise ValueError("the vocabularies have too many pairs")
        normal = [p for i, p in enumerate(pieces) if not self.right.is_byte(i)]
        self.cuts = not any("\n" in p or re.search("[^▁]▁", p) for p in normal)
        self.quick = _ranked_encoding(left, left_bytes)
        self.left_bytes, self.right_bytes = left_bytes, right_bytes
        self.left_sizes, self.right_sizes = (np.array([len(x) for x in side]) for side in (left_bytes, right_bytes))
        # A token as it is written: on the left before another or before the bar, on the right before another or the group's end.
        many = len(left_bytes)
        self.written = [b"%d%c" % (i, end) for end in b",|" for i in range(many)] + [b"%d%c" % (i, end) for end in b",;" for i in range(len(pieces))]
        self.bar, self.comma, self.semicolon = many, 2 * many, 2 * many + len(pieces)
        self.limit = limit
        self.forget(np.zeros(0, dtype=np.int64))

    def forget(self, kept: np.ndarray) -> None:
        """Keep the segments of these numbers only, under new numbers."""
        if not len(kept):
            self.known: dict[str, int] = {}
            self.texts: list[bytes] = []
            self.sizes = np.zeros((0, 4), dtype=np.int64)  # left tokens (-1: a side spells something else), right ones, groups, links
            self.pairs, self.links, self.ends = (np.zeros(n, dtype=np.int64) for n in (0, 0, 1))
        else:
            names = list(self.known)
            self.known = {names[i]: n for n, i in enumerate(kept.tolist())}
            self.texts = [self.texts[i] for i in kept.tolist()]
            self.sizes = self.sizes[kept]
            at, sizes = self._stretches(kept)
            self.pairs, self.links, self.ends = self.pairs[at], self.links[at], np.append(0, np.cumsum(sizes))
        self.uses = np.zeros(len(self.texts), dtype=np.int64)
        self.held = sum(map(len, self.known))

    def make_room(self) -> None:
        """Numbers hold until this is called: between batches only. Segments that came once since the last time go."""
        if len(self.texts) > self.limit or self.held > CACHE_CHARACTERS:
            again = np.flatnonzero(self.uses > 1)
            self.forget(again if len(again) < self.limit // 2 and self.held < 2 * CACHE_CHARACTERS else again[:0])

    def _stretches(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs of segments, one segment after the other, and how many each has."""
        starts = self.ends[numbers]
        sizes = self.ends[numbers + 1] - starts
        return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum()), sizes

    def segments(self, text: str) -> list[str]:
        return _SEGMENT.findall(text) if self.cuts else [text]

    def chunks(self, text: str) -> Iterator[str]:
        """Parts of a long text that end where a segment does."""
        at = 0
        while self.cuts and len(text) - at > CHUNK:
            cut = _CUT.search(text, at + CHUNK)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def look_up(self, segments: list[str]) -> np.ndarray:
        """Numbers of segments."""
        numbers = list(map(self.known.get, segments))
        missing = [i for i, n in enumerate(numbers) if n is None]
        if missing:
            self._learn(list(dict.fromkeys(segments[i] for i in missing)))
            for i in missing:
                numbers[i] = self.known[segments[i]]
        out = np.array(numbers, dtype=np.int64)
        self.uses += np.bincount(out, minlength=len(self.uses))
        return out

    def _left_ids(self, segments: list[str]) -> list[list[int]]:
        if self.quick is None:
            return [x.ids for x in self.left.encode_batch(segments, add_special_tokens=False)]
        quick = self.quick.encode_ordinary
        return [self.left.encode(s, add_special_tokens=False).ids if _FAR.search(s) else quick(s) for s in segments]

    def _learn(self, segments: list[str]) -> None:
        left = self._left_ids(segments)
        if self.cuts:  # a line feed is a token of its own on the right, after the space that is put before it
            right = [x[2:] for x in self.right.encode(["\n" + s for s in segments], num_threads=1)]
        else:
            right = self.right.encode([s[1:] for s in segments], num_threads=1)
        spelt = np.array(
            [
                b"".join(map(self.left_bytes.__getitem__, a)) == b"".join(map(self.right_bytes.__getitem__, b)) == s.encode()
                for s, a, b in zip(segments, left, right, strict=True)
            ]
        )
        start = len(self.known)
        self.known.update(zip(segments, range(start, start + len(segments)), strict=True))
        self.held += sum(map(len, segments))
        good = np.flatnonzero(spelt).tolist()
        found = self._align([left[i] for i in good], [right[i] for i in good])
        sizes = np.tile(np.array([-1, 0, 0, 0]), (len(segments), 1))
        texts, pairs = [b""] * len(segments), np.zeros(len(segments), dtype=np.int64)
        sizes[spelt], pairs[spelt] = found[1], found[2]
        for i, text in zip(good, found[0], strict=True):
            texts[i] = text
        self.texts += texts
        self.sizes = np.concatenate([self.sizes, sizes])
        self.uses = np.append(self.uses, np.zeros(len(segments), dtype=np.int64))
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(pairs))
        self.pairs, self.links = np.append(self.pairs, found[3]), np.append(self.links, found[4])

    def _align(self, left: list[list[int]], right: list[list[int]]) -> tuple:
        """Of segments that both sides spell: groups texts, sizes, numbers of distinct pairs, and these with their links."""
        n = len(left)
        if not n:
            return [], np.zeros((0, 4), dtype=np.int64), *(np.zeros(0, dtype=np.int64) for _ in range(3))
        counts = [np.array([len(x) for x in side]) for side in (left, right)]
        ids = [np.fromiter(chain.from_iterable(side), dtype=np.int64) for side in (left, right)]
        ends = [np.cumsum(sizes[i]) for sizes, i in zip((self.left_sizes, self.right_sizes), ids, strict=True)]
        # All segments lie behind each other; their ends are ends of both sides, and so of groups.
        cuts = np.intersect1d(*ends, assume_unique=True)
        group = [np.searchsorted(cuts, e) for e in ends]
        sizes = [np.bincount(g, minlength=len(cuts)) for g in group]
        owner = np.repeat(np.arange(n), counts[0])
        own = owner[np.searchsorted(group[0], np.arange(len(cuts)))]
        links = sizes[0] * sizes[1]
        table = np.stack([*counts, np.bincount(own, minlength=n), np.bincount(own, links, minlength=n).astype(np.int64)], axis=1)

        last = [np.append(g[1:] != g[:-1], True) for g in group]
        written = np.concatenate([ids[0] + self.bar * last[0], ids[1] + np.where(last[1], self.semicolon, self.comma)])
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        tokens = list(map(self.written.__getitem__, written[order].tolist()))
        stops = np.cumsum(counts[0] + counts[1]).tolist()
        texts = [b"".join(tokens[a:b])[:-1] for a, b in zip([0, *stops], stops, strict=False)]

        # Every token on the left with all on the right of its group. A group of very many is first made distinct.
        first = np.cumsum(sizes[1]) - sizes[1]
        times = [np.ones(len(i), dtype=np.int64) for i in ids]
        if links.max() > 4096:
            for k, (other, most) in enumerate(((ids[0], len(self.left_bytes)), (ids[1], len(self.right_bytes)))):
                keys, times[k] = np.unique(group[k] * most + other, return_counts=True)
                group[k], ids[k] = keys // most, keys % most
            sizes = [np.bincount(g, minlength=len(cuts)) for g in group]
            first = np.cumsum(sizes[1]) - sizes[1]
        width = sizes[1][group[0]]
        a = np.repeat(np.arange(len(ids[0])), width)
        b = np.repeat(first[group[0]] - (np.cumsum(width) - width), width) + np.arange(width.sum())
        pair = (ids[0][a] << _SIDE) | ids[1][b]
        segment = own[group[0][a]]
        order = np.lexsort((pair, segment))
        pair, segment, made = pair[order], segment[order], (times[0][a] * times[1][b])[order]
        start = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (segment[1:] != segment[:-1])))
        return texts, table, np.bincount(segment[start], minlength=n), pair[start], np.add.reduceat(made, start)

    def records(self, numbers: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys (pair, place) and links of segments that stand in documents at these places; keys may repeat."""
        keys, times = np.unique((places << 32) | numbers, return_counts=True)
        at, sizes = self._stretches(keys & 0xFFFFFFFF)
        return (self.pairs[at] << _PLACE) | np.repeat(keys >> 32, sizes), self.links[at] * np.repeat(times, sizes)


def _ranked_encoding(path: str, entries: list[bytes]):
    """The same byte-level encoding as ranks, which is several times as fast, or None where ids do not follow the merges."""
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    model, split = held["model"], held.get("pre_tokenizer") or {}
    merges = [x if isinstance(x, list) else x.split(" ") for x in model.get("merges") or []]
    made = [model["vocab"].get(a + b, -1) for a, b in merges]
    plain = {k: split.get(k) for k in ("type", "add_prefix_space", "use_regex")} == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if not plain or held.get("normalizer") or not made or made != list(range(256, 256 + len(made))):
        return None
    ranks = {entry: i for i, entry in enumerate(entries[: 256 + len(made)])}
    return tiktoken.Encoding("left", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _spoken(data: bytes | None) -> str | None:
    """The text after a space, or None if it is null, empty or not UTF-8."""
    try:
        return " " + data.decode() if data else None
    except UnicodeDecodeError:
        return None


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(left: str, right: str) -> Aligner:
    """One per Python worker and pair of files."""
    if (left, right) not in _aligners:
        _aligners[left, right] = Aligner(left, right)
    return _aligners[left, right]


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(values[order], first)


def _planes(x: np.ndarray) -> bytes:
    """The lowest bytes of all values, then the next ones, as far as any value has them."""
    wide = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    raw = np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :wide]
    return bytes([wide]) + np.ascontiguousarray(raw.T).tobytes()


def _values(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    wide = data[at]
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :wide] = np.frombuffer(data, np.uint8, n * wide, at + 1).reshape(wide, n).T
    return out.view("<i8").reshape(-1), at + 1 + n * wide


def write_run(keys: np.ndarray, links: np.ndarray) -> bytes:
    """A sorted run of distinct keys as zstd frames, each with its length before it; no pair is cut by a frame's end."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    pairs, places = keys >> _PLACE, keys & ((1 << _PLACE) - 1)
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
    out, start = [], 0
    while start < len(first):
        stop = max(start + 1, int(np.searchsorted(first, first[start] + FRAME_RECORDS)))
        a, b = int(first[start]), int(first[stop]) if stop < len(first) else len(keys)
        own = pairs[first[start:stop]]
        counts = np.diff(np.r_[first[start:stop], b])
        parts = (np.diff(own, prepend=0), counts, places[a:b], links[a:b])
        frame = pack(struct.pack("<II", stop - start, b - a) + b"".join(map(_planes, parts)))
        out.append(struct.pack("<I", len(frame)) + frame)
        start = stop
    return b"".join(out)


def read_run(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Frames: pairs, records of each, then places and links of the records."""
    import zstandard

    unpack, at = zstandard.ZstdDecompressor().decompress, 0
    while at < len(run):
        (size,) = struct.unpack_from("<I", run, at)
        data = unpack(run[at + 4 : at + 4 + size])
        at += 4 + size
        n, m = struct.unpack_from("<II", data)
        steps, where = _values(data, 8, n)
        counts, where = _values(data, where, n)
        places, where = _values(data, where, m)
        links, where = _values(data, where, m)
        yield np.cumsum(steps), counts, places, links


def merge_counts(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in order with their records in all runs. One frame of each run is held; a heap tells whose frame ends first."""
    frames = [((pairs, counts) for pairs, counts, _, _ in read_run(run)) for run in runs]
    held: list = [next(f, None) for f in frames]
    heap = [(int(h[0][-1]), i) for i, h in enumerate(held) if h is not None]
    heapq.heapify(heap)
    while heap:
        bound, ended = heap[0]
        ready = []
        for i, now in enumerate(held):
            if now is not None and (cut := int(np.searchsorted(now[0], bound, "right"))):
                ready.append((now[0][:cut], now[1][:cut]))
                held[i] = (now[0][cut:], now[1][cut:])
        while heap and heap[0][0] == bound:
            ended = heapq.heappop(heap)[1]
            held[ended] = next(frames[ended], None)
            if held[ended] is not None:
                heapq.heappush(heap, (int(held[ended][0][-1]), ended))
        yield summed(np.concatenate([p for p, _ in ready]), np.concatenate([n for _, n in ready]))


_DOCS = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string"
_RUNS = "part int, tasks int, first long, run binary"


def encode(docs: DataFrame, left: str | None = None, right: str | None = None, with_groups: bool = False) -> DataFrame:
    """Two kinds of rows: one for each document (part null), and runs of records (row null)."""
    left, right = left or tokenizer_path(LEFT), right or tokenizer_path(RIGHT)
    schema = f"{_DOCS}, {_RUNS}"
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int32()] * 2 + [pa.int64(), pa.binary()]
    names = [part.split()[0] for part in schema.split(", ")]

    def rows(columns: dict[str, list]) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(k, [None] * n), t) for k, t in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(left, right)
        task = TaskContext.get().partitionId()
        state = {"row": task << 33, "first": task << 33}
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if kept:
                keys, links = summed(*(np.concatenate(x) for x in zip(*kept, strict=True)))
                part = (keys >> (_PLACE + _SIDE)) % RADIX
                for r in np.unique(part).tolist():
                    own = part == r
                    yield rows({"part": [r], "tasks": [task // MERGED_TASKS], "first": [state["first"]], "run": [write_run(keys[own], links[own])]})
                kept.clear()
            state["first"] = state["row"]

        def align(ids: list, texts: list[bytes | None]) -> pa.RecordBatch:
            """Figures of some documents, and their records into ``kept``."""
            known.make_room()
            found: list[list[np.ndarray] | None] = [None] * len(texts)
            waiting: list[list[str]] = []
            owners: list[int] = []

            def number() -> None:
                all_numbers = known.look_up(list(chain.from_iterable(waiting)))
                for i, own in zip(owners, np.split(all_numbers, np.cumsum([len(w) for w in waiting])[:-1]), strict=True):
                    found[i].append(own)
                waiting.clear()
                owners.clear()

            for i, text in enumerate(map(_spoken, texts)):
                if text is not None:
                    found[i] = []
                    for chunk in known.chunks(text):
                        waiting.append(known.segments(chunk))
                        owners.append(i)
                        if sum(map(len, waiting)) > CHUNK // 4:
                            number()
            if waiting:
                number()
            sizes = known.sizes
            out = {k: [] for k in names[:8]}
            numbers, places = [], []
            for doc_id, parts in zip(ids, found, strict=True):
                total, digest, groups = [0, 0, 0, 0], "", None
                each = sizes[parts[0] if len(parts) == 1 else np.concatenate(parts)] if parts is not None else None
                if each is not None and (each[:, 0] >= 0).all():
                    total = each.sum(axis=0).tolist()
                    spelling = b";".join([b";".join(map(known.texts.__getitem__, own.tolist())) for own in parts])
                    digest = hashlib.sha256(spelling).hexdigest()
                    groups = spelling.decode() if with_groups else None
                    numbers += parts
                    places.append(np.full(len(each), state["row"] - state["first"], dtype=np.int64))
                for k, v in zip(out, (doc_id, state["row"], *total, digest, groups), strict=True):
                    out[k].append(v)
                state["row"] += 1
            if numbers:
                kept.append(summed(*known.records(np.concatenate(numbers), np.concatenate(places))))
            return rows(out)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            start, total = 0, 0
            for i, size in enumerate([*pc.fill_null(pc.binary_length(texts), 0).to_pylist(), BATCH]):
                if i > start and total + size > BATCH:
                    yield align(ids.slice(start, i - start).to_pylist(), texts.slice(start, i - start).to_pylist())
                    if sum(len(k) for k, _ in kept) > RUN_RECORDS or state["row"] - state["first"] > 1 << (_PLACE - 1):
                        yield from flush()
                    start, total = i, 0
                total += size
            if start < len(texts):
                yield align(ids.slice(start).to_pylist(), texts.slice(start).to_pylist())
        yield from flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _counted(runs: DataFrame) -> DataFrame:
    """tasks, part, pair, n: the records of a pair in each group of runs."""

    def count(group: pa.Table) -> pa.Table:
        tasks, part = group["tasks"][0].as_py(), group["part"][0].as_py()
        merged = list(merge_counts(group["run"].to_pylist()))
        pairs, n = (np.concatenate(x) for x in zip(*merged, strict=True))
        return pa.table({"tasks": pa.array([tasks] * len(pairs), pa.int32()), "part": pa.array([part] * len(pairs), pa.int32()), "pair": pairs, "n": n})

    return runs.groupBy("tasks", "part").applyInArrow(count, "tasks int, part int, pair long, n long")


def _totals(counted: DataFrame) -> DataFrame:
    """pair, total, and whether the total is the highest of its left id."""
    totals = counted.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("a", F.shiftright("pair", _SIDE))
    return totals.select("pair", "total", (F.col("total") == F.max("total").over(Window.partitionBy("a"))).alias("best"))


def _received(runs: DataFrame, answers: DataFrame) -> DataFrame:
    """row, n_best, count_sum: what the pairs of one group give to each document of its runs."""

    def give(group: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(known["pair"]))
        pairs, total = np.asarray(known["pair"])[order], np.asarray(known["total"])[order]
        best = np.asarray(known["best"])[order].astype(np.int64)
        row, n_best, count_sum = [], [], []
        for first, run in zip(group["first"].to_pylist(), group["run"].to_pylist(), strict=True):
            sums = np.zeros((2, 0), dtype=np.int64)
            for own, counts, places, links in read_run(run):
                if (most := int(places.max()) + 1) > sums.shape[1]:
                    sums = np.pad(sums, ((0, 0), (0, most - sums.shape[1])))
                at = np.repeat(np.searchsorted(pairs, own), counts)
                np.add.at(sums[0], places, links * best[at])
                np.add.at(sums[1], places, links * total[at])
            some = np.flatnonzero(sums[1])
            row.append(first + some)
            n_best.append(sums[0, some])
            count_sum.append(sums[1, some])
        return pa.table({k: np.concatenate(v) for k, v in (("row", row), ("n_best", n_best), ("count_sum", count_sum))})

    both = runs.groupBy("tasks", "part").cogroup(answers.groupBy("tasks", "part"))
    return both.applyInArrow(give, "row long, n_best long, count_sum long")


def _runs(encoded: DataFrame) -> DataFrame:
    return encoded.filter("part IS NOT NULL").select("tasks", "part", "first", "run")


def pair_counts(docs: DataFrame, left: str | None = None, right: str | None = None) -> DataFrame:
    """a, b, n, best: in how many documents each pair of ids is linked, and whether no pair of a has more."""
    encoded = materialize(encode(docs, left, right), "aligned")
    b = F.col("pair").bitwiseAND(F.lit((1 << _SIDE) - 1))
    return _totals(_counted(_runs(encoded))).select(F.shiftright("pair", _SIDE).alias("a"), b.alias("b"), F.col("total").alias("n"), "best")


def align_documents(docs: DataFrame, left: str | None = None, right: str | None = None, with_groups: bool = False) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, on request, the groups text."""
    encoded = materialize(encode(docs, left, right, with_groups), "aligned")
    runs = _runs(encoded)
    counted = materialize(_counted(runs), "pair-counts")
    totals = materialize(_totals(counted), "pair-totals")
    answers = counted.select("tasks", "part", "pair").join(totals, "pair")
    received = _received(runs, answers).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    given = encoded.filter("row IS NOT NULL").drop("part", "tasks", "first", "run")
    sums = {k: F.coalesce(k, F.lit(0).cast("long")) for k in ("n_best", "count_sum")}
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return given.join(received, "row", "left").withColumns(sums).select(*columns, *(["groups"] if with_groups else []))
