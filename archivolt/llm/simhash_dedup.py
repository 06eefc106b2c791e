"""Operator 3: near duplicates by SimHash fingerprints in Burkhard-Keller trees.

Fingerprints of equal value are one node, held by their smallest doc_id. Two
fingerprints that differ in at most 3 of 64 bits agree in at least 2 of 5 bit
blocks, so each goes to the 10 shards that its pairs of blocks name: linked ones
meet in a shard. A shard of more than ``SHARD`` fingerprints is cut into chunks by
hash; each chunk's tree is sent to every chunk of its shard, so no task holds more
than two chunks, whatever a group's size. A tree keeps children by their integer
Hamming distance to the parent, and a search follows only edges within the radius.

A search leaves out a subtree that lies wholly within the radius of both the value
and the subtree's parent: the parent stands for it. A task on one chunk links each
member of a group to the group's smallest, a task on two chunks links groups by
their smallest members, and of a node's links to smaller ones only that to the
smallest stays, the others being tied to it. Components stay whole, and no group's
pairs are spelled out. They come from rounds of label propagation.

A large shard is mostly one group of near copies. All its members are first held against
its smallest one; where at most a quarter of them are not near it, only these few are
compared with the others, for those near it are one group already. The work on such a
group grows with its size and not with its square.

``near_groups`` finds near duplicates by a similarity of word shingles instead. Wider fingerprints of the same kind, the
same trees and the same components give candidate groups; within each, all pairs of documents are compared by their
shingles, and only pairs that are alike link. ``keep_one`` keeps one document of each of its groups.

Defined cases: a null or blank text has fingerprint zero and links like any
other; fewer words than a shingle are one shingle; rows with a null doc_id get
the component of their fingerprint and lend it no id; repeated rows share a row's
result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.llm._hashing import mix
from archivolt.llm._io import map_rows, materialize
from archivolt.operators.graph import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: First bit and width of five blocks of the fingerprint; any two of them name a shard.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
TABLES = tuple(combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS))
SHARD = 512
_LANES = np.uint64(0x0101010101010101)


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, from bit 0 up."""
    padded = np.zeros(-(-len(hashes) // 255) * 255, dtype=np.uint64)
    padded[: len(hashes)] = hashes
    rows = padded.reshape(-1, 255)
    counts = np.zeros(64, dtype=np.int64)
    for bit in range(8):
        lanes = ((rows >> np.uint64(bit)) & _LANES).sum(axis=1, dtype=np.uint64)
        counts[bit::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; the whole sequence for fewer words, nothing for none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    width = min(shingle, len(words))
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(joined)]))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of word shingles, as an unsigned integer; zero without words."""
    hashes = shingle_hashes(text, shingle)
    ones = _set_bits(hashes) * 2 > len(hashes)
    return int(np.packbits(ones[::-1]).tobytes().hex(), 16)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a long) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        prints = np.array([fingerprint(t or b"", shingle) for t in texts], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_rows(rows, run, "doc_id long, fingerprint long")


def _shard_keys(fingerprint: Column) -> Column:
    def value(block: int) -> Column:
        first, width = BLOCKS[block]
        return F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << width) - 1))

    keys = []
    for number, table in enumerate(TABLES):
        key = F.lit(number).cast("long")
        for block in table:
            key = F.shiftleft(key, BLOCKS[block][1]).bitwiseOR(value(block))
        keys.append(key)
    return F.array(*keys)


class BKTree:
    """Burkhard-Keller tree: the children of a node are keyed by their Hamming distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        at = 0
        while at != new:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)

    def within(self, value: int, radius: int, stand_ins: bool = False):
        """Indices of the values at most ``radius`` bits away.

        With ``stand_ins``, a parent found stands for its subtrees that are near the value and near the parent as a
        whole: all of a subtree has one distance to the parent, so the triangle inequality bounds its distance to
        the value.
        """
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            children = self.children[at]
            if children:
                nearest = max(distance - radius, radius - distance + 1 if stand_ins else 0)
                for edge in range(nearest, distance + radius + 1):
                    child = children.get(edge)
                    if child is not None:
                        stack.append(child)


class _Groups:
    """Union-find over the members of one shard."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a: int, b: int) -> tuple[int, int] | None:
        """The smallest members (larger, smaller) of two groups that become one; None if they were."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return None
        self.parent[max(a, b)] = min(a, b)
        return max(a, b), min(a, b)

    def stars(self):
        """Each member with the smallest of its group."""
        return [(x, root) for x in list(self.parent) if (root := self.find(x)) != x]


def _grown(chunk: list[tuple[int, int]], groups: _Groups, radius: int) -> BKTree:
    """The tree of a chunk of (fingerprint, node), whose links join the groups."""
    tree = BKTree()
    for value, node in chunk:
        for at in tree.within(value, radius, stand_ins=True):
            groups.join(node, chunk[at][1])
        tree.add(value)
    return tree


def _search(prints: list[int], nodes: list[int], indexed: list[bool], task: str, radius: int) -> list[tuple[int, int]]:
    """Links in one task: within the indexed chunk (``alone``), those that join its groups to the other chunk's
    (``pair``), or those of the other rows with any of it (``star``)."""
    rows = list(zip(prints, nodes, strict=True))
    groups = _Groups()
    chunk = [row for row, inside in zip(rows, indexed, strict=True) if inside]
    other = [row for row, inside in zip(rows, indexed, strict=True) if not inside]
    if task == "star":
        tree = BKTree()
        for value, _ in chunk:
            tree.add(value)
    else:
        tree = _grown(chunk, groups, radius)
        if task == "alone":
            return groups.stars()
        _grown(other, groups, radius)
    out = []
    for value, node in other:
        # Stars have no task that ties the members of a chunk to each other, so no parent stands for others.
        for at in tree.within(value, radius, stand_ins=task != "star"):
            joined = groups.join(node, chunk[at][1])
            if joined:
                out.append(joined)
    return out


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(src, dst) pairs of nodes that connect every group of fingerprints within the radius.

    ``distinct`` has one row (fingerprint, node) per fingerprint.
    """
    if radius > RADIUS:
        raise ValueError(f"{len(BLOCKS)} blocks find pairs of at most {RADIUS} differing bits")
    rows = distinct.select(F.explode(_shard_keys(F.col("fingerprint"))).alias("key"), "fingerprint", "node")
    return _shard_links(rows, radius, shard)


def _led(rows: DataFrame, near) -> DataFrame:
    """Rows of large shards with ``close``: whether ``near`` holds for their value and that of the shard's smallest node."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        close = [near(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(close, pa.bool_())], ["key", "fingerprint", "node", "leader", "close"])

    first = rows.groupBy("key").agg(F.min(F.struct("node", "fingerprint")).alias("first"))
    joined = rows.join(first, "key").select("key", "fingerprint", "node", F.col("first.node").alias("leader"), F.col("first.fingerprint").alias("value"))
    kind = dict(rows.dtypes)["fingerprint"]
    return map_rows(joined, run, f"key long, fingerprint {kind}, node long, leader long, close boolean")


def _dealt(rows: DataFrame, shard: int, near) -> tuple[DataFrame, DataFrame]:
    """Rows (key, tree, searcher, indexed, fingerprint, node) of tasks, and links (src, dst) that are known before.

    Tasks with one number are a chunk alone, with two a pair of chunks, and with a searcher below zero a star: few
    rows of a shard against a chunk of it. Only shards that are too large are listed; where that list is short it is
    broadcast by the planner's own size check, else joined.
    """
    value = ["fingerprint", "node"]

    def place(df: DataFrame, tree: Column, searcher: Column, indexed: Column) -> DataFrame:
        return df.select("key", tree.cast("int").alias("tree"), searcher.cast("int").alias("searcher"), indexed.alias("indexed"), *value)

    large = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard).select("key"), "large-shards")
    if large.isEmpty():
        return place(rows, F.lit(0), F.lit(0), F.lit(True)), rows.sparkSession.createDataFrame([], "src long, dst long")
    led = materialize(_led(materialize(rows.join(large, "key", "left_semi").select("key", *value), "large-rows"), near), "led")
    sizes = led.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("close")).alias("far"))
    sizes = materialize(sizes.withColumn("star", 4 * F.col("far") <= F.col("n")), "shard-sizes")
    small = place(rows.join(large, "key", "left_anti"), F.lit(0), F.lit(0), F.lit(True))
    known = led.join(sizes, "key")
    # A power of two: a chunk of one shard is then part of a chunk of another, and groups have like smallest members.
    chunks = lambda n: F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(F.log2(F.col(n) / F.lit(shard))))).cast("int")
    own = lambda n: F.pmod(F.xxhash64("fingerprint"), chunks(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), chunks(n) - 1))
    pairs = known.filter("NOT star").withColumn("own", own("n")).withColumn("other", every("n"))
    pairs = place(pairs, F.least("own", "other"), F.greatest("own", "other"), F.col("own") <= F.col("other"))
    stars = known.filter("star AND far > 0")
    held = place(stars.withColumn("other", every("far")), own("n"), -F.col("other") - 1, F.lit(True))
    asking = place(stars.filter("NOT close").withColumn("other", every("n")), F.col("other"), -own("far") - 1, F.lit(False))
    tied = known.filter("star AND close AND node <> leader").select(F.col("node").alias("src"), F.col("leader").alias("dst"))
    return small.unionByName(pairs).unionByName(held).unionByName(asking), tied


def _shard_links(rows: DataFrame, radius: int, shard: int, compare=None, near=None) -> DataFrame:
    """(src, dst) pairs that connect the groups within each shard (key) of rows (key, fingerprint, node).

    Fingerprints are longs or binaries, linked within the radius, or whatever binaries ``compare`` takes (with nodes,
    which of them are indexed, and the kind of task) and ``near`` says of two.
    """
    wide = dict(rows.dtypes)["fingerprint"] == "binary"

    def distance(a, b) -> bool:
        if wide:
            return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() <= radius
        return ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius

    dealt, tied = _dealt(rows, shard, near or distance)
    task = ["key", "tree", "searcher"]
    placed = dealt.repartition(*task).sortWithinPartitions(*task, "node")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def columns(parts: list[pa.RecordBatch]):
            joined = pa.Table.from_batches(parts)
            return [joined.column(k).to_numpy() for k in range(joined.num_columns)]

        def integers(prints: np.ndarray) -> list[int]:
            return [int.from_bytes(p, "big") for p in prints] if wide else prints.view(np.uint64).tolist()

        def solve(parts: list[pa.RecordBatch], last: bool):
            """Edges of the complete tasks in the parts, and the rows of the last task unless it is complete."""
            key, tree, searcher, indexed, prints, nodes = columns(parts)
            new = (np.diff(key) != 0) | (np.diff(tree) != 0) | (np.diff(searcher) != 0)
            bounds = np.concatenate(([0], np.flatnonzero(new) + 1, [len(key)]))
            complete = len(bounds) - 1 if last else len(bounds) - 2
            out: list[tuple[int, int]] = []
            for start, end in zip(bounds[:complete].tolist(), bounds[1 : complete + 1].tolist(), strict=True):
                if end - start > 1:
                    kind = "star" if searcher[start] < 0 else "alone" if tree[start] == searcher[start] else "pair"
                    task = nodes[start:end].tolist(), indexed[start:end].tolist(), kind
                    if compare:
                        out += compare(prints[start:end], *task)
                    else:
                        out += _search(integers(prints[start:end]), *task, radius)
            rest = [] if last else pa.Table.from_batches(parts).slice(int(bounds[-2])).combine_chunks().to_batches()
            return out, rest

        for batch in batches:
            if batch.num_rows:
                out, held = solve([*held, batch], False)
                if out:
                    yield _edges(out)
        if held:
            out, _ = solve(held, True)
            if out:
                yield _edges(out)

    return _fewer(placed.mapInArrow(run, "src long, dst long").unionByName(tied))


def _fewer(edges: DataFrame) -> DataFrame:
    """Links (src > dst) with the same groups: a node keeps that to its smallest neighbour, to which its others are tied.

    A node has at most one neighbour per shard and chunk, and nodes of one group have mostly the same ones, so that
    links grow with the nodes and not with the shards they share.
    """
    least = F.array_min("below")
    tied = F.transform("below", lambda d: F.struct(F.when(d == least, F.col("src")).otherwise(d).alias("src"), least.alias("dst")))
    below = edges.groupBy("src").agg(F.collect_set("dst").alias("below"))
    return below.select(F.explode(tied).alias("edge")).select("edge.src", "edge.dst").distinct()


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["src", "dst"])


def components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node")), "distinct")
    found = connected_components(links(distinct.filter("node is not null"), radius))
    named = distinct.join(found, "node", "left").select(
        "fingerprint", F.coalesce("component", "node").alias("component_id")
    )
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return prints.join(named, "fingerprint").select("doc_id", hexed, "component_id")


#: Bits of the wide fingerprints that estimate a similarity; the least and most bits of the slices that deal them to
#: shards; the fingerprints per shard that the width of the slices aims at.
WIDE_BITS, SLICE_BITS, MOST_SLICE_BITS, SLICE_ROWS = 256, 16, 20, 64
#: Probability, at every size, that two documents of the wanted similarity share a slice.
SLICE_RECALL = 0.955
#: Standard errors by which a wide fingerprint may exceed the distance that its similarity expects.
MARGIN = 3


def bit_differs(similarity: float) -> float:
    """Probability that a bit differs between two sets of one size and this Jaccard similarity.

    Their cosine c is 2J / (1 + J), a bit differs with probability acos(c) / pi.
    """
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def expected_distance(similarity: float, bits: int = WIDE_BITS) -> int:
    """Differing bits that two sets of one size and this Jaccard similarity reach with few exceptions."""
    share = bit_differs(similarity)
    return int(round(bits * share + MARGIN * np.sqrt(bits * share * (1 - share))))


def slice_width(distinct: int) -> int:
    """Bits of a slice for so many fingerprints; shards that are larger all the same are cut into chunks."""
    return int(np.clip(np.ceil(np.log2(max(distinct, 1) / SLICE_ROWS)), SLICE_BITS, MOST_SLICE_BITS))


def slice_recall(width: int, slices: np.ndarray | int, similarity: float) -> np.ndarray:
    """Probability that two fingerprints of this similarity agree in one of so many random slices.

    Slices reuse the bits, so it is taken for each number of differing bits and averaged over their distribution.
    """
    share, differing = bit_differs(similarity), np.arange(WIDE_BITS + 1)
    chance = np.array([comb(WIDE_BITS, int(d)) * share**d * (1 - share) ** (WIDE_BITS - d) for d in differing])
    agree = np.prod([(np.maximum(WIDE_BITS - differing - i, 0)) / (WIDE_BITS - i) for i in range(width)], axis=0)
    return chance @ (1 - (1 - agree[:, None]) ** np.atleast_1d(slices))


def _slices(width: int, similarity: float = 0.8) -> np.ndarray:
    """Fixed choices of bits, one row per slice: permutations of all bits, cut into slices.

    As many as hold the recall at this width.
    """
    least = 1
    while slice_recall(width, least, similarity)[0] < SLICE_RECALL:
        least += 1
    rng = np.random.default_rng(31)
    per_round = WIDE_BITS // width
    rounds = [rng.permutation(WIDE_BITS)[: per_round * width].reshape(per_round, width) for _ in range(-(-least // per_round))]
    return np.concatenate(rounds)[:least]


def wide_bits(hashes: np.ndarray) -> np.ndarray:
    """SimHash bits of four derived hashes of each distinct shingle."""
    parts = [_set_bits(mix(hashes + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))) for k in range(WIDE_BITS // 64)]
    return np.concatenate(parts) * 2 > len(hashes)


def _similar(first: bytes, second: bytes, similarity: float) -> bool:
    """Whether two sorted sets of hashes have this Jaccard similarity."""
    a, b = (np.frombuffer(x, dtype=np.uint64) for x in (first, second))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common + 1e-9 >= similarity * (len(a) + len(b) - common)


def _alike(sets: list[bytes], nodes: list[int], indexed: list[bool], task: str, similarity: float) -> list[tuple[int, int]]:
    """Links of all pairs of shingle sets of at least this Jaccard similarity, as those that join groups: pairs within
    the indexed rows if alone, else between these and the others."""
    held = [np.frombuffer(x, dtype=np.uint64) for x in sets]
    size = np.array([len(x) for x in held])
    ends = np.cumsum(size)
    vocabulary, place = np.unique(np.concatenate(held), return_inverse=True)
    inside, names = np.array(indexed), np.array(nodes)
    marked = np.zeros(len(vocabulary), dtype=bool)
    total = np.zeros(len(place) + 1, dtype=np.int64)

    def near(i: int) -> np.ndarray:
        own = place[ends[i] - size[i] : ends[i]]
        marked[own] = True
        np.cumsum(marked[place], out=total[1:])
        marked[own] = False
        common = total[ends] - total[ends - size]
        # The margin is far below the steps of common and keeps a similarity met exactly.
        return common + 1e-9 >= similarity * (size + size[i] - common)

    label, out = names.copy(), []
    # Of two chunks the groups of each are made first, for they have tasks of their own; few rows against a chunk have none.
    steps = [(i, False) for i in range(len(held))] if task != "star" else []
    steps += [(i, True) for i in (np.flatnonzero(inside) if task == "pair" else np.flatnonzero(~inside) if task == "star" else ())]
    for i, cross in steps:
        met = np.unique(np.append(label[near(i) & ((inside != inside[i]) == cross)], label[i]))
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
            if cross:
                out += [(x, int(met[0])) for x in met[1:].tolist()]
    return [(x, y) for x, y in zip(nodes, label.tolist(), strict=True) if x != y] if task == "alone" else out


def verified_links(docs: DataFrame, found: DataFrame, groups: DataFrame, shingle: int, similarity: float, shard: int) -> DataFrame:
    """(src, dst) pairs that connect what is alike by its shingles within each candidate group.

    ``found`` has doc_id, fingerprint and digest (of the shingles) of every document, ``groups`` the group of every
    fingerprint that has one. One document stands for all of one digest: their sets of shingles are equal. No pair is
    judged by a third document.
    """
    members = materialize(
        found.join(groups, "fingerprint").groupBy("digest").agg(F.min("doc_id").alias("node"), F.min("key").alias("key")), "candidates"
    )
    several = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    asked = members.join(several, "key", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string")).join(asked, "node")

    def spell(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [np.unique(shingle_hashes(t or b"", shingle)).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
        own = np.array([xxhash.xxh3_128_digest(h) == d for h, d in zip(hashes, batch.column(2).to_pylist(), strict=True)], dtype=bool)
        columns = [batch.column(3), pa.array(hashes, pa.binary()), batch.column(0)]
        return pa.RecordBatch.from_arrays(columns, ["key", "fingerprint", "node"]).filter(pa.array(own))

    sets = materialize(map_rows(texts.select("node", "text", "digest", "key"), spell, "key long, fingerprint binary, node long"), "shingle-sets")
    return _shard_links(sets, 0, shard, lambda *task: _alike(*task, similarity), lambda a, b: _similar(a, b, similarity))


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, shard: int = SHARD) -> DataFrame:
    """doc_id and component of documents: groups linked by pairs of at least this Jaccard similarity of word shingles.

    Candidates: wide fingerprints are dealt to shards by slices of their bits; two documents of the similarity share
    one with a probability of ``SLICE_RECALL``, more similar ones almost surely, and a shard's BK-tree then ties those
    within the expected distance and its margin. Slices are wider in a large corpus, which keeps shards small, and
    then as many more as the same probability takes. Links: all pairs within a group of candidates are compared by
    their shingles (``verified_links``). Documents without words are alike.
    """

    def prints(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed, digests = [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            hashes = np.unique(shingle_hashes(text or b"", shingle))
            packed.append(np.packbits(wide_bits(hashes)).tobytes())
            digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
        columns = [batch.column(0), pa.array(packed, pa.binary()), pa.array(digests, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "fingerprint", "digest"])

    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = materialize(map_rows(rows, prints, "doc_id long, fingerprint binary, digest binary"), "wide-prints")
    distinct = materialize(found.groupBy("fingerprint").agg(F.min("doc_id").alias("node")), "wide-distinct")
    chosen = _slices(slice_width(distinct.count()), similarity)
    slices, width = chosen.shape

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.unpackbits(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1)
        keys = (bits[:, chosen].astype(np.int64) << np.arange(width)).sum(axis=2) | (np.arange(slices, dtype=np.int64) << 40)
        place = pa.array(np.repeat(np.arange(batch.num_rows), slices))
        return pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel()), batch.column(0).take(place), batch.column(1).take(place)], ["key", "fingerprint", "node"]
        )

    dealt = map_rows(distinct, deal, "key long, fingerprint binary, node long", rows=1024)
    candidates = connected_components(_shard_links(dealt, expected_distance(similarity), shard))
    groups = distinct.join(candidates, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("key"))
    alike = connected_components(verified_links(docs, found, groups, shingle, similarity, shard))
    least = found.groupBy("digest").agg(F.min("doc_id").alias("node"))
    named = least.join(alike, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    return found.join(named, "digest").select("doc_id", "component")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The row of the smallest doc_id of each group of near duplicates, all its columns; of rows that repeat that id, one.

    Rows with a null doc_id stay.
    """
    kept = near_groups(docs, shingle, similarity).filter("doc_id = component").select("doc_id").distinct()
    named = docs.filter(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter(F.col("doc_id").isNull())).select(docs.columns)
