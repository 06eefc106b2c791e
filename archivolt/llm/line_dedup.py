"""Operator 9: removal of repeated multi-line chunks, with DataFrame functions only.

Lines that are not blank are cut into chunks where a hash rolled over the last two line hashes says so: a boundary
depends on two lines alone and stays with them when lines before it are added or removed. Chunks of three lines and
more settle long copies in few rows. Copies are seldom cut like chunks, and many are shorter: so each two neighbouring
lines are a chunk of their own as well, which extends the long ones to the edges of the copy and finds the short ones.
A chunk that stands in several places of the corpus is kept at its first place (smallest doc_id, then line) and removed
at all others, after its bytes have been compared. Every passage of two or more lines that stands elsewhere before goes
as a whole; a line that is repeated right after itself stays once.

1. Chunk keys, without text, are grouped: a combinable count and minimum by key.
2. Only documents that hold a repeated key are asked for the text of those chunks; pairs inside a long chunk that goes
   are not spelled.
3. The text itself is the grouping key of the comparison; places after the first of their text are removed.

Joins on a key have plain shuffled sides, which adaptive execution splits if a chunk stands in a third of all
documents.

Defined cases: a null text stays null and has no lines; an empty text is one blank line; blank lines (space and
0x09 to 0x0D) go only between two lines that go together; single lines are never removed; rows that repeat a doc_id
with the same text are treated alike, and with other texts by their own text; rows with a null doc_id lose nothing and
count for nothing; a document that loses all its lines becomes an empty text; extra columns pass through ``dedup_lines``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.llm._io import join_by_text, materialize, merged_stretches, unused, version

#: One boundary in so many lines.
DIVISOR = 4
#: Lines of the shortest chunks that the rolled hash cuts; pairs of lines are chunks anyway.
LEAST_LINES = 3
NOT_BLANK = r"[^\x09-\x0D\x20]"
PLACE = ("doc_id", "version", "start")


def line_hash(line: Column) -> Column:
    """28 bits of a line."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def chunk_bounds(lines: Column, divisor: int = DIVISOR) -> Column:
    """Array of (start, n_lines) of the chunks of an array of lines."""

    def bounds(hashes: Column) -> Column:
        def ends_at(i: Column) -> Column:
            """Whether line i ends a chunk: the hash rolled over lines i - 1 and i decides."""
            before = F.when(i > 0, F.element_at(hashes, F.greatest(i, F.lit(1)))).otherwise(F.lit(0))
            rolled = before * 31 + F.element_at(hashes, i + 1)
            return F.pmod(F.shiftright(rolled, 4), F.lit(divisor)) == 0

        starts = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: (i == 0) | ends_at(F.greatest(i - 1, F.lit(0))))
        return starts

    def sized(start: Column, i: Column, starts: Column, n: Column) -> Column:
        after = F.coalesce(F.try_element_at(starts, i + 2), n)
        return F.struct(start.alias("start"), (after - start).alias("n_lines"))

    # An array of one value binds the value to the name of a lambda, so that it is computed once.
    starts = F.flatten(F.transform(F.array(F.transform(lines, line_hash)), bounds))
    chunks = F.transform(F.array(starts), lambda s: F.transform(s, lambda x, i: sized(x, i, s, F.size(lines))))
    return F.flatten(chunks)


def _versioned(docs: DataFrame) -> DataFrame:
    """doc_id, version (a hash that tells texts of one doc_id apart) and lines."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), version(text).alias("version"), F.split(text, "\n", -1).alias("lines"))


def _chunk_text(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["start"] + 1, chunk["n_lines"]), "\n")


def _bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of a value that is computed once: the one element of an array, named by a lambda."""
    return F.element_at(F.transform(F.array(value), function), 1)


def _chunk_keys(lines: Column, divisor: int) -> Column:
    """Array of (key, start, n_lines) of the pairs of lines and the longer chunks; the text itself stays inside."""

    def stretch(places: Column, first: Column, n: Column) -> Column:
        start = F.element_at(places, first + 1)
        return F.struct(start.alias("start"), (F.element_at(places, first + n) - start + 1).alias("n_lines"))

    def keyed(held: Column) -> Column:
        def of(places: Column) -> Column:
            written = F.transform(places, lambda i: F.element_at(held, i + 1))
            long = F.filter(chunk_bounds(written, divisor), lambda c: c["n_lines"] >= LEAST_LINES)
            pairs = F.transform(F.slice(places, 1, F.size(places) - 1), lambda _, k: stretch(places, k, F.lit(2)))
            chunks = F.concat(pairs, F.transform(long, lambda c: stretch(places, c["start"], c["n_lines"])))
            return F.transform(
                chunks,
                lambda c: F.struct(F.xxhash64(_chunk_text(held, c)).alias("key"), c["start"].alias("start"), c["n_lines"].alias("n_lines")),
            )

        places = F.filter(F.sequence(F.lit(0), F.size(held) - 1), lambda i: F.element_at(held, i + 1).rlike(NOT_BLANK))
        return _bound(places, lambda x: F.when(F.size(x) > 1, of(x)))

    return _bound(lines, keyed)


def _without(lines: Column, gone: Column) -> Column:
    """The lines outside of sorted disjoint stretches (start, n_lines)."""

    def piece(held: Column, i: Column) -> Column:
        before = F.try_element_at(gone, i)
        start = F.when(i == 0, 0).otherwise(before["start"] + before["n_lines"])
        stop = F.coalesce(F.try_element_at(gone, i + 1)["start"], F.size(held))
        return F.slice(held, start + 1, stop - start)

    return _bound(lines, lambda held: F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: piece(held, F.greatest(i, F.lit(0))))))


def removals(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """doc_id, version, start, n_lines of the disjoint stretches of lines to remove."""
    lines = _versioned(docs).filter("doc_id IS NOT NULL AND lines IS NOT NULL")
    chunks = lines.select("doc_id", "version", F.explode(_chunk_keys(F.col("lines"), divisor)).alias("chunk")).select(
        "chunk.key", "doc_id", "version", "chunk.start", "chunk.n_lines"
    )
    chunks = materialize(chunks, "chunks")
    repeated = materialize(
        chunks.groupBy("key")
        .agg(F.min(F.struct(*PLACE)).alias("first"), F.max(F.struct(*PLACE)).alias("last"))
        .filter("first < last")
        .select("key", "first"),
        "repeated",
    )
    # Long chunks after their first place cover the pairs inside them, which then stand before as well.
    reach = F.max(F.when((F.struct(*PLACE) > F.col("first")) & (F.col("n_lines") >= LEAST_LINES), F.struct("end", "n_lines"))).over(
        Window.partitionBy("doc_id", "version").orderBy("start", F.desc("n_lines"), "key").rowsBetween(Window.unboundedPreceding, 0)
    )
    covered = (F.col("reach.end") >= F.col("end")) & (F.col("n_lines") < F.col("reach.n_lines"))
    asked = (
        chunks.join(repeated, "key")
        .withColumn("end", F.col("start") + F.col("n_lines"))
        .withColumn("reach", reach)
        .filter(~F.coalesce(covered, F.lit(False)))
        .groupBy("doc_id", "version")
        .agg(F.collect_set(F.struct("key", "start", "n_lines")).alias("asked"))
    )
    spelled = _bound(
        F.col("lines"),
        lambda held: F.transform(
            "asked",
            lambda c: F.struct(c["key"].alias("key"), _chunk_text(held, c).alias("chunk"), c["start"].alias("start"), c["n_lines"].alias("n_lines")),
        ),
    )
    texts = _versioned(docs).join(asked, ["doc_id", "version"]).select("doc_id", "version", F.explode(spelled).alias("c"))
    texts = materialize(texts.select("c.key", "c.chunk", "doc_id", "version", "c.start", "c.n_lines"), "chunk-texts")
    firsts = materialize(
        texts.groupBy("key", "chunk").agg(F.min(F.struct(*PLACE)).alias("first")), "first-chunks"
    )
    gone = texts.join(firsts, ["key", "chunk"]).filter(F.struct(*PLACE) > F.col("first"))
    stretches = gone.select("doc_id", "version", "start", (F.col("start") + F.col("n_lines")).alias("end"))
    return merged_stretches(stretches, ["doc_id", "version"]).select("doc_id", "version", "start", (F.col("end") - F.col("start")).alias("n_lines"))


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """All columns, ``text`` without its removed chunks, with ``n_lines`` and ``n_removed`` (lines).

    Columns by those two names are replaced.
    """
    gone = unused("gone_", docs)
    found = (
        removals(docs, divisor)
        .groupBy("doc_id", "version")
        .agg(F.array_sort(F.collect_list(F.struct("start", "n_lines"))).alias(gone))
    )
    text = F.col("text").cast("string")
    kept = _without(F.split(text, "\n", -1), F.col(gone))
    n_removed = F.aggregate(gone, F.lit(0), lambda n, c: n + c["n_lines"])
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return join_by_text(docs, found, "left").select(
        *[F.col(f"`{c}`") for c in names if c != "text"],
        F.when(F.col(gone).isNull(), text).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1))).cast("long").alias("n_lines"),
        F.coalesce(n_removed, F.lit(0)).cast("long").alias("n_removed"),
    )


def dedup_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, kept_sha256 (of the text that is left; null for a null text)."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        F.col("doc_id").cast("long"), "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )
