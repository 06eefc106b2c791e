"""Operator 10: document quality by hierarchical empirical Bayes.

Two labels are learned, quality and toxicity. For each, a document's log odds are

    log odds of its path + slope x evidence of its text + intercept.

* Path: the share of the label on a path (host and language) is shrunk toward the share of its host, and that
  toward the global share. The strength of each shrinking is estimated by the method of moments from the spread of
  the shares over hosts, or over paths within their hosts; sparse sites follow their parent. All sums are grouped
  aggregations; sites stay a distributed table.
* Text: words and word shapes hash to buckets; a bucket that a document holds adds the log ratio of its rates in
  both classes, each shrunk toward the common rate, if the rates differ by more than chance would have it.
* Slope and intercept come from evidence that each half of the labelled documents gets from the other half. It is
  gathered as a histogram of bounded size, and fitted by Newton's method. Labelled documents are scored likewise, by
  the evidence of the half that they are not in.
* Texts are read once: a table holds the buckets of documents, two bytes each, which are shuffled to their labels.

The broadcast model has 2^16 buckets x 2 labels whatever the corpus; all labelled rows train.

``kept`` asks for a probability of toxicity under a half and of quality of at least a half.

Defined cases: a null or empty text has no evidence and takes its site's odds; a null source or lang is a site of its
own; documents without labels are scored alike; several label rows of a document count as toxic if one is and as good
if all are; null labels do not train; without any label both probabilities are a half and all documents are kept;
repeated rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.llm._io import map_rows, materialize

TARGETS = ("quality", "toxic")
BUCKET_BITS = 16
#: Occurrences at the common rate that both classes of a bucket start with.
PRIOR_COUNT = 1.0
#: Buckets whose rates differ by fewer standard errors say nothing: of 2^16 without a difference, about two pass.
SIGNIFICANCE = 4.0
#: Evidence is clipped to this many bins of this width on both sides of zero for the calibration.
BINS, BIN_WIDTH = 400, 0.25
LIMIT = 50.0
_WORDS = bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(256))
_SHAPES = bytes.maketrans(
    bytes(range(256)),
    bytes(
        0x61 if chr(c).islower() and c < 0x80 or c >= 0x80 else 0x41 if c < 0x80 and chr(c).isupper() else 0x30 if 0x30 <= c <= 0x39 else c
        for c in range(256)
    ),
)
_REPEATS = re.compile(rb"(.)\1+", re.S)


def buckets(text: bytes) -> np.ndarray:
    """Sorted distinct buckets of a text's words (lower case, letters and digits), of the shapes of its raw words,
    and of two shares in steps of a tenth: distinct words of all, and bytes that are neither word nor blank."""
    listed = text.translate(_WORDS).split()
    words = set(listed)
    raw = text.translate(_SHAPES).split()
    marks = {b"\0" + _REPEATS.sub(rb"\1", s) for s in set(raw)}
    if listed:
        marks.add(b"\1%d %d" % (10 * len(words) // len(listed), min(len(listed).bit_length(), 12)))
    if raw:
        marks.add(b"\2%d" % (10 * (sum(map(len, raw)) - sum(map(len, listed))) // sum(map(len, raw))))
    hashed = np.fromiter(map(zlib.crc32, words | marks), dtype=np.uint32, count=len(words) + len(marks))
    return np.unique(hashed >> np.uint32(32 - BUCKET_BITS)).astype("<u2")


def sites(docs: DataFrame) -> DataFrame:
    """doc_id, host, path, text of every row."""

    def name(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(""))

    return docs.select(
        F.col("doc_id").cast("long"),
        name("source").alias("host"),
        F.concat_ws("/", name("source"), name("lang")).alias("path"),
        F.col("text").cast("string").alias("text"),
    )


def _half() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)), F.lit(0)).cast("int").alias("half")


def features(rows: DataFrame) -> DataFrame:
    """doc_id, host, path and buckets (16-bit integers, two bytes each) of rows of ``sites``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [buckets(t or b"").tobytes() for t in batch.column(3).cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], ["doc_id", "host", "path", "buckets"])

    return map_rows(rows, run, "doc_id long, host string, path string, buckets binary")


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u2").astype(np.int64) for x in column.to_pylist()]


def document_labels(labels: DataFrame) -> DataFrame:
    """One row per labelled doc_id; 0, 1 or null per target."""
    return (
        labels.filter("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min((F.col("quality") > 0).cast("int")).alias("quality"), F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )


@dataclass(frozen=True)
class Evidence:
    """Log ratios per bucket: of each half of the labelled documents, and of both; targets in columns."""

    halves: np.ndarray  # 2 x buckets x targets
    whole: np.ndarray

    def of(self, held: list[np.ndarray], half: np.ndarray | None = None) -> np.ndarray:
        """Sums for documents; those of a half get the ratios of the other."""
        out = np.zeros((len(held), len(TARGETS)))
        for i, b in enumerate(held):
            table = self.whole if half is None else self.halves[1 - half[i]]
            out[i] = table[b].sum(axis=0)
        return np.clip(out, -LIMIT, LIMIT)


def _log_ratios(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """counts: class x buckets x targets, totals: class x targets."""
    everything = np.maximum(totals.sum(axis=0), 1)
    common = (counts.sum(axis=0) + 0.5) / (everything + 1)
    rates = (counts + PRIOR_COUNT) / (totals[:, None, :] + PRIOR_COUNT / common)
    plain = np.maximum(totals[:, None, :], 1)
    spread = np.sqrt(common * (1 - np.minimum(common, 1 - 1e-9)) * (1 / plain[0] + 1 / plain[1]))
    significant = np.abs(counts[1] / plain[1] - counts[0] / plain[0]) >= SIGNIFICANCE * spread
    return np.where(significant & (totals > 0).all(axis=0), np.log(rates[1]) - np.log(rates[0]), 0.0)


def learn(labelled: DataFrame) -> Evidence:
    """Counts of documents by half, class and bucket, summed over all labelled rows."""

    def run(batches):
        counts = np.zeros((2, 2, (1 << BUCKET_BITS) + 1, len(TARGETS)), dtype=np.int64)
        for batch in batches:
            half = np.asarray(batch.column(1))
            values = [batch.column(2 + t).to_pylist() for t in range(len(TARGETS))]
            for row, held in enumerate(_unpacked(batch.column(0))):
                places = np.append(held, 1 << BUCKET_BITS)  # the last one counts documents
                for t, column in enumerate(values):
                    if column[row] is not None:
                        counts[half[row], column[row], places, t] += 1
        used = np.flatnonzero(counts.any(axis=(0, 1, 3)))
        if len(used):
            flat = counts[:, :, used, :].transpose(2, 0, 1, 3).reshape(len(used), -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), *(pa.array(flat[:, k]) for k in range(flat.shape[1]))],
                ["bucket", *(f"n{k}" for k in range(flat.shape[1]))],
            )

    columns = [f"n{k}" for k in range(4 * len(TARGETS))]
    rows = labelled.select("buckets", "half", *TARGETS).mapInArrow(run, "bucket int, " + ", ".join(f"{c} long" for c in columns))
    # At most 2^16 + 1 rows of 8 counts.
    summed = rows.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    counts = np.zeros((2, 2, (1 << BUCKET_BITS) + 1, len(TARGETS)))
    flat = summed[columns].to_numpy(dtype=np.float64).reshape(-1, 2, 2, len(TARGETS))
    counts[:, :, summed["bucket"].to_numpy(dtype=np.int64), :] = flat.transpose(1, 2, 0, 3)
    whole = counts.sum(axis=0)
    return Evidence(
        np.stack([_log_ratios(c[:, :-1], c[:, -1]) for c in counts]), _log_ratios(whole[:, :-1], whole[:, -1])
    )


def _share(positive: Column, n: Column, parent: Column, strength: Column) -> Column:
    return (positive + strength * parent) / (n + strength)


def _strength(groups: DataFrame, parent: str, target: str) -> float:
    """Pseudo-documents of a beta prior around the parents' shares, by the method of moments.

    Of groups with n documents and k positives, the variance of k/n around the parent p is
    p(1-p)(1 + (n-1)r)/n with r = 1/(strength + 1).
    """
    k, n, p = F.col(f"{target}_k"), F.col(f"{target}_n"), F.col(parent)
    spread = p * (1 - p)
    row = (
        groups.filter((n > 1) & (spread > 0))
        .agg(F.sum(F.pow(k - n * p, 2) - n * spread).alias("excess"), F.sum(n * (n - 1) * spread).alias("scale"))
        .first()
    )
    if not row.scale:
        return 10.0
    r = min(max(row.excess / row.scale, 1e-3), 0.5)
    return 1 / r - 1


def site_shares(found: DataFrame, labelled: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Per path of ``found`` the shrunk share of each target, and the global shares."""
    sums = [
        f(F.col(t)).cast("double").alias(f"{t}_{s}") for t in TARGETS for s, f in (("k", F.sum), ("n", F.count))
    ]
    known = labelled.groupBy("host", "path").agg(*sums)
    paths = materialize(found.select("host", "path").distinct().join(known, ["host", "path"], "left"), "paths")
    again = [F.sum(f"{t}_{s}").alias(f"{t}_{s}") for t in TARGETS for s in "kn"]
    total = paths.agg(*again).first()
    shares = {t: ((total[f"{t}_k"] or 0.0) + 0.5) / ((total[f"{t}_n"] or 0.0) + 1.0) for t in TARGETS}
    hosts = paths.groupBy("host").agg(*again)
    for t in TARGETS:
        hosts = hosts.withColumn(f"{t}_parent", F.lit(shares[t]))
    hosts = materialize(hosts, "hosts")
    k, n = (lambda t: F.coalesce(f"{t}_k", F.lit(0.0))), (lambda t: F.coalesce(f"{t}_n", F.lit(0.0)))
    host_shares = hosts.select(
        "host", *[_share(k(t), n(t), F.lit(shares[t]), F.lit(_strength(hosts, f"{t}_parent", t))).alias(f"{t}_host") for t in TARGETS]
    )
    nested = paths.join(host_shares, "host")
    for t in TARGETS:
        nested = nested.withColumns({f"{t}_k": k(t), f"{t}_n": n(t)})
    nested = materialize(nested, "nested")
    return (
        materialize(
            nested.select(
                "host",
                "path",
                *[_share(k(t), n(t), F.col(f"{t}_host"), F.lit(_strength(nested, f"{t}_host", t))).alias(f"{t}_path") for t in TARGETS],
            ),
            "site-shares",
        ),
        shares,
    )


def _odds(share: Column) -> Column:
    return F.log(share / (1 - share))


def _scored(labelled: DataFrame, evidence: Evidence) -> DataFrame:
    """The targets of labelled rows and the evidence that the other half gives."""
    shared = labelled.sparkSession.sparkContext.broadcast(evidence)
    names = [*TARGETS, *(f"{t}_evidence" for t in TARGETS)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums = shared.value.of(_unpacked(batch.column(0)), np.asarray(batch.column(1)))
        return pa.RecordBatch.from_arrays([*batch.columns[2:], *(pa.array(sums[:, t]) for t in range(len(TARGETS)))], names)

    schema = ", ".join([*(f"{t} int" for t in TARGETS), *(f"{t}_evidence double" for t in TARGETS)])
    return map_rows(labelled.select("buckets", "half", *TARGETS), run, schema, rows=4096)


def _evidence(found: DataFrame, evidence: Evidence) -> DataFrame:
    """doc_id, host, path and the evidence of each target, of a row of ``features`` with and without its half's labels."""
    shared = found.sparkSession.sparkContext.broadcast(evidence)
    sums = [f"{t}_{s}" for s in ("whole", "other") for t in TARGETS]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = _unpacked(batch.column(4))
        both = np.hstack([shared.value.of(held), shared.value.of(held, np.asarray(batch.column(3)))])
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x) for x in both.T)], ["doc_id", "host", "path", *sums])

    rows = found.select("doc_id", "host", "path", _half(), "buckets")
    return map_rows(rows, run, "doc_id long, host string, path string, " + ", ".join(f"{x} double" for x in sums), rows=4096)


def _fit(table: pd.DataFrame) -> tuple[float, float]:
    """Slope and intercept of a logistic curve with a given offset, from weighted rows, with a weak prior on (1, 0)."""
    x, offset, y, w = (table[c].to_numpy(dtype=np.float64) for c in ("x", "offset", "y", "w"))
    design = np.stack([x, np.ones_like(x)], axis=1)

    def loss(beta: np.ndarray) -> float:
        z = offset + design @ beta
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + ((beta - [1.0, 0.0]) ** 2).sum() / 2)

    beta = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(offset + design @ beta, -LIMIT, LIMIT)))
        gradient = design.T @ (w * (p - y)) + beta - [1.0, 0.0]
        step = np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + np.eye(2), gradient)
        size, now = 1.0, loss(beta)
        while size > 1e-6 and loss(beta - size * step) > now:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def calibrate(labelled: DataFrame, evidence: Evidence, shares: dict[str, float]) -> dict[str, tuple[float, float]]:
    """Per target slope and intercept, from a histogram of out-of-half evidence (at most 2 x BINS x 2 rows)."""
    scored = _scored(labelled, evidence)
    out = {}
    for t in TARGETS:
        bins = F.least(F.greatest(F.round(F.col(f"{t}_evidence") / BIN_WIDTH), F.lit(-BINS)), F.lit(BINS))
        table = (
            scored.filter(F.col(t).isNotNull())
            .groupBy(bins.alias("bin"), F.col(t).cast("double").alias("y"))
            .agg(F.count(F.lit(1)).cast("double").alias("w"))
            .toPandas()
        )
        table["x"] = table["bin"].astype(float) * BIN_WIDTH
        table["offset"] = np.log(shares[t] / (1 - shares[t]))
        out[t] = _fit(table) if len(table) else (1.0, 0.0)
    return out


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, p_quality, p_toxic, the shares of its host and path, and kept."""
    found = materialize(features(sites(docs)), "features")
    known_labels = document_labels(labels)
    # Sorted and merged at every size: the labels grow with the documents.
    labelled = materialize(found.join(known_labels.hint("merge"), "doc_id").withColumn("half", _half()), "labelled")
    places, shares = site_shares(found, labelled)
    evidence = learn(labelled)
    curves = calibrate(labelled, evidence, shares)
    known = bool(labelled.select(*TARGETS).head(1))
    joined = _evidence(found, evidence).join(places, ["host", "path"], "left").join(known_labels.hint("merge"), "doc_id", "left")
    for t in TARGETS:
        slope, intercept = curves[t]
        share = F.coalesce(f"{t}_path", F.lit(shares[t] if known else 0.5))
        logit = _odds(share) + slope * F.when(F.col(t).isNull(), F.col(f"{t}_whole")).otherwise(F.col(f"{t}_other")) + intercept
        joined = joined.withColumn(f"p_{t}", 1 / (1 + F.exp(-logit))).withColumn(f"{t}_site", share)
    return joined.select(
        "doc_id",
        "p_quality",
        "p_toxic",
        "quality_site",
        "toxic_site",
        ((F.col("p_toxic") < 0.5) & (F.col("p_quality") >= 0.5) if known else F.lit(True)).alias("kept"),
    )
