"""A corpus pipeline of five stages on the table ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the shared folder and
read again as the next one's docs. All but the last return the columns of ``documents``. Stages run jobs of their own
while they build their DataFrame (they write tables and fit models); ``run`` removes those tables, and the docs of a
stage, once its result is written.

Defined cases: rows without a letter go in the first stage; rows with a null doc_id pass all filters that compare
documents; a document that line dedup leaves without a line goes; rows that repeat a doc_id are one document for the
near duplicates; extra columns pass through to packing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm import decontaminate, language_id, line_dedup, packing, simhash_dedup
from archivolt.session import table
from archivolt.storage import new_path, remove, scratch

#: Documents whose likeliest language has a lower posterior are rejected with those that have no letter.
LEAST_SCORE = 0.5

#: Bayes scores, fingerprints and packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one, whose names then clash with none that an operator adds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest).alias("rest"))


def _wide(narrow: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in their order, with the length of the text brought up to date."""
    text = F.col("text")
    given = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")}
    return narrow.select(*[given.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the learned languages."""
    model = language_id.fit(docs, where=~language_id.held_out())
    named = language_id.identify(_narrow(docs), model)
    return _wide(named.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove chunks of lines that stand elsewhere before; documents left empty go."""
    left = line_dedup.dedup_lines(_narrow(docs))
    return _wide(left.filter((F.col("n_removed") == 0) | (F.length("text") > 0)), docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return _wide(simhash_dedup.keep_one(_narrow(docs)), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go."""
    return _wide(decontaminate.without_hits(_narrow(docs), table(spark, sf_dir, "benchmark")), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
