"""The pipeline's stages against plain Python on a small corpus."""

import random

import pytest

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

from archivolt.llm import registry  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    path = tmp_path_factory.mktemp("corpus")
    prose = lambda n: " ".join(f"{'abcdefghij'[rng.randrange(10)]}{'klmnopqrst'[rng.randrange(10)]}{rng.randrange(90)}x" for _ in range(n))
    leak = prose(30)
    rows = [(d, "\n".join(prose(rng.randrange(3, 60)) for _ in range(rng.randrange(1, 6))), "en", "s") for d in range(60)]
    rows += [(100, rows[5][1].replace("\n", " "), "en", "s"), (101, rows[5][1].replace("\n", " "), "en", "s")]
    rows += [(102, "123 456 !!", "en", "s"), (103, prose(20) + " " + leak, "en", "s"), (104, None, "en", "s"), (None, prose(9), "en", "s")]
    docs = spark.createDataFrame([(d, t, l, s, None if t is None else len(t)) for d, t, l, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages_keep_and_drop_what_they_should(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [{r.doc_id for r in docs.collect()}]
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "packing":
            assert docs.columns == COLUMNS
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen.append({r.doc_id for r in docs.collect()})
    start, language, lines, simhash, clean, packed = seen
    assert start - language == {102, 104}
    assert lines <= language and {100, 101} <= lines
    assert 101 not in simhash and len(simhash & {5, 100, 101}) >= 1 and None in simhash
    assert simhash - clean == {103}
    assert packed == clean


def test_run_gives_the_last_stage(spark, folder):
    found = pipeline.run(spark, folder)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(found.columns) and found.count() > 40
    assert [n for n, _ in pipeline.STAGES] == ["language", "lines", "simhash", "decontamination", "packing"]


def written(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of this stands anywhere in these few documents at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert pipeline.run(spark, written(spark, tmp_path, [], schema)).count() == 0


def test_odd_rows_and_clashing_columns(spark, tmp_path, odd_rows):
    """Nulls, long texts, repeated rows, and extra columns named like those of the operators."""
    extra = ("hits", "gone_", "key_", "version_", "best_", "lang_pred", "rest", "items", "fingerprint", "n_lines")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    rows = [(d, t, l, s, None if t is None else len(t), *extra) for d, t, l, s in odd_rows]
    path = written(spark, tmp_path, rows, schema)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.schema.names == schema.replace(",", "").split()[::2], name
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        assert all(tuple(r[c] for c in extra) == extra for r in docs.collect())
    kept = sorted(repr(r.doc_id) for r in docs.collect())
    assert kept == sorted(["4", "5", "7", "None"])  # of 4 and 4 one, of 5 and 6 the first; without a letter none
    assert sorted({repr(r.doc_id) for r in pipeline.run(spark, path).collect()}) == kept


def test_registered_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
