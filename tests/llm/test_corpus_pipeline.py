"""The corpus pipeline against a plain version of each stage, stage by stage."""

import numpy as np
import pytest
from cases import DOCS, documents, leaks, near, repeats
from pyspark.sql import functions as F

import corpus_pipeline
from contigbin.llm import quality
from contigbin.llm.tokens import encoder


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = documents(8)
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, rows[5][1]), (1, "an item that no text holds at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_pipeline_equals_plain_stages(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    judged = [(d, *quality.judge(t or "")) for d, t, *_ in docs]
    plain = [(d, text) for d, row, text in judged if row[quality.NAMES.index("kept")]]
    component = near(plain, 5)
    plain = [(d, t) for d, t in plain if component[d][1] == d]
    cut, texts = repeats(plain), dict(plain)
    found = {r["doc_id"]: r["text"] for r in _upto(spark, sf_dir, 3).collect()}
    assert set(found) == set(texts)
    for d, t in found.items():  # characters that lose a byte go whole
        assert t.encode() == cut[d][4] or not texts[d].isascii() and len(t.encode()) <= len(cut[d][4])
    held = {d for d, _ in leaks(list(found.items()), [(0, documents(8)[5][1])])}
    left = {d: t for d, t in found.items() if d not in held}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(left)
    tokens = {d: len(encoder().ids(t)) + 1 for d, t in left.items()}
    assert {d: sum(r["length"] for r in rows if r["doc_id"] == d) for d in left} == tokens
    assert np.ceil(sum(tokens.values()) / 2048) <= len({r["sequence_id"] for r in rows}) <= np.ceil(sum(tokens.values()) / 2048) + 1


def _upto(spark, sf_dir, n):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:n]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
    return docs


def test_stages_keep_columns_and_take_empty_tables(spark, sf_dir):
    docs = spark.createDataFrame([], DOCS).withColumns({"kept": F.lit(1), "n": F.lit("x"), "_rest": F.lit(2), "a.b": F.lit(3), "c0": F.lit(4)})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns


def test_stages_take_dotted_columns_and_null_ids(spark, sf_dir, tmp_path):
    """Columns named like paths stay with their rows; documents without an id are documents of their own."""
    rows = [*documents(8)[:20], (None, documents(8)[5][1], "en", "x", 1), (None, documents(9)[0][1], None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({"a.b": F.concat(F.lit("own "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))), "rest": F.lit(1)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == [*(c.split()[0] for c in DOCS.split(", ")), "a.b", "rest"]
    got = docs.collect()
    assert got and all(r["a.b"] == f"own {'none' if r['doc_id'] is None else r['doc_id']}" and r["rest"] == 1 for r in got)
    assert sum(r["doc_id"] is None for r in got) == 1  # the other one holds a benchmark item
