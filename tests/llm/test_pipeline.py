"""The pipeline's stages one by one, and queries with SQL against DuckDB."""

import re

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from corpus_pipeline import STAGES, exact_dedup, near_dedup, packing, quality, run
from platwork.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _row int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1) for i, t in rows], SCHEMA)


def ids(df):
    return sorted(r.doc_id for r in df.collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, folder, name):
    problem, *_ = compare(spark, connect(folder), name, QUERIES[name], ORACLES[name], folder)
    assert problem is None, problem


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_exact_stage(spark):
    rows = [(3, "a b"), (2, "ab"), (4, "a  b"), (1, "x"), (1, "x"), (1, "y"), (None, None), (7, ""), (None, "z"), (9, " z")]
    out = exact_dedup(spark, docs_of(spark, rows), "")
    assert out.columns == docs_of(spark, []).columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(4, "a  b"), (1, "x"), (1, "y"), (None, None), (9, " z")], key=repr)


def test_near_stage(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(5, long), (2, long + " more"), (8, "a b"), (9, "a b"), (1, None), (4, ""), (6, "a b"), (6, "a b"), (7, "other words")]
    assert ids(near_dedup(spark, docs_of(spark, rows), "")) == [1, 2, 4, 6, 7]


def test_empty_tables(spark, folder):
    empty = docs_of(spark, [])
    for name, stage in STAGES:
        assert stage(spark, empty, folder).collect() == []


def test_columns_of_any_name_pass_through(spark):
    rows = [(1, "a b", "p"), (2, "ab", "q"), (3, "c", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `x.y` string").withColumn("a`b", F.lit(1))
    for stage in (exact_dedup, near_dedup):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and sorted(r["x.y"] for r in out.collect())[0] == "p"
    assert int(spark.conf.get(corpus_pipeline.BATCH_SETTING)) <= corpus_pipeline.BATCH_ROWS


def test_many_decisions_are_joined(spark, monkeypatch):
    rows = [(i, f"text {i // 2}") for i in range(40)]
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", 0)
    assert ids(exact_dedup(spark, docs_of(spark, rows), "")) == list(range(0, 40, 2))


def test_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = quality(spark, docs, folder)
    assert good.columns == docs.columns and 0.7 * docs.count() < good.count() <= docs.count()
    texts = {r.doc_id: r.text for r in good.collect()}
    left = near_dedup(spark, exact_dedup(spark, good, folder), folder)
    kept = {r.doc_id for r in left.collect()}
    plain = {}
    for i in sorted(texts, key=lambda i: (-len(texts[i]), i)):
        plain.setdefault(re.sub("[\x20\x09-\x0d]", "", texts[i]), i)
    assert kept <= set(plain.values())
    out = run(spark, folder)
    assert {r.doc_id for r in out.collect()} == kept
    assert out.columns == packing(spark, docs, folder).columns
