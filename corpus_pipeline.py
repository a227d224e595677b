"""Training-data pipeline: quality classifier, exact dedup, near dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``. Rows are told apart by doc_id and text, so a repeated row is one document. Null texts
count as empty, an empty table gives an empty one, and columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platwork.llm.common import stored, table
from platwork.llm.exact_dedup import exact_duplicates
from platwork.llm.jaccard import near_duplicates
from platwork.llm.packing import TOKENIZER, pack_documents, tokenizer_source
from platwork.llm.quality import MIN_PROBABILITY, fit_on_sample, graded, grader

# Near duplicates share 80 percent or more of their shingles of five words.
WORDS, PERCENT = 5, 80
# Rows that tasks hand to Python at once: texts of some MB, where the session's 10,000 would be ten times as much.
BATCH_ROWS, BATCH_SETTING = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"
# Fewer decisions than this (about 100 bytes each) are broadcast to the documents, more are joined.
BROADCAST_ROWS = 100_000


def _identity() -> Column:
    return F.struct("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("sha"))


def _keep(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose identity is ``kept`` in ``decisions`` (id, kept), repeated ones once."""
    marks = decisions.groupBy("id").agg(F.max("kept").alias("kept"), F.count("*").alias("times")).filter("NOT kept OR times > 1")
    marks = stored(marks.select(F.col("id.doc_id").alias("_id"), F.col("id.sha").alias("_sha"), F.col("kept").alias("_kept")), "decisions")
    counts = marks.agg(F.count("*"), F.count_if("_kept")).first()
    side = F.broadcast(marks) if counts[0] < BROADCAST_ROWS else marks
    own = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))
    rows = docs.select(own.alias("_doc"), _identity().alias("_key"))
    met = rows.join(side, F.col("_key.doc_id").eqNullSafe(F.col("_id")) & (F.col("_key.sha") == F.col("_sha")), "left")
    if counts[1]:
        first = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
        met = met.withColumn("_first", first).filter("_kept IS NULL OR (_kept AND _first = 1)")
    else:
        met = met.filter("_kept IS NULL")
    return met.select("_doc.*")


def small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage in a session whose batches are no larger than ``BATCH_ROWS``, which stays so: the
    stage's result is computed when it is written."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
            spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the rated ones among them, takes for good."""
    model = fit_on_sample(docs, graded(table(spark, sf_dir, "labels")))
    return docs.filter(grader(spark, model)(F.col("text"))["tail_probability"] >= MIN_PROBABILITY)


@small_batches
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal without blanks the longest, then the one with the smallest id."""
    decided = exact_duplicates(docs.select(_identity().alias("doc_id"), "text"))
    return _keep(docs, decided.select(F.col("doc_id").alias("id"), "kept"))


@small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by the similarity of their shingles the one with the smallest id."""
    decided = near_duplicates(docs.select(_identity().alias("doc_id"), "text"), WORDS, PERCENT)
    return _keep(docs, decided.select(F.col("doc_id").alias("id"), (F.col("doc_id") == F.col("component_id")).alias("kept")))


@small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in training sequences."""
    packed = pack_documents(docs, tokenizer_source(public_tokenizers.path(TOKENIZER)))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing),
]
# Tokens and fitted weights are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
