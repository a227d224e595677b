"""Duplicate permit numbers in staging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platwork.operators.skew import FLOOR, SHARE, salted_join

DUPLICATE_MESSAGE = "Duplicate permit number found in system"


def permit_number_counts(staging: DataFrame) -> DataFrame:
    """Per job and permit number the staging rows and those that did not fail.

    Partial counts, to be kept beside staging in folders per job and replaced when a job is loaded
    again: sums over jobs give the counts of any history without reading its records.
    """
    alive = F.coalesce(F.col("ProcessingStatus") != "Failed", F.lit(False))
    known = staging.filter(F.col("PermitNumber").isNotNull())
    return known.groupBy("ImportJobID", "PermitNumber").agg(F.count_if(alive).alias("alive"), F.count("*").alias("rows"))


def _with_other_count(staging: DataFrame, job_id, share: int, floor: int, counts: DataFrame | None, asked=None) -> DataFrame:
    """Rows (of one job, or all) with ``_others``: how many other rows that did not fail carry
    the same permit number. Grouped counts give it in linear time; no row meets another row.

    For one job (``asked``) only its own numbers are counted: they are semi-joined to the history
    before it is grouped, which also lets the engine filter the scan of the history by them.
    """
    alive = F.coalesce(F.col("ProcessingStatus") != "Failed", F.lit(False))
    history = permit_number_counts(staging) if counts is None else counts
    if asked is not None:
        own = staging.filter((F.col("ImportJobID") == asked) & F.col("PermitNumber").isNotNull()).select("PermitNumber").distinct()
        history = permit_number_counts(staging.join(own, "PermitNumber", "left_semi")) if counts is None else counts.join(own, "PermitNumber", "left_semi")
    sums = history.groupBy("PermitNumber").agg(F.sum("alive").alias("_alive"), F.sum("rows").alias("_rows"))
    rows = staging if job_id is None else staging.filter(F.col("ImportJobID") == job_id)
    joined = salted_join(
        rows, sums.select("PermitNumber", "_alive"), ["PermitNumber"], sums, "_rows", "left", share=share, floor=floor
    )
    return joined.withColumn("_others", F.coalesce(F.col("_alive") - alive.cast("int"), F.lit(0))).drop("_alive")


def duplicate_permit_pairs(
    staging: DataFrame, job_id=None, share: int = SHARE, floor: int = FLOOR, counts: DataFrame | None = None
) -> DataFrame:
    """Staging rows whose permit number another row that did not fail also has.

    A pair listing repeats the first row of a pair once per partner and shows nothing of the
    partner, so its whole content is the row and a multiplicity. That is what is returned:
    ``pair_count`` is the number of pairs of the row, and no quadratic listing is made. ``counts`` are
    kept partials of :func:`permit_number_counts` that cover all of staging.
    """
    rows = _with_other_count(staging, job_id, share, floor, counts, job_id).filter(F.col("_others") > 0)
    return rows.withColumnRenamed("_others", "pair_count").withColumn("DuplicateMessage", F.lit(DUPLICATE_MESSAGE))


def flag_duplicate_permits(
    staging: DataFrame, job_id=None, share: int = SHARE, floor: int = FLOOR, counts: DataFrame | None = None
) -> DataFrame:
    """All staging rows; duplicates (of the job, or of every job) get status ``Warning`` and the
    duplicate message after their earlier messages. ``counts`` as in :func:`duplicate_permit_pairs`."""
    rows = _with_other_count(staging, None, share, floor, counts, job_id)
    hit: Column = F.col("_others") > 0
    if job_id is not None:
        hit = hit & F.coalesce(F.col("ImportJobID") == job_id, F.lit(False))
    status = F.col("ValidationStatus") if "ValidationStatus" in staging.columns else F.lit("Pending")
    message = F.col("ValidationMessage") if "ValidationMessage" in staging.columns else F.lit(None).cast("string")
    return rows.withColumns(
        {
            "ValidationStatus": F.when(hit, "Warning").otherwise(status),
            "ValidationMessage": F.when(
                hit, F.concat(F.coalesce(message, F.lit("")), F.lit(f"{DUPLICATE_MESSAGE}; "))
            ).otherwise(message),
        }
    ).drop("_others")
