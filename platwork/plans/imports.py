"""Whole import flows: a feed cleaned and matched, and a run that stages, logs and summarises it."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platwork.operators.clean import clean_permits, clean_property
from platwork.operators.jobs import import_summary, log_import, log_import_errors, permit_staging_rows, property_staging_rows
from platwork.operators.match import address_match_rows, attach_best_parcel, attach_best_parcel_property
from platwork.operators.profile import sample_record
from platwork.operators.shape import map_columns
from platwork.operators.validate import in_error, validate_permits, validate_property
from platwork.sources.sinks import read_staging, write_run_output, write_staging


def import_permits(
    raw: DataFrame,
    as_of: Column | datetime | str,
    parcels: DataFrame | None = None,
    columns_map: dict[str, str] | None = None,
) -> DataFrame:
    """Map, clean, validate and, where parcels are given, match a permit feed."""
    df = map_columns(raw, columns_map) if columns_map else raw
    df = validate_permits(clean_permits(df, as_of, report=True), as_of)
    return attach_best_parcel(df, parcels) if parcels is not None and "address" in df.columns else df


def import_property(
    raw: DataFrame, parcels: DataFrame | None = None, columns_map: dict[str, str] | None = None
) -> DataFrame:
    """Map, clean, validate and, where parcels are given, match a personal-property feed."""
    df = map_columns(raw, columns_map) if columns_map else raw
    df = validate_property(clean_property(df))
    return attach_best_parcel_property(df, parcels) if parcels is not None and "property_location" in df.columns else df


class ImportRun(NamedTuple):
    """What an import run wrote, read back, and its summary and first record."""

    processed: DataFrame
    staging: DataFrame
    job: DataFrame
    errors: DataFrame
    matches: DataFrame | None
    summary: DataFrame
    sample: DataFrame


def run_import(
    raw: DataFrame,
    import_type: str,
    job_id: int,
    file_name: str,
    folder: str,
    as_of: Column | datetime | str,
    parcels: DataFrame | None = None,
    columns_map: dict[str, str] | None = None,
    record: str = "src_row",
    notes: str | None = None,
) -> ImportRun:
    """One import: the feed is mapped, cleaned, validated and matched once and written under
    ``folder``; staging, job, error and match rows, summary and sample come from what was written.

    ``record`` is a unique number of each record in the feed. A run of the same job replaces the
    rows of that job and leaves those of others.
    """
    permits = import_type == "Permit"
    done = import_permits(raw, as_of, parcels, columns_map) if permits else import_property(raw, parcels, columns_map)
    spark, root = raw.sparkSession, folder.rstrip("/")
    written = f"{write_run_output(done, root, 'permits' if permits else 'property', str(job_id), 'parquet')}/data.parquet"
    processed = spark.read.parquet(written)
    key = F.col(record).cast("bigint")
    rows = permit_staging_rows if permits else property_staging_rows
    write_staging(rows(processed.drop("match_attempted"), job_id, as_of, row_id=key), f"{root}/staging_{import_type}")
    parts = {
        "import_job": log_import(processed, import_type, file_name, job_id, as_of, notes),
        "import_error": log_import_errors(processed, job_id, as_of, record),
    }
    if "match_attempted" in processed.columns:
        place = "address" if permits else "property_location"
        parts["address_match"] = address_match_rows(processed, place, as_of, job_id, import_type, record)
    for name, part in parts.items():
        part.drop("ImportJobID").write.mode("overwrite").parquet(f"{root}/{name}/import_job_id={job_id}")

    def back(name: str) -> DataFrame:
        own = F.col("import_job_id") == job_id
        known = spark.read.parquet(f"{root}/{name}").filter(own).withColumnRenamed("import_job_id", "ImportJobID")
        return known.withColumn("ImportJobID", F.col("ImportJobID").cast("bigint"))

    staged = read_staging(spark, f"{root}/staging_{import_type}").filter(F.col("ImportJobID") == job_id)
    return ImportRun(
        processed, staged, back("import_job"), back("import_error"),
        back("address_match") if "address_match" in parts else None,
        import_summary(processed, "permit" if permits else "property"), sample_record(processed, [record]),
    )


def permit_type_report(processed: DataFrame) -> DataFrame:
    """Per permit type: permits, permits in error, matched permits, mean match confidence."""
    matched = F.col("match_confidence") > 0
    return processed.groupBy("permit_type").agg(
        F.count("*").alias("permits"),
        F.count_if(in_error()).alias("in_error"),
        F.count_if(matched).alias("matched"),
        F.avg(F.when(matched, F.col("match_confidence"))).alias("avg_confidence"),
    )
