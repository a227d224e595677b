"""Watched folders: new feed files are cleaned, validated, matched and staged as a stream."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from platwork.operators.clean import clean_permits, clean_property
from platwork.operators.jobs import log_import, log_import_errors, permit_staging_rows, property_staging_rows
from platwork.operators.match import attach_best_parcel, attach_best_parcel_property
from platwork.operators.shape import clean_column_names, map_columns
from platwork.operators.validate import validate_permits, validate_property
from platwork.session import stored
from platwork.sources.feeds import CSV_OPTIONS, null_tokens, text_schema

RECORD = "record_id"
PERMIT, PROPERTY = "Permit", "PersonalProperty"


def stream_watch_folder(
    spark: SparkSession,
    folder: str,
    columns: list[str],
    archive: str | None = None,
    max_files: int = 1000,
    multi_line: bool = False,
) -> DataFrame:
    """Rows of every new CSV file in ``folder``, as text, with ``source_file``.

    A file is read once per checkpoint. With ``archive`` processed files are moved there. As in
    :func:`scan_csv`, ``multi_line`` allows line breaks in quoted values, and a record of another
    number of cells than the header fails the batch.
    """
    reader = (
        spark.readStream.schema(text_schema(columns))
        .options(**CSV_OPTIONS)
        .options(header=True, enforceSchema=False, maxFilesPerTrigger=max_files, multiLine=multi_line, mode="FAILFAST", columnPruning=False)
    )
    if archive:
        reader = reader.options(cleanSource="archive", sourceArchiveDir=archive)
    rows = null_tokens(reader.csv(folder).select(*columns, F.col("_metadata.file_path").alias("source_file")))
    return rows


def process_feed(
    df: DataFrame, import_type: str, as_of: Column | datetime | str, mapping: dict[str, str] | None = None
) -> DataFrame:
    """Map, clean and validate; the same function serves batches and streams."""
    extra = [c for c in ("source_file", RECORD) if c in df.columns]
    shaped = map_columns(df, {**mapping, **{c: c for c in extra}}) if mapping else clean_column_names(df)
    if import_type == PERMIT:
        return validate_permits(clean_permits(shaped, as_of, report=True), as_of)
    if import_type == PROPERTY:
        return validate_property(clean_property(shaped))
    raise ValueError(f"Unsupported import type: {import_type}")


def stage_batch(
    processed: DataFrame,
    parcels: DataFrame,
    import_type: str,
    job_id: int,
    staging_path: str,
    error_path: str,
    as_of: Column | datetime | str,
    job_path: str | None = None,
) -> None:
    """Match one batch and write its staging, error and (with ``job_path``) job rows, in folders of
    its own job id.

    Writing the same batch again replaces those folders, so a retried batch adds nothing twice.
    The matched batch is written once and the errors are derived from what was written.
    """
    attach, rows = (
        (attach_best_parcel, permit_staging_rows) if import_type == PERMIT
        else (attach_best_parcel_property, property_staging_rows)
    )
    matched = attach(processed, parcels)
    staged = f"{staging_path.rstrip('/')}/import_job_id={job_id}/load_id=1"
    key = F.col(RECORD) if RECORD in processed.columns else None
    rows(matched, job_id, as_of, row_id=key).drop("ImportJobID").write.mode("overwrite").parquet(staged)
    spark = processed.sparkSession
    written = spark.read.parquet(staged).select(
        F.col("SourceData").alias("record"),
        F.col(f"{'Permit' if import_type == PERMIT else 'PersonalProperty'}StagingID").alias("src_row"),
        F.coalesce("ValidationMessage", F.lit("")).alias("validation_errors"),
    )
    errors = log_import_errors(written, job_id, as_of).withColumn("RecordData", F.get_json_object("RecordData", "$.record"))
    errors.drop("ImportJobID").write.mode("overwrite").parquet(f"{error_path.rstrip('/')}/import_job_id={job_id}")
    if job_path:
        job = log_import(written, import_type, "stream", job_id, as_of)
        job.drop("ImportJobID").write.mode("overwrite").parquet(f"{job_path.rstrip('/')}/import_job_id={job_id}")


def batch_job_id(query_id: str, batch_id: int) -> int:
    """The import job of a micro-batch. The query id lives in the checkpoint: a retried batch keeps
    its job, and a stream with a new checkpoint cannot meet the jobs of an earlier one."""
    digest = hashlib.sha256(f"{query_id}/{batch_id}".encode()).digest()
    return int.from_bytes(digest[:8], "big") >> 1


def stream_match_and_stage(
    rows: DataFrame,
    parcels: DataFrame | Callable[[], DataFrame],
    import_type: str,
    staging_path: str,
    error_path: str,
    checkpoint: str,
    as_of: Column | datetime | str,
    mapping: dict[str, str] | None = None,
    job_path: str | None = None,
) -> StreamingQuery:
    """Process all files waiting in the watched folder, then stop; run again for later files.

    Each micro-batch is one import job with the number of :func:`batch_job_id`; ``parcels`` may be
    a function, so that a long-running stream sees the current parcel table. A batch is cleaned
    once, into a table that matching and staging read.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        current = parcels() if callable(parcels) else parcels
        processed = stored(process_feed(batch, import_type, as_of, mapping), "batch")
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        job_id = batch_job_id(query_id, batch_id)
        stage_batch(processed, current, import_type, job_id, staging_path, error_path, as_of, job_path)

    return (
        rows.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
