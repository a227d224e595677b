"""Import jobs: logs, errors, staging rows, completion and statistics."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platwork.functions import improvement_type, source_json
from platwork.functions.values import as_timestamp
from platwork.operators.clean import blank
from platwork.operators.shape import ERRORS, error_messages, field
from platwork.operators.validate import in_error, staging_status

DONE = ("Processed", "Failed", "Skipped")
NOT_DONE = ("Failed", "Skipped")


def import_summary(df: DataFrame, label: str = "permit") -> DataFrame:
    """One row: record_count, valid_count, error_count, status, message."""
    errors = F.count_if(in_error()) if ERRORS in df.columns else F.lit(0).cast("bigint")
    total = F.count("*")
    return df.agg(total.alias("record_count"), errors.alias("error_count")).select(
        "record_count",
        (F.col("record_count") - F.col("error_count")).alias("valid_count"),
        "error_count",
        F.lit("success").alias("status"),
        F.concat(F.lit("Successfully imported "), F.col("record_count"), F.lit(f" {label} records")).alias("message"),
    )


def log_import(
    df: DataFrame, import_type: str, file_name: str, job_id: Column | int, as_of: Column | datetime | str, notes: str | None = None
) -> DataFrame:
    """The import-job row of a validated batch; the caller supplies the job id."""
    errors = F.count_if(in_error())
    counts = df.agg(F.count("*").alias("RecordsTotal"), errors.alias("RecordsFailed"))
    return counts.select(
        (job_id if isinstance(job_id, Column) else F.lit(job_id).cast("bigint")).alias("ImportJobID"),
        F.lit(import_type).alias("ImportType"),
        F.lit(file_name).alias("SourceFile"),
        as_timestamp(as_of).alias("ImportDate"),
        "RecordsTotal",
        (F.col("RecordsTotal") - F.col("RecordsFailed")).alias("RecordsSuccessful"),
        "RecordsFailed",
        F.lit(notes).cast("string").alias("Notes"),
    )


def log_import_errors(
    df: DataFrame,
    job_id: Column | int,
    as_of: Column | datetime | str,
    record_index: str = "src_row",
    record: Sequence[str] | None = None,
    per_message: bool = False,
) -> DataFrame:
    """Error records of a validated batch: one row per bad record, or per single message."""
    names = [c for c in (record or df.columns) if c not in (ERRORS, record_index)]
    bad = df.filter(in_error())
    if per_message:
        bad = bad.select("*", F.explode(error_messages(F.col(ERRORS))).alias("_message"))
    else:
        bad = bad.withColumn("_message", F.regexp_replace(F.col(ERRORS), r";\s*$", ""))
    return bad.select(
        (job_id if isinstance(job_id, Column) else F.lit(job_id).cast("bigint")).alias("ImportJobID"),
        F.col(record_index).cast("bigint").alias("RecordIndex"),
        F.lit("Validation").alias("ErrorType"),
        F.col("_message").alias("ErrorMessage"),
        source_json(*[field(c).alias(c) for c in names]).alias("RecordData"),
        as_timestamp(as_of).alias("CreatedDate"),
    )


def _text_or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return field(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _staging_tail(df: DataFrame, as_of) -> list[Column]:
    message = F.nullif(F.col(ERRORS), F.lit("")) if ERRORS in df.columns else F.lit(None).cast("string")
    status = staging_status() if ERRORS in df.columns else F.lit("Pending")
    source = [field(c).alias(c) for c in df.columns if c != ERRORS]
    return [
        source_json(*source).alias("SourceData"),
        status.alias("ValidationStatus"),
        message.alias("ValidationMessage"),
        F.lit("Pending").alias("ProcessingStatus"),
        F.lit(None).cast("string").alias("ProcessingMessage"),
        as_timestamp(as_of).alias("CreatedDate"),
        as_timestamp(as_of).alias("ModifiedDate"),
    ]


def _row_id(row_id: Column | None) -> Column:
    # Unique within one written job without a central counter. It is fixed once written; give a
    # key of the source instead where rows are numbered before they are written.
    return F.monotonically_increasing_id() if row_id is None else row_id


def permit_staging_rows(df: DataFrame, job_id: Column | int, as_of, row_id: Column | None = None) -> DataFrame:
    """Cleaned permits in the permit staging layout."""
    job = job_id if isinstance(job_id, Column) else F.lit(job_id).cast("bigint")
    text = _text_or_null(df, "description")
    return df.select(
        _row_id(row_id).alias("PermitStagingID"),
        job.alias("ImportJobID"),
        _text_or_null(df, "permit_number").alias("PermitNumber"),
        _text_or_null(df, "permit_type").alias("PermitType"),
        _text_or_null(df, "issue_date", "date").alias("IssueDate"),
        text.alias("Description"),
        _text_or_null(df, "address").alias("ProjectAddress"),
        F.nullif(_text_or_null(df, "parcel_id"), F.lit("")).alias("ParcelNumber"),
        _text_or_null(df, "owner_name").alias("ApplicantName"),
        _text_or_null(df, "valuation", "decimal(18,2)").alias("ValuationAmount"),
        _text_or_null(df, "status").alias("Status"),
        F.when(~blank(text), improvement_type(text)).alias("ImprovementType"),
        *_staging_tail(df, as_of),
    )


def property_staging_rows(df: DataFrame, job_id: Column | int, as_of, row_id: Column | None = None) -> DataFrame:
    """Cleaned property accounts in the property staging layout."""
    job = job_id if isinstance(job_id, Column) else F.lit(job_id).cast("bigint")
    return df.select(
        _row_id(row_id).alias("PersonalPropertyStagingID"),
        job.alias("ImportJobID"),
        _text_or_null(df, "account_number").alias("TaxpayerID"),
        _text_or_null(df, "business_name").alias("BusinessName"),
        _text_or_null(df, "owner_name").alias("TaxpayerName"),
        _text_or_null(df, "property_location").alias("PropertyAddress"),
        _text_or_null(df, "owner_address").alias("MailingAddress"),
        F.nullif(_text_or_null(df, "parcel_id"), F.lit("")).alias("ParcelNumber"),
        _text_or_null(df, "property_type").alias("PropertyType"),
        _text_or_null(df, "value", "decimal(18,2)").alias("AcquisitionCost"),
        *_staging_tail(df, as_of),
    )


def complete_import_job(
    jobs: DataFrame,
    permit_staging: DataFrame,
    property_staging: DataFrame,
    completed_at: Column | datetime | str,
    job_id=None,
) -> DataFrame:
    """Jobs with final counts from the staging table of their import type, marked completed.

    Jobs of another type are completed without counts. With ``job_id`` only that job changes.
    """
    tagged = permit_staging.select(F.lit("Permit").alias("ImportType"), "ImportJobID", "ProcessingStatus").unionByName(
        property_staging.select(F.lit("PersonalProperty").alias("ImportType"), "ImportJobID", "ProcessingStatus")
    )
    if job_id is not None:
        tagged = tagged.filter(F.col("ImportJobID") == job_id)
    state = F.col("ProcessingStatus")
    counts = tagged.groupBy("ImportType", "ImportJobID").agg(
        F.count("*").alias("_total"),
        F.count_if(state.isin(*DONE)).alias("_done"),
        F.count_if(state == "Processed").alias("_ok"),
        F.count_if(state.isin(*NOT_DONE)).alias("_failed"),
    )
    chosen = F.lit(True) if job_id is None else F.col("ImportJobID") == job_id
    known = F.col("ImportType").isin("Permit", "PersonalProperty")
    now = as_timestamp(completed_at)
    new = {
        "Status": F.lit("Completed"),
        "CompletedDate": now,
        "ModifiedDate": now,
    }
    for name, count in (
        ("RecordsTotal", "_total"), ("RecordsProcessed", "_done"),
        ("RecordsSuccessful", "_ok"), ("RecordsFailed", "_failed"),
    ):
        new[name] = F.when(known, F.coalesce(F.col(count), F.lit(0)))
    joined = jobs.join(counts, ["ImportType", "ImportJobID"], "left")
    updated = {
        name: F.when(chosen, value).otherwise(F.col(name)) if name in jobs.columns else F.when(chosen, value)
        for name, value in new.items()
    }
    return joined.withColumns(updated).drop("_total", "_done", "_ok", "_failed")


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Number of second boundaries crossed, fractions of a second ignored."""
    a, b = (F.date_trunc("second", F.col(c) if isinstance(c, str) else c).cast("timestamp") for c in (start, end))
    return F.unix_timestamp(b) - F.unix_timestamp(a)


def permit_import_stats(jobs: DataFrame, import_type: str = "Permit") -> DataFrame:
    """Totals, success percentage and mean processing seconds of completed jobs of a type."""
    done = jobs.filter((F.col("ImportType") == import_type) & F.col("CompletedDate").isNotNull())
    seconds = seconds_between("ImportDate", "CompletedDate")
    ok, total = F.col("SuccessfulRecords"), F.col("TotalRecords")
    rate = (ok * 100).cast("decimal(24,4)") / F.nullif(total, F.lit(0)).cast("decimal(20,0)")
    return (
        done.groupBy("ImportType")
        .agg(
            F.count("*").alias("TotalJobs"),
            F.sum("RecordsTotal").alias("TotalRecords"),
            F.sum("RecordsSuccessful").alias("SuccessfulRecords"),
            F.sum("RecordsFailed").alias("FailedRecords"),
            F.sum(seconds).alias("_seconds"),
            F.count(seconds).alias("_timed"),
        )
        .select(
            "ImportType", "TotalJobs", "TotalRecords", "SuccessfulRecords", "FailedRecords",
            rate.cast("decimal(5,2)").alias("SuccessRate"),
            F.call_function("div", F.col("_seconds"), F.nullif(F.col("_timed"), F.lit(0))).alias("AvgProcessingTimeSeconds"),
        )
    )
