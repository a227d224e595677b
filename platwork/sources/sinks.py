"""Writing feeds, run outputs, logs and staging tables."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platwork.operators.shape import field
from platwork.session import stored

logger = logging.getLogger(__name__)

# Rows per output file, so that a job holding a large share of the data still gives many files.
MAX_RECORDS_PER_FILE = 5_000_000

# Cell text is written as it is, blanks at its ends included; null and '' are both left empty.
CSV_WRITE = {
    "quote": '"', "escape": '"', "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def _flat(df: DataFrame) -> DataFrame:
    """Delimited text cannot hold nested values; they are written as JSON."""
    nested = ("array", "map", "struct")
    return df.select(
        *[F.to_json(field(n)).alias(n) if t.startswith(nested) else field(n) for n, t in df.dtypes]
    )


def write_feed(df: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """Write by extension: ``.csv`` or ``.parquet``; any other falls back to CSV with a warning.

    The output is a folder of part files. Texts with line breaks are kept; they are read back with
    ``multi_line``. True on success, False (logged) where Spark or the file
    system refuses.
    """
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in (".csv", ".parquet"):
        logger.warning("Unsupported output format: %s, defaulting to CSV", suffix.lstrip("."))
        path = path[: len(path) - len(suffix)] + ".csv"
    try:
        writer = (df if path.endswith(".parquet") else _flat(df)).write.mode(mode)
        writer = writer.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        if path.endswith(".parquet"):
            writer.parquet(path)
        else:
            writer.options(header=True, **CSV_WRITE).csv(path)
        return True
    except (PySparkException, OSError) as error:
        logger.error("Error saving processed data: %s", error)
        return False


def write_run_output(df: DataFrame, folder: str, kind: str, run_id: str, suffix: str = "csv") -> str:
    """Processed rows of one import run, under ``processed_<kind>/run_id=<run_id>`` as
    ``data.<suffix>``. Writing the same run again replaces it."""
    path = f"{folder.rstrip('/')}/processed_{kind}/run_id={run_id}"
    if not write_feed(df, f"{path}/data.{suffix}"):
        raise OSError(f"Could not write {path}")
    return path


def append_rows(df: DataFrame, target: str, columns: Sequence[str], jdbc: dict | None = None) -> bool:
    """Append the named columns to a table (a parquet path, or a JDBC table with ``jdbc`` options).

    False, with nothing written, when there are no rows. The rows are computed once.
    """
    rows = stored(df.select(*[field(c) for c in columns]), "append")
    if rows.isEmpty():
        return False
    if jdbc:
        rows.write.format("jdbc").options(dbtable=target, batchsize="10000", **jdbc).mode("append").save()
    else:
        rows.write.mode("append").parquet(target)
    return True


def write_staging(rows: DataFrame, path: str, load_id: str = "1") -> None:
    """Staging rows, one folder per import job and load.

    A load written again replaces its own folders only, so a repeated load does not double its
    rows and a job may come in several loads. Rows are clustered by job before they are written:
    small jobs give one file, large ones as many as their size asks for.
    """
    (
        rows.withColumnRenamed("ImportJobID", "import_job_id")
        .withColumn("load_id", F.lit(load_id))
        .hint("rebalance", "import_job_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .partitionBy("import_job_id", "load_id")
        .parquet(path)
    )


def read_staging(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumnRenamed("import_job_id", "ImportJobID").drop("load_id")
