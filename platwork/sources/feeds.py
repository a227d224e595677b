"""Delimited and workbook feeds, read as text columns."""

from __future__ import annotations

import csv
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platwork.operators.shape import ERRORS, field, map_columns
from platwork.sources.workbooks import scan_workbooks

# Cell texts that mean "no value".
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

CSV_OPTIONS = {"sep": ",", "quote": '"', "escape": '"'}
DELIMITED = ("csv", "txt")
WORKBOOK = ("xlsx", "xls")
RAGGED = "ragged_record"
# Files whose header places are broadcast (about 100 bytes each); beyond that they are joined.
BROADCAST_FILES = 100_000


def null_tokens(df: DataFrame) -> DataFrame:
    """Turn every no-value token into null."""
    return df.select(*[F.when(~field(c).isin(*NA_TOKENS), field(c)).alias(c) for c in df.columns])


def text_schema(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def require_path(spark: SparkSession, path: str) -> None:
    """Raise ``FileNotFoundError`` where a path or glob names nothing; no file is opened."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"File not found: {path}") from error
        raise


def _records(read, names: list[str], ragged: str | None) -> DataFrame:
    """Records of ``read(schema, options)`` with the header's cells. One with another number of
    cells fails the read or, where ``ragged`` names a column, keeps its whole line there."""
    if ragged is None:
        return read(text_schema(names), {"mode": "FAILFAST"})
    if ragged in names:
        raise ValueError(f"The feed has a column {ragged} of its own")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": ragged}
    rows = read(text_schema([*names, ragged]), options)
    # The reader compares a record with the header only while the line is asked for too.
    return rows.select(*[field(n) for n in names], field(ragged))


def ragged_errors(df: DataFrame, ragged: str = RAGGED) -> DataFrame:
    """The kept lines of ragged records as a validation message."""
    lost = F.when(field(ragged).isNotNull(), "Ragged record; ").otherwise("")
    earlier = F.coalesce(F.col(ERRORS), F.lit("")) if ERRORS in df.columns else F.lit("")
    return df.withColumn(ERRORS, F.concat(earlier, lost))


def _skip_lines(spark: SparkSession, path: str, n: int, ragged: str | None) -> DataFrame:
    """Read delimited text whose header comes after ``n`` physical lines of each file.

    A line's place in its file is its row id in the scan minus that of the file's first line. The
    preamble must lie in the first split of the file. Only headers come to the driver.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_id"),
    )
    opening = lines.filter(F.col("_split") == 0)
    firsts = opening.groupBy("_file").agg(F.min("_id").alias("_first"))
    after = (F.col("_id") - F.col("_first") >= n) & (F.trim("value") != "")
    heads = opening.join(firsts, "_file").filter(after).groupBy("_file").agg(
        F.min("_id").alias("_head"), F.min_by("value", "_id").alias("_header")
    )
    headers = [r[0] for r in heads.select("_header").distinct().limit(2).collect()]
    if len(headers) != 1:
        raise ValueError(f"{'No header' if not headers else 'Different headers'} after {n} lines in {path}")
    # One row per file: broadcast, so that the lines stay where they are, unless files are very many.
    starts = heads.select("_file", "_head")
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_FILES else starts
    body = lines.join(starts, "_file").filter(
        ((F.col("_split") != 0) | (F.col("_id") > F.col("_head"))) & (F.trim("value") != "")
    )

    def read(schema: T.StructType, options: dict) -> DataFrame:
        ddl = ", ".join("`" + f.name.replace("`", "``") + "` STRING" for f in schema)
        return body.select(F.from_csv("value", F.lit(ddl), {**CSV_OPTIONS, **options}).alias("r")).select("r.*")

    return _records(read, next(csv.reader(headers)), ragged)


def scan_csv(
    spark: SparkSession, path: str, skip_rows: int = 0, schema=None, multi_line: bool = False, ragged: str | None = None
) -> DataFrame:
    """Comma-separated text with a header; every column is text and no-value tokens are null.

    ``path`` may be a file, a glob or a folder. Files are split for parallel reading unless
    ``multi_line`` allows line breaks inside quoted values. A file whose header differs from the
    schema fails instead of being misread. No cell is lost in silence: a record with more or fewer
    cells than the header fails the read, or keeps its line in a column named ``ragged``.
    """
    if skip_rows:
        if multi_line:
            raise ValueError("skip_rows needs one record per line")
        return null_tokens(_skip_lines(spark, path, skip_rows, ragged))
    reader = spark.read.options(**CSV_OPTIONS).options(
        header=True, inferSchema=False, enforceSchema=False, multiLine=multi_line,
        # A record is compared with the header only where all of its cells are parsed.
        columnPruning=False,
    )
    names = [f.name for f in schema] if schema is not None else reader.csv(path).columns
    return null_tokens(_records(lambda full, options: reader.options(**options).schema(full).csv(path), names, ragged))


def feed_format(path: str, format_type: str | None = None) -> str:
    return (format_type or PurePosixPath(path).suffix.lstrip(".")).lower()


def scan_feed(
    spark: SparkSession,
    path: str,
    format_type: str | None = None,
    sheet_name: str | None = None,
    skip_rows: int = 0,
    columns_map: dict[str, str] | None = None,
    multi_line: bool = False,
    ragged: str | None = None,
) -> DataFrame:
    """Read a feed by its format (given, or from the suffix) and map its columns.

    With ``ragged`` records of another number of cells than the header come out too, with a
    validation message and their line in that column.
    """
    require_path(spark, path)
    kind = feed_format(path, format_type)
    if kind in DELIMITED:
        df = scan_csv(spark, path, skip_rows, multi_line=multi_line, ragged=ragged)
    elif kind in WORKBOOK:
        df = null_tokens(scan_workbooks(spark, path, sheet_name, skip_rows))
    else:
        raise ValueError(f"Unsupported file format: {kind}")
    if ragged and kind in DELIMITED:
        df = ragged_errors(df, ragged)
        columns_map = columns_map and {**columns_map, ragged: ragged, ERRORS: ERRORS}
    return map_columns(df, columns_map) if columns_map else df
