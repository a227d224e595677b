"""Catalog questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMA = (
    "ordinal int, name string, data_type string, max_length int, precision int, scale int, "
    "is_nullable boolean, is_identity boolean, description string"
)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def describe_schema(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """One row per column in column order; Spark has no identity columns, so that flag is false."""
    rows = []
    for i, f in enumerate(schema.fields, 1):
        decimal = isinstance(f.dataType, T.DecimalType)
        length = f.dataType.length if isinstance(f.dataType, (T.VarcharType, T.CharType)) else None
        rows.append(
            (
                i, f.name, f.dataType.simpleString(), length,
                f.dataType.precision if decimal else None, f.dataType.scale if decimal else None,
                f.nullable, False, f.metadata.get("comment", ""),
            )
        )
    return spark.createDataFrame(rows, SCHEMA)


def table_schema(spark: SparkSession, name: str) -> DataFrame | None:
    """Columns of a table, or None if there is no such table."""
    return describe_schema(spark, spark.table(name).schema) if table_exists(spark, name) else None
