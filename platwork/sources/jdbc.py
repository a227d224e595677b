"""Database tables and SQL text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(
    url: str,
    query: str | None = None,
    table: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[Any, Any] | None = None,
    num_partitions: int = 1,
    fetch_size: int = 10_000,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Reader options. A partitioned read wraps the query as a table, as the source requires."""
    if (query is None) == (table is None):
        raise ValueError("Give either a query or a table")
    options = {"url": url, "fetchsize": str(fetch_size), **(properties or {})}
    if partition_column is None:
        options["query" if query else "dbtable"] = query or table
        return options
    if bounds is None:
        raise ValueError("A partitioned read needs the bounds of its column")
    options["dbtable"] = f"({query}) AS q" if query else table
    options["partitionColumn"] = partition_column
    options["lowerBound"], options["upperBound"] = str(bounds[0]), str(bounds[1])
    options["numPartitions"] = str(num_partitions)
    return options


def scan_jdbc(spark: SparkSession, url: str, query: str | None = None, **options) -> DataFrame:
    """A query or table as a DataFrame; read in parallel when a partition column is given.

    Filters, columns, limits and simple aggregates on the result are pushed into the database.
    """
    return spark.read.format("jdbc").options(**jdbc_options(url, query, **options)).load()


def sql_query(
    spark: SparkSession, text: str, params: Sequence[Any] | Mapping[str, Any] | None = None, **tables: DataFrame
) -> DataFrame:
    """Parameterised SQL (``?`` or ``:name`` markers) over registered tables and, as
    ``{name}``, over DataFrames given by keyword."""
    args = params if params is None or isinstance(params, Mapping) else list(params)
    return spark.sql(text, args=args, **tables)
