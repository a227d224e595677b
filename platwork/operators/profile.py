"""Column population and a one-record preview."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platwork.operators.clean import blank
from platwork.operators.shape import ERRORS, field


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: ``non_null`` count and ``pct_populated`` (one decimal), from a single pass."""
    names = df.columns
    counts = df.agg(F.count("*").alias("_all"), *[F.count(field(c)).alias(f"_c{i}") for i, c in enumerate(names)])
    entries = F.array(
        *[F.struct(F.lit(i + 1).alias("ordinal"), F.lit(c).alias("column_name"), F.col(f"_c{i}").alias("non_null"))
          for i, c in enumerate(names)]
    )
    share = F.try_divide(F.col("c.non_null") * F.lit(100.0), F.col("_all"))
    return counts.select("_all", F.explode(entries).alias("c")).select(
        "c.ordinal", "c.column_name", "c.non_null", F.bround(share, 1).alias("pct_populated")
    )


def sample_record(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Non-empty fields of the first record, one row per field, without the error text."""
    names = [c for c in df.columns if c != ERRORS]
    first = df.orderBy(*order).limit(1).select(*[field(c).cast("string").alias(c) for c in names])
    entries = F.array(*[F.struct(F.lit(c).alias("field"), field(c).alias("value")) for c in names])
    return first.select(F.explode(entries).alias("e")).select("e.field", "e.value").filter(~blank(F.col("value")))
