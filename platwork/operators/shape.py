"""Column mapping and naming."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERRORS = "validation_errors"


def field(name: str):
    """Column reference that also works for names with spaces, dots or quotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Project ``{target: source}``: absent sources are skipped and unmapped columns dropped.

    An empty ``validation_errors`` column is added.
    """
    present = [field(source).alias(target) for target, source in mapping.items() if source in df.columns]
    return df.select(*present, F.lit("").alias(ERRORS))


def standard_name(name: str) -> str:
    return name.lower().strip().replace(" ", "_")


def clean_column_names(df: DataFrame) -> DataFrame:
    names = [standard_name(c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"Column names collide after cleaning: {', '.join(clashes)}")
    return df.toDF(*names)


def stored_mapping(mappings: DataFrame, import_type: str, name: str | None = None) -> dict[str, str]:
    """The default (or the named) field mapping of an import type, from a table of JSON configs.

    Exactly one row of metadata is read; the newest wins when several are marked default.
    """
    chosen = mappings.filter(F.col("ImportType") == import_type)
    chosen = chosen.filter(F.col("MappingName") == name) if name else chosen.filter(F.col("IsDefault").cast("boolean"))
    parsed = F.from_json("MappingConfig", T.MapType(T.StringType(), T.StringType()))
    row = chosen.orderBy(F.col("FieldMappingID").desc()).select(parsed.alias("m")).first()
    return dict(row.m) if row and row.m else {}


def error_messages(errors) -> Column:
    """``"a; b; "`` as an array of messages."""
    trimmed = F.regexp_replace(F.coalesce(errors, F.lit("")), r";\s*$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, re.escape("; ")))
