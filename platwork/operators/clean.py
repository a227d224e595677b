"""Cleaning rules. Each feed is cleaned in one projection; rules apply to the columns present."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platwork.functions import (
    clean_address,
    clean_identifier,
    clean_text,
    parse_money,
    standardize_permit_type,
    standardize_property_type,
    title_case,
    upper_trim,
)
from platwork.functions.text import strip
from platwork.functions.values import as_timestamp, read_date
from platwork.operators.shape import ERRORS, clean_column_names, field

PERMIT_FIELDS = (
    "permit_number", "permit_type", "issue_date", "address",
    "owner_name", "valuation", "description", "parcel_id", "status",
)
PROPERTY_FIELDS = (
    "account_number", "owner_name", "owner_address", "business_name",
    "property_location", "property_type", "value", "status",
)


NUMBERS = (T.NumericType,)
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _money(df: DataFrame, name: str) -> Column:
    """Numeric columns keep their value and sign; only text is read digit by digit."""
    if isinstance(df.schema[name].dataType, NUMBERS):
        return F.coalesce(field(name).cast("double"), F.lit(0.0))
    return parse_money(field(name).cast("string"))


def _known_date(df: DataFrame, name: str) -> Column:
    """Dates and times as they are, text by its layout; null where neither gives a date."""
    if isinstance(df.schema[name].dataType, TIMES):
        return field(name).cast("timestamp_ntz")
    return read_date(field(name).cast("string"))


def _apply(
    df: DataFrame, rules: dict[str, Callable[[Column], Column]], typed: dict[str, Callable[[DataFrame, str], Column]]
) -> list[Column]:
    return [
        typed[c](df, c).alias(c) if c in typed else rules[c](field(c).cast("string")).alias(c) if c in rules else field(c)
        for c in df.columns
    ]


def clean_permits(df: DataFrame, as_of: Column | datetime | str, report: bool = False) -> DataFrame:
    """Clean a permit feed; ``as_of`` replaces unreadable issue dates. Null stays null.

    Money and dates that come typed are cast, not printed and read again. With ``report`` a date
    that was given but not readable is stated in ``validation_errors``.
    """
    named = clean_column_names(df)
    today = F.date_trunc("day", as_timestamp(as_of)).cast("timestamp_ntz")
    columns = _apply(
        named,
        {
            "permit_number": clean_identifier,
            "address": clean_address,
            "permit_type": standardize_permit_type,
            "owner_name": title_case,
            "description": clean_text,
            "parcel_id": clean_identifier,
            "status": upper_trim,
        },
        {"valuation": _money, "issue_date": lambda d, c: F.coalesce(_known_date(d, c), today)},
    )
    if report and "issue_date" in named.columns:
        given = ~blank(strip(field("issue_date").cast("string")))
        lost = F.when(given & _known_date(named, "issue_date").isNull(), "Unreadable issue date; ").otherwise("")
        earlier = F.coalesce(F.col(ERRORS), F.lit("")) if ERRORS in named.columns else F.lit("")
        columns = [c for c, name in zip(columns, named.columns) if name != ERRORS] + [F.concat(earlier, lost).alias(ERRORS)]
    return named.select(*columns)


def clean_property(df: DataFrame) -> DataFrame:
    """Clean a personal-property feed. Null stays null, and typed money is cast."""
    named = clean_column_names(df)
    return named.select(
        *_apply(
            named,
            {
                "account_number": clean_identifier,
                "owner_name": title_case,
                "owner_address": clean_address,
                "business_name": title_case,
                "property_location": clean_address,
                "property_type": standardize_property_type,
                "status": upper_trim,
            },
            {"value": _money},
        )
    )


def blank(c: Column) -> Column:
    """True for null and for empty text; never null."""
    return F.coalesce(c == "", F.lit(True))
