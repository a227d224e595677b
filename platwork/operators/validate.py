"""Record validation: each rule appends ``"message; "`` in a fixed order."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platwork.functions.values import as_timestamp
from platwork.operators.clean import blank
from platwork.operators.shape import ERRORS, field

Rule = tuple[str, Column, str]

HIGH_VALUE = 10_000_000
MIN_ADDRESS_LENGTH = 5
MAX_AGE_YEARS = 50


def append_errors(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Append the message of every rule that holds, skipping rules of absent columns."""
    parts = [F.coalesce(F.col(ERRORS), F.lit("")) if ERRORS in df.columns else F.lit("")]
    parts += [F.when(bad, f"{message}; ").otherwise("") for column, bad, message in rules if column in df.columns]
    return df.withColumn(ERRORS, F.concat(*parts))


def _short(name: str) -> Column:
    return ~blank(field(name)) & (F.length(field(name)) < MIN_ADDRESS_LENGTH)


def validate_permits(df: DataFrame, as_of: Column | datetime | str) -> DataFrame:
    now = as_timestamp(as_of)
    oldest = now - F.make_ym_interval(F.lit(MAX_AGE_YEARS))
    return append_errors(
        df,
        [
            ("permit_number", blank(F.col("permit_number")), "Missing permit number"),
            ("address", blank(F.col("address")), "Missing address"),
            ("address", _short("address"), "Address too short"),
            ("valuation", F.col("valuation") < 0, "Negative valuation"),
            ("issue_date", F.col("issue_date") > now, "Future issue date"),
            ("issue_date", F.col("issue_date") < oldest, "Very old issue date"),
        ],
    )


def validate_property(df: DataFrame) -> DataFrame:
    return append_errors(
        df,
        [
            ("account_number", blank(F.col("account_number")), "Missing account number"),
            ("owner_name", blank(F.col("owner_name")), "Missing owner name"),
            ("property_location", blank(F.col("property_location")), "Missing property location"),
            ("property_location", _short("property_location"), "Property location too short"),
            ("value", F.col("value") < 0, "Negative property value"),
            ("value", F.col("value") > HIGH_VALUE, "Unusually high property value"),
        ],
    )


def in_error() -> Column:
    return ~blank(F.col(ERRORS))


def split_valid_invalid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid): a row is invalid iff its error text is neither null nor empty."""
    return df.filter(~in_error()), df.filter(in_error())


def staging_status(errors: Column | str = ERRORS) -> Column:
    """A missing field makes a row Invalid, any other message a Warning, none Valid."""
    c = F.col(errors) if isinstance(errors, str) else errors
    return F.when(blank(c), "Valid").when(c.contains("Missing "), "Invalid").otherwise("Warning")
