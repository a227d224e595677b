"""Money and date parsing that never fails a row."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from platwork.functions.text import strip

# Accepted date layouts, each with the shape of the texts it reads. Single-letter
# fields also accept two digits.
SLASH_LAYOUTS = (
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}", "M/d/yyyy H:mm"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}", "M/d/yyyy H:mm:ss"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
)
DASH_LAYOUTS = ((r"\d{1,2}-\d{1,2}-\d{4}", "M-d-yyyy"),)
DIGIT_LAYOUTS = ((r"\d{8}", "yyyyMMdd"),)
LETTER_LAYOUTS = (
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} [AP]M", "M/d/yyyy h:mm a"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AP]M", "M/d/yyyy h:mm:ss a"),
    (r"\d{1,2}-[A-Z][a-z]{2}-\d{4}", "d-MMM-yyyy"),
    (r"[A-Z][a-z]{2} \d{1,2}, \d{4}", "MMM d, yyyy"),
)
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?$"
SHORT_YEAR = r"^(\d{1,2}/\d{1,2}/)(\d{2})$"
# Fixed value: two-digit years from this one on belong to the last century.
PIVOT = 69


def parse_money(c: Column | str) -> Column:
    """Keep digits and dots, read as a number, 0 when nothing readable remains."""
    digits = F.regexp_replace(F.col(c) if isinstance(c, str) else c, "[^0-9.]", "")
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))


def as_timestamp(value: Column | datetime | str) -> Column:
    """A processing time given as a column, a datetime or ISO text."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    text = value if isinstance(value, str) else value.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def read_date(c: Column | str) -> Column:
    """The timestamp of a text in one of the known layouts, else null; months and AM/PM in any case.

    Whether a text has letters, slashes or hyphens chooses the layouts whose shapes it is held
    against, and its shape the one layout that is tried.
    """
    text = F.regexp_replace(strip(c), r"\s{2,}|[\s&&[^ ]]", " ")
    named = F.when(text.rlike("[A-Za-z]{3}"), F.initcap(F.lower(text))).otherwise(F.upper(text))
    year = F.regexp_extract(text, SHORT_YEAR, 2)
    century = F.when(year.try_cast("int") >= PIVOT, "19").otherwise("20")
    long_year = F.concat(F.regexp_extract(text, SHORT_YEAR, 1), century, year)
    # Months follow a hyphen too, where words do not begin for initcap.
    month = F.regexp_extract(named, r"^(\d{1,2}-)([a-z])(.*)$", 2)
    spelled = F.when(
        month != "", F.concat(F.regexp_extract(named, r"^(\d{1,2}-)", 1), F.upper(month), F.regexp_extract(named, r"^\d{1,2}-[a-z](.*)$", 1))
    ).otherwise(named)
    full = F.regexp_replace(spelled, r"(\d)([AP]M)$", "$1 $2")

    def tried(value: Column, layouts: tuple) -> Column:
        parsed = F
        for shape, layout in layouts:
            parsed = parsed.when(value.rlike(f"^{shape}$"), F.try_to_timestamp(value, F.lit(layout)).cast("timestamp_ntz"))
        return parsed

    lettered = text.rlike("[A-Za-z]")
    slashed = tried(text, SLASH_LAYOUTS).when(text.rlike(SHORT_YEAR), F.try_to_timestamp(long_year, F.lit("M/d/yyyy")).cast("timestamp_ntz"))
    return (
        F.when(lettered, F.when(text.rlike(ISO_DATE), text.try_cast("timestamp_ntz")).otherwise(tried(full, LETTER_LAYOUTS)))
        .when(text.contains("/"), slashed)
        .when(text.contains("-"), F.when(text.rlike(ISO_DATE), text.try_cast("timestamp_ntz")).otherwise(tried(text, DASH_LAYOUTS)))
        .otherwise(tried(text, DIGIT_LAYOUTS))
    )


def parse_date(c: Column | str, as_of: Column | datetime | str) -> Column:
    """The date of a known layout; otherwise midnight of the processing day."""
    fallback = F.date_trunc("day", as_timestamp(as_of)).cast("timestamp_ntz")
    return F.coalesce(read_date(c), fallback)
