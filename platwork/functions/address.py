"""Postal address normalization and parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from platwork.functions.text import WORD, _col, collapse

# Postal abbreviations of street suffixes and directions.
ABBREVIATIONS = {
    "AVENUE": "AVE",
    "BOULEVARD": "BLVD",
    "CIRCLE": "CIR",
    "COURT": "CT",
    "DRIVE": "DR",
    "EXPRESSWAY": "EXPY",
    "HIGHWAY": "HWY",
    "LANE": "LN",
    "PARKWAY": "PKWY",
    "PLACE": "PL",
    "ROAD": "RD",
    "SQUARE": "SQ",
    "STREET": "ST",
    "TERRACE": "TER",
    "TRAIL": "TRL",
    "NORTH": "N",
    "SOUTH": "S",
    "EAST": "E",
    "WEST": "W",
    "NORTHEAST": "NE",
    "NORTHWEST": "NW",
    "SOUTHEAST": "SE",
    "SOUTHWEST": "SW",
}

# Words that announce a unit, in the order they are removed.
UNIT_WORDS = ("UNIT", "APT", "BUILDING", "FLOOR")

# Abbreviations recognised as a trailing street type.
STREET_TYPES = (
    "AVE", "BLVD", "CIR", "CT", "DR", "EXPY", "HWY", "LN",
    "PKWY", "PL", "RD", "SQ", "ST", "TER", "TRL", "WAY",
)


# A mark for a dropped character; it keeps the words beside it apart until they are abbreviated.
CUT = "\x01"


def normalize_address(c: Column | str) -> Column:
    """Upper-case, drop units and everything after a comma, abbreviate, drop punctuation.

    Whole words are abbreviated by plain replacement between spaces: punctuation is first set
    apart as a mark and every space doubled, so that neighbouring words do not share one. This
    keeps the whole function inside generated code; one pass over an array of words was slower.
    """
    text = collapse(F.upper(_col(c)))
    noise = [rf"(?<![{WORD}]){word} +[{WORD}]+" for word in UNIT_WORDS] + [f"#[{WORD}]+", ",.*"]
    bare = reduce(lambda acc, pattern: F.regexp_replace(acc, pattern, ""), noise, text)
    # Most addresses name no unit: one look decides whether the removals run at all.
    noisy = text.rlike("#|,|" + "|".join(f"{word} " for word in UNIT_WORDS))
    kept = F.when(noisy, bare).otherwise(text)
    words = F.replace(F.regexp_replace(kept, f"[^A-Z0-9 {WORD}]", f" {CUT} "), F.lit(" "), F.lit("  "))
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    short = reduce(
        lambda acc, pair: F.replace(acc, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), ABBREVIATIONS.items(), padded
    )
    joined = F.replace(short, F.lit(f"  {CUT}  "), F.lit(""))
    return F.coalesce(F.regexp_replace(F.trim(joined), " {2,}", " "), F.lit(""))


def parse_address(c: Column | str) -> Column:
    """Struct of street_number, street_name, street_type, city, state, zip_code.

    Number and name are both set or both empty; city, state and zip are never filled.
    """
    text = _col(c)
    pattern = r"^([0-9]+)\s+(.+)$"
    number = F.regexp_extract(text, pattern, 1)
    rest = F.regexp_extract(text, pattern, 2)
    last = F.substring_index(rest, " ", -1)
    typed = last.isin(*STREET_TYPES) & rest.contains(" ")
    name = F.when(typed, F.regexp_replace(rest, r"\s+\S+$", "")).otherwise(rest)
    return F.struct(
        F.coalesce(number, F.lit("")).alias("street_number"),
        F.coalesce(name, F.lit("")).alias("street_name"),
        F.when(typed, last).otherwise("").alias("street_type"),
        F.lit("").alias("city"),
        F.lit("").alias("state"),
        F.lit("").alias("zip_code"),
    )


def format_situs(number, street, city, state) -> Column:
    """``number street, city, state`` with nulls as empty text."""
    n, s, c, st = (F.coalesce(_col(x), F.lit("")) for x in (number, street, city, state))
    return F.concat(n, F.lit(" "), s, F.lit(", "), c, F.lit(", "), st)
