"""Text cleaning. Word characters are Unicode letters, digits and underscore throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
# Whitespace as the source data means it: every Unicode whitespace character, as ranges of codes.
SPACES = ((9, 13), (28, 32), (133, 133), (160, 160), (5760, 5760), (8192, 8202), (8232, 8233), (8239, 8239), (8287, 8287), (12288, 12288))
WHITESPACE = "".join(chr(c) for first, last in SPACES for c in range(first, last + 1))
# Patterns name ranges, not every character: the fewer members a class has, the faster it is tested.
SPACE = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in SPACES) + "]"
# Runs of whitespace other than one plain space, which stays as it is.
RUNS = f"[{SPACE}&&[^ ]]{SPACE}*| {SPACE}+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def collapse(c: Column | str) -> Column:
    """Strip, then turn each inner run of whitespace into one space."""
    return F.regexp_replace(strip(c), RUNS, " ")


def clean_identifier(c: Column | str) -> Column:
    """Keep word characters and hyphens only."""
    return F.regexp_replace(_col(c), rf"[^{WORD}\-]", "")


def clean_text(c: Column | str) -> Column:
    return collapse(c)


def clean_address(c: Column | str) -> Column:
    return F.upper(collapse(c))


def upper_trim(c: Column | str) -> Column:
    return F.upper(strip(c))


def title_case(c: Column | str) -> Column:
    """Capitalise the first letter of every run of letters (``o'neil`` -> ``O'Neil``).

    ``initcap`` only breaks words at spaces, so a marker with a space is put before each letter
    that follows a non-letter and taken out again; that stays inside generated code.
    """
    marker = "\x01 "
    marked = F.regexp_replace(strip(c), r"(?<=\P{L})(?=\p{L})", marker)
    return F.replace(F.initcap(marked), F.lit(marker), F.lit(""))


def normalize_parcel_number(c: Column | str) -> Column:
    return F.replace(upper_trim(c), F.lit("-"), F.lit(""))


def source_json(*columns: Column | str) -> Column:
    """The record as JSON text; null fields are kept so the record can be rebuilt."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
