"""Permit and property classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from platwork.functions.text import _col, upper_trim

# Text contained in a type -> standard type; the first that fits decides.
PERMIT_TYPES = {
    "NEW": "NEW CONSTRUCTION",
    "ADDITION": "ADDITION",
    "REMODEL": "REMODEL",
    "ALT": "ALTERATION",
    "REPAIR": "REPAIR",
    "DEMO": "DEMOLITION",
    "ELEC": "ELECTRICAL",
    "PLUMB": "PLUMBING",
    "MECH": "MECHANICAL",
}
PROPERTY_TYPES = {
    "COM": "COMMERCIAL",
    "RES": "RESIDENTIAL",
    "IND": "INDUSTRIAL",
    "AGR": "AGRICULTURAL",
    "MAN": "MANUFACTURING",
}

# Description pattern -> improvement type; the first that fits decides.
IMPROVEMENT_TYPES = {
    r"\bTENANT\s+IMPROVEMENT": "TENANT_IMPROVEMENT",
    r"\bADDITION\b": "ADDITION",
    r"\b(REMODEL|RENOVAT|ALTERATION)": "REMODEL",
    r"\bNEW\b": "NEW_CONSTRUCTION",
    r"\bDEMO": "DEMOLITION",
}


def _first_fit(rules: dict[str, str], test, default: Column) -> Column:
    pairs = list(rules.items())
    chain = reduce(lambda acc, kv: acc.when(test(kv[0]), kv[1]), pairs[1:], F.when(test(pairs[0][0]), pairs[0][1]))
    return chain.otherwise(default)


def standardize_permit_type(c: Column | str) -> Column:
    text = upper_trim(c)
    return _first_fit(PERMIT_TYPES, text.contains, text)


def standardize_property_type(c: Column | str) -> Column:
    text = upper_trim(c)
    return _first_fit(PROPERTY_TYPES, text.contains, text)


def improvement_type(c: Column | str) -> Column:
    text = F.upper(_col(c))
    return _first_fit(IMPROVEMENT_TYPES, text.rlike, F.lit("OTHER"))


def extract_parcel_number(c: Column | str) -> Column:
    """Digits after ``Parcel #``, ``Parcel ID:`` or ``APN:`` with hyphens dropped; null if none."""
    found = F.regexp_extract(_col(c), r"(?i)\b(?:parcel\s*(?:id\s*:?|number\s*:?|no\.?|#)|apn\s*[:#]?)\s*#?([0-9][0-9\-]*)", 1)
    return F.nullif(F.replace(found, F.lit("-"), F.lit("")), F.lit(""))
