"""Scalar column functions; every one is a native Spark expression."""

from platwork.functions.address import format_situs, normalize_address, parse_address
from platwork.functions.permits import (
    extract_parcel_number,
    improvement_type,
    standardize_permit_type,
    standardize_property_type,
)
from platwork.functions.similarity import token_sort_key, token_sort_ratio
from platwork.functions.text import (
    clean_address,
    clean_identifier,
    clean_text,
    normalize_parcel_number,
    source_json,
    strip,
    title_case,
    upper_trim,
)
from platwork.functions.values import parse_date, parse_money

__all__ = [
    "clean_address",
    "clean_identifier",
    "clean_text",
    "extract_parcel_number",
    "format_situs",
    "improvement_type",
    "normalize_address",
    "normalize_parcel_number",
    "parse_address",
    "parse_date",
    "parse_money",
    "source_json",
    "standardize_permit_type",
    "standardize_property_type",
    "strip",
    "title_case",
    "token_sort_key",
    "token_sort_ratio",
    "upper_trim",
]
