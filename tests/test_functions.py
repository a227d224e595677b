"""Scalar functions against fixed expectations and small brute-force models."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from platwork import functions as fn

AS_OF = "2025-06-30 12:00:00"


def apply(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", build(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("123 Main St", "123 MAIN ST"), ("123 Main Street", "123 MAIN ST"), ("123 Main Avenue", "123 MAIN AVE"),
        ("123 North Main St", "123 N MAIN ST"), ("123 Main St, Apt 4B", "123 MAIN ST"), ("123 Main St #101", "123 MAIN ST"),
        ("  123   Main   St  ", "123 MAIN ST"), ("", ""), (None, ""),
        ("5 N.Street-Road building 3", "5 NSTRD"), ("unit apt 4", "4"), ("apt unit 4", "APT"), ("north north street", "N N ST"),
        ("7 REUNIT 5 COURT", "7 REUNIT 5 CT"),
    ],
)
def test_normalize_address(spark, given, expected):
    assert apply(spark, [given], fn.normalize_address) == [expected]


def test_normalized_addresses_are_clean_and_stay_as_they_are(spark):
    from platwork.functions.address import ABBREVIATIONS, UNIT_WORDS

    pick = random.Random(3)
    words = ["12", "north", "Street", "st", "UNIT", "apt", "4b", "floor", "oak", "é", "a_b", "east", "Building", "way"]
    cases = [" ".join(pick.choice(words) for _ in range(pick.randint(1, 8))) + pick.choice(["", ", rest 5", " #7"]) for _ in range(300)]
    once = apply(spark, cases, fn.normalize_address)
    for out in once:
        assert out == out.strip().upper() and "  " not in out and not set(out) & set(",#.-'")
        assert not set(out.split()) & set(ABBREVIATIONS)
    # A second pass can only meet a unit word that the first one left last.
    again = apply(spark, once, fn.normalize_address)
    assert all(a == b for a, b in zip(once, again) if not set(a.split()) & set(UNIT_WORDS))


# Every long word and its short form.
@pytest.mark.parametrize("gap", [" ", "  ", "\t"])
def test_every_abbreviation(spark, gap):
    from platwork.functions.address import ABBREVIATIONS

    longs = [f"9{gap}{word.lower()}" for word in ABBREVIATIONS]
    assert apply(spark, longs, fn.normalize_address) == [f"9 {short}" for short in ABBREVIATIONS.values()]


def test_every_unit_word(spark):
    from platwork.functions.address import UNIT_WORDS

    assert apply(spark, [f"9 elm {word.lower()} 4c" for word in UNIT_WORDS], fn.normalize_address) == ["9 ELM"] * len(UNIT_WORDS)


def test_parse_address(spark):
    got = apply(spark, ["123 MAIN ST", "123 MAIN", "123 N MAIN ST", "MAIN ST", "5 ST", ""], fn.parse_address)
    assert [(r.street_number, r.street_name, r.street_type) for r in got] == [
        ("123", "MAIN", "ST"), ("123", "MAIN", ""), ("123", "N MAIN", "ST"), ("", "", ""), ("5", "ST", ""), ("", "", ""),
    ]
    assert (got[0].city, got[0].state, got[0].zip_code) == ("", "", "")


def test_title_case(spark):
    cases = ["o'neil mc-donald 3rd", " JOHN  SMITH ", "ÉCOLE d'été", "a1b2", None, "", "x_y\tz"]
    expected = [None if c is None else c.strip().title() for c in cases]
    assert apply(spark, cases, fn.title_case) == expected


def test_identifier_text_and_trim(spark):
    assert apply(spark, [" BP#-12. ", "Ñandú-7_x", "", None], fn.clean_identifier) == ["BP-12", "Ñandú-7_x", "", None]
    assert apply(spark, ["  a \t b\n"], fn.clean_text) == ["a b"]
    assert apply(spark, ["\t ab c "], fn.upper_trim) == ["AB C"]
    assert apply(spark, [" 12-34-a "], fn.normalize_parcel_number) == ["1234A"]


def test_money(spark):
    assert apply(spark, ["$1,250.50", "-$500.25", "1.2.3", "", None, "n/a", "1e5"], fn.parse_money) == [1250.5, 500.25, 0, 0, 0, 0, 15]


def test_dates(spark):
    cases = ["01/15/2023", "1/5/2023", "2023-01-20", "2023-01-20 08:30:00", "not a date", None, "13/45/2023"]
    day = datetime(2025, 6, 30)
    expected = [datetime(2023, 1, 15), datetime(2023, 1, 5), datetime(2023, 1, 20), datetime(2023, 1, 20, 8, 30), day, day, day]
    assert apply(spark, cases, lambda c: fn.parse_date(c, AS_OF)) == expected


def test_types(spark):
    cases = ["new sfr", "Addition", "remodel", "alt", "alteration", "repair", "demo", "electrical", "plumb", "mech", "RENEWAL", "sign", None]
    assert apply(spark, cases, fn.standardize_permit_type) == [
        "NEW CONSTRUCTION", "ADDITION", "REMODEL", "ALTERATION", "ALTERATION", "REPAIR", "DEMOLITION", "ELECTRICAL",
        "PLUMBING", "MECHANICAL", "NEW CONSTRUCTION", "SIGN", None,
    ]
    cases = ["com", "COMPUTER", "res", "industrial", "agr", "man", "furniture"]
    assert apply(spark, cases, fn.standardize_property_type) == [
        "COMMERCIAL", "COMMERCIAL", "RESIDENTIAL", "INDUSTRIAL", "AGRICULTURAL", "MANUFACTURING", "FURNITURE",
    ]


def test_improvement_and_parcel_numbers(spark):
    cases = ["New Single Family Home", "Kitchen Remodel", "Commercial Tenant Improvement", "Room addition", "Demolition", "other"]
    assert apply(spark, cases, fn.improvement_type) == [
        "NEW_CONSTRUCTION", "REMODEL", "TENANT_IMPROVEMENT", "ADDITION", "DEMOLITION", "OTHER",
    ]
    cases = [
        "Garage on Parcel #40471122 behind the mill", "see APN: 771-204-355, second floor",
        "fence along the creek (Parcel ID: 55501234)", "no number",
    ]
    assert apply(spark, cases, fn.extract_parcel_number) == ["40471122", "771204355", "55501234", None]


def model_ratio(a, b):
    def key(s):
        plain = re.sub("[^a-z0-9_]+", " ", s.encode("ascii", "ignore").decode().lower())
        return " ".join(sorted(plain.split()))

    a, b = key(a), key(b)
    if not a or not b:
        return 0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return round(200 * row[-1] / (len(a) + len(b)))


def test_token_sort_ratio(spark):
    pick = random.Random(1)

    def text(low, high):
        return "".join(pick.choice("abcd 12é#_") for _ in range(pick.randint(low, high)))

    pairs = [("123 main st", "123 main n st"), ("abcbdab", "bdcaba"), ("", "a"), ("b a", "A, b")]
    pairs += [(text(0, 30), text(0, 30)) for _ in range(200)]
    pairs += [(text(50, 75), text(50, 75)) for _ in range(60)] + [(text(100, 260), text(100, 260)) for _ in range(40)]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", fn.token_sort_ratio("a", "b").alias("s"), fn.token_sort_ratio("b", "a").alias("r")).collect()
    assert [r.s for r in rows] == [model_ratio(r.a, r.b) for r in rows]
    assert all(r.s == r.r for r in rows)
    assert [r.s for r in rows[:4]] == [92, 62, 0, 100]


def test_format_situs_and_json(spark):
    df = spark.createDataFrame([("1", "OAK ST", None, "WA")], "n string, s string, c string, t string")
    row = df.select(fn.format_situs("n", "s", "c", "t").alias("f"), fn.source_json("n", "c").alias("j")).first()
    assert (row.f, row.j) == ("1 OAK ST, , WA", '{"n":"1","c":null}')
