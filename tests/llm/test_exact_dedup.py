"""Exact duplicates against plain grouping, with fingerprints of full and of hopeless strength."""

import hashlib
import random
from collections import defaultdict

import pytest

from platwork.llm.exact_dedup import Hashing, combine, differing, exact_duplicates, part_hash

BLANKS = str.maketrans("", "", " \t\n\x0b\x0c\r")
WEAK = Hashing(primes=(3, 2), radixes=(1, 1), chunk=8)
SHORT = Hashing(chunk=8)
random.seed(3)
ROWS = [
    (5, "a b c"), (1, "abc"), (2, "ab  c "), (9, "ab\tc\n "), (3, None), (4, ""), (8, " \r\n"), (6, "äöü 😀"), (7, "äöü😀"), (10, "acb"), (11, "bca"), (12, "cab"),
    (13, "x" * 5000), (14, "x" * 4999 + "y"), (15, "x" * 2500 + " " + "x" * 2500), (16, "abc\xa0"), (17, "dup"), (17, "dup"), (None, "null id"), (None, "null  id"), (20, "nullid"),
    *[(100 + i, "".join(random.choice("ab ") for _ in range(6))) for i in range(40)],
]


def plain(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(BLANKS)].append((i, text or ""))
    out = []
    for text, own in groups.items():
        best = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        kept = False
        for r in own:
            first = r == best and not kept
            kept = kept or first
            out.append((r[0], best[0], len(own), first, hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hashing", [Hashing(), SHORT, WEAK])
@pytest.mark.parametrize("huge", [4 << 20, 40])
def test_equals_plain_grouping(spark, hashing, huge):
    """``huge`` 40 cuts the long texts into rows; with WEAK most texts collide."""
    docs = spark.createDataFrame([(i, t, "clash") for i, t in ROWS], "doc_id long, text string, n_chars string").repartition(3)
    got = exact_duplicates(docs, hashing, huge, bits=1 << 16)
    found = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(plain(ROWS), key=repr)


def test_hash_of_a_text_follows_from_its_parts():
    for hashing in (Hashing(), SHORT):
        powers = hashing.powers()
        data = random.randbytes(100)
        n, whole = len(data), part_hash(data, hashing, powers)
        by_hand = tuple(sum(b * pow(r, n - 1 - i, p) for i, b in enumerate(data)) % p for p, r in zip(hashing.primes, hashing.radixes))
        assert whole == (n, *by_hand)
        for cut in (0, 1, 50, 100):
            assert combine(part_hash(data[:cut], hashing, powers), part_hash(data[cut:], hashing, powers), hashing) == whole


def test_empty_table(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("hashing", [Hashing(), SHORT, WEAK])
@pytest.mark.parametrize("bits", [8, 1 << 16])
def test_filter_of_any_size(spark, hashing, bits):
    """With 8 bits most texts pass without a partner."""
    made = exact_duplicates(spark.createDataFrame(ROWS, "doc_id long, text string"), hashing, bits=bits)
    rows = [tuple(r) for r in made.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(rows, key=repr) == sorted(plain(ROWS), key=repr)


def test_differing_is_one_python_pass(spark, capsys):
    """Two passes in one task are two workers for every core, for the rest of the session."""
    docs = spark.createDataFrame([(1, "ab"), (2, "ba"), (3, "c")], "doc_id long, text string")
    weak = Hashing(primes=(3, 2), radixes=(1, 1), chunk=8)
    shared = spark.createDataFrame([(2, *part_hash(b"ab", weak, weak.powers())[1:])], "n_bytes long, h1 long, h2 long")
    found = differing(docs, shared, weak)
    found.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    assert found.collect() == shared.collect()
