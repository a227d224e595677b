"""Sorted lists read in blocks: the same results as reading all, with less read."""

import random

import pytest
from pyspark.sql import functions as F

from platwork.functions import similarity, token_sort_key
from platwork.operators import blocks, lookup, match
from platwork.plans.queries import Tables

random.seed(2)
PARCEL = "pid string, full_address string, street_number string, street_name string, street_type string, city string, state string, zip_code string"


def street(spark, n, name="MAIN"):
    ends = ["ST", "Street", "ST E", "ST UNIT 3", "Avenue", "ST NORTH"]
    rows = [(f"{i * 7919 % 100003:06d}", f"{1 + i} {name} {ends[i % 6]}", str(1 + i), name, "ST", "X", "Y", "0") for i in range(n)]
    rows += [(None, f"9 {name} ST", "9", name, "ST", "X", "Y", "0"), ("1", f"5 N {name} ST", "5", f"N {name}", "ST", "X", "Y", "0")]
    return spark.createDataFrame(rows, PARCEL)


def asked(spark, *texts):
    return match.distinct_addresses(match.spelled_addresses(spark.createDataFrame([(t,) for t in texts], "address string"), "address"))


def full(addresses, parcels, least, n):
    situs = match.situs_texts(parcels)
    scored = match.score_candidates(match.unnumbered_candidates(match.asked_addresses(addresses), match.distinct_texts(situs)), least)
    return match.rank_matches(match.parcels_of_texts(scored, situs), ["normalized"], n)


def rows(df):
    return sorted(((r.normalized, r.match_rank, r.pid, r.confidence, r.match_method) for r in df.collect()), key=repr)


@pytest.mark.parametrize("least,n,take", [(70, 5, 1), (0, 40, 2)])
def test_unnumbered_addresses_equal_the_full_scoring(spark, monkeypatch, least, n, take):
    monkeypatch.setattr(blocks.first_hits, "__defaults__", (take, 4))
    monkeypatch.setattr(blocks.ordered_blocks, "__defaults__", ((), 7))
    texts = asked(spark, "Main St", "main street east", "N Main St", "Main", "Ave Main", "Elm St", "MAIN ST 12", "St")
    parcels = street(spark, 400).unionByName(street(spark, 50, "MAINLAND"))
    assert rows(match.match_distinct(texts, parcels, least, n)) == rows(full(texts, parcels, least, n))


def test_dense_table(spark, folder):
    t = Tables(spark, folder)
    texts = match.distinct_addresses(match.spelled_addresses(t.view("fx_dense_address"), "address")).filter("normalized NOT RLIKE '^[0-9]'")
    parcels = match.parcel_dimension(t.view("fx_parcel_dense"))
    assert texts.count() and rows(match.match_distinct(texts, parcels)) == rows(full(texts, parcels, 70, 5))


def test_scored_pairs_grow_slower_than_the_street(spark, monkeypatch):
    counts = []
    held = match.stored

    def counting(df, label):
        out = held(df, label)
        if label == "scored-pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(match, "stored", counting)
    seen = {}
    for n in (400, 3200):
        counts.clear()
        assert match.match_distinct(asked(spark, "Main St"), street(spark, n)).count() == 5
        seen[n] = sum(counts)
    assert 0 < seen[3200] < 2 * seen[400] and seen[3200] < 1600


def test_forms_score_as_keys(spark):
    letters = "ab c1_Z é"
    texts = ["".join(random.choice(letters) for _ in range(random.choice([0, 3, 20, 61, 62, 130]))) for _ in range(150)]
    pairs = spark.createDataFrame([(random.choice(texts), random.choice(texts)) for _ in range(400)], "a string, b string")
    keyed = pairs.select(*(token_sort_key(c).alias(c) for c in "ab"))
    formed = keyed.select(*(similarity.key_form(F.col(c)).alias(c) for c in "ab"), *(similarity.kind_counts(F.col(c)).alias("n" + c) for c in "ab"))
    got = formed.select(
        similarity.form_ratio(F.col("a"), F.col("b")).alias("form"), similarity.key_ratio(F.col("a.key"), F.col("b.key")).alias("key"),
        similarity.counts_bound(F.col("na"), F.col("nb")).alias("bound"),
    ).collect()
    assert all(r.form == r.key <= r.bound for r in got) and {r.form for r in got} > {0, 100}


def test_blocks_hold_all_rows_in_order(spark):
    values = [(random.choice("xy"), random.randrange(50), i) for i in range(300)]
    made = blocks.ordered_blocks(spark.createDataFrame(values, "k string, o int, i int"), ["k"], "o", ["i"], 9).collect()
    assert sorted((r.k, e.o, e.i) for r in made for e in r.entries) == sorted(values)
    assert all(len(r.entries) <= 9 and r.first == r.entries[0].o for r in made)
    ordered = sorted(made, key=lambda r: (r.k, r.block))
    assert all(a.entries[-1].o <= b.first for a, b in zip(ordered, ordered[1:]) if a.k == b.k)


def test_lookups_stop_at_the_first_hit_and_share_an_index(spark, monkeypatch):
    monkeypatch.setattr(blocks.first_hits, "__defaults__", (1, 4))
    monkeypatch.setattr(blocks.ordered_blocks, "__defaults__", ((), 5))
    rows = [(f"{i:04d}", f"{i % 50} {random.choice(['OAK', 'ELM HILL', 'MAIN'])} ST") for i in range(600)] + [("0000", None), (None, "7 NOWHERE"), ("0601", "")]
    parcels = spark.createDataFrame(rows, "pid string, situs_address string")
    queries = ["oak st", "M HILL", "49 main", "nowhere", "St", "x", "", "1 ELM HILL ST", " "]
    index = lookup.lookup_index(parcels, F.upper("situs_address"))
    asked = spark.createDataFrame([(q,) for q in queries], "address string")
    for given in (None, index):
        got = lookup.parcel_by_address(asked, parcels, payload=["situs_address"], index=given).collect()
        want = {}
        for q in {q.strip().upper() for q in queries}:
            hits = sorted(((p is not None, p or "") for p, t in rows if t is not None and q in t))
            if hits and hits[0][0]:
                want[q] = hits[0][1]
        assert {r.query: r.pid for r in got if r.pid is not None} == want


def test_search_reads_words(spark, monkeypatch):
    monkeypatch.setattr(blocks.first_hits, "__defaults__", (1, 4))
    monkeypatch.setattr(blocks.ordered_blocks, "__defaults__", ((), 4))
    names = ["OAK TREE", "MAIN", "EAST MAIN", "MAINE 5%", "TREEMAIN"]
    rows = [(f"{i:03d}", str(i % 7) if i % 9 else None, names[i % 5], "TOWN", "US", "1") for i in range(200)]
    parcels = spark.createDataFrame(rows, "pid string, street_number string, street_name string, city string, state string, zip_code string")
    queries = ["main town", "ma in", "tree main", "ain ma", "5% t", "e", "oak  us", "zzz", "main zzz", "e e e"]
    got = lookup.parcel_search(spark.createDataFrame([(q,) for q in queries], "address string"), parcels, limit=6).collect()

    def fits(text, words):
        at = 0
        for w in words:
            if (at := text.find(w, at)) < 0:
                return False
            at += len(w)
        return True

    for q in queries:
        hits = [r for r in rows if fits(f"{r[1] or ''} {r[2]}, {r[3]}, {r[4]}", q.upper().split(" "))]
        want = sorted((r[1] is not None, r[1] or "", r[2], r[0]) for r in hits)[:6]
        assert sorted((r.street_number is not None, r.street_number or "", r.street_name, r.pid) for r in got if r.query == q) == want


def test_short_queries_read_no_lists(spark, monkeypatch):
    taken, held = [], blocks.stored

    def counting(df, label):
        out = held(df, label)
        if label == "taken":
            taken.append(out.count())
        return out

    monkeypatch.setattr(blocks, "stored", counting)
    numbers = [f"{i * 7919 % 3001:08d}" for i in range(400)] + ["0000123456", None]
    parcels = spark.createDataFrame([(n,) for n in numbers], "pid string")
    texts = [n[a:b] for n in numbers[:120] for a, b in ((0, 8), (1, 6), (4, 8), (7, 8))] + ["5-99", "x", "", None, "000012345", "99999999"]
    asked = spark.createDataFrame([(t,) for t in texts], "parcel_number string")
    keys = {t.replace("-", "").strip().upper() for t in texts if t is not None}
    known = [n for n in numbers if n is not None]
    want = sorted((q, min(n for n in known if q in n)) for q in keys if any(q in n for n in known))
    index = lookup.lookup_index(parcels, F.col("pid"))
    for given in (None, index):
        got = lookup.parcel_by_number(asked, parcels, payload=("pid",), index=given).select("query", "pid").collect()
        assert sorted(map(tuple, got)) == want
    # Only the query longer than a gram reads a list.
    assert max(taken) == 1
