"""Operators on small tables, against expectations and brute force."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from platwork.operators import clean, duplicates, jobs, keyed, lookup, match, paging, profile, rules, shape, validate
from platwork.operators.grams import gram_join, rare_gram_join
from platwork.operators.skew import hot_keys, salted_join

AS_OF = "2025-06-30 12:00:00"
PARCEL = "pid string, full_address string, street_number string, street_name string, street_type string, city string, state string, zip_code string"


def parcels_of(spark, rows):
    return spark.createDataFrame([(*r, "ANYTOWN", "US", "12345") for r in rows], PARCEL)


@pytest.fixture(scope="module")
def three(spark):
    return parcels_of(
        spark,
        [
            ("123456", "123 MAIN ST", "123", "MAIN", "ST"),
            ("789012", "123 MAIN STREET", "123", "MAIN", "STREET"),
            ("345678", "123 N MAIN ST", "123", "N MAIN", "ST"),
        ],
    )


def addresses(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "address string")


def test_match_addresses(spark, three):
    rows = match.match_addresses(addresses(spark, "123 Main St", " 123  main street ", "999 Nonexistent Rd", " ", None), three).collect()
    assert [(r.normalized, r.pid, r.confidence, r.match_method, r.match_rank) for r in sorted(rows, key=lambda r: r.match_rank)] == [
        ("123 MAIN ST", "123456", 100, "Exact", 1), ("123 MAIN ST", "789012", 100, "Exact", 2), ("123 MAIN ST", "345678", 92, "Fuzzy", 3),
    ]
    north = match.match_addresses(addresses(spark, "123 North Main St"), three).collect()
    assert [(r.pid, r.confidence) for r in north] == [("345678", 100)]
    strict = match.match_addresses(addresses(spark, "123 Main St"), three, min_confidence=95).collect()
    assert sorted(r.pid for r in strict) == ["123456", "789012"]
    assert match.match_addresses(addresses(spark, "123 Main St"), three, max_results=1).count() == 1


def test_exact_parcel_is_found_behind_many_others(spark):
    # 130 parcels of lower ids on streets that contain the name, and 130 of the same text as the hit.
    rows = [(f"{i:05d}", f"7 ELM GROVE {i} ST", "7", f"ELM GROVE {i}", "ST") for i in range(130)]
    rows += [(f"9{i:04d}", "7 Elm Grove Street", "7", "ELM GROVE", "ST") for i in range(130)]
    table = parcels_of(spark, rows)
    got = match.match_addresses(addresses(spark, "7 Elm Grove St"), table).collect()
    assert [(r.pid, r.confidence, r.match_method) for r in sorted(got, key=lambda r: r.match_rank)] == [(f"9{i:04d}", 100, "Exact") for i in range(5)]
    assert match.match_addresses(addresses(spark, "7 Elm Grove St"), table, max_results=500).count() == 260


def test_address_without_a_number_is_looked_up_by_its_words(spark, three):
    got = match.match_addresses(addresses(spark, "N Main St", "Elm St", "St"), three, min_confidence=1).collect()
    assert [(r.normalized, r.pid) for r in got] == [("N MAIN ST", "345678")]


def test_attach_twice_changes_nothing_and_keeps_manual_matches(spark, three):
    df = spark.createDataFrame(
        [(1, "123 MAIN ST", None, None, None), (2, "9 NOWHERE RD", "77", 55.0, "Manual"), (3, "9 NOWHERE RD", None, None, None), (4, "123 MAIN ST", "5", None, None)],
        "id int, address string, parcel_id string, match_confidence double, match_method string",
    )
    once = match.attach_best_parcel(df, three)
    again = match.attach_best_parcel(once, three)
    rows = sorted((r.id, r.parcel_id, r.match_confidence, r.match_method, r.match_attempted) for r in once.collect())
    assert rows == [(1, "123456", 100.0, "Exact", True), (2, "77", 55.0, "Manual", False), (3, "", 0.0, None, True), (4, "5", 0.0, None, False)]
    assert sorted((r.id, r.parcel_id, r.match_confidence, r.match_method, r.match_attempted) for r in again.collect()) == rows
    log = match.address_match_rows(again, matched_at="2025-06-30 12:00:00", job_id=9, record_type="Permit", record_id="id")
    assert sorted((r.RecordID, r.MatchMethod, r.ParcelNumber, r.ImportJobID, r.RecordType, str(r.MatchDate)) for r in log.collect()) == [
        (1, "Exact", "123456", 9, "Permit", "2025-06-30 12:00:00"), (2, "Manual", "77", 9, "Permit", "2025-06-30 12:00:00"),
        (3, "Fuzzy", None, 9, "Permit", "2025-06-30 12:00:00"),
    ]


def test_attach_best_parcel(spark, three):
    df = spark.createDataFrame(
        [
            (1, "123 MAIN ST", None, "Old; "), (2, "123 MAIN ST", "KEEP", ""), (3, None, None, ""),
            (4, "9 NOWHERE RD", "", ""), (5, "123 N MAIN ST", "", ""), (6, "", None, None),
        ],
        "id int, address string, parcel_id string, validation_errors string",
    )
    rows = {r.id: r for r in match.attach_best_parcel(df, three).collect()}
    assert [(i, rows[i].parcel_id, rows[i].match_confidence) for i in sorted(rows)] == [
        (1, "123456", 100.0), (2, "KEEP", 0.0), (3, "", 0.0), (4, "", 0.0), (5, "345678", 100.0), (6, "", 0.0),
    ]
    assert rows[1].validation_errors == "Old; " and rows[6].validation_errors == ""
    low = parcels_of(spark, [("1", "55 LAKE VIEW HGTS PL", "55", "LAKE VIEW HGTS", "PL")])
    one = match.attach_best_parcel(addresses(spark, "55 Lake View Rd"), low).first()
    assert one.match_confidence < 80 and one.validation_errors == "Low confidence address match; "
    place = spark.createDataFrame([("55 Lake View Rd",)], "property_location string")
    assert match.attach_best_parcel_property(place, low).first().validation_errors == "Low confidence location match; "


def test_attach_is_the_same_when_hot_keys_are_split(spark, three):
    rows = [(i, "123 MAIN ST" if i % 3 else f"{i} X ST", "P" if i % 7 == 0 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, address string, parcel_id string").repartition(6)
    plain = match.attach_best_parcel(df, three)
    split = match.attach_best_parcel(df, three, share=50, floor=1)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, split.collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_join(spark, how):
    pick = random.Random(5)
    fact = spark.createDataFrame([(i, pick.choice([1, 1, 1, 2, 3, None, 9])) for i in range(500)], "i int, k int").repartition(7)
    dim = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, None)], "k int, v string")
    counts = fact.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    hot = {r.k: r._fan for r in hot_keys(counts, ["k"], "n", share=10, floor=5).collect()}
    assert hot[1] > 1
    got = salted_join(fact, dim, ["k"], counts, "n", how, share=10, floor=5)
    want = fact.join(dim, "k", how).select("i", "k", "v")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_gram_join_against_brute_force(spark):
    pick = random.Random(2)
    texts = ["".join(pick.choice("ab c") for _ in range(pick.randint(0, 45))) for _ in range(150)]
    asked = {"".join(pick.choice("ab c") for _ in range(pick.randint(1, 12))) for _ in range(60)} | {t[2:37] for t in texts if len(t) > 36}
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, body string")
    q = spark.createDataFrame([(x,) for x in asked], "q string")
    got = gram_join(q, t, F.col("q"), "body", lambda c: F.contains(c, F.col("q"))).select("q", "i").collect()
    assert sorted((r.q, r.i) for r in got) == sorted((x, i) for x in asked for i, body in enumerate(texts) if x in body)


    rare = rare_gram_join(q, t, F.array("q"), "body", lambda c: F.contains(c, F.col("q"))).select("q", "i").collect()
    assert sorted((r.q, r.i) for r in rare) == sorted((x, i) for x in asked for i, body in enumerate(texts) if x in body)


@pytest.fixture(scope="module")
def county(spark):
    rows = [
        ("0001", "0-001-22", "123 MAIN ST", "ANYTOWN"), ("0002", "000122", "123 MAIN ST UNIT 2", "ANYTOWN"),
        ("0003", "777", "9 50% OFF LN", "OTHER"), ("0004", "778", None, "OTHER"),
    ]
    parcels = spark.createDataFrame(rows, "pid string, parcel_number string, situs_address string, city string")
    owners = spark.createDataFrame([("0001", "Ann", 1), ("0001", "Bob", 0), ("0002", "Cy", 0)], "pid string, OwnerName string, IsPrimary int")
    return parcels, owners


def test_parcel_lookups(spark, county):
    parcels, owners = county
    common = {"number": "parcel_number", "payload": ["situs_address", "city"]}
    got = lookup.parcel_by_address(addresses(spark, " 123 main st ", "%", "50% off", "nothing", ""), parcels, owners, **common)
    rows = {r.query: (r.pid, r.parcel_number, r.owner_name) for r in got.collect()}
    assert rows == {
        "123 MAIN ST": ("0001", "0-001-22", "Ann"), "%": ("0003", "777", None), "50% OFF": ("0003", "777", None), "": ("0001", "0-001-22", "Ann"),
    }
    asked = spark.createDataFrame([("0-001-22",), ("77",)], "parcel_number string")
    literal = {r.query: r.pid for r in lookup.parcel_by_number(asked, parcels, owners, **common).collect()}
    assert literal == {"000122": "0002", "77": "0003"}
    stored = {r.query: r.pid for r in lookup.parcel_by_number(asked, parcels, owners, normalize_stored=True, **common).collect()}
    assert stored == {"000122": "0001", "77": "0003"}
    owned = {r.pid: r.owner_name for r in lookup.primary_owner(parcels, owners).collect()}
    assert owned == {"0001": "Ann", "0002": None, "0003": None, "0004": None}


def test_parcel_search_and_exact(spark):
    rows = [(f"{i:03d}", str(i % 5), f"STREET {i}", "TOWN_A" if i % 2 else "TOWNSHIP", "US", "1") for i in range(40)]
    parcels = spark.createDataFrame(rows, "pid string, street_number string, street_name string, city string, state string, zip_code string")
    full = {r[0]: f"{r[1]} {r[2]}, {r[3]}, {r[4]}" for r in rows}
    queries = ["street town", "3 street", "", "town_a", "a street"]
    got = lookup.parcel_search(addresses(spark, *queries), parcels).collect()
    import re

    for q in queries:
        pattern = ".*".join(re.escape(p) for p in q.upper().split(" "))
        hits = sorted((r[1], r[2], r[0]) for r in rows if re.search(pattern, full[r[0]].upper()))[:10]
        assert sorted((r.street_number, r.street_name, r.pid) for r in got if r.query == q) == hits
    exact = lookup.parcel_exact(spark.createDataFrame([("007",), ("007",), ("x",)], "pid string"), parcels).collect()
    assert [(r.pid, r.full_address) for r in exact] == [("007", full["007"])]


def test_latest_assessment_is_global(spark):
    accounts = spark.createDataFrame([(1,), (2,)], "PersonalPropertyID int")
    table = spark.createDataFrame([(1, 2022, 5.0), (1, 2023, 6.0), (2, 2022, 7.0)], "PersonalPropertyID int, AssessmentYear int, AssessedValue double")
    rows = {r.PersonalPropertyID: r.AssessedValue for r in lookup.latest_assessment(accounts, table).collect()}
    assert rows == {1: 6.0, 2: None}


def test_shape(spark):
    df = spark.createDataFrame([("1", "x", "y")], ["Permit Number", "Odd.Name", "C"])
    assert shape.clean_column_names(df).columns == ["permit_number", "odd.name", "c"]
    mapped = shape.map_columns(df, {"a": "Odd.Name", "b": "missing"})
    assert mapped.columns == ["a", "validation_errors"] and mapped.first().a == "x"
    with pytest.raises(ValueError):
        shape.clean_column_names(df.toDF("a b", "A_B", "c"))
    empty = spark.createDataFrame([], "FieldMappingID int, MappingName string, ImportType string, IsDefault boolean, MappingConfig string")
    assert shape.stored_mapping(empty, "Permit") == {}


def test_clean_and_validate(spark):
    df = spark.createDataFrame(
        [(" bp#1 ", "abc", "01/01/2030", -5.0), (None, None, "01/01/1950", 1.0), ("x", "12345", "01/01/2020", None)],
        "`Permit Number` string, Address string, `Issue Date` string, amount double",
    )
    done = validate.validate_permits(clean.clean_permits(df, AS_OF), AS_OF)
    assert [r.validation_errors for r in done.orderBy(F.col("permit_number").asc_nulls_last()).collect()] == [
        "Address too short; Future issue date; ", "", "Missing permit number; Missing address; Very old issue date; ",
    ]
    loaded = spark.createDataFrame([(-1.0,)], "valuation double")
    assert validate.validate_permits(loaded, AS_OF).first().validation_errors == "Negative valuation; "
    prop = spark.createDataFrame([("A", "", "1 X", 2e7)], "account_number string, owner_name string, property_location string, value double")
    checked = validate.validate_property(prop)
    assert checked.first().validation_errors == "Missing owner name; Property location too short; Unusually high property value; "
    good, bad = validate.split_valid_invalid(done)
    summary = jobs.import_summary(done).first()
    assert (good.count(), bad.count()) == (summary.valid_count, summary.error_count) == (1, 2)
    assert summary.message == "Successfully imported 3 permit records"
    status = [r[0] for r in done.orderBy(F.col("permit_number").asc_nulls_last()).select(validate.staging_status()).collect()]
    assert status == ["Warning", "Valid", "Invalid"]


def staging(spark, rows):
    return spark.createDataFrame(rows, "StagingID int, ImportJobID int, PermitNumber string, ProcessingStatus string, ValidationMessage string")


@pytest.mark.parametrize("floor", [0, 10_000])
def test_duplicates_against_brute_force(spark, floor):
    pick = random.Random(9)
    rows = [
        (i, i % 3, pick.choice(["A", "A", "A", "B", "C", f"U{i}", None]), pick.choice(["Failed", "Processed", "Pending", None]), pick.choice([None, "Old; "]))
        for i in range(120)
    ]
    table = staging(spark, rows).repartition(5)

    def partners(r):
        return sum(1 for s in rows if r[2] is not None and s[2] == r[2] and s[0] != r[0] and s[3] not in ("Failed", None))

    for job in (None, 1):
        got = {r.StagingID: r.pair_count for r in duplicates.duplicate_permit_pairs(table, job, share=20, floor=floor).collect()}
        assert got == {r[0]: partners(r) for r in rows if partners(r) and (job is None or r[1] == job)}
        flagged = {r.StagingID: r for r in duplicates.flag_duplicate_permits(table, job, share=20, floor=floor).collect()}
        assert len(flagged) == len(rows)
        for r in rows:
            hit = partners(r) > 0 and (job is None or r[1] == job)
            assert flagged[r[0]].ValidationStatus == ("Warning" if hit else "Pending")
            assert flagged[r[0]].ValidationMessage == ((r[4] or "") + "Duplicate permit number found in system; " if hit else r[4])


def test_jobs(spark):
    start = datetime(2025, 1, 1, 10, 0, 0, 900000)
    table = spark.createDataFrame(
        [(1, "Permit", start, datetime(2025, 1, 1, 10, 0, 1, 100000), 3, 2, 1), (2, "Permit", start, None, 9, 9, 0),
         (3, "Permit", start, datetime(2025, 1, 1, 10, 0, 3), 0, 0, 0), (4, "Other", start, start, 1, 1, 0)],
        "ImportJobID int, ImportType string, ImportDate timestamp, CompletedDate timestamp, RecordsTotal bigint, RecordsSuccessful bigint, RecordsFailed bigint",
    )
    stats = jobs.permit_import_stats(table).first()
    assert (stats.TotalJobs, stats.TotalRecords, float(stats.SuccessRate), stats.AvgProcessingTimeSeconds) == (2, 3, 66.67, 2)
    empty = jobs.permit_import_stats(table.filter("ImportJobID = 3")).first()
    assert empty.SuccessRate is None
    st = spark.createDataFrame([(1, "Processed"), (1, "Failed"), (1, "Skipped"), (1, "Pending")], "ImportJobID int, ProcessingStatus string")
    done = {r.ImportJobID: r for r in jobs.complete_import_job(table, st, st, AS_OF, job_id=1).collect()}
    one = done[1]
    assert (one.Status, one.RecordsTotal, one.RecordsProcessed, one.RecordsSuccessful, one.RecordsFailed) == ("Completed", 4, 3, 1, 2)
    assert done[2].CompletedDate is None and done[2].RecordsTotal == 9
    everything = {r.ImportJobID: r for r in jobs.complete_import_job(table, st, st, AS_OF).collect()}
    assert everything[2].RecordsTotal == 0 and everything[4].RecordsTotal is None and everything[4].Status == "Completed"


def test_logs(spark):
    df = spark.createDataFrame([(1, "a", "X; Y; "), (2, "b", ""), (3, "c", None), (4, None, "Z; ")], "src_row int, name string, validation_errors string")
    log = jobs.log_import(df, "PERMIT", "f.csv", 5, AS_OF).first()
    assert (log.RecordsTotal, log.RecordsSuccessful, log.RecordsFailed) == (4, 2, 2)
    rows = jobs.log_import_errors(df, 5, AS_OF).orderBy("RecordIndex").collect()
    assert [(r.RecordIndex, r.ErrorMessage, r.RecordData) for r in rows] == [(1, "X; Y", '{"name":"a"}'), (4, "Z", '{"name":null}')]
    single = jobs.log_import_errors(df, 5, AS_OF, per_message=True)
    assert sorted((r.RecordIndex, r.ErrorMessage) for r in single.collect()) == [(1, "X"), (1, "Y"), (4, "Z")]


def test_profile_and_sample(spark):
    df = spark.createDataFrame([(1, "a", ""), (2, None, "x"), (3, None, "y")], "id int, v string, validation_errors string")
    assert [(r.column_name, r.non_null, r.pct_populated) for r in profile.column_profile(df).orderBy("ordinal").collect()] == [
        ("id", 3, 100.0), ("v", 1, 33.3), ("validation_errors", 3, 100.0),
    ]
    assert profile.column_profile(df.limit(0)).first().pct_populated is None
    assert {r.field: r.value for r in profile.sample_record(df, [F.col("id").desc()]).collect()} == {"id": "3"}


def test_settings(spark):
    schema = "category string, name string, value string, description string, seq int"
    table = spark.createDataFrame([("Db", "Server", "a", "d1", 1), ("Db", "Port", "1", None, 2), ("Ui", "Theme", "light", "", 3)], schema)
    maps = {r.category: r for r in keyed.settings_map(table, "seq", table).select("*", F.map_keys("settings").alias("names")).collect()}
    assert maps["Db"].names == ["Port", "Server"] and maps["Db"].settings["Server"].value == "a"
    assert [r.category for r in keyed.settings_map(table, "seq", table.filter("category = 'Ui'")).collect()] == ["Ui"]
    updates = spark.createDataFrame(
        [("Db", "Server", "b", "", 1), ("Db", "Server", "c", None, 2), ("Db", "Port", "2", "the port", 3), ("New", "K", "v", None, 4), ("New", "K", "w", "late", 5), ("New", "L", "v", "", 6)],
        schema,
    )
    base = table.drop("seq")
    merged = {(r.category, r.name): (r.value, r.description) for r in keyed.upsert_keyed(base, updates, "seq").collect()}
    assert merged == {
        ("Db", "Server"): ("c", "d1"), ("Db", "Port"): ("2", "the port"), ("Ui", "Theme"): ("light", ""),
        ("New", "K"): ("w", "late"), ("New", "L"): ("v", "New - L"),
    }
    added = keyed.insert_if_absent(base, updates.filter("name in ('L', 'Port')"), "seq")
    assert {(r.category, r.name): (r.value, r.description) for r in added.collect()}[("New", "L")] == ("v", "New - L setting")
    assert added.count() == 4 and keyed.insert_if_absent(added, added, "value").count() == 4
    twice = keyed.insert_if_absent(base, updates.filter("name = 'K'"), "seq")
    assert [(r.name, r.value) for r in twice.filter("category = 'New'").collect()] == [("K", "v")]
    counts = {(r.category, r.name): r.n for r in keyed.existing_key_count(base, updates).collect()}
    assert counts[("Db", "Port")] == 1 and counts[("New", "L")] == 0


def test_rules(spark):
    df = spark.createDataFrame([("BP-1", 5.0), ("x", 500.0), (None, None)], "number string, worth double")

    def rule(i, field, kind, config, message, active=True):
        return {"ValidationRuleID": i, "ImportType": "Permit", "FieldName": field, "RuleType": kind, "RuleConfig": config, "ErrorMessage": message, "IsActive": active}

    checks = [
        rule(2, "number", "Format", '{"pattern": "^BP-"}', "format"), rule(1, "number", "Required", "{}", "required"),
        rule(3, "worth", "Range", '{"max": 100}', "range"), rule(4, "worth", "Custom", '{"expression": "worth is not null"}', "custom"),
        rule(5, "number", "Required", "{}", "off", False), rule(6, "absent", "Required", "{}", "absent"),
    ]
    got = [r.validation_errors for r in rules.apply_validation_rules(df, checks, "Permit").collect()]
    assert got == ["", "format; range; ", "required; custom; "]
    with pytest.raises(ValueError):
        rules.apply_validation_rules(df, [rule(1, "number", "Code", "{}", "m")], "Permit")


def test_pages(spark):
    rows = [(i, datetime(2025, 1, 1 + i % 5) if i % 6 else None) for i in range(30)]
    df = spark.createDataFrame(rows, "PermitID int, IssuedDate timestamp")
    whole = [r.PermitID for r in paging.read_permits_page(df, 100).collect()]
    assert whole == [i for i, d in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or datetime(1970, 1, 2)).timestamp(), r[0]))]
    seen, after = [], None
    while True:
        part = paging.read_permits_page(df, 7, after=after).collect()
        if not part:
            break
        seen += [r.PermitID for r in part]
        after = (part[-1].IssuedDate, part[-1].PermitID)
    assert seen == whole
    assert [r.PermitID for r in paging.read_permits_page(df, 5, 10).collect()] == whole[10:15]


def test_pages_of_accounts_continue_behind_nulls(spark):
    rows = [(i, None if i % 4 == 0 else f"A{i % 5}") for i in range(40)]
    accounts = spark.createDataFrame(rows, "PersonalPropertyID int, AccountNumber string")
    table = spark.createDataFrame([(1, 2023, 6.0)], "PersonalPropertyID int, AssessmentYear int, AssessedValue double")
    whole = [i for i, n in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))]
    seen, after = [], None
    while part := paging.read_property_page(accounts, table, 9, after=after).collect():
        seen += [r.PersonalPropertyID for r in part]
        after = (part[-1].AccountNumber, part[-1].PersonalPropertyID)
    assert seen == whole
    index = paging.page_index(accounts.repartition(3), paging.PROPERTY_ORDER)
    for offset in (0, 13, 36, 40, 99):
        assert [r.PersonalPropertyID for r in paging.read_property_page(accounts, table, 9, offset, index=index).collect()] == whole[offset : offset + 9]
    assert paging.read_property_page(accounts, table, 9, index=paging.page_index(accounts.limit(0), paging.PROPERTY_ORDER)).collect() == []


def test_kept_number_counts(spark):
    rows = [(i, i % 3, f"P{i % 4}" if i % 5 else None, "Failed" if i % 7 == 0 else "Processed") for i in range(60)]
    staging = spark.createDataFrame(rows, "StagingID int, ImportJobID int, PermitNumber string, ProcessingStatus string")
    counts = duplicates.permit_number_counts(staging)
    for job in (None, 1, 9):
        plain = sorted(duplicates.duplicate_permit_pairs(staging, job).collect())
        assert plain == sorted(duplicates.duplicate_permit_pairs(staging, job, counts=counts).collect())
        alive = [r for r in rows if r[3] != "Failed"]
        want = {r[0]: sum(o[2] == r[2] and o[0] != r[0] for o in alive) for r in rows if r[2] and job in (None, r[1])}
        assert {r.StagingID: r.pair_count for r in plain} == {i: n for i, n in want.items() if n}


def test_match_stats_keep_manual_matches(spark):
    rows = spark.createDataFrame([("Fuzzy", "1", 90), ("Fuzzy", None, 0), ("Manual", "2", 100)], "MatchMethod string, ParcelNumber string, c int")
    rows = rows.withColumn("ConfidenceScore", F.col("c").cast("decimal(5,2)"))
    got = {r.MatchMethod: (r.TotalMatches, r.AvgConfidence, r.SuccessfulMatches, r.FailedMatches, float(r.SuccessRate)) for r in match.address_match_stats(rows).collect()}
    assert got == {"Fuzzy": (2, 45.0, 1, 1, 50.0), "Manual": (1, 100.0, 1, 0, 100.0)}
    partials = match.match_stat_partials(rows.withColumn("ImportJobID", F.col("c") % 3))
    merged = {r.MatchMethod: (r.TotalMatches, r.AvgConfidence, r.SuccessfulMatches, r.FailedMatches, float(r.SuccessRate)) for r in match.merged_match_stats(partials).collect()}
    assert merged == got
