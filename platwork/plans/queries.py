"""One query per operator over the benchmark tables, by name."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platwork import functions as fn
from platwork.operators import (
    clean,
    duplicates,
    jobs,
    keyed,
    lookup,
    match,
    paging,
    profile,
    rules,
    shape,
    validate,
)
from platwork.plans import imports
from platwork.plans.standins import Tables
from platwork.session import shared_dir, stored
from platwork.sources import feeds, jdbc, sinks
from platwork.streaming import watch

AS_OF = "2025-06-30 12:00:00"
JOB = 77
# A job of the import tables.
ONE_JOB = 4

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Rules as an administrator would store them; the records they run on are the whole feed.
VALIDATION_RULES = [
    (1, "number", "Permit", "permit_number", "Required", "{}", "Number needed", True),
    (2, "format", "Permit", "permit_number", "Format", '{"pattern": "^BP-[0-9]+$"}', "Number format", True),
    (3, "range", "Permit", "valuation", "Range", '{"min": 1000, "max": 300000}', "Valuation range", True),
    (4, "custom", "Permit", "status", "Custom", '{"expression": "status <> \'P\' or valuation > 0"}', "Pending without value", True),
    (5, "off", "Permit", "status", "Required", "{}", "Never shown", False),
]
RULE_COLUMNS = (
    "ValidationRuleID int, RuleName string, ImportType string, FieldName string, RuleType string, "
    "RuleConfig string, ErrorMessage string, IsActive boolean"
)
TRANSFORMATION_RULES = [
    (1, "calc", "Permit", "fee", "Calculate", "floor(valuation / 100)", 30, True),
    (2, "status", "Permit", "status", "Mapping", '{"O": "OPEN", "F": "FINAL", "P": "PENDING"}', 10, True),
    (3, "number", "Permit", "permit_number", "Format", '{"pattern": "^BP-", "replacement": "B"}', 20, True),
    (4, "custom", "Permit", "status", "Custom", "concat(status, ':', permit_type)", 20, True),
    (5, "off", "Permit", "status", "Mapping", '{"OPEN": "X"}', 15, False),
]
TRANSFORMATION_COLUMNS = (
    "TransformationRuleID int, RuleName string, ImportType string, FieldName string, RuleType string, "
    "TransformationLogic string, ExecutionOrder int, IsActive boolean"
)
FIELD_MAPPINGS = [
    (1, "old", "Permit", False, '{"permit_number": "Status"}'),
    (2, "standard", "Permit", True, '{"permit_number": "Permit Number", "worth": "Valuation", "gone": "No Such", "src_row": "src_row"}'),
    (3, "accounts", "PersonalProperty", True, '{"account_number": "Account Number"}'),
]
FIELD_MAPPING_COLUMNS = "FieldMappingID int, MappingName string, ImportType string, IsDefault boolean, MappingConfig string"

PERMIT_MAP = {
    "permit_number": "Permit Number", "permit_type": "Permit Type", "issue_date": "Issue Date", "address": "Address",
    "owner_name": "Owner Name", "valuation": "Valuation", "description": "Description", "parcel_id": "Parcel ID",
    "status": "Status", "src_row": "src_row",
}


def register(name: str):
    def wrap(body: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: body(Tables(spark, folder))
        return body

    return wrap


def _day(df: DataFrame, *names: str) -> DataFrame:
    """Dates and times as ISO text, so that both engines show them alike."""
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


def _parcels(t: Tables) -> DataFrame:
    return match.parcel_dimension(t.view("fx_parcel"))


def _permits(t: Tables) -> DataFrame:
    return clean.clean_permits(t.view("fx_permit_raw"), AS_OF)


def _valid_permits(t: Tables) -> DataFrame:
    return validate.validate_permits(clean.clean_permits(t.view("fx_permit_raw"), AS_OF, report=True), AS_OF)


def _property(t: Tables) -> DataFrame:
    return clean.clean_property(t.view("fx_property_raw"))


def _matched(t: Tables) -> DataFrame:
    return match.attach_best_parcel(_valid_permits(t), _parcels(t))


# Scalar functions, each over the whole raw feed.

def _scalar(name: str, view: str, build: Callable[[], F.Column], key: str = "src_row") -> None:
    @register(name)
    def run(t: Tables) -> DataFrame:
        return t.view(view).select(key, build().alias("result"))


_scalar("clean_identifier", "fx_permit_raw", lambda: fn.clean_identifier(fn.strip("Permit Number")))
_scalar("clean_text", "fx_permit_raw", lambda: fn.clean_text("Description"))
_scalar("clean_address", "fx_permit_raw", lambda: fn.clean_address("Address"))
_scalar("title_case", "fx_permit_raw", lambda: fn.title_case("Owner Name"))
_scalar("upper_trim", "fx_permit_raw", lambda: fn.upper_trim("Permit Type"))
_scalar("parse_money", "fx_permit_raw", lambda: fn.parse_money("Valuation"))
_scalar("parse_date", "fx_permit_raw", lambda: F.date_format(fn.parse_date("Issue Date", AS_OF), "yyyy-MM-dd HH:mm:ss"))
_scalar("standardize_permit_type", "fx_permit_raw", lambda: fn.standardize_permit_type("Permit Type"))
_scalar("standardize_property_type", "fx_property_raw", lambda: fn.standardize_property_type("Property Type"))
_scalar("normalize_address", "fx_permit_raw", lambda: fn.normalize_address("Address"))
_scalar("normalize_parcel_number", "fx_permit_raw", lambda: fn.normalize_parcel_number(F.concat(F.lit(" x-"), F.col("Parcel ID"), F.lit("-9 "))))
_scalar("extract_parcel_number", "fx_permit_raw", lambda: fn.extract_parcel_number("Description"))
_scalar("improvement_type", "fx_permit_raw", lambda: fn.improvement_type("Description"))
_scalar("source_json", "fx_permit_raw", lambda: fn.source_json("src_row", F.col("Permit Number").alias("number"), F.col("Status").alias("status")))
_scalar("format_situs", "fx_parcel", lambda: fn.format_situs("street_number", "street_name", "city", "state"), key="pid")


@register("parse_address")
def _parse_address(t: Tables) -> DataFrame:
    parsed = t.view("fx_permit_raw").select("src_row", fn.parse_address(fn.normalize_address("Address")).alias("p"))
    return parsed.select("src_row", "p.street_number", "p.street_name", "p.street_type")


@register("token_sort_ratio")
def _token_sort_ratio(t: Tables) -> DataFrame:
    asked = t.view("fx_permit_raw").select("src_row", "Address")
    owner = t.base("orders").select(F.col("o_orderkey").alias("src_row"), F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("pid"))
    pairs = asked.join(owner, "src_row").join(t.view("fx_parcel").select("pid", "situs_address"), "pid")
    return pairs.select("src_row", fn.token_sort_ratio("Address", "situs_address").alias("score"))


# Column shaping, cleaning, validation.

@register("map_columns")
def _map_columns(t: Tables) -> DataFrame:
    mapping = {"permit_number": "Permit Number", "amount": "Valuation", "gone": "No Such", "src_row": "src_row"}
    return shape.map_columns(t.view("fx_permit_raw"), mapping)


@register("clean_column_names")
def _clean_column_names(t: Tables) -> DataFrame:
    return shape.clean_column_names(t.view("fx_permit_raw"))


@register("stored_mapping")
def _stored_mapping(t: Tables) -> DataFrame:
    table = t.spark.createDataFrame(FIELD_MAPPINGS, FIELD_MAPPING_COLUMNS)
    return shape.map_columns(t.view("fx_permit_raw"), shape.stored_mapping(table, "Permit"))


@register("clean_permits")
def _clean_permits(t: Tables) -> DataFrame:
    return _day(_permits(t), "issue_date")


@register("clean_permits_typed")
def _clean_permits_typed(t: Tables) -> DataFrame:
    return _day(clean.clean_permits(t.view("fx_permit_typed"), AS_OF), "issue_date")


@register("clean_property_typed")
def _clean_property_typed(t: Tables) -> DataFrame:
    return clean.clean_property(t.view("fx_property_typed"))


@register("parse_date_layouts")
def _parse_date_layouts(t: Tables) -> DataFrame:
    parsed = F.date_format(fn.parse_date("text", AS_OF), "yyyy-MM-dd HH:mm:ss")
    return t.view("fx_date_text").select("src_row", parsed.alias("result"))


@register("clean_property")
def _clean_property(t: Tables) -> DataFrame:
    return _property(t)


@register("validate_permits")
def _validate_permits(t: Tables) -> DataFrame:
    return _valid_permits(t).select("src_row", "validation_errors")


@register("validate_property")
def _validate_property(t: Tables) -> DataFrame:
    return validate.validate_property(_property(t)).select("src_row", "validation_errors")


@register("split_valid_invalid")
def _split(t: Tables) -> DataFrame:
    good, bad = validate.split_valid_invalid(_valid_permits(t))
    return good.select("src_row", F.lit("valid").alias("side")).unionByName(bad.select("src_row", F.lit("invalid").alias("side")))


@register("staging_status")
def _staging_status(t: Tables) -> DataFrame:
    return _valid_permits(t).select("src_row", validate.staging_status().alias("ValidationStatus"))


@register("apply_validation_rules")
def _validation_rules(t: Tables) -> DataFrame:
    table = t.spark.createDataFrame(VALIDATION_RULES, RULE_COLUMNS)
    return rules.apply_validation_rules(_permits(t), table, "Permit").select("src_row", "validation_errors")


@register("apply_transformation_rules")
def _transformation_rules(t: Tables) -> DataFrame:
    table = t.spark.createDataFrame(TRANSFORMATION_RULES, TRANSFORMATION_COLUMNS)
    out = rules.apply_transformation_rules(_permits(t), table, "Permit")
    return out.select("src_row", "permit_number", "status", F.col("fee").cast("bigint").alias("fee"))


# Matching.

@register("like_contains_filter")
def _like_contains(t: Tables) -> DataFrame:
    return match.like_contains_filter(_parcels(t), "150", "MAIN").unionByName(match.like_contains_filter(_parcels(t), None, "HILL"))


def _scored(t: Tables, n: int | None = None) -> DataFrame:
    addresses = match.distinct_addresses(match.spelled_addresses(_permits(t), "address"))
    situs = match.stored_situs(_parcels(t))
    texts = stored(match.distinct_texts(situs), "texts")
    asked = stored(match.asked_addresses(addresses), "asked")
    scored = stored(match.score_candidates(match.candidate_texts(asked, texts), 40), "scored")
    return match.parcels_of_texts(scored, situs, n)


@register("min_confidence_filter")
def _min_confidence(t: Tables) -> DataFrame:
    return match.min_confidence_filter(_scored(t), 90).select("normalized", "pid", "confidence")


@register("rank_matches")
def _rank_matches(t: Tables) -> DataFrame:
    return match.rank_matches(_scored(t, 2), ["normalized"], 2).select("normalized", "pid", "confidence", "match_rank")


@register("match_addresses")
def _match_addresses(t: Tables) -> DataFrame:
    return match.match_addresses(_permits(t), _parcels(t)).select(
        "normalized", "pid", "full_address", "confidence", "match_method", "match_rank"
    )


@register("match_addresses_dense")
def _match_dense(t: Tables) -> DataFrame:
    parcels = match.parcel_dimension(t.view("fx_parcel_dense"))
    return match.match_addresses(t.view("fx_dense_address"), parcels).select(
        "normalized", "pid", "full_address", "confidence", "match_method", "match_rank"
    )


@register("attach_best_parcel")
def _attach(t: Tables) -> DataFrame:
    return _matched(t).select("src_row", "parcel_id", "match_confidence", "validation_errors")


@register("attach_best_parcel_property")
def _attach_property(t: Tables) -> DataFrame:
    checked = validate.validate_property(_property(t))
    return match.attach_best_parcel_property(checked, _parcels(t)).select(
        "src_row", "parcel_id", "match_confidence", "validation_errors"
    )


@register("address_match_stats")
def _match_stats(t: Tables) -> DataFrame:
    rows = match.address_match_rows(_matched(t), matched_at=AS_OF, job_id=JOB, record_type="Permit", record_id="src_row")
    stats = match.address_match_stats(rows)
    return stats.withColumn("SuccessRate", F.col("SuccessRate").cast("double"))


@register("address_match_stats_merged")
def _merged_stats(t: Tables) -> DataFrame:
    rows = match.address_match_rows(_matched(t), matched_at=AS_OF, job_id=F.pmod("src_row", F.lit(5)), record_type="Permit", record_id="src_row")
    stats = match.merged_match_stats(stored(match.match_stat_partials(rows), "match-partials"))
    return stats.withColumn("SuccessRate", F.col("SuccessRate").cast("double"))


# Lookups.

@register("parcel_by_address")
def _by_address(t: Tables) -> DataFrame:
    return lookup.parcel_by_address(t.view("fx_permit_raw").select(fn.clean_text("Address").alias("address")), t.view("fx_parcel"), t.view("fx_parcel_owner"))


@register("parcel_by_number")
def _by_number(t: Tables) -> DataFrame:
    dashed = F.concat(F.lit(" "), F.substring("pid", 1, 4), F.lit("-"), F.substring("pid", 5, 4))
    short = F.ltrim("pid", F.lit("0"))
    asked = t.view("fx_parcel").select(F.explode(F.array(dashed, short, F.substring("pid", 2, 5))).alias("parcel_number"))
    return lookup.parcel_by_number(asked, t.view("fx_parcel"), t.view("fx_parcel_owner"))


@register("parcel_search")
def _search(t: Tables) -> DataFrame:
    words = F.concat(F.substring("street_number", 1, 2), F.lit(" "), F.substring("street_name", 1, 3), F.lit(" "), F.substring("state", 1, 4))
    return lookup.parcel_search(t.view("fx_parcel").select(words.alias("address")), t.view("fx_parcel"))


@register("parcel_exact")
def _exact(t: Tables) -> DataFrame:
    return lookup.parcel_exact(t.view("fx_permit_raw").select(F.col("Parcel ID").alias("pid")), t.view("fx_parcel"))


@register("primary_owner")
def _primary_owner(t: Tables) -> DataFrame:
    return lookup.primary_owner(t.view("fx_parcel"), t.view("fx_parcel_owner")).select("pid", "situs_address", "owner_name")


@register("latest_assessment")
def _latest(t: Tables) -> DataFrame:
    return lookup.latest_assessment(t.view("fx_personal_property"), t.view("fx_assessment"))


def _permit_table(t: Tables) -> DataFrame:
    return _permits(t).select(
        F.col("src_row").alias("PermitID"), F.col("permit_number").alias("PermitNumber"), F.col("issue_date").alias("IssuedDate"),
        F.col("permit_type").alias("PermitType"), F.col("description").alias("Description"), F.col("address").alias("ProjectAddress"),
        F.col("valuation").alias("Valuation"), F.col("status").alias("Status"),
    )


@register("read_permits_page")
def _permits_page(t: Tables) -> DataFrame:
    return _day(paging.read_permits_page(_permit_table(t), limit=100, offset=50), "IssuedDate")


@register("read_permits_page_after")
def _permits_after(t: Tables) -> DataFrame:
    seen = (datetime(1996, 1, 2), 300)
    return _day(paging.read_permits_page(_permit_table(t), limit=100, after=seen), "IssuedDate")


@register("read_permits_page_indexed")
def _permits_indexed(t: Tables) -> DataFrame:
    index = paging.page_index(_permit_table(t), paging.PERMIT_ORDER)
    return _day(paging.read_permits_page(index.rows, limit=100, offset=700, index=index), "IssuedDate")


@register("read_property_page")
def _property_page(t: Tables) -> DataFrame:
    return paging.read_property_page(t.view("fx_personal_property"), t.view("fx_assessment"), limit=100, offset=300)


@register("read_property_page_after")
def _property_after(t: Tables) -> DataFrame:
    seen = ("PP00000040", 40)
    return paging.read_property_page(t.view("fx_personal_property"), t.view("fx_assessment"), limit=50, after=seen)


# Duplicates and jobs.

def _staging(t: Tables) -> DataFrame:
    return t.view("fx_staging").withColumns(
        {
            "ValidationStatus": F.when(F.col("ProcessingStatus") == "Failed", "Invalid").otherwise("Valid"),
            "ValidationMessage": F.when(F.col("ProcessingStatus") == "Failed", "Missing address; "),
        }
    )


@register("duplicate_permit_pairs")
def _pairs(t: Tables) -> DataFrame:
    return duplicates.duplicate_permit_pairs(_staging(t)).select("StagingID", "PermitNumber", "pair_count", "DuplicateMessage")


@register("flag_duplicate_permits")
def _flag(t: Tables) -> DataFrame:
    return duplicates.flag_duplicate_permits(_staging(t)).select("StagingID", "PermitNumber", "ValidationStatus", "ValidationMessage")


@register("duplicate_permit_pairs_of_job")
def _pairs_of_job(t: Tables) -> DataFrame:
    return duplicates.duplicate_permit_pairs(_staging(t), job_id=ONE_JOB).select("StagingID", "PermitNumber", "pair_count", "DuplicateMessage")


@register("flag_duplicate_permits_of_job")
def _flag_of_job(t: Tables) -> DataFrame:
    counts = stored(duplicates.permit_number_counts(_staging(t)), "number-counts")
    flagged = duplicates.flag_duplicate_permits(_staging(t), job_id=ONE_JOB, counts=counts)
    return flagged.select("StagingID", "PermitNumber", "ValidationStatus", "ValidationMessage")


@register("complete_one_import_job")
def _complete_one(t: Tables) -> DataFrame:
    done = jobs.complete_import_job(t.view("fx_import_job"), t.view("fx_staging"), t.view("fx_staging"), AS_OF, job_id=ONE_JOB)
    done = done.filter((F.col("ImportJobID") == ONE_JOB) | F.col("Status").isNull())
    return _day(done, "CompletedDate").select("ImportJobID", "ImportType", "Status", "CompletedDate", "RecordsTotal", "RecordsSuccessful", "RecordsFailed")


@register("complete_import_job")
def _complete(t: Tables) -> DataFrame:
    done = jobs.complete_import_job(t.view("fx_import_job"), t.view("fx_staging"), t.view("fx_staging"), AS_OF)
    return _day(done, "CompletedDate").select(
        "ImportJobID", "ImportType", "Status", "CompletedDate", "RecordsTotal", "RecordsProcessed", "RecordsSuccessful", "RecordsFailed"
    )


@register("permit_import_stats")
def _import_stats(t: Tables) -> DataFrame:
    stats = jobs.permit_import_stats(t.view("fx_import_job"))
    return stats.withColumn("SuccessRate", F.col("SuccessRate").cast("double"))


@register("import_summary")
def _summary(t: Tables) -> DataFrame:
    return jobs.import_summary(_valid_permits(t))


@register("column_profile")
def _profile(t: Tables) -> DataFrame:
    return profile.column_profile(_permits(t))


@register("sample_record")
def _sample(t: Tables) -> DataFrame:
    return profile.sample_record(_valid_permits(t).drop("issue_date", "valuation"), ["src_row"])


@register("log_import")
def _log_import(t: Tables) -> DataFrame:
    return _day(jobs.log_import(_valid_permits(t), "PERMIT", "permits.csv", JOB, AS_OF, "nightly"), "ImportDate")


@register("log_import_errors")
def _log_errors(t: Tables) -> DataFrame:
    log = jobs.log_import_errors(_valid_permits(t), JOB, AS_OF, record=["permit_number", "address", "status"])
    return _day(log, "CreatedDate")


@register("log_import_error_messages")
def _log_messages(t: Tables) -> DataFrame:
    log = jobs.log_import_errors(_valid_permits(t), JOB, AS_OF, record=["permit_number"], per_message=True)
    return log.select("ImportJobID", "RecordIndex", "ErrorMessage")


# Settings tables.

def _settings(t: Tables) -> DataFrame:
    return t.view("fx_settings").select("category", "name", "value", "description")


@register("category_filter")
def _category(t: Tables) -> DataFrame:
    return keyed.category_filter(_settings(t), "C7").unionByName(keyed.category_filter(_settings(t)))


@register("existing_key_count")
def _key_count(t: Tables) -> DataFrame:
    return keyed.existing_key_count(_settings(t), t.view("fx_setting_update"))


@register("settings_rows")
def _settings_rows(t: Tables) -> DataFrame:
    return keyed.settings_rows(t.view("fx_setting_update"), "seq")


@register("settings_map")
def _settings_map(t: Tables) -> DataFrame:
    return keyed.settings_map(t.view("fx_settings"), "seq", t.view("fx_setting_update")).select("category", F.to_json("settings").alias("settings"))


@register("upsert_keyed")
def _upsert(t: Tables) -> DataFrame:
    return keyed.upsert_keyed(_settings(t), t.view("fx_setting_update"), "seq")


@register("insert_if_absent")
def _insert(t: Tables) -> DataFrame:
    return keyed.insert_if_absent(_settings(t), t.view("fx_setting_update"), "seq")


# Sources, sinks and streams: the feed is written to the shared folder first and read back.

@register("sql_query")
def _sql(t: Tables) -> DataFrame:
    text = "SELECT src_row, `Status` AS status FROM {permits} WHERE `Status` = ? OR `Description` LIKE ?"
    return jdbc.sql_query(t.spark, text, ["o", "%Remodel%"], permits=t.view("fx_permit_raw"))


def _write_feed_files(t: Tables) -> str:
    path = shared_dir(t.spark, "feed") + ".csv"
    if not sinks.write_feed(t.view("fx_permit_raw"), path):
        raise OSError(f"Could not write {path}")
    return path


@register("scan_csv")
def _scan_csv(t: Tables) -> DataFrame:
    back = feeds.scan_csv(t.spark, _write_feed_files(t))
    return back.select("src_row", "Permit Number", "Valuation", "Address", "Parcel ID", "Description")


@register("scan_csv_multiline")
def _scan_multiline(t: Tables) -> DataFrame:
    # Texts with line breaks, quotes and commas, written and read back.
    path = shared_dir(t.spark, "breaks") + ".csv"
    broken = F.concat("Description", F.lit('\nsecond "line", '), "Address")
    if not sinks.write_feed(t.view("fx_permit_raw").select("src_row", broken.alias("note")), path):
        raise OSError(f"Could not write {path}")
    back = feeds.scan_csv(t.spark, path, multi_line=True)
    return back.select(F.col("src_row").cast("bigint").alias("src_row"), "note")


@register("scan_csv_ragged")
def _scan_ragged(t: Tables) -> DataFrame:
    # Every fifth record has a cell too many, every seventh one too few.
    path = shared_dir(t.spark, "ragged")
    cells = F.when(F.col("src_row") % 5 == 0, F.lit(",x,y")).when(F.col("src_row") % 7 == 0, F.lit("")).otherwise(F.lit(",x"))
    lines = t.view("fx_permit_raw").select(F.concat(F.col("src_row").cast("string"), cells).alias("value"))
    lines.selectExpr("value as `src_row,note`").write.options(header=True, quote="\u0000", escapeQuotes=False, sep="\u0001").csv(path)
    back = feeds.scan_feed(t.spark, path, format_type="csv", ragged=feeds.RAGGED)
    return back.select(
        F.regexp_extract(F.coalesce(feeds.RAGGED, "src_row"), "^([0-9]+)", 1).cast("bigint").alias("src_row"),
        F.col(feeds.RAGGED).alias("line"), "validation_errors",
    )


@register("scan_feed")
def _scan_feed(t: Tables) -> DataFrame:
    return feeds.scan_feed(t.spark, _write_feed_files(t), columns_map=PERMIT_MAP).select("src_row", "permit_number", "valuation", "validation_errors")


@register("skip_rows")
def _skip_rows(t: Tables) -> DataFrame:
    # Four files, each opening with two lines of title and then the header.
    path = shared_dir(t.spark, "preamble")
    quoted = F.concat(F.lit('"'), F.col("Description"), F.lit('"'))
    body = t.view("fx_permit_raw").select(
        (F.col("src_row") % 4).alias("part"), F.lit(3).alias("place"), F.concat_ws(",", "src_row", quoted).alias("line")
    )
    opening = F.posexplode(F.array(F.lit("Permit report"), F.lit("for the county"), F.lit("src_row,note"))).alias("place", "line")
    heads = body.select("part").distinct().select("part", opening)
    lines = body.unionByName(heads).repartition("part").sortWithinPartitions("part", "place")
    lines.select("part", "line").write.partitionBy("part").text(path)
    return feeds.scan_feed(t.spark, path, format_type="txt", skip_rows=2)


@register("write_feed")
def _write_feed(t: Tables) -> DataFrame:
    path = shared_dir(t.spark, "cleaned") + ".parquet"
    if not sinks.write_feed(_valid_permits(t), path):
        raise OSError(f"Could not write {path}")
    return t.spark.read.parquet(path).select("src_row", "permit_number", "valuation", "validation_errors")


@register("write_run_output")
def _run_output(t: Tables) -> DataFrame:
    folder = shared_dir(t.spark, "runs")
    path = sinks.write_run_output(_valid_permits(t), folder, "permits", "20250630_120000")
    return feeds.scan_csv(t.spark, f"{path}/data.csv").select("src_row", "permit_number", "valuation", "validation_errors")


@register("append_rows")
def _append(t: Tables) -> DataFrame:
    path = shared_dir(t.spark, "log")
    sinks.append_rows(_permits(t), path, ["src_row", "permit_number"])
    sinks.append_rows(_property(t).withColumnRenamed("account_number", "permit_number"), path, ["src_row", "permit_number"])
    return t.spark.read.parquet(path)


@register("write_staging")
def _write_staging(t: Tables) -> DataFrame:
    path = shared_dir(t.spark, "staging")
    job = F.col("src_row") % 5
    rows = jobs.permit_staging_rows(_valid_permits(t), job, AS_OF, row_id=F.col("src_row"))
    sinks.write_staging(rows, path)
    back = sinks.read_staging(t.spark, path)
    return _day(back, "IssueDate").select(
        "PermitStagingID", F.col("ImportJobID").cast("bigint").alias("ImportJobID"), "PermitNumber", "IssueDate", "ImprovementType",
        F.col("ValuationAmount").cast("double").alias("ValuationAmount"), "ValidationStatus", "ValidationMessage", "ProcessingStatus",
    )


@register("stream_watch_folder")
def _watch(t: Tables) -> DataFrame:
    folder, out, state = (shared_dir(t.spark, label) for label in ("watch", "watched", "watch-state"))
    raw = t.view("fx_permit_raw")
    raw.repartition(4, "src_row").write.options(header=True, **sinks.CSV_WRITE).csv(folder)
    rows = watch.process_feed(watch.stream_watch_folder(t.spark, folder, raw.columns), watch.PERMIT, AS_OF)
    writer = rows.writeStream.format("parquet").option("checkpointLocation", state).option("path", out)
    writer.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out).select(F.col("src_row").cast("bigint").alias("src_row"), "permit_number", "validation_errors")


@register("stream_match_and_stage")
def _stage_stream(t: Tables) -> DataFrame:
    folder, out, errors, state = (shared_dir(t.spark, label) for label in ("watch", "staged", "errors", "stage-state"))
    raw = t.view("fx_permit_raw").withColumnRenamed("src_row", watch.RECORD)
    raw.repartition(4, watch.RECORD).write.options(header=True, **sinks.CSV_WRITE).csv(folder)
    rows = watch.stream_watch_folder(t.spark, folder, raw.columns)
    rows = rows.withColumn(watch.RECORD, F.col(watch.RECORD).cast("bigint"))
    query = watch.stream_match_and_stage(rows, lambda: _parcels(t), watch.PERMIT, out, errors, state, AS_OF)
    query.awaitTermination()
    staged = sinks.read_staging(t.spark, out)
    logged = t.spark.read.parquet(errors).select(F.col("RecordIndex").alias("PermitStagingID"), F.col("ErrorMessage").alias("LoggedError"))
    return staged.join(logged, "PermitStagingID", "left").select(
        F.col("PermitStagingID").alias("src_row"), "PermitNumber", "ParcelNumber", "ValidationStatus", "ValidationMessage", "LoggedError"
    )


@register("stream_match_and_stage_property")
def _stage_property(t: Tables) -> DataFrame:
    folder, out, errors, state = (shared_dir(t.spark, label) for label in ("watch", "staged", "errors", "stage-state"))
    raw = t.view("fx_property_raw").withColumnRenamed("src_row", watch.RECORD)
    raw.repartition(4, watch.RECORD).write.options(header=True, **sinks.CSV_WRITE).csv(folder)
    rows = watch.stream_watch_folder(t.spark, folder, raw.columns)
    rows = rows.withColumn(watch.RECORD, F.col(watch.RECORD).cast("bigint"))
    query = watch.stream_match_and_stage(rows, lambda: _parcels(t), watch.PROPERTY, out, errors, state, AS_OF)
    query.awaitTermination()
    staged = sinks.read_staging(t.spark, out)
    logged = t.spark.read.parquet(errors).select(F.col("RecordIndex").alias("PersonalPropertyStagingID"), F.col("ErrorMessage").alias("LoggedError"))
    return staged.join(logged, "PersonalPropertyStagingID", "left").select(
        F.col("PersonalPropertyStagingID").alias("src_row"), "TaxpayerID", "ParcelNumber", "ValidationStatus", "ValidationMessage", "LoggedError"
    )


# Flows.

@register("import_permits")
def _import_permits(t: Tables) -> DataFrame:
    done = imports.import_permits(t.view("fx_permit_raw"), AS_OF, _parcels(t), PERMIT_MAP)
    return _day(done, "issue_date").select("src_row", "permit_number", "issue_date", "address", "parcel_id", "validation_errors")


@register("import_property")
def _import_property(t: Tables) -> DataFrame:
    done = imports.import_property(t.view("fx_property_raw"), _parcels(t))
    return done.select("src_row", "account_number", "owner_name", "property_type", "value", "parcel_id", "validation_errors")


def _run_rows(run: imports.ImportRun, number: str, name: str, parcel: str = "ParcelNumber") -> DataFrame:
    """Every staged record with its logged error and the totals of its job."""
    logged = run.errors.select(F.col("RecordIndex").alias(number), F.col("ErrorMessage").alias("LoggedError"))
    totals = F.broadcast(run.job.select("ImportJobID", "RecordsTotal", "RecordsFailed"))
    return run.staging.join(logged, number, "left").join(totals, "ImportJobID").select(
        F.col(number).alias("src_row"), name, parcel, "ValidationStatus", "ValidationMessage", "LoggedError", "RecordsTotal", "RecordsFailed"
    )


@register("run_import_permits")
def _run_permits(t: Tables) -> DataFrame:
    folder = shared_dir(t.spark, "run")
    run = imports.run_import(t.view("fx_permit_raw"), "Permit", JOB, "permits.csv", folder, AS_OF, _parcels(t), PERMIT_MAP)
    return _run_rows(run, "PermitStagingID", "PermitNumber")


@register("run_import_property")
def _run_property(t: Tables) -> DataFrame:
    folder = shared_dir(t.spark, "run")
    run = imports.run_import(t.view("fx_property_raw"), "PersonalProperty", JOB, "property.csv", folder, AS_OF, _parcels(t))
    return _run_rows(run, "PersonalPropertyStagingID", "TaxpayerID")


@register("permit_type_report")
def permit_type_report(t: Tables) -> DataFrame:
    return imports.permit_type_report(imports.import_permits(t.view("fx_permit_raw"), AS_OF, _parcels(t)))
