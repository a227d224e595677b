"""Matching free-text addresses to parcels, and filling parcel ids from the best match."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platwork.functions import normalize_address, parse_address, token_sort_key
from platwork.functions.similarity import counts_bound, form_ratio, key_form, kind_counts, reachable
from platwork.functions.text import strip
from platwork.functions.values import as_timestamp
from platwork.operators.blocks import first_hits, first_per_key, ordered_blocks
from platwork.operators.clean import blank
from platwork.operators.grams import gram_join
from platwork.operators.shape import ERRORS
from platwork.operators.skew import FLOOR, SHARE, salted_join
from platwork.session import stored

MIN_CONFIDENCE = 70.0
MAX_RESULTS = 5
LOW_CONFIDENCE = 80
ATTEMPTED = "match_attempted"

PARCEL_COLUMNS = ("pid", "full_address", "street_number", "street_name", "street_type", "city", "state", "zip_code")
# Parcels of one text are alike to the matcher.
TEXT_KEY = ["street_number", "street_name", "situs_normalized"]


def parcel_dimension(parcels: DataFrame, address: str = "situs_address") -> DataFrame:
    """Parcel rows in the matcher's shape."""
    return parcels.withColumnRenamed(address, "full_address").select(*PARCEL_COLUMNS)


def like_contains_filter(parcels: DataFrame, street_number: str | None = None, street_name: str | None = None) -> DataFrame:
    """The candidate predicates for one address; an empty component adds no predicate."""
    if street_number:
        parcels = parcels.filter(F.col("street_number") == street_number)
    if street_name:
        parcels = parcels.filter(F.col("street_name").contains(street_name))
    return parcels


def candidate_cap(candidates: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first ``n`` candidates of each key by parcel id."""
    return first_per_key(candidates, keys, [F.col("pid")], n)


def rank_matches(scored: DataFrame, keys: list[str], n: int = MAX_RESULTS) -> DataFrame:
    """The ``n`` best by confidence, ties in parcel-id order, with their ``match_rank``."""
    order = [F.col("confidence").desc(), F.col("pid")]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return scored.withColumn("match_rank", rank).filter(F.col("match_rank") <= n)


def min_confidence_filter(scored: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    return scored.filter(F.col("confidence") >= min_confidence)


def spelled_addresses(requests: DataFrame, address: str) -> DataFrame:
    """One row per distinct non-blank address text: ``spelling``, ``normalized``, ``requests``.

    Grouping the texts as they are comes first, with partial counts before the shuffle, so that
    the costly normalization runs once per spelling and not once per record.
    """
    asked = requests.filter(~blank(strip(F.col(address)))).select(F.col(address).alias("spelling"))
    counted = asked.groupBy("spelling").agg(F.count("*").alias("requests"))
    return counted.withColumn("normalized", _after_grouping(normalize_address("spelling")))


def _after_grouping(value: Column) -> Column:
    # Tied to the count, which only exists after the grouping. Otherwise filters on the value
    # would move below the grouping and compute it again for every record of every branch.
    return F.when(F.col("requests") > 0, value)


def distinct_addresses(spelled: DataFrame) -> DataFrame:
    """One row per ``normalized`` address with its numbers of ``requests`` and ``spellings``."""
    return spelled.groupBy("normalized").agg(F.sum("requests").alias("requests"), F.count("*").alias("spellings"))


def situs_texts(parcels: DataFrame) -> DataFrame:
    """Parcels with their normalized situs text; those without a street name cannot be candidates."""
    placed = parcels.filter(F.col("street_name").isNotNull())
    return placed.withColumn("street_number", F.coalesce("street_number", F.lit(""))).withColumn(
        "situs_normalized", normalize_address("full_address")
    )


def stored_situs(parcels: DataFrame) -> DataFrame:
    """:func:`situs_texts` made once by all tasks and stored, for the several steps that read them."""
    return stored(situs_texts(parcels.repartition("pid")), "situs")


def distinct_texts(situs: DataFrame) -> DataFrame:
    """One row per street number, street name and normalized situs of :func:`situs_texts`, with the
    ``lowest`` parcel id and the text's ``situs_form``. Parcels of one text score alike."""
    texts = situs.groupBy(*TEXT_KEY).agg(F.min(F.struct("pid")).alias("lowest"))
    return texts.withColumn("situs_form", key_form(token_sort_key("situs_normalized")))


def asked_addresses(addresses: DataFrame) -> DataFrame:
    """(normalized, q_number, q_name, address_form) of the addresses that name a street.

    An address without a number is asked for by all its words but the street type.
    """
    parts = F.struct(
        parse_address("normalized").alias("p"), parse_address(F.concat(F.lit("0 "), "normalized")).alias("u"), key_form(token_sort_key("normalized")).alias("form")
    )
    return addresses.select("normalized", _after_grouping(parts).alias("q")).select(
        "normalized",
        F.col("q.p.street_number").alias("q_number"),
        F.when(F.col("q.p.street_number") == "", F.col("q.u.street_name")).otherwise(F.col("q.p.street_name")).alias("q_name"),
        F.col("q.form").alias("address_form"),
    ).filter("q_name <> ''")


def _names_containing(asked: DataFrame, streets: DataFrame, equal: list[str]) -> DataFrame:
    return gram_join(asked, streets, F.col("q_name"), "street_name", lambda text: F.contains(text, F.col("q_name")), equal=equal)


def numbered_candidates(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(normalized, text of parcels) pairs of the addresses with a number: same street number, parcel
    street name containing the address's.

    ``asked`` come from :func:`asked_addresses`, ``texts`` from :func:`distinct_texts`; no pair is left
    out. The substring join runs between distinct names within one number. What scoring needs of
    either side is made once per address and once per text, best stored with them.
    """
    parsed = asked.filter("q_number <> ''")
    formed = texts.select(*TEXT_KEY, "situs_form")
    streets = texts.select(F.col("street_number").alias("q_number"), "street_name").distinct()
    found = _names_containing(parsed.select("q_number", "q_name").distinct(), streets, ["q_number"]).select(
        "q_number", "q_name", F.col("q_number").alias("street_number"), "street_name"
    )
    return parsed.join(found, ["q_number", "q_name"]).join(formed, ["street_number", "street_name"]).select(
        "normalized", "address_form", *TEXT_KEY, "situs_form"
    )


def unnumbered_candidates(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """As :func:`numbered_candidates` for addresses without a number: with every text of all streets
    whose name contains their words. :func:`best_unnumbered` scores only those that can be among the
    best."""
    parsed = asked.filter("q_number = ''")
    formed = texts.select(*TEXT_KEY, "situs_form")
    found = _names_containing(parsed.select("q_name").distinct(), texts.select("street_name").distinct(), [])
    return parsed.join(found, "q_name").join(formed, "street_name").select("normalized", "address_form", *TEXT_KEY, "situs_form")


def candidate_texts(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """All candidate pairs, of addresses with and without a number."""
    return numbered_candidates(asked, texts).unionByName(unnumbered_candidates(asked, texts))


def _method() -> Column:
    return F.when(F.col("situs_normalized") == F.col("normalized"), "Exact").otherwise("Fuzzy").alias("match_method")


def score_candidates(candidates: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Pairs of :func:`candidate_texts` with ``confidence`` and ``match_method``, those that reach
    ``min_confidence``."""
    a, b = F.col("address_form"), F.col("situs_form")
    # Scoring is the costly step, so the pairs left to score are spread evenly first.
    near = candidates.filter(reachable(a["key"], b["key"], min_confidence)).repartition("normalized", *TEXT_KEY)
    scored = near.select("normalized", *TEXT_KEY, form_ratio(a, b).alias("confidence"), _method())
    return min_confidence_filter(scored, min_confidence)


def best_unnumbered(
    asked: DataFrame, texts: DataFrame, min_confidence: float = MIN_CONFIDENCE, n: int = MAX_RESULTS
) -> DataFrame:
    """As :func:`score_candidates` for the addresses without a number, each with its ``n`` best texts
    only: by confidence, then by their parcels' lowest id. A ranking of ``n`` parcels needs no others.

    The texts of a street whose keys have the same character counts share an upper bound of their
    score with an address. They lie in blocks by parcel id. An address reads the blocks by descending
    bound, then by id, and stops where they cannot beat its ``n``-th best text, so what is scored
    does not grow with the street unless its scores do.
    """
    parsed = stored(asked.filter("q_number = ''").withColumn("asked", kind_counts(F.col("address_form.key"))), "unnumbered")
    found = _names_containing(parsed.select("q_name").distinct(), texts.select("street_name").distinct(), [])
    reached = stored(parsed.select("normalized", "q_name", "asked").join(found, "q_name").select("normalized", "asked", "street_name"), "streets")
    if reached.isEmpty():
        none = "normalized string, street_number string, street_name string, situs_normalized string, confidence int, match_method string"
        return texts.sparkSession.createDataFrame([], none)
    own = texts.join(reached.select("street_name").distinct(), "street_name", "left_semi")
    formed = own.withColumn("counts", kind_counts(F.col("situs_form.key")))
    blocks = stored(ordered_blocks(formed, ["street_name", "counts"], "lowest", ["street_number", "situs_normalized", "situs_form"]), "text-blocks")
    bound = counts_bound(F.col("asked"), F.col("counts"))
    open_blocks = reached.join(blocks.select("street_name", "counts", "block", "first"), "street_name").withColumn("bound", bound)
    open_blocks = open_blocks.filter(F.col("bound") >= min_confidence).select(
        "normalized", F.struct((-F.col("bound")).alias("score"), F.col("first").alias("lowest")).alias("rank"), "street_name", "counts", "block"
    )

    def read(taken: DataFrame) -> DataFrame:
        met = taken.drop("rank").join(blocks, ["street_name", "counts", "block"]).join(parsed.select("normalized", "address_form"), "normalized")
        pairs = met.select("normalized", "address_form", "street_name", F.explode("entries").alias("e")).select("normalized", "address_form", "street_name", "e.*")
        a, b = F.col("address_form"), F.col("situs_form")
        near = pairs.filter(reachable(a["key"], b["key"], min_confidence)).repartition("normalized", *TEXT_KEY)
        scored = stored(near.select("normalized", *TEXT_KEY, form_ratio(a, b).alias("confidence"), _method(), "lowest"), "scored-pairs")
        rank = F.struct((-F.col("confidence")).alias("score"), F.col("lowest"))
        return min_confidence_filter(scored, min_confidence).withColumn("rank", rank).drop("lowest")

    return first_hits(open_blocks, read, ["normalized"], n).select("normalized", *TEXT_KEY, "confidence", "match_method")


def parcels_of_texts(scored: DataFrame, situs: DataFrame, n: int | None = None) -> DataFrame:
    """Scored texts with their parcels, or with the first ``n`` of each text by parcel id: a ranking
    of ``n`` by confidence, then id, can use no others."""
    chosen = situs if n is None else first_per_key(situs, TEXT_KEY, [F.col("pid")], n)
    return scored.join(chosen, TEXT_KEY).select("normalized", *PARCEL_COLUMNS, "confidence", "match_method")


def match_distinct(
    addresses: DataFrame,
    parcels: DataFrame,
    min_confidence: float = MIN_CONFIDENCE,
    max_results: int = MAX_RESULTS,
) -> DataFrame:
    """Ranked matches of a table from :func:`distinct_addresses`."""
    situs = stored_situs(parcels)
    texts = stored(distinct_texts(situs), "texts")
    asked = stored(asked_addresses(addresses), "asked")
    scored = score_candidates(numbered_candidates(asked, texts), min_confidence)
    scored = scored.unionByName(best_unnumbered(asked, texts, min_confidence, max_results))
    return rank_matches(parcels_of_texts(scored, situs, max_results), ["normalized"], max_results)


def match_addresses(
    requests: DataFrame,
    parcels: DataFrame,
    address: str = "address",
    min_confidence: float = MIN_CONFIDENCE,
    max_results: int = MAX_RESULTS,
) -> DataFrame:
    """Up to ``max_results`` parcels per distinct normalized address: ``normalized``, the parcel
    columns, ``confidence``, ``match_method``, ``match_rank``. Blank addresses give no rows."""
    addresses = distinct_addresses(spelled_addresses(requests, address))
    return match_distinct(addresses, parcels, min_confidence, max_results)


def attach_best_parcel(
    df: DataFrame,
    parcels: DataFrame,
    address: str = "address",
    label: str = "address",
    min_confidence: float = MIN_CONFIDENCE,
    share: int = SHARE,
    floor: int = FLOOR,
) -> DataFrame:
    """Fill ``parcel_id`` and ``match_confidence`` from the best match of ``address``.

    Only rows with an address and no parcel id are matched, which ``match_attempted`` marks; the
    others keep their parcel id, and the confidence and method they came with (0 and null without
    any), so a second run changes nothing and a ``Manual`` match stays. A match below 80 adds
    ``"Low confidence <label> match; "``.
    """
    for name, kind in (("match_confidence", "double"), ("match_method", "string"), (ATTEMPTED, "boolean")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    if "parcel_id" not in df.columns:
        df = df.withColumn("parcel_id", F.lit(""))
    if ERRORS not in df.columns:
        df = df.withColumn(ERRORS, F.lit(""))
    wanted = blank(F.col("parcel_id")) & ~blank(strip(F.col(address)))
    # One row per distinct text, written once: the feed below is read here and in the last join only.
    spelled = stored(spelled_addresses(df.filter(wanted), address), "spelled")
    addresses = stored(distinct_addresses(spelled), "addresses")
    best = match_distinct(addresses, parcels, min_confidence, max_results=1).select(
        "normalized",
        F.col("pid").alias("_pid"),
        F.col("confidence").alias("_confidence"),
        F.col("match_method").alias("_method"),
    )
    # Both joins split hot keys: one address may have very many spellings (a tower's units), and
    # one spelling very many records. Records are joined by the text they carry, so none of them
    # is normalized on its own.
    found = salted_join(spelled, best, ["normalized"], addresses, "spellings", share=share, floor=floor)
    found = found.select(F.col("spelling").alias("_spelling"), "_pid", "_confidence", "_method")
    keyed = df.withColumn("_spelling", F.when(wanted, F.col(address)))
    counts = spelled.select(F.col("spelling").alias("_spelling"), "requests")
    joined = salted_join(keyed, found, ["_spelling"], counts, "requests", "left", share=share, floor=floor)
    confidence = F.col("_confidence").cast("double")
    low = F.when(confidence < LOW_CONFIDENCE, f"Low confidence {label} match; ").otherwise("")
    kept = [F.col(c) for c in df.columns if c not in ("parcel_id", "match_confidence", "match_method", ATTEMPTED, ERRORS)]
    return joined.select(
        *kept,
        F.coalesce("_pid", "parcel_id", F.lit("")).alias("parcel_id"),
        F.coalesce(confidence, F.col("match_confidence").cast("double"), F.lit(0.0)).alias("match_confidence"),
        F.coalesce("_method", "match_method").alias("match_method"),
        (F.coalesce(F.col(ATTEMPTED), F.lit(False)) | F.col("_spelling").isNotNull()).alias(ATTEMPTED),
        F.concat(F.coalesce(F.col(ERRORS), F.lit("")), low).alias(ERRORS),
    )


def attach_best_parcel_property(df: DataFrame, parcels: DataFrame, **options) -> DataFrame:
    """:func:`attach_best_parcel` for property accounts, matched on ``property_location``."""
    return attach_best_parcel(df, parcels, address="property_location", label="location", **options)


def address_match_rows(
    df: DataFrame,
    address: str = "address",
    matched_at: Column | datetime | str | None = None,
    job_id: Column | int | None = None,
    record_type: str | None = None,
    record_id: str | None = None,
) -> DataFrame:
    """Address-match records of the rows that :func:`attach_best_parcel` compared, or that a person
    matched. Unmatched rows count as fuzzy attempts without a parcel."""
    asked = F.coalesce(F.col(ATTEMPTED), F.lit(False)) | F.coalesce(F.col("match_method") == "Manual", F.lit(False))
    return df.filter(~blank(F.col(address)) & asked).select(
        F.col(address).alias("SourceAddress"),
        normalize_address(address).alias("StandardizedAddress"),
        F.nullif(F.col("parcel_id"), F.lit("")).alias("ParcelNumber"),
        F.col("match_confidence").cast("decimal(5,2)").alias("ConfidenceScore"),
        F.coalesce("match_method", F.lit("Fuzzy")).alias("MatchMethod"),
        (F.lit(None).cast("timestamp_ntz") if matched_at is None else as_timestamp(matched_at)).alias("MatchDate"),
        (job_id if isinstance(job_id, Column) else F.lit(job_id)).cast("bigint").alias("ImportJobID"),
        F.lit(record_type).cast("string").alias("RecordType"),
        (F.lit(None) if record_id is None else F.col(record_id)).cast("bigint").alias("RecordID"),
    )


def match_stat_partials(matches: DataFrame) -> DataFrame:
    """Per job and match method the sums that :func:`merged_match_stats` adds up. They are kept beside
    the matches in folders per job, and replaced when a job is matched again."""
    return matches.groupBy("ImportJobID", "MatchMethod").agg(
        F.count("*").alias("matches"), F.count("ParcelNumber").alias("found"), F.count("ConfidenceScore").alias("scores"),
        F.sum("ConfidenceScore").cast("decimal(28,2)").alias("score_sum"),
    )


def merged_match_stats(partials: DataFrame) -> DataFrame:
    """The statistics of :func:`address_match_stats` from the partials of any set of jobs."""
    sums = partials.groupBy("MatchMethod").agg(*(F.sum(c).alias(c) for c in ("matches", "found", "scores", "score_sum")))
    total, found = F.col("matches"), F.col("found")
    rate = (found * 100).cast("decimal(24,4)") / total.cast("decimal(20,0)")
    return sums.select(
        "MatchMethod",
        total.alias("TotalMatches"),
        F.when(F.col("scores") > 0, F.col("score_sum").cast("double") / F.col("scores")).alias("AvgConfidence"),
        found.alias("SuccessfulMatches"),
        (total - found).alias("FailedMatches"),
        rate.cast("decimal(5,2)").alias("SuccessRate"),
    )


def address_match_stats(matches: DataFrame) -> DataFrame:
    """Per match method: count, average confidence, matched, unmatched and success percentage."""
    total, found = F.count("*"), F.count("ParcelNumber")
    rate = (found * 100).cast("decimal(24,4)") / total.cast("decimal(20,0)")
    return matches.groupBy("MatchMethod").agg(
        total.alias("TotalMatches"),
        F.avg(F.col("ConfidenceScore").cast("double")).alias("AvgConfidence"),
        found.alias("SuccessfulMatches"),
        (total - found).alias("FailedMatches"),
        rate.cast("decimal(5,2)").alias("SuccessRate"),
    )
