"""Parcel lookups by address or number, owners, latest assessments."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platwork.functions import format_situs, normalize_parcel_number, upper_trim
from platwork.operators.blocks import first_per_key
from platwork.operators.grams import RARE_LENGTH, ListIndex, first_containing, first_places, gram_index, gram_join, query_grams, rarest, word_index
from platwork.session import stored

SEARCH_LIMIT = 10


def primary_owner(parcels: DataFrame, owners: DataFrame, key: str = "pid") -> DataFrame:
    """Parcels with their primary owner; parcels without one stay, with null."""
    primary = owners.filter(F.col("IsPrimary").cast("int") == 1).select(key, F.col("OwnerName").alias("owner_name"))
    return parcels.join(primary, key, "left")


def lookup_index(parcels: DataFrame, text: Column, key: str = "pid", number: str = "pid") -> ListIndex:
    """A gram index of the parcels' ``text``, posting lists sorted by number, for many lookups:
    build it once and pass it to :func:`parcel_by_address` or :func:`parcel_by_number` as ``index``."""
    return gram_index(_places(parcels.withColumn("_text", text), key, number), "_text")


def _places(texts: DataFrame, key: str, number: str) -> DataFrame:
    return texts.filter(F.col("_text").isNotNull()).select(F.struct(F.col(number).alias("o"), F.col(key).alias("k")).alias("place"), "_text")


def _first_containing(queries: DataFrame, texts: DataFrame, key: str, number: str, index: ListIndex | None) -> DataFrame:
    """Per distinct ``query``, the ``key`` of the text row lowest by ``number`` that contains it.

    A query that is one gram takes the first place of that gram's list, in one grouping for all of
    them. A longer one reads the posting list of its rarest gram in blocks by number and stops at the
    first text that contains it. An empty query is contained everywhere and takes the overall first row.
    """
    places = _places(texts, key, number)
    size = F.length("query")
    grams = queries.filter((size > 0) & (size <= RARE_LENGTH)).select(F.col("query").alias("item"))
    whole = first_places(grams, places, "_text", index).withColumnRenamed("item", "query")
    named = queries.filter(size > RARE_LENGTH)
    asked = stored(named.select("query", F.explode(query_grams(F.array("query"))).alias("item")), "query-grams")
    index = index or gram_index(places, "_text", asked.select("item").distinct())
    chosen = stored(rarest(asked, index.counts, ["query"]), "rarest-grams")
    found = first_containing(chosen, index, places, "_text", ["query"], lambda t: F.contains(t, F.col("query")), 1)
    overall = queries.filter(F.col("query") == "").withColumn("rank", places.agg(F.min("place")).scalar())
    hits = whole.unionByName(found).unionByName(overall.filter(F.col("rank").isNotNull()))
    return hits.select("query", F.col("rank.k").alias(key))


def _lookup(
    requests: DataFrame, column: str, prepare: Callable[[str], Column], parcels: DataFrame, owners: DataFrame | None,
    text: Column, key: str, number: str, payload: Sequence[str], index: ListIndex | None,
) -> DataFrame:
    queries = stored(requests.filter(F.col(column).isNotNull()).select(prepare(column).alias("query")).distinct(), "queries")
    texts = parcels.withColumn("_text", text)
    hits = _first_containing(queries, texts, key, number, index)
    rows = parcels.select(*dict.fromkeys([key, number, *payload]))
    found = hits.join(rows, key).select("query", *rows.columns)
    if owners is None:
        return found
    # Only the winning parcels meet the owners; the lowest name if several are primary.
    primary = owners.filter(F.col("IsPrimary").cast("int") == 1)
    one = primary.groupBy(key).agg(F.min("OwnerName").alias("owner_name"))
    return found.join(one, key, "left").select("query", *rows.columns, "owner_name")


def parcel_by_address(
    requests: DataFrame,
    parcels: DataFrame,
    owners: DataFrame | None = None,
    address: str = "address",
    situs: str = "situs_address",
    key: str = "pid",
    number: str = "pid",
    payload: Sequence[str] = ("situs_address", "city", "state", "zip_code"),
    ignore_case: bool = True,
    index: ListIndex | None = None,
) -> DataFrame:
    """Per distinct query (trimmed, upper case), the parcel with the lowest number whose situs
    address contains it, with its primary owner. Queries without a hit give no row. ``index`` is one
    of the same text (:func:`lookup_index`); without it the grams asked for are indexed here."""
    text = F.upper(situs) if ignore_case else F.col(situs)
    return _lookup(requests, address, upper_trim, parcels, owners, text, key, number, payload, index)


def parcel_by_number(
    requests: DataFrame,
    parcels: DataFrame,
    owners: DataFrame | None = None,
    parcel_number: str = "parcel_number",
    key: str = "pid",
    number: str = "pid",
    payload: Sequence[str] = ("situs_address", "city", "state", "zip_code"),
    normalize_stored: bool = False,
    index: ListIndex | None = None,
) -> DataFrame:
    """As :func:`parcel_by_address`, on the parcel number. Hyphens are removed from the query;
    ``normalize_stored`` removes them from the stored number too."""
    text = normalize_parcel_number(number) if normalize_stored else F.upper(number)
    return _lookup(requests, parcel_number, normalize_parcel_number, parcels, owners, text, key, number, payload, index)


def parcel_search(
    requests: DataFrame,
    parcels: DataFrame,
    address: str = "address",
    limit: int = SEARCH_LIMIT,
    ignore_case: bool = True,
) -> DataFrame:
    """First ``limit`` parcels per query whose ``number street, city, state`` text contains the
    query's words in order, sorted by number, street, parcel id."""
    queries = stored(requests.filter(F.col(address).isNotNull()).select(F.col(address).alias("query")).distinct(), "queries")
    full = format_situs("street_number", "street_name", "city", "state")
    texts = parcels.select(
        "pid", "street_number", "street_name", "city", "state", "zip_code", full.alias("full_address")
    ).withColumn("_text", F.upper("full_address") if ignore_case else F.col("full_address"))
    asked = F.upper("query") if ignore_case else F.col("query")
    # Wildcard characters in the query are literal; each space stands for any text.
    literal = F.regexp_replace(asked, r"([\\%_])", r"\\$1")
    queries = queries.withColumn("_pattern", F.concat(F.lit("%"), F.replace(literal, F.lit(" "), F.lit("%")), F.lit("%")))
    words = F.filter(F.split(asked, " "), lambda w: w != "")
    columns = ["pid", "street_number", "street_name", "city", "state", "zip_code", "full_address"]
    order = ["street_number", "street_name", "pid"]
    places = texts.select(F.struct(*order).alias("place"), "_text")
    # A query's word lies within one word of a text, so it is looked up among the distinct words.
    spelled = stored(queries.filter(F.size(words) > 0).select("query", "_pattern", F.explode(F.array_distinct(words)).alias("word")), "query-words")
    index = word_index(places, "_text")
    known = gram_join(spelled.select("word").distinct(), index.counts.select("item"), F.col("word"), "item", lambda item: F.contains(item, F.col("word")))
    known = stored(known, "known-words")
    every = spelled.join(known, "word", "left")
    chosen = rarest(every, index.counts, ["query", "_pattern"], "word").join(known, "word").select("query", "_pattern", "item")
    found = first_containing(stored(chosen, "rarest-words"), index, places, "_text", ["query", "_pattern"], lambda t: F.like(t, F.col("_pattern")), limit)
    pairs = found.select("query", F.col("rank.pid").alias("pid")).join(texts.drop("_text"), "pid").select("query", *columns)
    # A query without words matches every parcel; a constant number of rows answers it.
    head = texts.orderBy(*order).limit(limit).agg(F.collect_list(F.struct(*columns))).scalar()
    open_hits = (
        queries.filter(F.size(words) == 0)
        .select("query", F.explode(head).alias("c"))
        .select("query", *[F.col(f"c.{c}").alias(c) for c in columns])
    )
    return pairs.unionByName(open_hits)


def parcel_exact(requests: DataFrame, parcels: DataFrame, pid: str = "pid") -> DataFrame:
    """One parcel per distinct requested id, with its ``full_address`` text."""
    asked = requests.filter(F.col(pid).isNotNull()).select(F.col(pid).alias("pid")).distinct()
    full = format_situs("street_number", "street_name", "city", "state").alias("full_address")
    rows = parcels.select("pid", "street_number", "street_name", "city", "state", "zip_code", full)
    return first_per_key(rows.join(asked, "pid", "left_semi"), ["pid"], [F.col("full_address")], 1)


def latest_assessment(accounts: DataFrame, assessments: DataFrame, key: str = "PersonalPropertyID") -> DataFrame:
    """Accounts with their assessment of the latest year found in the whole assessment table."""
    latest = assessments.agg(F.max("AssessmentYear")).scalar()
    current = assessments.filter(F.col("AssessmentYear") == latest).select(key, "AssessmentYear", "AssessedValue")
    return accounts.join(current, key, "left")
