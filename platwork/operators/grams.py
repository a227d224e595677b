"""Substring joins by n-gram blocking: which texts contain which queries.

A ``contains`` condition alone is a nested loop. Here a query is looked up by its opening gram
among the grams of the texts, an equi-join, and the pair is then verified on the whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platwork.operators.blocks import first_hits, ordered_blocks
from platwork.session import stored

# Gram lengths. A query uses the longest one that fits: at least half of it, up to the longest.
GRAM_SIZES = (1, 2, 4, 8, 16, 32)

# A gram may occur in a large share of the texts. Its texts are spread over this many pieces and
# each query is repeated once per piece: queries are one row each against dozens of grams per
# text, so the repetition stays below the size of the other side. What is still uneven after that
# is left to the adaptive skew join.
PIECES = 16


def gram_size(text: Column) -> Column:
    """Longest gram length that fits ``text``; 0 for empty text."""
    chain = F.when(F.length(text) >= GRAM_SIZES[-1], GRAM_SIZES[-1])
    for size in reversed(GRAM_SIZES[:-1]):
        chain = chain.when(F.length(text) >= size, size)
    return chain.otherwise(0)


def opening_gram(text: Column) -> Column:
    return F.substring(text, F.lit(1), gram_size(text))


def text_grams(text: Column) -> Column:
    """Distinct grams of every length, as an array; its size is linear in the text's length."""
    length = F.length(text)
    sizes = F.filter(F.array(*[F.lit(s) for s in GRAM_SIZES]), lambda s: s <= length)
    per_size = F.transform(
        sizes, lambda s: F.transform(F.sequence(F.lit(1), length - s + 1), lambda i: F.substring(text, i, s))
    )
    return F.array_distinct(F.flatten(per_size))


def gram_join(
    queries: DataFrame,
    texts: DataFrame,
    anchor: Column,
    text: str,
    verify: Callable[[Column], Column],
    equal: Sequence[str] = (),
    pieces: int = PIECES,
) -> DataFrame:
    """Rows of ``queries`` with rows of ``texts`` for which ``verify(text)`` holds.

    ``anchor`` is a non-empty piece of each query that ``verify`` implies to be part of the text;
    ``equal`` names columns that must agree on both sides. Text rows come along as they are, so
    callers pass only the columns they need. A pair comes out once.
    """
    keys = [*equal, "_gram", "_piece"]
    asked = queries.withColumn("_gram", opening_gram(anchor)).withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))
    )
    columns = texts.columns
    spread = texts.withColumn("_piece", F.pmod(F.xxhash64(*columns), F.lit(pieces)).cast("int"))
    postings = spread.select(*columns, "_piece", F.explode(text_grams(F.col(text))).alias("_gram"))
    return postings.join(asked, keys).filter(verify(F.col(text))).drop("_gram", "_piece")


# Longest gram of the rarest-gram join. A word of at most this length is one gram, so the list of
# that gram holds the texts that contain it and no others.
RARE_LENGTH = 8
RARE_SIZES = tuple(range(1, RARE_LENGTH + 1))


def _rare_size(text: Column) -> Column:
    return F.least(F.length(text), F.lit(RARE_LENGTH))


def _grams_of(text: Column, size: Column) -> Column:
    """All grams of one length; none where the text is shorter."""
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, size))).otherwise(
        F.array().cast("array<string>")
    )


def query_grams(words: Column) -> Column:
    """The distinct grams that a text with all of a query's ``words`` must have."""
    return F.array_distinct(F.flatten(F.transform(words, lambda w: _grams_of(w, _rare_size(w)))))


@dataclass(frozen=True)
class ListIndex:
    """An inverted index: ``postings`` (item, place) of the texts' grams or words, and ``counts``
    (item, n). A place is the struct that orders a text's row and ends in its key."""

    postings: DataFrame
    counts: DataFrame

    def blocks(self, items: DataFrame) -> DataFrame:
        """The lists of ``items`` in blocks of their order."""
        return stored(ordered_blocks(self.postings.join(items, "item", "left_semi"), ["item"], "place"), "blocks")


def _indexed(postings: DataFrame, wanted: DataFrame | None) -> ListIndex:
    if wanted is None:
        held = stored(postings.repartitionByRange("item", "place").sortWithinPartitions("item", "place"), "postings")
    else:
        held = stored(postings.join(wanted, "item", "left_semi"), "postings")
    return ListIndex(held, stored(held.groupBy("item").agg(F.count("*").alias("n")), "posting-counts"))


def gram_index(texts: DataFrame, text: str, wanted: DataFrame | None = None) -> ListIndex:
    """The grams of ``texts`` (``place`` and ``text``; null has none), made once.

    ``wanted`` (item) keeps only what some query asks for, and only grams of such lengths are made.
    Without it the index holds all grams, its files sorted by gram and place, and serves any number
    of lookups.
    """
    return _indexed(_gram_postings(texts, text, wanted), wanted)


def _gram_postings(texts: DataFrame, text: str, wanted: DataFrame | None) -> DataFrame:
    lengths = RARE_SIZES if wanted is None else [r[0] for r in wanted.select(F.length("item")).distinct().collect()]
    sizes = F.flatten(F.array(*[_grams_of(F.col(text), F.lit(s)) for s in lengths] or [F.array().cast("array<string>")]))
    # A text becomes many rows here, so the texts of a few large files are spread evenly first.
    known = texts.filter(F.col(text).isNotNull()).select("place", text).repartition("place")
    return known.select("place", F.explode(F.array_distinct(sizes)).alias("item"))


def first_places(wanted: DataFrame, texts: DataFrame, text: str, index: ListIndex | None = None) -> DataFrame:
    """(item, rank): the lowest place of the texts that contain the gram, per distinct ``wanted`` (item).

    One grouping of the grams of the lengths asked for, or of the ``index``; no list is read.
    """
    postings = _gram_postings(texts, text, wanted) if index is None else index.postings
    return postings.join(wanted, "item", "left_semi").groupBy("item").agg(F.min("place").alias("rank"))


def word_index(texts: DataFrame, text: str, wanted: DataFrame | None = None) -> ListIndex:
    """As :func:`gram_index`, of the words between spaces."""
    words = F.array_distinct(F.filter(F.split(F.col(text), " "), lambda w: w != ""))
    return _indexed(texts.filter(F.col(text).isNotNull()).select("place", F.explode(words).alias("item")), wanted)


def rarest(asked: DataFrame, counts: DataFrame, query: Sequence[str], choice: str = "item") -> DataFrame:
    """Per query the one ``choice`` (of rows query, choice, item) whose items have the fewest postings."""
    if choice == "item":
        known = asked.join(counts, "item", "left")
        return known.groupBy(*query).agg(F.min_by("item", F.struct(F.coalesce("n", F.lit(0)), "item")).alias("item"))
    sums = asked.join(counts, "item", "left").groupBy(*query, choice).agg(F.sum(F.coalesce("n", F.lit(0))).alias("_n"))
    return sums.groupBy(*query).agg(F.min_by(choice, F.struct("_n", choice)).alias(choice))


def first_containing(
    lists: DataFrame, index: ListIndex, texts: DataFrame, text: str, query: Sequence[str], verify: Callable[[Column], Column], n: int
) -> DataFrame:
    """Per query (``lists`` has its columns and the items to read) the first ``n`` places whose text
    passes ``verify``, as ``rank``.

    The lists are read block by block in their order, and no further than the ``n``-th hit. Texts
    are fetched for the places read, not carried in the lists.
    """
    blocks = index.blocks(lists.select("item").distinct())
    open_blocks = lists.join(blocks.select("item", "block", "first"), "item").select(*query, F.col("first").alias("rank"), "item", "block")
    held = texts.select(F.col("place").alias("rank"), text)

    def read(taken: DataFrame) -> DataFrame:
        met = taken.drop("rank").join(blocks, ["item", "block"]).select(*query, F.explode("entries.place").alias("rank"))
        return met.join(held, "rank").filter(verify(F.col(text))).select(*query, "rank")

    return first_hits(open_blocks, read, query, n)


def rare_gram_join(
    queries: DataFrame, texts: DataFrame, words: Column, text: str, verify: Callable[[Column], Column]
) -> DataFrame:
    """As :func:`gram_join`, looking each query up by the rarest gram of all its ``words``.

    ``words`` is an array of non-empty pieces that ``verify`` implies to be parts of the text. Grams
    that any query asks for are counted over the texts first; a query is then joined under its
    rarest one only, and only texts holding such a gram leave their task. A query one of whose grams
    occurs nowhere has no pairs.
    """
    asked = queries.select(*queries.columns, F.explode(query_grams(words)).alias("item"))
    placed = texts.withColumn("place", F.struct(*texts.columns))
    index = gram_index(placed, text, asked.select("item").distinct())
    chosen = stored(rarest(asked, index.counts, queries.columns), "rarest-grams")
    return index.postings.join(chosen, "item").select("place.*", *queries.columns).filter(verify(F.col(text)))
