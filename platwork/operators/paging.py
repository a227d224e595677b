"""Pages of the permit and property tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platwork.operators.lookup import latest_assessment
from platwork.session import stored

PERMIT_PAGE_COLUMNS = (
    "PermitID", "PermitNumber", "IssuedDate", "PermitType", "Description",
    "ProjectAddress", "ParcelID", "ParcelNumber", "Valuation", "Status",
)
PROPERTY_PAGE_COLUMNS = (
    "PersonalPropertyID", "AccountNumber", "BusinessName", "OwnerName",
    "SitusAddress", "SitusCity", "SitusState", "SitusZip",
    "MailingAddress", "MailingCity", "MailingState", "MailingZip",
    "PropertyType", "AssessmentYear", "AssessedValue",
)


@dataclass(frozen=True)
class Key:
    """A column of a page's order. Rising orders begin with nulls, falling ones end with them."""

    name: str
    falling: bool = False

    @property
    def order(self) -> Column:
        return F.col(self.name).desc_nulls_last() if self.falling else F.col(self.name).asc_nulls_first()

    def beyond(self, value) -> Column:
        """Whether the column lies behind ``value``; never null."""
        column = F.col(self.name)
        if self.falling:
            return F.lit(False) if value is None else F.coalesce(column < F.lit(value), F.lit(True))
        return column.isNotNull() if value is None else F.coalesce(column > F.lit(value), F.lit(False))


PERMIT_ORDER = (Key("IssuedDate", falling=True), Key("PermitID"))
PROPERTY_ORDER = (Key("AccountNumber"), Key("PersonalPropertyID"))


def rows_after(df: DataFrame, order: Sequence[Key], values: Sequence) -> DataFrame:
    """The rows behind the one with these values of the order's columns; any of them may be null."""
    behind, same = F.lit(False), F.lit(True)
    for key, value in zip(order, values, strict=True):
        behind = behind | (same & key.beyond(value))
        same = same & F.col(key.name).eqNullSafe(F.lit(value))
    return df.filter(behind)


@dataclass(frozen=True)
class PageIndex:
    """A table sorted by ranges: ``rows`` with their ``_range``, and ``ranges`` (_range, start, n),
    where ``start`` rows lie before a range."""

    rows: DataFrame
    ranges: DataFrame
    order: tuple[Key, ...]


def page_index(df: DataFrame, order: Sequence[Key]) -> PageIndex:
    """The index of a table's pages, written once for any number of them."""
    by = [key.order for key in order]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id())
    rows = stored(dealt, "pages")
    counts = rows.groupBy("_range").agg(F.count("*").alias("n"))
    # One row per range, so the running sum is over a few thousand rows at most.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.select("_range", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return PageIndex(rows, stored(ranges, "page-ranges"), tuple(order))


def seek(index: PageIndex, limit: int, offset: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit``: only the ranges that hold them are read and sorted."""
    inside = (F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset)
    low, high, start = index.ranges.filter(inside).agg(F.min("_range"), F.max("_range"), F.min("start")).first()
    if low is None:
        return index.rows.drop("_range").limit(0)
    rows = index.rows.filter(F.col("_range").between(low, high)).drop("_range")
    return rows.orderBy(*(key.order for key in index.order)).offset(offset - start).limit(limit)


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def _present(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in names if c in df.columns]


def _page_of(df: DataFrame, order: Sequence[Key], limit: int, offset: int, after: tuple | None, index: PageIndex | None) -> DataFrame:
    if index is not None:
        if after is not None:
            raise ValueError("An index seeks an offset; after needs none")
        return seek(index, limit, offset)
    rows = df if after is None else rows_after(df, order, after)
    return page(rows, [key.order for key in order], limit, offset)


def read_permits_page(
    permits: DataFrame, limit: int = 100, offset: int = 0, after: tuple | None = None, index: PageIndex | None = None
) -> DataFrame:
    """Permits, newest first, ties by id.

    ``after`` = (IssuedDate, PermitID) of the last row seen continues from there. It replaces a
    growing offset, whose skipped rows would all have to be sorted again for each page. ``index``
    (:func:`page_index` of the permits by ``PERMIT_ORDER``) finds any offset by counts of ranges.
    """
    found = _page_of(permits, PERMIT_ORDER, limit, offset, after, index)
    return found.select(*_present(found, PERMIT_PAGE_COLUMNS))


def read_property_page(
    accounts: DataFrame, assessments: DataFrame, limit: int = 100, offset: int = 0, after: tuple | None = None,
    index: PageIndex | None = None,
) -> DataFrame:
    """Property accounts by account number with their latest assessment.

    The page is cut before the join, since the join neither adds nor removes accounts as long as
    an account has one assessment per year. ``after`` = (AccountNumber, PersonalPropertyID), and
    ``index`` is one of the accounts by ``PROPERTY_ORDER``.
    """
    cut = _page_of(accounts, PROPERTY_ORDER, limit, offset, after, index)
    full = latest_assessment(cut, assessments)
    return full.select(*_present(full, PROPERTY_PAGE_COLUMNS)).orderBy(*(key.order for key in PROPERTY_ORDER))
