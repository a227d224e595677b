"""Settings tables keyed by category and name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platwork.operators.clean import blank

KEY = ["category", "name"]


def category_filter(settings: DataFrame, category: str | None = None) -> DataFrame:
    return settings.filter(F.col("category") == category) if category else settings


def existing_key_count(settings: DataFrame, requests: DataFrame) -> DataFrame:
    """How many settings rows each distinct requested key has (0 when absent)."""
    counts = settings.groupBy(*KEY).agg(F.count("*").alias("n"))
    asked = requests.select(*KEY).distinct()
    return asked.join(counts, KEY, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def settings_rows(settings: DataFrame, order: str) -> DataFrame:
    """One row per key: where a key repeats, the row last by ``order`` stands."""
    last = F.max_by(F.struct("value", "description"), order).alias("s")
    return settings.groupBy(*KEY).agg(last).select(*KEY, "s.value", "s.description")


def settings_map(settings: DataFrame, order: str, requests: DataFrame) -> DataFrame:
    """The map from name to (value, description) of each requested ``category``, names in order.

    A map is one value of one row, so it is made for categories that are asked for; whole tables
    are read as rows with :func:`settings_rows`, which has the same content.
    """
    rows = settings_rows(settings.join(requests.select("category").distinct(), "category", "left_semi"), order)
    entries = F.array_sort(F.collect_list(F.struct("name", F.struct("value", "description").alias("setting"))))
    return rows.groupBy("category").agg(F.map_from_entries(entries).alias("settings"))


def upsert_keyed(settings: DataFrame, updates: DataFrame, order: str) -> DataFrame:
    """The next version of the table after applying ``updates`` in ``order``.

    An update replaces the value, and the description only if it brings a non-empty one. A new
    key gets its first description, or ``"<category> - <name>"``.
    """
    given = F.when(~blank(F.col("description")), F.col(order))
    last = updates.groupBy(*KEY).agg(
        F.max_by("value", order).alias("_value"),
        F.max_by("description", given).alias("_description"),
        F.lit(True).alias("_new"),
    )
    merged = settings.withColumn("_old", F.lit(True)).join(last, KEY, "full")
    default = F.concat(F.col("category"), F.lit(" - "), F.col("name"))
    return merged.select(
        *KEY,
        F.when(F.col("_new"), F.col("_value")).otherwise(F.col("value")).alias("value"),
        F.coalesce("_description", F.when(F.col("_old"), F.col("description")).otherwise(default)).alias("description"),
    )


def insert_if_absent(settings: DataFrame, additions: DataFrame, order: str) -> DataFrame:
    """The next version of the table: keys not present yet are added with a standard description.

    Of several additions of one key the first by ``order`` counts.
    """
    firsts = additions.groupBy(*KEY).agg(F.min_by("value", order).alias("value"))
    new = firsts.join(settings, KEY, "left_anti").select(
        *KEY, "value", F.concat(F.col("category"), F.lit(" - "), F.col("name"), F.lit(" setting")).alias("description")
    )
    return settings.select(*KEY, "value", "description").unionByName(new)
