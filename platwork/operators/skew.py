"""Equi-joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot above 1/SHARE of all rows, so there are at most SHARE hot keys (their shares add up
# to at most one) and at most 2 * SHARE fanned-out copies of them: both small enough to broadcast
# whatever the size of the data.
SHARE = 10_000
# Keys below this many rows are never worth splitting.
FLOOR = 200_000


def hot_keys(counts: DataFrame, keys: Sequence[str], weight: str, share: int = SHARE, floor: int = FLOOR) -> DataFrame:
    """Keys to split and the number of pieces ``_fan`` each needs.

    ``counts`` holds one row per key with ``weight`` rows behind it. The total is read once as a
    scalar subquery.
    """
    total = counts.agg(F.sum(weight)).scalar()
    rows = F.col(weight)
    return (
        counts.filter((rows > floor) & (rows * share > total))
        .select(*keys, F.ceil(rows * share / total).cast("int").alias("_fan"))
    )


def salted_join(
    fact: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    counts: DataFrame,
    weight: str,
    how: str = "inner",
    usable: Column | None = None,
    share: int = SHARE,
    floor: int = FLOOR,
) -> DataFrame:
    """``fact`` inner or left joined to ``dim`` on ``keys``, hot keys cut into pieces.

    Rows of a hot key are spread by the number of their input partition, which a retried task
    reproduces, and which also separates identical copies of a row. The matching ``dim`` rows are
    repeated once per piece. Fact rows without a usable key (``usable`` false, or a null key)
    cannot match; they are spread the same way instead of meeting in the partition of null.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"Unsupported join type: {how}")
    hot = F.broadcast(hot_keys(counts, keys, weight, share, floor))
    part = F.spark_partition_id()
    ok = F.lit(True) if usable is None else F.coalesce(usable, F.lit(False))
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    if how == "inner":
        spread = fact.filter(ok).withColumn("_part", part)
        salt = F.coalesce(F.pmod("_part", "_fan"), F.lit(0))
        keyed = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    else:
        spread = fact.withColumn("_part", part).withColumn("_ok", ok)
        salt = F.when(F.col("_ok"), F.coalesce(F.pmod("_part", "_fan"), F.lit(0))).otherwise(F.col("_part"))
        keyed = [F.when(F.col("_ok"), F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)]
    left = spread.join(hot, list(keys), "left").select(*fact.columns, *keyed, salt.alias("_salt"))
    pieces = F.explode(F.sequence(F.lit(0), F.coalesce("_fan", F.lit(1)) - 1))
    right = (
        dim.join(hot, list(keys), "left")
        .withColumn("_salt", pieces)
        .withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
        .drop("_fan")
    )
    on = [f"_k{i}" for i in range(len(keys))] + ["_salt"]
    return left.join(right, on, how).drop(*on)
