"""Sorted lists read in blocks, so that the first hits of a query end its reading.

A list (the texts of a street, the postings of a gram) is cut into blocks of its order. A query
knows of each block the best rank a hit in it can have. Blocks are read by rank, a growing number
per round; once a query has its ``n`` hits, blocks that cannot beat the last one stay unread.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platwork.session import stored

BLOCK_ROWS = 64
# Blocks that a query reads in the first round, and how many times as many in each later one. All
# blocks that may hold a better hit are read in the end.
FIRST_BLOCKS, GROWTH = 8, 8


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of each key. The rank limit also runs before the shuffle, so a hot key
    sends at most ``n`` rows per input task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def ordered_blocks(rows: DataFrame, keys: Sequence[str], order: str, payload: Sequence[str] = (), size: int = BLOCK_ROWS) -> DataFrame:
    """(keys, block, first, entries): the rows of each list in blocks of at most ``size``, by ``order``.

    ``entries`` are structs of order and payload, ``first`` is the lowest order among them. Rows
    are dealt by ranges of list and order, so a long list lies in several tasks, and blocks end
    where a range ends.
    """
    dealt = rows.select(*keys, order, *payload).repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id())
    held = stored(dealt, "ranges")
    number = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(order))
    block = F.col("_part").cast("long") * F.lit(1 << 40) + F.floor((number - 1) / size).cast("long")
    cut = held.withColumn("block", block)
    entry = F.struct(order, *payload)
    return cut.groupBy(*keys, "block").agg(F.min(order).alias("first"), F.sort_array(F.collect_list(entry)).alias("entries"))


def first_hits(
    open_blocks: DataFrame,
    read: Callable[[DataFrame], DataFrame],
    query: Sequence[str],
    n: int,
    first_blocks: int = FIRST_BLOCKS,
    growth: int = GROWTH,
) -> DataFrame:
    """The first ``n`` hits of each query by ``rank``.

    ``open_blocks`` has the query's columns, ``rank``, the lowest rank that a hit in the block can
    have, and what names the block; it is read twice. ``read`` makes hits of some of its rows: the query's columns,
    ``rank`` and what else is wanted; a hit met in two blocks counts once. The result is exact; reading ends for a query when the best
    open block ranks behind its last hit.
    """
    named = [c for c in open_blocks.columns if c not in query and c != "rank"]
    place = F.struct("rank", *named)
    waiting, best, take = open_blocks, None, first_blocks
    while True:
        taken = stored(first_per_key(waiting, query, [place], take), "taken")
        found = read(taken)
        pool = found if best is None else best.unionByName(found)
        best = stored(first_per_key(pool.distinct(), query, [F.col("rank")], n), "hits")
        done = taken.groupBy(*query).agg(F.max(place).alias("_done"))
        full = best.groupBy(*query).agg(F.max("rank").alias("_last"), F.count("*").alias("_n")).filter(F.col("_n") >= n).drop("_n")
        rest = waiting.join(done, list(query)).filter(place > F.col("_done")).join(full, list(query), "left")
        waiting = stored(rest.filter(F.col("_last").isNull() | (F.col("rank") < F.col("_last"))).select(*open_blocks.columns), "open")
        if waiting.isEmpty():
            return best
        take *= growth
