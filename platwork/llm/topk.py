"""Exact top-k by inner product with the threshold algorithm over sorted per-dimension lists.

Method: vectors are dealt into blocks of a bounded number of rows; a block keeps, for each
dimension, its rows in the order of that component. For a query the lists of all dimensions are
read in parallel, best contribution first; a row met for the first time in any list is scored in
full. The sum of the contributions at the depth read so far bounds every row not met yet, and
reading stops once that bound is below the k-th score. The results of the blocks are merged by
rank. Queries visit the blocks in small groups, so no task holds more than one block and one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platwork.llm.common import stored, table

BLOCK = 4096
QUERIES = 64
FIRST_DEPTH = 8


def threshold_top(query: np.ndarray, rows: np.ndarray, order: np.ndarray, ids: np.ndarray, skip: int, k: int) -> tuple[list[int], int]:
    """Positions of the ``k`` best rows (score, then smaller id) but ``skip``, and the depth read.

    ``rows`` is n x d, ``order`` d x n: positions by ascending component.
    """
    n = len(rows)
    rising, falling = np.flatnonzero(query < 0), np.flatnonzero(query > 0)
    if not len(rising) + len(falling):
        best = np.argsort(ids, kind="stable")
        return [int(i) for i in best if i != skip][:k], 0
    # A row is new until some list has shown it.
    new, met = np.zeros(n, bool), np.zeros(n, bool)
    if skip >= 0:
        met[skip] = True
    top, scores = np.empty(0, np.int64), np.empty(0)
    depth, further = 0, max(FIRST_DEPTH, n // 32)
    while depth < n:
        end = min(n, further)
        new[order[rising, depth:end]] = True
        new[order[falling, n - end : n - depth]] = True
        new &= ~met
        fresh = np.flatnonzero(new)
        met |= new
        # Many new rows are scored where they lie; a copy of them would cost more.
        found = rows[fresh] @ query if 4 * len(fresh) < n else (rows @ query)[fresh]
        if len(top) == k:
            better = found >= scores[-1]
            fresh, found = fresh[better], found[better]
        elif len(fresh) > 4 * k:
            better = found >= np.partition(found, len(found) - k)[len(found) - k]
            fresh, found = fresh[better], found[better]
        top, scores = np.r_[top, fresh], np.r_[scores, found]
        best = np.lexsort((ids[top], -scores))[:k]
        top, scores = top[best], scores[best]
        depth, further = end, 2 * end
        bound = rows[order[rising, end - 1], rising] @ query[rising] + rows[order[falling, n - end], falling] @ query[falling]
        # A row of the same score but a smaller id could still come: stop below, not at, the bound.
        if len(top) == k and bound < scores[-1] or met.all():
            break
    return top.tolist(), depth


def whole_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding",
    block: int = BLOCK, queries: int = QUERIES,
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query row's ``k`` best other rows, ties to the smaller id.

    Rows whose id or vector is null, or whose vector holds a null or non-finite component, take no
    part. Vectors of different lengths do not meet. A query that meets fewer than ``k`` rows gets
    them all; repeated rows are rows of their own. Scores are exact while they stay below 2^53.
    """
    usable = F.col(vector).isNotNull() & F.col(key).isNotNull() & ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    chosen = vectors.filter(F.coalesce(usable, F.lit(False)))
    held = stored(
        chosen.select(F.col(key).cast("long").alias("id"), whole_components(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")),
        "vectors",
    ).withColumn("row", F.monotonically_increasing_id())
    count = held.count()
    blocks = max(1, ceil(count / block))
    # Row numbers start anew in every input partition: both parts of them are mixed.
    dealt = held.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))

    def packed(group: pa.Table) -> pa.Table:
        ids, numbers = group.column("id").to_numpy(), group.column("row").to_numpy()
        by_length: dict[int, list[int]] = {}
        values = group.column("v").to_pylist()
        for i, v in enumerate(values):
            by_length.setdefault(len(v), []).append(i)
        out = []
        for length, spots in by_length.items():
            rows = np.array([values[i] for i in spots], np.int64).reshape(len(spots), length)
            own = ids[spots]
            order = np.argsort(rows, axis=0, kind="stable").T.astype(np.int32)
            out.append((group.column("block")[0].as_py(), length, own.tobytes(), numbers[spots].tobytes(), rows.tobytes(), order.tobytes()))
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["block", "length", "ids", "numbers", "rows", "lists"])

    shape = "block int, length int, ids binary, numbers binary, rows binary, lists binary"
    index = dealt.select("block", "id", "row", "v").groupBy("block").applyInArrow(packed, shape)
    asked = dealt.filter("asks").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(1, ceil(count / queries)))).cast("int"))
    groups = asked.select("block", "id", "row", "v").groupBy("block").applyInArrow(packed, shape)
    visits = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("lists", F.lit(None).cast("binary"))
    stream = index.withColumn("kind", F.lit(0)).unionByName(visits.withColumn("kind", F.lit(1)))
    placed = stream.repartition(blocks, "block").sortWithinPartitions("block", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("block", "kind", "length", "ids", "numbers", "rows", "lists")}
                if r["block"] != at:
                    at, parts = r["block"], {}
                d = r["length"]
                ids, numbers = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["numbers"], np.int64)
                rows = np.frombuffer(r["rows"], np.int64).reshape(len(ids), d).astype(np.float64)
                if r["kind"] == 0:
                    parts[d] = ids, {n: j for j, n in enumerate(numbers.tolist())}, rows, np.frombuffer(r["lists"], np.int32).reshape(d, len(ids))
                elif d in parts:
                    have, places, own, order = parts[d]
                    # Whole numbers this small are summed exactly in 32-bit floats too.
                    if d and np.abs(own).max() * np.abs(rows).max() * d < 1 << 24:
                        own, rows = own.astype(np.float32), rows.astype(np.float32)
                    out = []
                    for q, number, x in zip(ids.tolist(), numbers.tolist(), rows):
                        best, _ = threshold_top(x, own, order, have, places.get(number, -1), k)
                        out += [(q, number, int(have[b]), int(s)) for b, s in zip(best, (own[best] @ x).tolist())]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["query_id", "number", "vec_id", "score"])

    found = placed.mapInArrow(search, "query_id long, number long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "number").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
