"""How document filters interact, audited by incremental retraction streaming.

Method. The files of the document table are processed as available-now micro-batches. A document's
own filters give a mask; whether it repeats a document of a smaller id depends on all files, so a
state keyed by the text's digest, in buckets of some hundred texts, holds the smallest id met so far,
with what was counted for it.
When a smaller id arrives, the earlier document's mask is taken back from its part's counters and
counted anew as a repeat. A micro-batch adds its changes to the counters as a folder of its own, which
a retried batch replaces. The sums of all batches, 32 masks per part, give every order of the filters.

Before the shuffle each task keeps the smallest id of a text among the rows it has at hand and counts
the others as repeats, so a text of very many copies sends a few rows per task.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import permutations
from math import ceil

import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from platwork.llm.common import raw_bytes, slices, table
from platwork.session import shared_dir

FILTERS = "ABCDE"
# Fixed values of the filters: fewest words, distinct words and upper-case letters in percent, marks.
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, MARKS = 200, 50, 2, b"#$%&*|"
UPPER = bytes(range(65, 91))
REPEAT = 1 << FILTERS.index("E")
# Texts in one state, by the table's rows, and micro-batches of a run where files are many.
TEXTS_PER_STATE, MOST_BATCHES = 512, 16
# A text's smallest id so far and what its rows were counted as.
HELD = pa.schema(
    [("text_key", pa.binary()), ("least", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("good", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64())]
)
COUNTED = "part string, mask int, good int, toxic int, delta long"
COUNTERS = "part string, mask int, rows long, good long, toxic long"


def own_failures(text: bytes, points: int) -> int:
    """The bits of the filters A to D that a text of ``points`` code points fails."""
    words = text.split()
    upper = len(text) - len(text.translate(None, UPPER))
    failed = (
        len(words) < LEAST_WORDS, 100 * len(set(words)) < DISTINCT_PERCENT * len(words),
        100 * upper > UPPER_PERCENT * points, len(text.translate(None, MARKS)) < len(text),
    )
    return sum(f << i for i, f in enumerate(failed))


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text_key, mask) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (s for batch in batches for s in slices(batch, "text")):
            texts = raw_bytes(part.column("text"))
            points = pa.compute.utf8_length(part.column("text").cast(pa.string())).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("part"), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                    pa.array(map(own_failures, texts, points), pa.int32()),
                ],
                ["doc_id", "part", "text_key", "mask"],
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, text_key binary, mask int")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """With ``good`` and ``toxic``, 1 where a label of the id says so. Rows without an id are dealt by text."""
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias("good" if c == "quality" else c)
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(flag("quality"), flag("toxic"))
    known = known.withColumn("_salt", F.lit(0).cast("long"))
    salted = rows.withColumn("_salt", F.when(F.col("doc_id").isNull(), F.xxhash64("text_key")).otherwise(F.lit(0).cast("long")))
    met = salted.join(known, (F.col("doc_id") == F.col("_id")) & (salted["_salt"] == known["_salt"]), "left")
    return met.select("doc_id", "part", "text_key", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def combined(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, text_key, least, part, mask, good, toxic, n): per Arrow batch the smallest id of each
    text, in the text's bucket, and, without a text, counters of all other rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[bytes, tuple[int, Counter]] = {}
            counted: Counter = Counter()
            for number, part, key, mask, good, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                about = (part, mask, good, toxic)
                if number is None:
                    counted[about] += 1
                    continue
                least, held = first.get(key, (number, None))
                if held is None:
                    first[key] = number, Counter({about: 1})
                elif number == least:
                    held[about] += 1
                elif number > least:
                    counted[_repeat(about)] += 1
                else:
                    for other, n in held.items():
                        counted[_repeat(other)] += n
                    first[key] = number, Counter({about: 1})
            out = [(int.from_bytes(key[:8]) % buckets, key, least, *about, n) for key, (least, held) in first.items() for about, n in held.items()]
            out += [(i % buckets, None, 0, *about, n) for i, (about, n) in enumerate(counted.items())]
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 8, kinds)], ["bucket", *HELD.names])

    return rows.mapInArrow(run, "bucket long, text_key binary, least long, part string, mask int, good int, toxic int, n long")


def _repeat(about: tuple) -> tuple:
    return about[0], about[1] | REPEAT, *about[2:]


def changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What a bucket's new rows change in the counters. The state holds, per text, its smallest id
    and what that id's rows were counted as."""
    out: Counter = Counter()
    texts: dict[bytes, tuple[int, Counter]] = {}
    if state.exists:
        with pa.ipc.open_stream(state.get[0]) as held:
            for text, least, *about, n in zip(*(c.to_pylist() for c in held.read_all().columns)):
                texts.setdefault(text, (least, Counter()))[1][tuple(about)] = n
    for frame in frames:
        for text, number, *about, n in frame[HELD.names].itertuples(index=False, name=None):
            about = tuple(about)
            if text is None:
                out[about] += n
                continue
            least, first = texts.get(text, (None, None))
            if least is None or number < least:
                # Counted as the first of its text so far, now taken back.
                for was, m in (first or {}).items():
                    out[was] -= m
                    out[_repeat(was)] += m
                texts[text] = number, Counter({about: n})
                out[about] += n
            elif number == least:
                first[about] += n
                out[about] += n
            else:
                out[_repeat(about)] += n
    rows = [(text, int(least), *about, int(n)) for text, (least, first) in texts.items() for about, n in first.items()]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, HELD) as stream:
        stream.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 7, HELD)], schema=HELD))
    state.update((sink.getvalue().to_pybytes(),))
    yield pd.DataFrame([(*about, n) for about, n in out.items() if n], columns=["part", "mask", "good", "toxic", "delta"])


def part_counters(
    spark: SparkSession, path: str, labels: DataFrame, files_per_batch: int | None = None, texts_per_state: int = TEXTS_PER_STATE
) -> DataFrame:
    """(part, mask, rows, good, toxic) of all files of the document table at ``path``.

    By default a micro-batch takes one file per core, or a sixteenth of all files if that is more:
    each batch rewrites the state of the texts' buckets that it meets. State, counters and offsets
    lie in the folder of ``spark.checkpoint.dir``; the state store's provider is the session's.
    """
    folder = shared_dir(spark, "audit")
    spark.createDataFrame([], COUNTERS).write.parquet(f"{folder}/counters/batch=-1")
    known = spark.read.parquet(path)
    files = files_per_batch or max(spark.sparkContext.defaultParallelism, ceil(len(known.inputFiles()) / MOST_BATCHES))
    buckets = max(1, ceil(known.count() / texts_per_state))
    # A stream takes a table of a single file only by a pattern; this one matches the path alone.
    whole = path.rstrip("/")
    stream = spark.readStream.schema(known.schema).option("maxFilesPerTrigger", files).parquet(f"{whole[:-1]}[{whole[-1]}]")
    changed = combined(labelled(profiles(stream), labels), buckets).groupBy("bucket").applyInPandasWithState(
        changes, COUNTED, "held binary", "append", "NoTimeout"
    )

    def add(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("part", "mask").agg(
            F.sum("delta").alias("rows"), F.sum(F.col("delta") * F.col("good")).alias("good"), F.sum(F.col("delta") * F.col("toxic")).alias("toxic")
        )
        sums.write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")

    query = (
        changed.writeStream.foreachBatch(add).outputMode("append").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    added = spark.read.schema(COUNTERS).parquet(f"{folder}/counters")
    sums = added.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("rows", "good", "toxic")))
    return sums.filter("rows <> 0")


def audit(counters: DataFrame) -> DataFrame:
    """Per part, order of the filters and step what the step's filter does there."""
    parts = counters.groupBy("part").agg(F.collect_list(F.struct("mask", "rows", "good", "toxic")).alias("masks"))
    orders = F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")
    bit = lambda letter: F.when(letter == "", 0).otherwise(F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord("A")))
    bits = lambda text: F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: a + bit(c))
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    steps = steps.withColumn("own", bits(F.col("letter"))).withColumn("prior", bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)))

    def total(field: str, condition: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.filter("masks", condition), F.lit(0).cast("long"), lambda a, m: a + m[field])

    own, prior = F.col("own"), F.col("prior")
    fails = lambda m: m["mask"].bitwiseAND(own) != 0
    here = lambda m: fails(m) & (m["mask"].bitwiseAND(prior) == 0)
    counted = steps.select(
        "part", "filter_order", "step", "letter",
        total("rows", lambda m: m["mask"].bitwiseAND(own + prior) == 0).alias("kept"),
        total("rows", here).alias("removed"),
        total("rows", lambda m: fails(m) & (m["mask"].bitwiseAND(prior) != 0)).alias("redundant"),
        total("rows", lambda m: m["mask"] == own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
    )
    return counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit_filters(spark: SparkSession, path: str, labels: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """Per part, order of the filters and step (1 to 5): ``kept``, ``removed``, ``redundant``,
    ``unique_fails``, ``good_lost``, ``toxic_lost`` and ``shapley``.

    The Parquet table at ``path`` has doc_id, text and source, ``labels`` has doc_id, quality and toxic.
    A null text is an empty one, a null source the part of the empty name. A row without an id repeats
    nothing and is repeated by nothing; rows of one id do not repeat each other. An id is good (toxic)
    if any of its labels is 1. Other columns are not looked at; an empty table gives no rows. Texts
    are told apart by SHA-256.
    """
    return audit(part_counters(spark, path, labels, files_per_batch))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH marked AS (
    SELECT coalesce(d.source, '') AS part, coalesce(d.text, '') AS t, d.doc_id,
           regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') AS words,
           min(d.doc_id) OVER (PARTITION BY coalesce(d.text, '')) AS least,
           coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
    FROM documents d LEFT JOIN (
        SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
        FROM labels GROUP BY doc_id) l USING (doc_id)),
failed AS (
    SELECT part, good, toxic,
           CASE WHEN len(words) < 200 THEN 1 ELSE 0 END AS a,
           CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 1 ELSE 0 END AS b,
           CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 1 ELSE 0 END AS c,
           CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
           CASE WHEN doc_id > least THEN 1 ELSE 0 END AS e
    FROM marked),
masks AS (
    SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY 1, 2),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, bit)),
orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
    SELECT filter_order, CAST(s AS INTEGER) AS step, bits[s] AS own, coalesce(list_sum(bits[1:s - 1]), 0)::INTEGER AS prior
    FROM orders, range(1, 6) r(s)),
sums AS (
    SELECT part, filter_order, step, own,
           sum(CASE WHEN mask & (own | prior) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
           sum(CASE WHEN mask & own <> 0 AND mask & prior = 0 THEN n ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN mask & own <> 0 AND mask & prior <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN mask & own <> 0 AND mask & prior = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
           sum(CASE WHEN mask & own <> 0 AND mask & prior = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM masks, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM sums
"""
