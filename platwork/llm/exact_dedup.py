"""Exact duplicates by composable polynomial fingerprints and chunkwise comparison.

Method: a normalised text is cut into chunks of a fixed number of bytes; each chunk has a
polynomial hash modulo two primes. The hash of a text follows from those of its parts by
length-shifted arithmetic, H(AB) = H(A) * r^|B| + H(B), so the parts of a huge document are hashed
as rows of their own wherever they land and combined afterwards. Texts with equal length and
fingerprint are then compared chunk by chunk: per fingerprint and chunk number the smallest and the
largest chunk must be the same, an aggregate that is combined before the shuffle, so a group of any
size stays even. Should a fingerprint hold different texts, its rows are told apart by the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platwork.llm.common import BLANKS, slices, stored, table
from platwork.operators.skew import salted_join


class Hashing(NamedTuple):
    """Two primes below 2^31, their radixes, and the chunk length in bytes."""

    primes: tuple[int, int] = (2_147_483_647, 2_147_483_629)
    radixes: tuple[int, int] = (1_103_515_245, 1_664_525)
    chunk: int = 1 << 16

    @lru_cache(4)
    def powers(self) -> list[np.ndarray]:
        """r^(chunk-1) ... r^0 for each prime: the weights of a chunk's bytes."""
        out = []
        for p, r in zip(self.primes, self.radixes):
            row = np.ones(self.chunk, np.int64)
            for i in range(1, self.chunk):
                row[i] = int(row[i - 1]) * r % p
            out.append(row[::-1].copy())
        return out


# Documents above this many bytes are cut into rows before they are hashed.
HUGE = 4 << 20
# Bits of the filter that keeps texts without a partner out of the comparison: 4 MB, whatever the data.
FILTER_BITS = 1 << 25
_DROP = bytes(BLANKS, "ascii")


def part_hash(data: bytes, hashing: Hashing, powers: list[np.ndarray]) -> tuple[int, int, int]:
    """(length, hash modulo the first prime, hash modulo the second) of any bytes, chunk by chunk."""
    values = np.frombuffer(data, np.uint8)
    if len(values) <= hashing.chunk:
        # A byte is below 2^8 and a weight below 2^31: the sum over a chunk of 2^16 fits 64 bits.
        own = [int(np.dot(values.astype(np.int64), w[len(w) - len(values) :])) % p for w, p in zip(powers, hashing.primes)]
        return len(values), own[0], own[1]
    whole = (0, 0, 0)
    for at in range(0, len(values), hashing.chunk):
        whole = combine(whole, part_hash(data[at : at + hashing.chunk], hashing, powers), hashing)
    return whole


def combine(a: tuple[int, int, int], b: tuple[int, int, int], hashing: Hashing) -> tuple[int, int, int]:
    """The hash of AB from those of A and B."""
    out = [(x * pow(r, b[0], p) + y) % p for x, y, r, p in zip(a[1:], b[1:], hashing.radixes, hashing.primes)]
    return a[0] + b[0], out[0], out[1]


def normalised(text: Column) -> Column:
    """The text without the characters \\x20 and \\x09 to \\x0D; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _fold(parts: Column, hashing: Hashing) -> Column:
    """(h1, h2) of a text from its parts in order, each with length-shift factors s1 and s2."""
    (p1, p2) = hashing.primes
    start = F.struct(F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"))
    return F.aggregate(
        parts, start,
        lambda a, x: F.struct(
            ((a.h1 * x.s1 + x.h1) % F.lit(p1)).alias("h1"), ((a.h2 * x.s2 + x.h2) % F.lit(p2)).alias("h2")
        ),
    )


def fingerprints(docs: DataFrame, hashing: Hashing = Hashing(), huge: int = HUGE) -> DataFrame:
    """``doc_id``, code points of the text, bytes, fingerprint and SHA-256 of the normalised text, per row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    big = F.octet_length("text") > huge
    small = _hashed(rows.filter(~big), hashing)
    # A huge text travels once, in pieces; its row keeps only what needs the whole text.
    numbered = rows.filter(big).withColumn("_row", F.xxhash64("doc_id", F.sha2("text", 256)))
    step = huge // 4
    pieces = numbered.select(
        "_row", F.posexplode(F.transform(F.sequence(F.lit(0), F.length("text") - 1, F.lit(step)), lambda i: F.substring("text", i + 1, F.lit(step)))).alias("_at", "text")
    ).dropDuplicates(["_row", "_at"])
    parts = _hashed(pieces.repartition("_row", "_at").select(F.struct("_row", "_at").alias("doc_id"), "text"), hashing, sha=False)
    whole = (
        parts.groupBy(F.col("doc_id._row").alias("_row"))
        .agg(F.sort_array(F.collect_list(F.struct("doc_id._at", "h1", "h2", "s1", "s2"))).alias("p"), F.sum("n_bytes").alias("n_bytes"))
        .select("_row", "n_bytes", _fold(F.col("p"), hashing).alias("h"))
        .select("_row", "n_bytes", "h.h1", "h.h2")
    )
    ids = numbered.select("_row", "doc_id", F.length("text").alias("n_chars"), F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    columns = ["doc_id", "n_chars", "n_bytes", "h1", "h2", "text_sha256"]
    return small.select(columns).unionByName(ids.join(whole, "_row").select(columns))


def _hashed(rows: DataFrame, hashing: Hashing, sha: bool = True) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = hashing.powers()
        for batch in batches:
            for part in slices(batch, "text"):
                lengths, h1, h2, s1, s2 = [], [], [], [], []
                for data in part.column("text").to_pylist():
                    n, a, b = part_hash(data.translate(None, _DROP), hashing, powers)
                    lengths.append(n), h1.append(a), h2.append(b)
                    if not sha:
                        s1.append(pow(hashing.radixes[0], n, hashing.primes[0]))
                        s2.append(pow(hashing.radixes[1], n, hashing.primes[1]))
                own = [pa.array(x, pa.int64()) for x in (lengths, h1, h2)]
                if sha:
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), part.column("n_chars"), *own, part.column("text_sha256")],
                        ["doc_id", "n_chars", "n_bytes", "h1", "h2", "text_sha256"],
                    )
                else:
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), *own, pa.array(s1, pa.int64()), pa.array(s2, pa.int64())],
                        ["doc_id", "n_bytes", "h1", "h2", "s1", "s2"],
                    )

    kind = dict(rows.dtypes)["doc_id"]
    raw = F.col("text").cast("binary").alias("text")
    if sha:
        given = rows.select("doc_id", raw, F.length("text").alias("n_chars"), F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
        return given.mapInArrow(run, f"doc_id {kind}, n_chars int, n_bytes long, h1 long, h2 long, text_sha256 string")
    return rows.select("doc_id", raw).mapInArrow(run, f"doc_id {kind}, n_bytes long, h1 long, h2 long, s1 long, s2 long")


KEY = ["n_bytes", "h1", "h2"]


def _spot(n_bytes: Column | int, h1: Column | int, h2: Column | int, bits: int) -> Column | int:
    """The bit of a fingerprint; both hashes are below 2^31 and spread by themselves."""
    return (n_bytes + h1 + h2) % bits


def _filter_bits(shared: DataFrame, bits: int) -> bytes:
    """A bitmap with the bit of every shared fingerprint set; ``bits`` / 8 bytes at most."""
    # The bitmap functions count from 1.
    spot = shared.select((_spot(*map(F.col, KEY), bits) + 1).alias("b"))
    words = spot.groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m"))
    out = bytearray(bits // 8)
    for row in words.toLocalIterator():  # at most bits / 32768 rows
        data = bytes(row["m"])
        at = (row["k"] - 1) * 4096
        out[at : at + len(data)] = data[: len(out) - at]
    return bytes(out)


def differing(docs: DataFrame, shared: DataFrame, hashing: Hashing = Hashing(), bits: int = FILTER_BITS) -> DataFrame:
    """Of the ``shared`` fingerprints those under which the chunks of the texts are not all the same.

    Texts are hashed, filtered and cut in one Python pass: a second one in the same task would be a
    worker of its own for every core, which lives on and keeps its memory in all later stages.
    """
    # The filter is a bitmap of fixed size: a set bit lets a text through, and most texts have no partner.
    kept = _filter_bits(shared, bits)
    bitmap = docs.sparkSession.sparkContext.broadcast(kept)
    chunk = hashing.chunk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, have = hashing.powers(), bitmap.value
        for batch in batches:
            for part in slices(batch, "text"):
                cut = []
                for text in part.column("text").to_pylist():
                    data = text.translate(None, _DROP)
                    key = part_hash(data, hashing, powers)
                    spot = _spot(*key, bits)
                    if have[spot >> 3] >> (spot & 7) & 1:
                        cut += [(*key, i, data[at : at + chunk]) for i, at in enumerate(range(0, len(data), chunk))]
                if cut:
                    kinds = [pa.int64()] * 3 + [pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cut), kinds)], [*KEY, "at", "chunk"])

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    chunks = docs.select(text).mapInArrow(run, "n_bytes long, h1 long, h2 long, at int, chunk binary")
    ranges = chunks.groupBy(*KEY, "at").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b"))
    return ranges.filter("a <> b").select(*KEY).distinct()


def exact_duplicates(
    docs: DataFrame, hashing: Hashing = Hashing(), huge: int = HUGE, bits: int = FILTER_BITS
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal if identical without blanks; null counts as empty, and empty texts are equal to
    each other. Of equal texts the row with the most code points, then the smallest id stays; a
    null id comes last. Of rows equal in both, one is kept. Other columns are not looked at.
    """
    prints = stored(fingerprints(docs, hashing, huge).withColumn("_row", F.monotonically_increasing_id()), "fingerprints")
    best = F.min_by(
        F.struct("doc_id", "_row"), F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "_row")
    ).alias("best")

    def grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count("*").alias("group_size"), best)

    groups = stored(grouped(prints, KEY).filter("group_size > 1"), "groups")
    differ = stored(differing(docs, groups, hashing, bits), "collisions")
    keys = KEY
    if not differ.isEmpty():
        # Rows under these fingerprints are told apart by the texts themselves, named by their digests.
        keys = [*KEY, "_text"]
        told = F.when(F.col("_differs"), F.col("text_sha256")).otherwise("")
        prints = stored(
            prints.join(differ.withColumn("_differs", F.lit(True)), KEY, "left").withColumn("_text", F.coalesce(told, F.lit(""))).drop("_differs"),
            "told",
        )
        groups = stored(grouped(prints, keys).filter("group_size > 1"), "told-groups")
    joined = salted_join(prints, groups, keys, groups.select(*keys, "group_size"), "group_size", "left")
    return joined.select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | (F.col("_row") == F.col("best._row"))).alias("kept"), "text_sha256",
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY plain) AS group_size,
         first_value(doc_id) OVER (PARTITION BY plain ORDER BY length(text) DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM g
"""
