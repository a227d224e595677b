"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays.

Counting: every task turns its training texts into arrays of word hashes and sums equal pairs before
the shuffle; pairs are dealt into buckets by their context, and contexts with more than a bucket's
share of all tokens are spread over several buckets by the following word. A bucket's task merges
its pairs, writes them to the shared folder as arrays sorted by hash, and passes on how many
contexts each word followed, summed per word. Scoring: workers map these files into memory and look
a batch of tokens up at once. Files are written under a temporary name and renamed, and their
content depends on the data only, so a lost task can be run again at any time.

The folder in ``spark.checkpoint.dir`` must be mounted on all machines for that (a file path).
"""

from __future__ import annotations

import mmap
import os
import sys
import tempfile
from collections.abc import Iterator
from functools import lru_cache
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platwork.llm.common import LOWER_ASCII, raw_bytes, slices, table
from platwork.session import shared_dir

BUCKET_BYTES = 12 << 20  # of training text
FLUSH_TOKENS = 3_000_000
MAX_SPREAD = 100_000  # contexts that are spread, at most: those above this share of all tokens
KNOWN_WORDS = 600_000
WORD_MASK = np.uint64((1 << 48) - 1)
BEGIN, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
NUMBERS = ("n1", "n2", "n3", "n4")


class Hashes(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def tokens(self, text: bytes) -> np.ndarray:
        """Hashes of the words with A-Z in lower case, then of the end."""
        words = text.translate(LOWER_ASCII).split()
        out = np.empty(len(words) + 1, np.uint64)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        out[-1] = END
        return out


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """A 64-bit hash of each pair."""
    x = a * np.uint64(0xBF58476D1CE4E5B9) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the position of one of each, and the sum of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    if counts is None:
        sums = np.diff(np.r_[first, len(keys)])
    else:
        sums = np.add.reduceat(counts[order].astype(np.int64), first) if len(keys) else np.empty(0, np.int64)
    return keys[first], order[first], sums


def contexts_of(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of some texts, and what stands before each."""
    after = np.concatenate(tokens)
    before = np.r_[BEGIN, after[:-1]]
    before[np.cumsum([0, *map(len, tokens[:-1])])] = BEGIN
    return before, after


class Layout(NamedTuple):
    """How pairs are dealt: the number of buckets, and the spread contexts with their numbers of pieces."""

    buckets: int
    spread: np.ndarray
    pieces: np.ndarray

    def of_word(self, words: np.ndarray) -> np.ndarray:
        return (mix(words, np.uint64(7)) >> np.uint64(32)) % np.uint64(self.buckets)

    def of_pair(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        piece = np.zeros(len(before), np.uint64)
        if len(self.spread):
            at = np.minimum(np.searchsorted(self.spread, before), len(self.spread) - 1)
            fan = np.where(self.spread[at] == before, self.pieces[at], 1).astype(np.uint64)
            piece = mix(after & WORD_MASK, np.uint64(3)) % fan
        return self.of_word(before + piece * np.uint64(0x2545F4914F6CDD1D))

    def is_spread(self, before: np.ndarray) -> np.ndarray:
        if not len(self.spread):
            return np.zeros(len(before), bool)
        return self.spread[np.minimum(np.searchsorted(self.spread, before), len(self.spread) - 1)] == before


def local_folder(path: str) -> str:
    """The folder as workers open it; any other store than a mounted one is refused."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"Workers map the model into memory, so {path} must be a mounted folder")
    return path


def put(folder: str, name: str, array: np.ndarray) -> None:
    """Write one array; a name is either missing or complete."""
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile(dir=folder, delete=False) as file:
        np.save(file, array)
    os.replace(file.name, os.path.join(folder, f"{name}.npy"))


def put_counts(folder: str, name: str, counts: np.ndarray) -> None:
    """Counts in one byte each; those from 255 on in two short arrays of their own."""
    large = np.flatnonzero(counts >= 255)
    put(folder, f"{name}.c", np.minimum(counts, 255).astype(np.uint8))
    put(folder, f"{name}.at", large.astype(np.int64))
    put(folder, f"{name}.big", counts[large].astype(np.int64))


@lru_cache(8192)
def get(folder: str, name: str) -> np.ndarray | None:
    """An array mapped into memory, or None; the file itself is closed again."""
    try:
        file = open(os.path.join(folder, f"{name}.npy"), "rb")
    except FileNotFoundError:
        return None
    with file:
        np.lib.format.read_magic(file)
        shape, _, kind = np.lib.format.read_array_header_1_0(file)
        size = int(np.prod(shape))
        if not size:
            return np.empty(shape, kind)
        kept = {"trackfd": False} if sys.version_info >= (3, 13) else {}
        return np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, **kept), kind, size, file.tell()).reshape(shape)


def found(folder: str, name: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``keys`` in the sorted keys of a file, and whether they are there."""
    own = get(folder, f"{name}.k")
    if own is None or not len(own):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
    return at, own[at] == keys


def counts_of(folder: str, name: str, keys: np.ndarray) -> np.ndarray:
    """The count of each key, 0 where it is missing."""
    at, there = found(folder, name, keys)
    out = np.zeros(len(keys), np.int64)
    if there.any():
        out[there] = get(folder, f"{name}.c")[at[there]]
        big = out == 255
        if big.any():
            out[big] = get(folder, f"{name}.big")[np.searchsorted(get(folder, f"{name}.at"), at[big])]
    return out


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the positions in it."""
    order = np.argsort(buckets, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(buckets[order].astype(np.int64)) != 0]) if len(order) else []
    for a, b in zip(edges, [*edges[1:], len(order)]):
        yield int(buckets[order[a]]), order[a:b]


def _token_flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    known, held, size = Hashes(), [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            for text in raw_bytes(part.column("text")):
                held.append(known.tokens(text))
                size += len(held[-1])
                if size >= FLUSH_TOKENS:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _row(values: list, kinds: list, names: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)


def _discounts(n: list[float]) -> np.ndarray:
    """D1, D2, D3+ of modified Kneser-Ney from the numbers of counts 1 to 4; halves where they are undefined."""
    out = np.array([0.5, 1.0, 1.5])
    if n[0] > 0 and n[1] > 0:
        y = n[0] / (n[0] + 2 * n[1])
        for i in range(3):
            if n[i] > 0:
                out[i] = min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.0), i + 1.0)
    return out


class Model(NamedTuple):
    """What scoring needs beside the files: the layout and a few numbers."""

    folder: str
    layout: Layout
    tokens: int
    distinct: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    followed: int  # distinct pairs
    rest: float  # weight of the uniform part of the lower order
    spread_numbers: np.ndarray  # n1, n2, n3+ of each spread context

    def unigrams(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for b, at in _by_bucket(self.layout.of_word(words)):
            out[at] = counts_of(self.folder, f"word-{b}", words[at])
        return out

    def lower(self, words: np.ndarray) -> np.ndarray:
        """P(word) of the lower order: contexts that it followed, interpolated with uniform."""
        cut = words & WORD_MASK
        n = np.zeros(len(words), np.int64)
        for b, at in _by_bucket(self.layout.of_word(cut)):
            n[at] = counts_of(self.folder, f"after-{b}", cut[at])
        uniform = 1.0 / (self.distinct + 1)
        if not self.followed:
            return np.full(len(words), uniform)
        own = np.maximum(n - np.where(n > 0, self.word_discounts[np.clip(n, 1, 3) - 1], 0), 0) / self.followed
        return own + self.rest * uniform

    def back_off(self, before: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Weight of the lower order after each context; 1 where the context is unknown."""
        numbers = np.zeros((len(before), 3))
        spread = self.layout.is_spread(before)
        if spread.any():
            numbers[spread] = self.spread_numbers[np.searchsorted(self.layout.spread, before[spread])]
        rest = np.flatnonzero(~spread)
        for b, at in _by_bucket(self.layout.of_word(before[rest])):
            spots, there = found(self.folder, f"context-{b}", before[rest[at]])
            if there.any():
                numbers[rest[at[there]]] = get(self.folder, f"context-{b}.n")[spots[there]]
        return np.where(totals > 0, numbers @ self.pair_discounts / np.maximum(totals, 1), 1.0)

    def pairs(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        keys, out = mix(before, after & WORD_MASK), np.zeros(len(before), np.int64)
        for b, at in _by_bucket(self.layout.of_pair(before, after)):
            at = at[np.argsort(keys[at])]
            out[at] = counts_of(self.folder, f"pair-{b}", keys[at])
        return out

    def score(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text the number of known tokens, the base score and the model's log10 probability."""
        before, after = contexts_of(texts)
        words, local = np.unique(np.r_[before, after], return_inverse=True)
        first, second = local[: len(after)], local[len(after) :]
        counts = self.unigrams(words)
        # BEGIN stands before as many tokens as END ends texts.
        totals = np.where(words == BEGIN, self.unigrams(np.array([END]))[0], counts)
        low, weight = self.lower(words), self.back_off(words, totals)
        pair, back = np.unique(first * np.int64(len(words)) + second, return_inverse=True)
        a, b = pair // len(words), pair % len(words)
        n = self.pairs(words[a], words[b])
        own = np.maximum(n - np.where(n > 0, self.pair_discounts[np.clip(n, 1, 3) - 1], 0), 0) / np.maximum(totals[a], 1)
        logs = np.log10(own + weight[a] * low[b])[back]
        base = np.log10((counts + 1) / (self.tokens + self.distinct + 1))[second]
        starts = np.cumsum([0, *map(len, texts[:-1])])
        return (
            np.add.reduceat((counts > 0).astype(np.int64)[second], starts), np.add.reduceat(base, starts), np.add.reduceat(logs, starts)
        )


def train(texts: DataFrame, bucket_bytes: int = BUCKET_BYTES, folder: str | None = None) -> Model:
    """Count the ``text`` column of all rows; null counts as empty, and an empty text is one end.

    Words are told apart by 64-bit hashes, the second word of a pair by 48 bits. Without any row
    every token has the uniform probability 1.
    """
    spark = texts.sparkSession
    folder = local_folder(folder or shared_dir(spark, "language-model"))
    os.makedirs(folder, exist_ok=True)
    rows = texts.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    plain = Layout(max(1, ceil(size / bucket_bytes)), np.empty(0, np.uint64), np.empty(0, np.int64))
    many = plain.buckets

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _token_flushes(batches):
            keys, _, counts = summed(np.concatenate(held))
            for b, at in _by_bucket(plain.of_word(keys)):
                yield _row([b, keys[at].tobytes(), counts[at].astype("<u4").tobytes()], [pa.int32(), pa.binary(), pa.binary()], ["bucket", "keys", "counts"])

    def merge_words(group: pa.Table) -> pa.Table:
        keys, counts = (np.concatenate([np.frombuffer(x, t) for x in group.column(c).to_pylist()]) for c, t in (("keys", np.uint64), ("counts", "<u4")))
        keys, _, counts = summed(keys, counts)
        name = f"word-{group.column('bucket')[0].as_py()}"
        put(folder, f"{name}.k", keys)
        put_counts(folder, name, counts)
        return pa.table({"tokens": pa.array([int(counts.sum())], pa.int64()), "words": pa.array([len(keys)], pa.int64())})

    counted = rows.mapInArrow(count_words, "bucket int, keys binary, counts binary")
    total = counted.groupBy("bucket").applyInArrow(merge_words, "tokens long, words long").agg(F.sum("tokens"), F.sum("words")).first()
    tokens, distinct = total[0] or 0, total[1] or 0

    # More than a bucket's share of all tokens: at most as many words as buckets, and MAX_SPREAD.
    least = tokens / min(many, MAX_SPREAD)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column("id").to_pylist():
                keys, counts = get(folder, f"word-{b}.k"), get(folder, f"word-{b}.c")
                if keys is not None:
                    all_counts = np.array(counts, np.int64)
                    all_counts[get(folder, f"word-{b}.at")] = get(folder, f"word-{b}.big")
                    at = np.flatnonzero(all_counts > least)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(all_counts[at])], ["key", "n"])

    every = spark.range(many)
    hot = sorted((np.int64(r["key"]).view(np.uint64), r["n"]) for r in every.mapInArrow(frequent, "key long, n long").collect())
    ends = next((n for key, n in hot if key == END), 0)
    hot = sorted([(k, n) for k, n in hot if k != END] + ([(BEGIN, ends)] if ends else []))
    layout = Layout(many, np.array([k for k, _ in hot], np.uint64), np.array([ceil(n * many / max(tokens, 1)) for _, n in hot], np.int64))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _token_flushes(batches):
            before, after = contexts_of(held)
            _, at, counts = summed(mix(before, after & WORD_MASK))
            before, after = before[at], after[at] & WORD_MASK
            for b, spots in _by_bucket(layout.of_pair(before, after)):
                spots = spots[np.argsort(before[spots], kind="stable")]
                own, word = before[spots], after[spots]
                edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                parts = (
                    own[edges], np.diff(np.r_[edges, len(own)]).astype("<u4"), (word & np.uint64(0xFFFFFFFF)).astype("<u4"),
                    (word >> np.uint64(32)).astype("<u2"), counts[spots].astype("<u4"),
                )
                yield _row([b, *(p.tobytes() for p in parts)], [pa.int32(), *[pa.binary()] * 5], ["bucket", "before", "runs", "low", "high", "counts"])

    def merge_pairs(group: pa.Table) -> pa.Table:
        read = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in group.column(c).to_pylist()])
        b = group.column("bucket")[0].as_py()
        before = np.repeat(read("before", np.uint64), read("runs", "<u4"))
        after = read("low", "<u4").astype(np.uint64) | read("high", "<u2").astype(np.uint64) << np.uint64(32)
        keys, at, counts = summed(mix(before, after), read("counts", "<u4"))
        before, after = before[at], after[at]
        put(folder, f"pair-{b}.k", keys)
        put_counts(folder, f"pair-{b}", counts)
        kinds = np.stack([counts == 1, counts == 2, counts >= 3], 1)
        order = np.argsort(before, kind="stable")
        own = before[order]
        edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        numbers, own = np.add.reduceat(kinds[order].astype(np.int64), edges), own[edges]
        spread = layout.is_spread(own)
        put(folder, f"context-{b}.k", own[~spread])
        put(folder, f"context-{b}.n", numbers[~spread].astype(np.uint32))
        put(folder, f"spread-{b}.k", own[spread])
        put(folder, f"spread-{b}.n", numbers[spread])
        put(folder, f"numbers-{b}", np.array([np.count_nonzero(counts == i) for i in (1, 2, 3, 4)], np.int64))
        words, _, followed = summed(after)
        out = [(k, words[w].tobytes(), followed[w].astype("<u4").tobytes()) for k, w in _by_bucket(layout.of_word(words))]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "keys", "counts"])

    def merge_after(group: pa.Table) -> pa.Table:
        keys, counts = (np.concatenate([np.frombuffer(x, t) for x in group.column(c).to_pylist()]) for c, t in (("keys", np.uint64), ("counts", "<u4")))
        keys, _, counts = summed(keys, counts)
        name = f"after-{group.column('bucket')[0].as_py()}"
        put(folder, f"{name}.k", keys)
        put_counts(folder, name, counts)
        numbers = [int(np.count_nonzero(counts == i)) for i in (1, 2, 3, 4)]
        return pa.table({k: pa.array([v], pa.int64()) for k, v in zip(("pairs", "words", *NUMBERS), (int(counts.sum()), len(keys), *numbers))})

    pairs = rows.mapInArrow(count_pairs, "bucket int, before binary, runs binary, low binary, high binary, counts binary")
    after = pairs.groupBy("bucket").applyInArrow(merge_pairs, "bucket int, keys binary, counts binary")
    done = after.groupBy("bucket").applyInArrow(merge_after, "pairs long, words long, n1 long, n2 long, n3 long, n4 long")
    low = done.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "words", *NUMBERS))).first()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column("id").to_pylist():
                numbers = get(folder, f"numbers-{b}")
                if numbers is not None:
                    yield _row([None, *numbers.tolist()], [pa.int64()] * 5, ["key", *NUMBERS])
                    keys, own = get(folder, f"spread-{b}.k"), get(folder, f"spread-{b}.n")
                    if len(keys):
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(own[:, i]) for i in range(3)), pa.array(np.zeros(len(keys), np.int64))], ["key", *NUMBERS])

    # One row for all buckets and one for each spread context.
    gathered = every.mapInArrow(gather, "key long, n1 long, n2 long, n3 long, n4 long").groupBy("key").agg(*(F.sum(c).alias(c) for c in NUMBERS)).collect()
    high = next(([r[c] for c in NUMBERS] for r in gathered if r["key"] is None), [0] * 4)
    spread_numbers = np.zeros((len(hot), 3))
    for r in gathered:
        if r["key"] is not None:
            spread_numbers[np.searchsorted(layout.spread, np.int64(r["key"]).view(np.uint64))] = r["n1"], r["n2"], r["n3"]
    d_low = _discounts([low[c] for c in NUMBERS])
    kinds = np.array([low["n1"], low["n2"], low["words"] - low["n1"] - low["n2"]])
    rest = float(d_low @ kinds) / low["pairs"] if low["pairs"] else 1.0
    return Model(folder, layout, tokens, distinct, _discounts(high), d_low, low["pairs"], rest, spread_numbers)


SCORED = "doc_id {}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text, held_out) scored; per row the token numbers and both log10 scores.

    Null counts as empty; an empty text is the one token "end". Repeated rows are scored alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value, Hashes()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [known.tokens(t) for t in raw_bytes(part.column("text"))]
                n_known, base, logs = own.score(texts)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("held_out"), pa.array(list(map(len, texts)), pa.int64()), pa.array(n_known),
                        pa.array([own.tokens] * n, pa.int64()), pa.array(base), pa.array(logs),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    rows = docs.select("doc_id", "held_out", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, SCORED.format(dict(docs.dtypes)["doc_id"]))


def held_out(key: Column) -> Column:
    """crc32 of the id as text leaves 2 modulo 7; a null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 7 == 2, F.lit(False))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    return score_documents(docs, train(docs.filter("NOT held_out")))
