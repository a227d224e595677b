"""Byte-level BPE by corpus-level merge replay, and decoding.

Method: the pieces that the pattern cuts out of a block of documents are gathered once each. All
distinct pieces not met before form one long chain of byte tokens, and an inverted index maps each
mergeable token pair to its positions in that chain. Merges are applied in rank order over the
whole chain; a merge touches only its own positions, whose two neighbouring pairs are entered into
the index anew. Documents are then spelled by looking their pieces up. A block is a bounded part of
a task's input, so memory is bounded and a lost task is simply run again; every document is read
once and nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from platwork.llm.common import raw_bytes, slices, table

RANKS = "byte_bpe_50k.tiktoken"
# Text bytes per block, and remembered pieces per Python worker before it starts anew.
BLOCK_BYTES = 6 << 20
KNOWN_PIECES = 600_000
# A rank with fewer positions than this is merged one position at a time.
FEW = 24
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _sorted_once(spots: np.ndarray) -> np.ndarray:
    spots.sort()
    return spots[np.r_[True, spots[1:] != spots[:-1]]]


class MergeReplay:
    """Merges of a rank file (lines of base64 token and rank), replayed over many pieces at once."""

    def __init__(self, rank_file: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.base = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # Token pair -> rank of what they make; every split of a token into two tokens is a pair.
        self.width = len(self.tokens)
        self.pairs = {
            ranks[token[:i]] * self.width + ranks[token[i:]]: rank
            for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks
        }
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.fromiter(self.pairs.values(), np.int64, len(self.pairs))[order]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it makes no token."""
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.made[at], -1)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers. No piece is empty."""
        chain = np.frombuffer(b"".join(pieces), np.uint8)
        size = len(chain)
        if not size:
            return []
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = np.zeros(size + 1, bool)
        first[np.cumsum(lengths) - lengths] = first[size] = True
        token = np.full(size + 1, -1, np.int64)
        token[:size] = self.base[chain]
        after = np.arange(1, size + 2)
        before = np.arange(-1, size)
        # No pair crosses the end of a piece: the chain is cut there.
        after[:size][first[1:]] = size
        before[:size][first[:size]] = -1
        # Rank -> single positions, and runs of positions.
        index: dict[int, tuple[list[int], list[np.ndarray]]] = {}
        starts = np.flatnonzero(after[:size] != size)
        ranks = self._rank(token[starts], token[after[starts]])
        starts, ranks = starts[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        starts, ranks = starts[order], ranks[order]
        edges = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]) if len(ranks) else np.array([], np.int64)
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(ranks)]):
            index[int(ranks[a])] = ([], [starts[a:b]])
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank, None)
            if found is None:
                continue
            single, runs = found
            if runs:
                spots = _sorted_once(np.concatenate([*runs, np.array(single, np.int64)]))
            elif len(single) > FEW:
                spots = _sorted_once(np.array(single, np.int64))
            else:
                self._few(sorted(single), rank, token, after, before, size, index, heap)
                continue
            if len(spots) <= FEW:
                self._few(spots.tolist(), rank, token, after, before, size, index, heap)
            else:
                self._many(spots, rank, token, after, before, size, index, heap)
        alive = np.flatnonzero(token[:size] >= 0)
        ids = token[alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.add.reduceat((token[:size] >= 0).astype(np.int64), np.cumsum(lengths) - lengths))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def _few(self, spots, rank, token, after, before, size, index, heap) -> None:
        pairs, width = self.pairs, self.width
        for p in spots:
            q = int(after[p])
            left = int(token[p])
            if left < 0 or q >= size or pairs.get(left * width + int(token[q])) != rank:
                continue  # a neighbour changed since the position was entered
            r = int(after[q])
            token[p], token[q], after[p] = rank, -1, r
            if r < size:
                before[r] = p
                self._enter(pairs.get(rank * width + int(token[r])), p, index, heap)
            o = int(before[p])
            if o >= 0:
                self._enter(pairs.get(int(token[o]) * width + rank), o, index, heap)

    @staticmethod
    def _enter(rank, spot, index, heap) -> None:
        if rank is not None:
            if rank not in index:
                index[rank] = ([], [])
                heapq.heappush(heap, rank)
            index[rank][0].append(spot)

    def _many(self, spots, rank, token, after, before, size, index, heap) -> None:
        spots = spots[token[spots] >= 0]
        spots = spots[after[spots] < size]
        right = after[spots]
        fits = self._rank(token[spots], token[right]) == rank
        spots, right = spots[fits], right[fits]
        if len(spots) == 0:
            return
        if np.any(right[:-1] == spots[1:]):
            # Runs such as "aaaa": taken from the left, each token in one merge only.
            self._few(spots.tolist(), rank, token, after, before, size, index, heap)
            return
        beyond = after[right]
        token[spots], token[right], after[spots] = rank, -1, beyond
        inner = beyond < size
        before[beyond[inner]] = spots[inner]
        previous = before[spots]
        a, b = spots[inner], previous[previous >= 0]
        touched = np.concatenate([a, b])
        new = self._rank(token[touched], token[after[touched]])
        touched, new = touched[new >= 0], new[new >= 0]
        if len(new):
            order = np.argsort(new, kind="stable")
            touched, new = touched[order], new[order]
            edges = np.flatnonzero(np.r_[True, new[1:] != new[:-1]])
            for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(new)]):
                key = int(new[i])
                if key not in index:
                    index[key] = ([], [])
                    heapq.heappush(heap, key)
                if j - i == 1:
                    index[key][0].append(int(touched[i]))
                else:
                    index[key][1].append(touched[i:j])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Worker:
    """What one Python worker keeps between blocks: the merges and the pieces met so far."""

    held: dict[str, _Worker] = {}

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        self.replay, self.pattern, self.known = MergeReplay(rank_file), regex.compile(pattern), {}

    @classmethod
    def of(cls, rank_file: bytes, pattern: str) -> _Worker:
        key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
        if key not in cls.held:
            cls.held[key] = cls(rank_file, pattern)
        return cls.held[key]

    def encode(self, texts: list[str]) -> list[bytes]:
        known, find = self.known, self.pattern.findall
        if len(known) > KNOWN_PIECES:
            known.clear()
        cut = [find(t) for t in texts]
        fresh = list(set().union(*cut) - known.keys())
        known.update(zip(fresh, self.replay.encode([p.encode() for p in fresh])))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]


def encode_documents(docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document its ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and the ``decoded`` bytes.

    Whole texts, no special tokens; null and empty texts give no ids. Every row gives one row,
    repeated or not, and other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast((rank_file, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _Worker.of(*shared.value)
        for part in (s for batch in batches for s in slices(batch, "text", BLOCK_BYTES)):
            ids = worker.encode([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array(ids, pa.binary()), pa.array(map(worker.replay.decode, ids), pa.binary()),
                ],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    coded = encode_documents(
        table(spark, sf_dir, "documents"), read_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN
    )
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
