"""Packing: tokens against the library, gapless places, bounds and the number of sequences."""

import zlib
from collections import defaultdict
from math import ceil

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from platwork.llm.packing import (
    TOKENIZER, WordTokens, best_fit_decreasing, lower_bound, op7_packing, pack_documents, pack_pieces, sequences, tokenizer_source,
)

SOURCE = tokenizer_source(public_tokenizers.path(TOKENIZER))
ODD = [
    None, "", "   ", "don't WE'LL I'd 've", "İstanbul ẞ Ǆ ŉ", "é É H̱", "日本 語", "a b\x1cc\x85d", "<|endoftext|> x", "² ³ ½ ª º", "...*** 12345 1a2b",
    "Σας ΣΑΣ", "\x00\x01a", "😀a😀", "naïve Ünïcödé's", "word " * 3000, "word " * 2047, "word " * 2048, "dup dup", "dup dup",
]


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_str(SOURCE)
    own.encode_special_tokens = True
    return own


def test_tokens_equal_the_library(library):
    own = WordTokens(SOURCE)
    for text in ODD:
        assert np.frombuffer(own.ids((text or "").encode()), "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def check_places(rows, capacity):
    """Every sequence is filled from 0 without gaps; returns the number of sequences."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_documents(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, length string")
    packed = pack_documents(docs, SOURCE, with_ids=True)
    rows = packed.collect()
    assert check_places(rows, 2048) == ceil(sum(r.length for r in rows) / 2048)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(ODD)}
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == set(ids)
    for i, own in by.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(ceil(len(ids[i]) / 2048)))
        for r in own:
            part = np.array(ids[i][r.start : r.start + 2048], "<u4").tobytes()
            assert r.start == 2048 * r.piece and r.length == len(part) // 4 and r.ids_crc32 == zlib.crc32(part)
    whole = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in sequences(packed).collect()}
    for r in rows:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == ids[r.doc_id][r.start : r.start + r.length]


@pytest.mark.parametrize("seed,low,high", [(0, 1, 100), (1, 30, 70), (2, 51, 100), (3, 1, 20), (4, 33, 35)])
def test_bounds_and_best_fit(seed, low, high):
    sizes = np.random.default_rng(seed).integers(low, high, 200)
    bins, offsets, left = best_fit_decreasing(sizes, 100)
    assert lower_bound(sizes, 100) <= len(left)
    for b in range(len(left)):
        own = np.flatnonzero(bins == b)
        assert sizes[own].sum() == 100 - left[b]
    if low > 50:
        assert lower_bound(sizes, 100) == 200
    if low == 33:
        assert lower_bound(sizes, 100) >= ceil(np.count_nonzero(sizes == 34) / 2 + 0) // 2


def exact_bins(sizes, capacity):
    """The smallest number of bins, by trying everything."""
    best = len(sizes)

    def go(i, left):
        nonlocal best
        if len(left) >= best:
            return
        if i == len(sizes):
            best = len(left)
            return
        for k in range(len(left)):
            if left[k] >= sizes[i]:
                left[k] -= sizes[i]
                go(i + 1, left)
                left[k] += sizes[i]
        go(i + 1, [*left, capacity - sizes[i]])

    go(0, [])
    return best


def test_bound_never_exceeds_the_optimum():
    for seed in range(60):
        sizes = np.random.default_rng(seed).integers(1, 31, 7)
        assert lower_bound(sizes, 30) <= exact_bins(sizes.tolist(), 30) <= len(best_fit_decreasing(sizes, 30)[2])


def test_parts_exchange_pieces(spark):
    """What parts give back is packed better together; parts of 30 sequences come close to the bound."""
    sizes = np.random.default_rng(9).integers(1, 100, 3000)
    pieces = spark.createDataFrame([(int(s),) for s in sizes], "length long")
    alone, rows = (pack_pieces(pieces, 100, part_pieces=100, rounds=r).collect() for r in (1, 4))
    assert len(alone) == len(rows) == 3000
    assert check_places(rows, 100) < check_places(alone, 100) and check_places(rows, 100) <= 1.04 * lower_bound(sizes, 100)


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), SOURCE).collect() == []


def test_query(spark, folder):
    rows = op7_packing(spark, folder).collect()
    assert check_places(rows, 2048) <= 1.02 * ceil(sum(r.length for r in rows) / 2048)
