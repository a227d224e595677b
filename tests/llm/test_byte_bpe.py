"""Byte-level BPE against the tiktoken library, and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from platwork.llm import byte_bpe
from platwork.llm.byte_bpe import RANKS, MergeReplay, encode_documents, op8_byte_bpe, read_ranks

FILE = read_ranks(public_tokenizers.path(RANKS))
random.seed(5)
TEXTS = [
    "", None, "a", "don't we'll I'd", "aaaaaaaaaaaaaaaaa" * 40, "  \n\n \t x ", "日本語 😀😀 ñandú", "\x00\x01\x02" * 50, "=-" * 300, " " * 500, "the the the", "the the the",
    *["".join(random.choice("abct ehn\nioé!1") for _ in range(400)) for _ in range(30)], "word " * 20000,
]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, FILE.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("few", [0, 24, 10**9])
def test_replay_equals_the_library(library, few, monkeypatch):
    """Merging one position at a time and many at once give the same tokens."""
    monkeypatch.setattr(byte_bpe, "FEW", few)
    pieces = sorted({p for t in TEXTS if t for p in byte_bpe.regex.findall(public_tokenizers.PATTERN, t)})
    ids = MergeReplay(FILE).encode([p.encode() for p in pieces])
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [library.encode_ordinary(p) for p in pieces]


def test_documents_equal_the_library(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = encode_documents(docs, FILE, public_tokenizers.PATTERN).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        text = TEXTS[r.doc_id] or ""
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(r.decoded).decode() == text and r.n_tokens * 4 == len(r.ids)
    assert encode_documents(docs.limit(0), FILE, public_tokenizers.PATTERN).collect() == []


def test_query(spark, library, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op8_byte_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
