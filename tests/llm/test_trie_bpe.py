"""The trie traversal against the tokenizers library, and against merging pair by pair."""

import hashlib
import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from platwork.llm import trie_bpe
from platwork.llm.trie_bpe import TOKENIZER, Merges, encode_documents, op11_trie_bpe, read_tokenizer

PATH = public_tokenizers.path(TOKENIZER)
FILE = read_tokenizer(PATH)
random.seed(11)
TEXTS = [
    "", None, "a", "don't we'll I'd", "aaaaaaaaaaaaaaaaa" * 40, "  \n\n \t x ", "日本語 😀😀 ñandú\u0085 x\x1c\x1dy", "\x00\x01\x02" * 50, "=-" * 300, "=" * 700, " " * 500,
    "the the the", "the the the", "a<|endoftext|>b <|endoftext|><|endoftext|> c<|endoftext|", "<|endoftext|>", "word " * 20_000, "ab" * 30_000, "Größé ﬁ ½ Ⅷ ٣",
    *["".join(random.choice("abct ehn\nioé!1=-") for _ in range(400)) for _ in range(30)],
    *["".join(chr(random.choice([random.randrange(32, 0x250), random.randrange(0x4E00, 0x4F00), random.randrange(0x1F600, 0x1F640)])) for _ in range(200)) for _ in range(30)],
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    return Merges(json.loads(FILE))


def test_words_equal_the_library(library, merges):
    words = {w for t in TEXTS if t for w in trie_bpe.regex.findall(public_tokenizers.PATTERN, t)} - {"<|endoftext|>"}
    words |= {"".join(random.choice("abcdeinorst") for _ in range(random.randrange(1, 14))) for _ in range(3000)}
    got = merges.encode([w.encode() for w in words])
    for w in words:
        assert trie_bpe.np.frombuffer(got[w.encode()], "<u4").tolist() == library.encode(w, add_special_tokens=False).ids, w


def pair_by_pair(rules, text):
    """The lowest merge first, of equal ones the leftmost."""
    parts = list(text)
    while found := [(rules.index((a, b)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in rules]:
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@pytest.mark.parametrize("seed", range(20))
def test_random_merges(seed):
    """Small alphabets and arbitrary merges: tokens that never come out whole, runs, ties."""
    rng = random.Random(seed)
    made, rules = ["a", "b", "c"], []
    while len(rules) < 25:
        a, b = rng.choice(made), rng.choice(made)
        if a + b not in made and len(a + b) < 9:
            rules.append((a, b))
            made.append(a + b)
    vocab = {c: i for i, c in enumerate([*trie_bpe.byte_letters(), *made[3:]])}
    known = Merges({"model": {"type": "BPE", "vocab": vocab, "merges": [list(r) for r in rules]}, "pre_tokenizer": {"type": "ByteLevel"}})
    words = ["".join(rng.choice("abc"[: rng.choice([1, 2, 3])]) for _ in range(rng.randrange(1, 15))) for _ in range(300)]
    got = known.encode([w.encode() for w in set(words)])
    for w in words:
        assert trie_bpe.np.frombuffer(got[w.encode()], "<u4").tolist() == [vocab[p] for p in pair_by_pair(rules, w)]


@pytest.mark.parametrize("depth,known,pairs", [(256, 96 << 20, 400_000), (2, 0, 5)])
def test_documents_equal_the_library(spark, library, monkeypatch, depth, known, pairs):
    """Also with nothing remembered and open tokens found again at every depth."""
    for name, value in (("KEPT_DEPTH", depth), ("KNOWN_BYTES", known), ("KNOWN_PAIRS", pairs)):
        monkeypatch.setattr(trie_bpe, name, value)
    worker = trie_bpe._Worker(FILE, public_tokenizers.PATTERN)
    for texts in ([t or "" for t in TEXTS[:20]], [t or "" for t in TEXTS]):
        for text, ids in zip(texts, worker.encode(texts)):
            want = library.encode(text, add_special_tokens=False).ids
            ids = trie_bpe.np.frombuffer(ids, "<u4").tolist()
            assert ids == want and worker.merges.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_table(spark, library):
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, n_tokens int")
    got = encode_documents(docs, FILE, public_tokenizers.PATTERN).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        want = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == library.decode(want, skip_special_tokens=False)
    assert encode_documents(docs.limit(0), FILE, public_tokenizers.PATTERN).collect() == []


def test_bytes_that_are_no_text(library, merges):
    for _ in range(200):
        ids = [random.choice([*range(256), 50256]) for _ in range(random.randrange(8))]
        assert merges.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        Merges({"model": {"type": "BPE", "vocab": {}, "merges": []}, "pre_tokenizer": None})
    vocab = {c: i for i, c in enumerate([*trie_bpe.byte_letters(), "ab", "abc", "bc"])}
    with pytest.raises(ValueError, match="unmade"):
        Merges({"model": {"type": "BPE", "vocab": vocab, "merges": ["ab c", "a b"]}, "pre_tokenizer": {"type": "ByteLevel"}})


def test_query(spark, library, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op11_trie_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
