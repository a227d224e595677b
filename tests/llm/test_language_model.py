"""The language model against a plain count of all pairs, and its held-out likelihood."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from platwork.llm.language_model import _discounts, held_out, op10_language_model, score_documents, train

from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in BLANKS:
            out += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return [*out, None]


def brute(rows):
    """Plain dictionaries in place of sorted arrays."""
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    single, pair = Counter(), Counter()
    for i, text in rows:
        if not out(i):
            w = words(text)
            single.update(w)
            pair.update(zip(["<s>", *w[:-1]], w))
    total, distinct = sum(single.values()), len(single)
    after, kinds, follows = Counter(), defaultdict(Counter), Counter()
    for (a, b), n in pair.items():
        follows[a] += n
        after[b] += 1
        kinds[a][min(n, 3)] += 1
    d = _discounts([sum(n == k for n in pair.values()) for k in (1, 2, 3, 4)])
    e = _discounts([sum(n == k for n in after.values()) for k in (1, 2, 3, 4)])
    rest = sum(e[min(n, 3) - 1] for n in after.values()) / len(pair)

    def probability(a, b):
        n = after[b]
        low = (n - e[min(n, 3) - 1] if n else 0) / len(pair) + rest / (distinct + 1)
        if a not in kinds:
            return low
        c = pair[a, b]
        weight = sum(d[k - 1] * n for k, n in kinds[a].items()) / follows[a]
        return (c - d[min(c, 3) - 1] if c else 0) / follows[a] + weight * low

    result = {}
    for i, text in rows:
        w = words(text)
        result[i] = (
            out(i), len(w), sum(single[x] > 0 for x in w), total,
            sum(math.log10((single[x] + 1) / (total + distinct + 1)) for x in w),
            sum(math.log10(probability(a, b)) for a, b in zip(["<s>", *w[:-1]], w)),
        )
    return result


ROWS = [(i, t) for i, t in enumerate([
    "the cat sat on the mat", "The cat ran", None, "", "  \t\n ", "the the the the the the", "a b c d e f g the cat", "ÄÖ straße the mat",
    "the dog sat on the log\nthe dog ran", "x y stays one word", "zzz unseen words only", "cat", "the cat sat", "the mat sat",
])]


def scored(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", held_out(F.col("doc_id")))
    return score_documents(docs, train(docs.filter("NOT held_out"), **more)).collect()


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 16])
def test_equals_plain_counting(spark, bucket_bytes):
    """With tiny buckets the frequent contexts are spread over several of them."""
    want = brute(ROWS)
    got = scored(spark, ROWS, bucket_bytes=bucket_bytes)
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4]) and r.score == pytest.approx(want[r.doc_id][5])


def test_empty_table_and_no_training_rows(spark):
    assert scored(spark, []) == []
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = scored(spark, [(out, "a b")])
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)


def test_query_beats_its_base_on_held_out_texts(spark, folder):
    rows = op10_language_model(spark, folder).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    want = brute(sorted(texts.items()))
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.score == pytest.approx(want[r.doc_id][5])
    kept = [r for r in rows if r.held_out]
    assert sum(r.score for r in kept) > sum(r.base_score for r in kept)
