"""The manifest against a plain tree in memory."""

import hashlib
import zlib

import pytest

from platwork.llm import merkle
from platwork.llm.merkle import lower_third, manifest, op13_merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, position int, leaf string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain(rows, alter=None):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root, verified) of rows of five values."""

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def sides(tree, i):
        for level in tree[:-1]:
            a = i // 8 * 8
            yield "".join(level[a:i]), "".join(level[i + 1 : a + 8])
            i //= 8

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = levels([leaf_of(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            steps = [*sides(trees[g], i), *sides(top, k)]
            text = r[4]
            if alter and r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf_of((*r[:4], text))
            for a, b in steps:
                folded = sha(a + folded + b)
            out.append((r[0], leaf_of(r), trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def got(df):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_nulls_copies_and_wide_ids(spark):
    rows = [(i, f"s{i % 3}", ("en", "de", None)[i % 3], i, f"Text {i}") for i in range(200)]
    rows += [(i * 977 - 4_000_000, "s", "fr", 1, "É A") for i in range(120)] + [(-(2**63), "s", "fr", 0, ""), (2**63 - 1, None, "fr", None, None)]
    rows += [(7, "other", "de", 7, "same id")] * 3 + [(7, "x", "de", 7, "same id")] + [(None, "s", "de", 1, f"none {i % 4}") for i in range(9)]
    rows += [(None, None, None, None, None)] * 2 + [(1, "s", "", 1, "Q"), (3, "s", "日本", 1, "x" * 100_000)]
    rows += [(i, "s", "f\x7f", 1, "T") for i in range(9)]
    docs = spark.createDataFrame([(*r, "own", 1, "own") for r in rows], SCHEMA).repartition(5)
    assert got(manifest(docs, lower_third)) == plain(rows, True)
    assert all(r[-1] for r in got(manifest(docs)))
    assert manifest(docs.limit(0), lower_third).collect() == []


@pytest.mark.parametrize("n", [1, 8, 65])
def test_several_rounds(spark, monkeypatch, n):
    """Blocks of 8: every level is a round of its own, and groups end in different rounds."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    monkeypatch.setattr(merkle, "STRETCH", 2)
    rows = [(i, "s", "en", 1, f"A{i}") for i in range(n)] + [(i, "s", f"l{i}", 1, "B") for i in range(12)] + [(5, "s", "en", 1, "copy")] * 5
    docs = spark.createDataFrame([(*r, "own", 1, "own") for r in rows], SCHEMA)
    assert got(manifest(docs, lower_third)) == plain(rows, True)


def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert got(op13_merkle(spark, folder)) == plain(rows, True)
