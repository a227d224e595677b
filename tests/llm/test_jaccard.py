"""The Jaccard join against all pairs, and its groups."""

import random
import re

import pytest

from platwork.llm import jaccard
from platwork.llm.jaccard import Shingles, near_duplicates

random.seed(11)


def shingles(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows):
        least[g] = i if least.get(g) is None else i if i is not None and i < least[g] else least[g]
    return [(i, len(s), least[g]) for (i, _), s, g in zip(rows, sets, group)]


def changed(words, times):
    out = list(words)
    for _ in range(times):
        out[random.randrange(len(out))] = f"new{random.randrange(10**6)}"
    return " ".join(out)


def corpus():
    """Chains of near copies around the threshold, a passage in many texts, copies, short and empty texts."""
    rows = [None, "", "  \n\t", "a", "A", "a b", "b a", "a b c d", "A B  c\nD", "a b c d e", "É é", "é É", "x " * 400, "x " * 401]
    passage = " ".join(f"shared{i}" for i in range(30))
    for k in range(12):
        words = [f"w{k}x{random.randrange(40)}" for _ in range(random.choice([20, 60, 200]))]
        for _ in range(random.choice([1, 3, 12])):
            rows.append(changed(words, random.choice([0, 1, 1, 2, 3, 4])))
            words = words if random.random() < 0.5 else rows[-1].split()
    rows += [passage + " " + " ".join(f"own{k}y{i}" for i in range(random.choice([2, 5, 9, 40]))) for k in range(40)]
    rows += [passage] * 5 + [rows[20]] * 7
    return list(enumerate(rows))


@pytest.mark.parametrize("width,percent,seed", [(4, 85, 1), (5, 80, 2), (1, 60, 3), (4, 100, 4)])
def test_equals_all_pairs(spark, width, percent, seed):
    random.seed(seed)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(5)
    got = near_duplicates(docs, width, percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(plain(rows, width, percent))


def test_large_group_of_near_copies(spark):
    """Two hundred copies of one text, each changed in its own places, all in one group."""
    words = [f"w{i}" for i in range(300)]
    rows = [(i, changed(words, 3)) for i in range(200)] + [(1000 + i, "one two three four five six") for i in range(100)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, _, c in plain(rows, 4, 85)}


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (1, "q r s t"), (None, "z")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == sorted(
        [(3, 2, 3), (3, 2, 3), (None, 2, 3), (1, 1, 1), (None, 1, None)], key=repr
    )
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sets():
    known = Shingles(4)
    for _, text in corpus():
        assert len(known.of((text or "").encode())) == len(shingles(text, 4))


def test_visits_do_not_grow_with_the_square_of_near_copies(spark, monkeypatch):
    counts, held = [], jaccard.stored

    def counting(df, label):
        out = held(df, label)
        if label.endswith("visits"):
            counts.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stored", counting)
    random.seed(7)
    words = [f"w{i}" for i in range(150)]
    rows = list(enumerate([changed(words, random.choice([1, 1, 2, 2])) for _ in range(400)]))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    want = plain(rows, 4, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(want)
    assert sum(counts) < 4 * len(rows)
