"""The ordinal classifier: held-out grades, gradients, and defined results for odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from platwork.llm.quality import BITS, Features, OrdinalModel, fit, fit_on_sample, graded, op4_quality, score


def rated(folder):
    import pyarrow.parquet as pq

    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()}
    labels = [r for r in pq.read_table(f"{folder}/labels.parquet").to_pylist() if r["doc_id"] in texts]
    return [(r["doc_id"], texts[r["doc_id"]], 0 if r["toxic"] else 1 if r["quality"] == 0 else 2) for r in labels]


def test_held_out_grades():
    rows = sorted(rated("/root/testdata/sf0.1"), key=lambda r: r[0] * 2654435761 % 1000003)
    known = Features()
    made = [known.of(t.encode()) for _, t, _ in rows]
    grades = np.array([g for _, _, g in rows])
    cut = len(rows) * 2 // 3
    model = fit(made[:cut], grades[:cut])
    assert np.all(np.diff(model.thresholds) >= 0)
    good = model.tails(np.array([model.weights[f].sum() for f in made[cut:]]))[:, 1] >= 0.5
    test = grades[cut:]
    assert good[test == 2].mean() > 0.98 and good[test == 0].mean() < 0.05 and good[test == 1].mean() < 0.25


def test_thresholds_are_ordered_and_tails_fall():
    model = OrdinalModel(np.zeros(1 << BITS, np.float32), np.array([-1.0, 0.5]))
    tails = model.tails(np.linspace(-50, 50, 11))
    assert np.all(tails[:, 0] >= tails[:, 1]) and np.all(np.diff(tails, axis=0) >= 0)


def test_fit_without_rows_keeps_all_and_one_grade_follows_its_share():
    assert fit([], np.array([], np.int64)).tails(np.zeros(1)).min() > 0.99
    one = fit([np.array([3])] * 50, np.full(50, 2))
    assert one.tails(np.zeros(1))[0, 1] > 0.9


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "fine words here", "a"), (2, None, "b"), (3, "", "c"), (4, " \n", "d"), (5, "fine words here", "e"), (6, "long " * 50000, "f"), (None, "x", "g")],
        "doc_id long, text string, kept string",
    )
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (3, None, 0), (None, 1, 1), (2, 1, None), (77, 0, 1)], "doc_id long, quality int, toxic int"
    )
    assert sorted((r.doc_id, r.grade) for r in graded(labels).collect()) == [(1, 1), (77, 0)]
    out = score(docs, fit_on_sample(docs, graded(labels))).collect()
    assert len(out) == 7 and set(out[0].asDict()) == {"doc_id", "text", "kept", "expected_grade", "tail_probability"}
    by = {r.doc_id: r for r in out}
    assert by[1].expected_grade == by[5].expected_grade and by[2].tail_probability == by[3].tail_probability == by[4].tail_probability
    assert all(0 <= r.tail_probability <= 1 and r.kept == (r.tail_probability >= 0.5) for r in out)
    none = fit_on_sample(docs, graded(labels.limit(0)))
    assert score(docs, none).filter("NOT kept").count() == 0 and score(docs.limit(0), none).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    grades = {i: g for i, _, g in rated(folder)}
    rows = op4_quality(spark, folder).collect()
    assert len(rows) == 1000
    good = [r.kept for r in rows if grades.get(r.doc_id) == 2]
    assert sum(good) / len(good) > 0.97
    bad = [r.kept for r in rows if grades.get(r.doc_id) == 0]
    assert sum(bad) / len(bad) < 0.2
