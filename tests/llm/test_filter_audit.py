"""The audit against plain counting; files arrive one by one, smaller ids after larger ones."""

import random
from itertools import permutations

import pytest

from platwork.llm import filter_audit
from platwork.llm.filter_audit import audit_filters, own_failures

SCHEMA = "doc_id long, text string, source string, mask int, part string, n long"
LABELS = "doc_id long, quality int, toxic int, good int"
random.seed(3)


def plain(rows, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    docs = []
    for number, text, source in rows:
        text = text or ""
        words = [w for w in text.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": number is not None and any(o is not None and o < number and (t or "") == text for o, t, _ in rows),
        }
        docs.append((source or "", {f for f in fails if fails[f]}, number in good, number in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for s, f in enumerate(order):
                prior = set(order[:s])
                lost = [d for d in own if f in d[1] and not d[1] & prior]
                out[part, order, s + 1] = [
                    sum(not d[1] & (prior | {f}) for d in own), len(lost), sum(f in d[1] and bool(d[1] & prior) for d in own),
                    sum(d[1] == {f} for d in own), sum(d[2] for d in lost), sum(d[3] for d in lost),
                ]
    for (part, order, s), v in out.items():
        v.append(sum(out[part, o, o.index(order[s - 1]) + 1][1] for o in map("".join, permutations("ABCDE"))))
    return {k: tuple(v) for k, v in out.items()}


def got(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(found) == len(rows)
    return found


def text():
    words = [random.choice(["a", "B", "word", "Üx", "$5", "x" + str(random.randrange(300))]) for _ in range(random.choice([3, 199, 200, 260]))]
    return random.choice([" ", "\t", "\x0b ", " "]).join(words)


@pytest.mark.parametrize("per_state", [512, 20])
def test_retraction_over_many_files(spark, tmp_path, monkeypatch, per_state):
    texts = [text() for _ in range(12)] + [None, "", " ", "A" * 300 + "a" * 14_700, "A" * 301 + "a" * 14_700]
    rows = [(i, random.choice(texts), random.choice(["s", "t", None, ""])) for i in range(160)]
    rows += [(None, texts[0], "s"), (None, None, "t")] + [(3, rows[3][1], "t"), rows[3], (5, texts[1], "u")] * 2
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1])) for i in range(0, 170, 2)] + [(4, 1, 1), (None, 1, 1)]
    random.shuffle(rows)
    path = str(tmp_path / "docs.parquet")
    for k in range(0, len(rows), 40):
        # Larger ids come first as often as not; a file is one micro-batch.
        spark.createDataFrame([(*r, 7, "own", 9) for r in rows[k : k + 40]], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    marks = spark.createDataFrame([(*r, 5) for r in labels], LABELS)
    monkeypatch.setattr(filter_audit.part_counters, "__defaults__", (None, per_state))
    assert got(audit_filters(spark, path, marks, 1)) == plain(rows, labels)


def test_one_text_of_all_rows(spark, tmp_path):
    rows = [(i, "x", f"s{i % 2}") for i in range(500, 0, -1)]
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame([(*r, 7, "own", 9) for r in rows], SCHEMA).repartition(3).write.parquet(path)
    found = got(audit_filters(spark, path, spark.createDataFrame([], LABELS), 2))
    assert found["s1", "EABCD", 1][:2] == (1, 249) and found["s0", "EABCD", 1][:2] == (0, 250)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert audit_filters(spark, path, spark.createDataFrame([], LABELS)).collect() == []


@pytest.mark.parametrize(
    "value,mask", [("", 1), ("w " * 200, 2), (" ".join(map(str, range(200))), 0), (" ".join(map(str, range(200))) + "|", 8), ("A", 5), ("é" * 49 + "A", 1)]
)
def test_own_failures(value, mask):
    assert own_failures(value.encode(), len(value)) == mask
    assert filter_audit.REPEAT == 16
