"""License scan against plain TF-IDF, and inheritance along directories."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from platwork.llm import license_scan as license_scan_module
from platwork.llm.license_scan import NOTICES, _masses, heavy_terms, license_scan, license_texts, op1_license_scan

FILES = [
    ("src/a/x.py", "Licensed under the Apache License, Version 2.0.\ncode here"),
    ("src/a/y.py", "no header at all"),
    ("src/LICENSE", "Released under the MIT License."),
    ("src/b/c/d/z.py", "by and by\nfor the use of source"),
    ("src/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3.\r\nReleased under the MIT License."),
    ("srcx/q.py", "some text"), ("top.py", "plain"), ("LICENCE", "nothing of that kind"), ("src/e.py", None), ("src/f.py", ""), (None, "Released under the MIT License."),
    ("src/g.py", "word " * 30000 + "\nreleased UNDER the mit license"), ("src/g.py", "again"), ("src/h.py", "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."),
    ("src/i.py", "x\nLicensed under CC BY 4.0."), ("src/j.py", "the License under which this was released is the MIT one"),
]


def terms(text):
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


def plain(files, threshold):
    named = [(p, t or "") for p, t in files if p is not None]
    df = Counter(t for _, text in named for t in set(terms(text)))
    words = {t for n in NOTICES.values() for t in terms(n)}
    idf = lambda t: math.log((len(named) + 1) / ((df[t] if t in words else 0) + 1)) + 1
    vector = lambda text: {t: n * idf(t) for t, n in Counter(terms(text)).items()}
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    own, flag = {}, r"(?i)(^|/)(un)?licen[sc]e[^/]*$|(^|/)(copying|notice)[^/]*$"
    for path, text in named:
        for line in re.split("[\r\n]+", text):
            v = vector(line)
            for name, notice in NOTICES.items():
                u = vector(notice)
                if v and (s := round(sum(w * u.get(t, 0) for t, w in v.items()) / norm(v) / norm(u), 6)) >= threshold:
                    own[path] = min(own.get(path, (0, "")), (-s, name))
    given = {}
    for path in own:
        if re.search(flag, path):
            d = path.rpartition("/")[0]
            given[d] = min(given.get(d, (0, "")), own[path])
    out = []
    for path, _ in files:
        up = path.rpartition("/")[0] if path is not None else None
        while up and up not in given:
            up = up.rpartition("/")[0]
        if path in own:
            out.append((path, own[path][1], -own[path][0], "header", None))
        elif up in given:
            out.append((path, given[up][1], -given[up][0], "directory", up))
        else:
            out.append((path, None, None, "none", None))
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.95])
def test_equals_plain_scan(spark, threshold):
    files = spark.createDataFrame([(p, t, "clash") for p, t in FILES], "path string, text string, license string")
    got = license_scan(files, threshold=threshold).collect()
    found = [(r.path, r.license, r.score and round(r.score, 5), r.origin, r.from_dir) for r in got]
    want = [(p, n, s and round(s, 5), o, d) for p, n, s, o, d in plain(FILES, threshold)]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_heavy_terms_lose_nothing():
    vector = {"a": 0.8, "b": 0.48, "c": 0.36}
    assert heavy_terms(vector, 0.61) == {"a"} and heavy_terms(vector, 0.59) == {"a", "b"}
    assert heavy_terms(vector, 0.01) == {"a", "b", "c"} and heavy_terms(vector, 1.0) == {"a"}


def test_no_python_and_no_cross_join(spark, folder):
    plan = op1_license_scan(spark, folder)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Arrow", "Pandas"):
        assert bad not in plan


def test_empty_table(spark):
    assert license_scan(spark.createDataFrame([], "path string, text string")).collect() == []
    only = spark.createDataFrame([("a/b", "text")], "path string, text string")
    assert [r.origin for r in license_scan(only, is_license_file=F.lit(None).cast("boolean")).collect()] == ["none"]


APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
GPL = """#!/bin/sh
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.
#
run
"""


def test_headers_and_whole_license_texts(spark):
    full = dict(license_texts())
    mit = "Copyright (c) 2020 A. Person\n\n" + full["MIT"]
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
    files = [
        ("h/one_line.c", APACHE), ("h/gpl3.sh", GPL.format(3)), ("h/gpl2.sh", GPL.format(2)),
        ("h/mit.js", "/*\n" + "".join(f" * {x}\n" for x in mit.splitlines()) + " */\n" + f"{words};\n" * 50),
        ("h/prose.txt", f"{words} {words}. Released under the MIT License. {words}"),
        ("w/whole_under_any_name", mit), ("w/sub/code.c", "int main"), ("b2/text", "Copyright 2021 B. Holder\n" + full["BSD-2-Clause"]), ("b2/x", "x"),
        ("g/LICENSE", full["GPL-3.0"]), ("a/LICENSE", full["Apache-2.0"]), ("m/LICENSE", full["MPL-2.0"]), ("g/y", "y"), ("a/y", "y"), ("m/y", "y"),
        ("h/plain.c", words), *((f"p/{i}", f"{words} the file {i} of the work, and you may use a copy of it") for i in range(40)),
    ]
    got = {r.path: r for r in license_scan(spark.createDataFrame(files, "path string, text string")).collect()}
    own = {p: r.license for p, r in got.items() if r.origin == "header"}
    assert own == {
        "h/one_line.c": "Apache-2.0", "h/gpl3.sh": "GPL-3.0", "h/gpl2.sh": "GPL-2.0", "h/mit.js": "MIT", "h/prose.txt": "MIT", "w/whole_under_any_name": "MIT",
        "b2/text": "BSD-2-Clause", "g/LICENSE": "GPL-3.0", "a/LICENSE": "Apache-2.0", "m/LICENSE": "MPL-2.0",
    }
    inherited = {p: (r.license, r.from_dir) for p, r in got.items() if r.origin == "directory"}
    assert inherited == {
        "w/sub/code.c": ("MIT", "w"), "b2/x": ("BSD-2-Clause", "b2"), "g/y": ("GPL-3.0", "g"), "a/y": ("Apache-2.0", "a"), "m/y": ("MPL-2.0", "m"),
    }


def test_columns_of_any_name_stay(spark):
    names = ["up", "given", "given_score", "_dir", "_row", "_flag", "times", "a.b", "present", "key"]
    rows = [("d/LICENSE", "Released under the MIT License.", *names), ("d/x", "x", *names)]
    files = spark.createDataFrame(rows, "path string, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = license_scan(files)
    assert got.columns == ["path", *names, "license", "score", "origin", "from_dir"]
    assert sorted((r.path, r.license, r["_dir"], r["a.b"], r["up"]) for r in got.collect()) == [("d/LICENSE", "MIT", "_dir", "a.b", "up"), ("d/x", "MIT", "_dir", "a.b", "up")]


def test_masses(spark):
    rows = spark.createDataFrame([(["a", "c", "x"],), ([],), (["b"],)], "terms array<string>")
    got = [r[0] for r in rows.select(_masses("terms", [{"a": 0.8, "b": 0.6}, {"c": 1.0}])).collect()]
    assert [[round(v, 9) for v in r] for r in got] == [[0.64, 1.0], [0.0, 0.0], [0.36, 0.0]]


def test_products_and_norms_within_the_row(spark):
    rows = spark.createDataFrame([(["a", "b", "a", "x", "x", "y"],), ([],)], "terms array<string>")
    known = F.filter("terms", lambda t: t.isin("a", "b", "c"))
    sums = license_scan_module._sums("known", [{"a": 0.5, "b": 2.0}, {"c": 1.0}])
    squares = license_scan_module._square_sum("terms", {"a": 3.0, "b": 0.5}, 2.0)
    got = rows.withColumn("known", known).select(sums, squares).collect()
    assert [r[0] for r in got] == [[3.0, 0.0], [0.0, 0.0]]
    assert [r[1] for r in got] == [36 + 0.25 + 16 + 4, 0.0]


def test_pieces_are_scored_without_a_row_per_term(spark, monkeypatch):
    plans, held = [], license_scan_module.stored

    def looking(df, label):
        if label.endswith("-hits"):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return held(df, label)

    monkeypatch.setattr(license_scan_module, "stored", looking)
    files = spark.createDataFrame(FILES, "path string, text string")
    assert license_scan(files).filter("origin = 'header'").count()
    assert len(plans) == 3 and not [p for p in plans if "explode" in p]
