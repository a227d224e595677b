"""License scan: TF-IDF cosine of lines, sentences and texts to licenses, then inheritance along directories.

Method, with DataFrame functions only. Every line of every text is compared with the short notices, every
sentence, across line breaks and comment marks, with the notices and the sentences of usual headers, and
every whole text with the full license texts. Document frequencies of the templates' terms are counted
over all texts; a term outside the templates weighs as one that no text holds, and is summed up in its row. A line or sentence can only
reach the threshold if it holds one of a template's heaviest terms (those without which its remaining
weight stays below the threshold), and a text only if the squared weights of the license terms it holds
sum up to the squared threshold, so others are passed over without loss. The rest are compared with all
templates within their row, once per distinct piece. Files without a license of
their own take that of the nearest directory, at or above their own, that holds a license file, by name or
by a match to a full text: directories are joined with their ancestors' paths and the longest one that is
licensed wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from math import log, sqrt
from pathlib import Path
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platwork.llm.common import stored, table
from platwork.operators.skew import salted_join

# Short notices by license name.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
# Fixed values: (license, sentence of its usual header). Near neighbours are here to be told apart.
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
     "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
     "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    *((name, f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the "
       f"Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
      for name, thing, kind, version in (("AGPL-3.0", "program", "Affero General", "3"), ("GPL-2.0", "program", "General", "2"), ("GPL-3.0", "program", "General", "3"),
                                         ("LGPL-2.1", "library", "Lesser General", "2.1"), ("LGPL-3.0", "library", "Lesser General", "3"))),
    *((f"CC-{short}-4.0", f"This work is licensed under a Creative Commons {long} 4.0 International License.")
      for short, long in (("BY", "Attribution"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
                          ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-SA", "Attribution-ShareAlike"))),
)
THRESHOLD = 0.6
WINDOW_THRESHOLD = 0.6  # sentences and whole texts need this, or the threshold of lines if it is higher
LICENSE_TEXT = 0.9  # a text of this cosine to a full license text is that license, and its file a license file
MAX_TERMS = 50_000  # distinct terms of all templates: their weights are broadcast, a few MB
PARTS = 64  # maps that a look-up of a term is cut into
LICENSE_FILE = r"(?i)(^|/)(un)?licen[sc]e[^/]*$|(^|/)(copying|notice)[^/]*$"
_BREAKS = "[^a-z0-9]+"
# Between sentences: blanks after an end mark, or a line without letters and digits.
_SENTENCES = r"(?<=[.!?])\s+|(?>\r\n|[\r\n])[^\p{L}\p{N}\r\n]*(?>\r\n|[\r\n])"


def license_texts() -> list[tuple[str, str]]:
    """(license, full text) of the files beside this module; only the driver reads them."""
    return [(p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]


def terms_of(text: Column) -> Column:
    """The terms of a text in order, an empty one possible at its ends."""
    return F.split(F.lower(text), _BREAKS)


def _vector(notice: str, idf: Mapping[str, float]) -> dict[str, float]:
    terms = [t for t in re.split(_BREAKS, notice.lower()) if t]
    raw = {t: terms.count(t) * idf[t] for t in terms}
    norm = sqrt(sum(w * w for w in raw.values()))
    return {t: w / norm for t, w in raw.items()}


def heavy_terms(vector: Mapping[str, float], threshold: float) -> set[str]:
    """The heaviest terms of a unit vector without which its norm is below the threshold."""
    rest, out = sum(w * w for w in vector.values()), set()
    for term, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
        # Scores are rounded to six digits, so a cosine just below the threshold may count.
        if rest < (threshold - 1e-5) ** 2:
            break
        out.add(term)
        rest -= w * w
    return out


def _words(texts: Iterable[str]) -> list[str]:
    return sorted({t for text in texts for t in re.split(_BREAKS, text.lower()) if t})


def _has(text: Column, terms: Iterable[str]) -> Column:
    return F.lower(text).rlike("(?<![a-z0-9])(?:" + "|".join(sorted(terms)) + ")(?![a-z0-9])")


def _in(known: Iterable[str]) -> str:
    """SQL: the term t is ``known``, by a look into a hash set. Terms have no quotes; one text is
    parsed faster than thousands of literals are made."""
    return "t IN (" + ", ".join(f"'{t}'" for t in sorted(known)) + ")"


def _among(terms: str, known: Iterable[str]) -> Column:
    """The elements of an array column that are ``known``."""
    return F.expr(f"filter({terms}, t -> {_in(known)})")


def _held(values: Mapping[str, str]) -> str:
    """SQL: the value of the term t, null for others. The terms are dealt to constant maps by their
    checksum, because a look into a map goes through its terms."""
    parts: list[list[str]] = [[] for _ in range(PARTS)]
    for term, value in sorted(values.items()):
        parts[crc32(term.encode()) % PARTS].append(f"'{term}', {value}")
    # No term is empty; this one gives maps without terms their type.
    filler = f"'', {next(iter(values.values()))}"
    maps = ", ".join(f"map({', '.join(part or [filler])})" for part in parts)
    return f"try_element_at(element_at(array({maps}), CAST(crc32(CAST(t AS BINARY)) % {PARTS} AS INT) + 1), t)"


def _square_sum(terms: str, weights: Mapping[str, float], outside: float) -> Column:
    """The sum of the squared (number of times * weight) of an array column's terms; those without a
    weight weigh ``outside``."""
    weighted = F.expr(f"transform(sort_array({terms}), t -> struct(t AS term, coalesce({_held({t: f'{w!r}D' for t, w in weights.items()})}, {outside!r}D) AS w))")
    start = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0.0).alias("sum"))

    def step(state: Column, item: Column) -> Column:
        run = F.when(item["term"] == state["last"], state["run"] + 1).otherwise(F.lit(1).cast("long"))
        # 1 + 3 + 5 + ...: the odd numbers of a run sum up to its square.
        return F.struct(item["term"].alias("last"), run.alias("run"), (state["sum"] + (2 * run - 1) * item["w"] * item["w"]).alias("sum"))

    return F.aggregate(weighted, start, step, lambda state: state["sum"])


def _sums(terms: str, vectors: Sequence[Mapping[str, float]]) -> Column:
    """Per vector the sum of its values over an array column's terms: an array."""
    known = sorted(set().union(*vectors))
    held = _held({t: f"array({', '.join(f'{v.get(t, 0.0)!r}D' for v in vectors)})" for t in known})
    zero = "array(" + ", ".join(["0.0D"] * len(vectors)) + ")"
    return F.expr(f"aggregate({terms}, {zero}, (sums, t) -> coalesce(zip_with(sums, {held}, (a, b) -> a + b), sums))")


def _masses(terms: str, vectors: Sequence[Mapping[str, float]]) -> Column:
    """Per vector the squared weights of an array column's distinct terms, summed up: an array."""
    return _sums(terms, [{t: w**2 for t, w in v.items()} for v in vectors])


def _hits(
    pieces: DataFrame, templates: Sequence[tuple[str, str]], idf: Mapping[str, float], outside: float, lowest: float, label: str
) -> DataFrame:
    """(path, score, license): the best template of each row of ``pieces`` (path, piece, need), if its score is ``need`` or more.

    ``lowest`` is the least ``need``. A piece's norm and its products with all templates are summed up
    within its row, so that a piece stays one row whatever its number of terms.
    """
    keyed = stored(pieces.select("path", "need", F.md5("piece").alias("key"), "piece"), f"license-{label}")
    distinct = keyed.groupBy("key").agg(F.first("piece").alias("piece"))
    split = distinct.select("key", F.filter(terms_of(F.col("piece")), lambda t: t != "").alias("terms"))
    shares = [_vector(text, idf) for _, text in templates]
    split = split.select("key", "terms", _among("terms", set().union(*shares)).alias("known"))
    # A term that comes n times adds its weight n times to a product.
    products = _sums("known", [{t: w * idf[t] for t, w in v.items()} for v in shares])
    norm = F.nullif(F.sqrt(_square_sum("terms", idf, outside)), F.lit(0.0))
    names = F.array(*[F.lit(name) for name, _ in templates])

    def best(row: Column) -> Column:
        scored = F.zip_with(row["products"], names, lambda dot, name: F.struct(-F.round(dot / row["norm"], 6), name.alias("license")))
        return F.array_min(F.filter(scored, lambda s: (s["col1"] < 0) & (s["col1"] <= -lowest)))

    # An array of one, so that products and norm are made once per row.
    hit = F.element_at(F.transform(F.array(F.struct(products.alias("products"), norm.alias("norm"))), best), 1)
    hits = split.select("key", hit.alias("b"))
    hits = stored(hits, f"license-{label}-hits").filter("b IS NOT NULL")
    counts = keyed.groupBy("key").agg(F.count("*").alias("times"))
    found = salted_join(keyed.select("path", "need", "key"), hits, ["key"], counts, "times")
    found = found.select("path", "need", (-F.col("b.col1")).alias("score"), F.col("b.license").alias("license"))
    return found.filter(F.col("score") >= F.col("need")).drop("need")


def _heavy(templates: Sequence[tuple[str, str]], idf: Mapping[str, float], threshold: float) -> set[str]:
    return set().union(*(heavy_terms(_vector(text, idf), threshold) for _, text in templates))


def _masses(terms: str, vectors: Sequence[Mapping[str, float]]) -> Column:
    """Per vector the squared weights of an array column's distinct terms, summed up: an array. The
    weights are one constant map from term to all vectors' squares."""
    known = sorted(set().union(*vectors))
    squares = (f"'{t}', array({', '.join(f'{v.get(t, 0.0) ** 2!r}D' for v in vectors)})" for t in known)
    zero = "array(" + ", ".join(["0.0D"] * len(vectors)) + ")"
    held = f"try_element_at(map({', '.join(squares)}), t)"
    return F.expr(f"aggregate({terms}, {zero}, (sums, t) -> coalesce(zip_with(sums, {held}, (a, b) -> a + b), sums))")


def own_licenses(
    files: DataFrame, notices: Mapping[str, str] = NOTICES, threshold: float = THRESHOLD,
    headers: Sequence[tuple[str, str]] = HEADERS, texts: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """(path, license, score, whole): per path its best line, sentence or whole text, ties to the first name.

    A whole text of cosine ``LICENSE_TEXT`` to a full license text comes before any part; ``whole`` tells it.
    The texts are read twice: to count the templates' terms, and to keep the texts that hold enough of
    them; lines and sentences are only made of those.
    """
    texts = license_texts() if texts is None else texts
    line_terms, vocabulary = _words(notices.values()), _words(text for _, text in [*notices.items(), *headers, *texts])
    if not line_terms or len(vocabulary) > MAX_TERMS:
        raise ValueError(f"The notices must have a term, and all templates at most {MAX_TERMS}")
    text = F.coalesce(F.col("text"), F.lit(""))
    split = files.select("path", text.alias("text"), F.array_distinct(terms_of(text)).alias("terms"))
    rows = split.select("path", "text", _among("terms", vocabulary).alias("present"))
    # At most one row per term of the templates.
    counted = rows.select(F.explode("present").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()
    df = {r["term"]: r["n"] for r in counted}
    total = files.count()
    idf = {t: log((total + 1) / (df.get(t, 0) + 1)) + 1 for t in vocabulary}
    outside = log(total + 1) + 1
    wide = max(threshold, WINDOW_THRESHOLD)

    # For the notices, only their own terms are inside.
    line_idf = {t: idf[t] for t in line_terms}
    noticed, headed = _heavy(list(notices.items()), line_idf, threshold), _heavy(headers, idf, wide) if headers else set()
    holds = lambda known: F.expr(f"exists(present, t -> {_in(known)})") if known else F.lit(False)
    # No cosine is above the norm of the shared terms' shares.
    near = F.array_max(_masses("present", [_vector(full, idf) for _, full in texts])) >= (wide - 1e-5) ** 2 if texts else F.lit(False)
    # A column that no rule may compute twice keeps the filter above this projection; below it, the
    # terms of every text would be made anew for each flag.
    rows = rows.select("path", "text", "present", holds(noticed).alias("noticed"), holds(headed).alias("headed"), near.alias("near"), F.spark_partition_id().alias("part"))
    held = stored(rows.filter("noticed OR headed OR near"), "license-candidates")

    def pieces(flag: str, breaks: str, need: float) -> DataFrame:
        return held.filter(flag).select("path", F.explode(F.split("text", breaks)).alias("piece"), F.lit(need).alias("need"))

    chosen = _has(F.col("piece"), noticed)
    parts = pieces("noticed", r"[\r\n]+", threshold).filter(chosen).unionByName(pieces("noticed", _SENTENCES, wide).filter(chosen))
    parts = _hits(parts, list(notices.items()), line_idf, outside, threshold, "notices")
    if headers:
        spoken = pieces("headed", _SENTENCES, wide).filter(_has(F.col("piece"), headed))
        parts = parts.unionByName(_hits(spoken, headers, idf, outside, wide, "headers"))
    parts = parts.withColumn("whole", F.lit(False))
    if texts:
        whole = held.filter("near").select("path", F.col("text").alias("piece"), F.lit(wide).alias("need"))
        by_text = _hits(whole, texts, idf, outside, wide, "texts")
        parts = parts.unionByName(by_text.withColumn("whole", F.col("score") >= LICENSE_TEXT))
    best = parts.groupBy("path").agg(F.min(F.struct(~F.col("whole"), -F.col("score"), "license")).alias("b"))
    return best.select("path", F.col("b.license").alias("license"), (-F.col("b.col2")).alias("score"), (~F.col("b.col1")).alias("whole"))


def directory_of(path: Column) -> Column:
    """All before the last slash; empty for a file at the top."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def _ancestors(directory: Column) -> Column:
    """The directory itself and every one above it, the top included."""
    parts = F.split(directory, "/")
    upward = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("")), upward))


def license_scan(
    files: DataFrame, notices: Mapping[str, str] = NOTICES, threshold: float = THRESHOLD, is_license_file: Column | None = None,
    headers: Sequence[tuple[str, str]] = HEADERS, texts: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """Per row of ``files`` (path, text, ...): ``license``, ``score``, ``origin`` and ``from_dir``.

    ``origin`` is header, directory or none. A file's own header comes first; else the nearest
    directory at or above its own with a license file that was recognised. Of several license files
    in a directory the best score counts, then the first name. ``is_license_file`` is by default a
    test of the file name; a file whose whole text is a full license text is one under any name. A null
    or empty text has no header but may inherit; a null path has neither. Rows of one path count as one
    file and get the same result. All columns but ``text`` stay, whatever their names; those named like
    a result are replaced.
    """
    flag = F.col("path").rlike(LICENSE_FILE) if is_license_file is None else is_license_file
    results = ["license", "score", "origin", "from_dir"]
    own_columns = [F.col("`" + c.replace("`", "``") + "`") for c in files.columns if c not in (*results, "text")]
    # The caller's columns travel in one struct, so that none of their names meets one of these.
    base = files.select(
        F.struct(*own_columns).alias("_row"), "path", "text", F.coalesce(flag, F.lit(False)).alias("_flag"), directory_of(F.col("path")).alias("_dir")
    )
    named = base.filter("path IS NOT NULL")
    own = stored(own_licenses(named.select("path", "text"), notices, threshold, headers, texts), "license-own")
    marked = named.groupBy("path", "_dir").agg(F.max("_flag").alias("_flag"))
    given = marked.join(own, "path").filter("_flag OR whole").groupBy(F.col("_dir").alias("up")).agg(F.min(F.struct(-F.col("score"), "license")).alias("g"))
    given = stored(given.select("up", F.col("g.license").alias("given"), (-F.col("g.col1")).alias("given_score")), "license-dirs")
    dirs = stored(named.groupBy("_dir").agg(F.count("*").alias("times")), "dirs")
    upward = dirs.select("_dir", F.explode(_ancestors(F.col("_dir"))).alias("up"))
    reach = salted_join(upward, given, ["up"], upward.groupBy("up").agg(F.count("*").alias("times")), "times")
    nearest = reach.groupBy("_dir").agg(F.max_by(F.struct("up", "given", "given_score"), F.length("up")).alias("near"))
    nearest = stored(nearest.select("_dir", "near.*"), "license-nearest")
    slim = base.select("_row", "path", "_dir")
    headed = salted_join(slim, own.drop("whole"), ["path"], slim.groupBy("path").agg(F.count("*").alias("times")), "times", "left")
    joined = salted_join(headed, nearest, ["_dir"], dirs, "times", "left")
    header, inherited = F.col("license").isNotNull(), F.col("given").isNotNull()
    return joined.select(
        "_row.*",
        F.coalesce("license", "given").alias("license"), F.coalesce("score", "given_score").alias("score"),
        F.when(header, "header").when(inherited, "directory").otherwise("none").alias("origin"),
        F.when(~header & inherited, F.col("up")).alias("from_dir"),
    )


# Documents of at most this many characters lie one directory up, as its license files.
SHORT = 200


def document_files(docs: DataFrame) -> DataFrame:
    """The documents as files: source/lang/thousand/sixteen/id, short ones at source/lang/thousand/id."""
    number = F.coalesce(F.col("doc_id"), F.lit(-1))
    short = F.length(F.coalesce(F.col("text"), F.lit(""))) <= SHORT
    top = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(number / 1000).cast("string"))
    path = F.when(short, F.concat_ws("/", top, number.cast("string"))).otherwise(
        F.concat_ws("/", top, F.floor(number / 16).cast("string"), number.cast("string"))
    )
    return docs.select("doc_id", path.alias("path"), "text", short.alias("short"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    scanned = license_scan(document_files(docs), is_license_file=F.col("short"))
    return scanned.select("doc_id", "path", "license", "score", "origin", "from_dir")


_VALUES = ", ".join(f"('{name}', '{notice}')" for name, notice in NOTICES.items())
OP1_SQL = f"""
WITH files AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) <= {SHORT} AS short,
         coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || CAST(CAST(floor(coalesce(doc_id, -1) / 1000) AS BIGINT) AS VARCHAR)
         || CASE WHEN length(coalesce(text, '')) <= {SHORT} THEN '' ELSE '/' || CAST(CAST(floor(coalesce(doc_id, -1) / 16) AS BIGINT) AS VARCHAR) END AS dir
  FROM documents
), paths AS (SELECT *, dir || '/' || CAST(coalesce(doc_id, -1) AS VARCHAR) AS path FROM files),
notices(license, notice) AS (VALUES {_VALUES}),
nt AS (
  SELECT license, term, count(*) AS tf FROM (SELECT license, unnest(regexp_split_to_array(lower(notice), '[^a-z0-9]+')) AS term FROM notices)
  WHERE term <> '' GROUP BY ALL
), n AS (SELECT count(*) AS total FROM files),
words AS (SELECT DISTINCT path, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM paths),
idf AS (
  SELECT t.term, ln((total + 1) / (coalesce(c, 0) + 1)) + 1 AS idf
  FROM (SELECT DISTINCT term FROM nt) t CROSS JOIN n LEFT JOIN (SELECT term, count(*) AS c FROM words GROUP BY term) d ON t.term = d.term
), nv AS (
  SELECT license, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY license)) AS share FROM nt JOIN idf USING (term)
), lines AS (SELECT path, unnest(regexp_split_to_array(text, '[\\r\\n]+')) AS line FROM paths),
chosen AS (SELECT DISTINCT line FROM lines),
tf AS (
  SELECT line, term, count(*) AS tf FROM (SELECT line, unnest(regexp_split_to_array(lower(line), '[^a-z0-9]+')) AS term FROM chosen)
  WHERE term <> '' GROUP BY ALL
), w AS (SELECT line, tf.term, tf * coalesce(idf, ln(total + 1) + 1) AS w FROM tf CROSS JOIN n LEFT JOIN idf ON tf.term = idf.term),
norms AS (SELECT line, sqrt(sum(w * w)) AS norm FROM w GROUP BY line),
dots AS (SELECT line, license, sum(w * share) AS dot FROM w JOIN nv ON w.term = nv.term GROUP BY ALL),
hits AS (
  SELECT line, license, round(dot / norm, 6) AS score FROM dots JOIN norms USING (line) WHERE round(dot / norm, 6) >= {THRESHOLD}
), own AS (
  SELECT path, license, score FROM lines JOIN hits USING (line) QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1
), given AS (
  SELECT dir AS up, license, score FROM paths JOIN own USING (path) WHERE short
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1
), near AS (
  SELECT d.dir, up, license, score FROM (SELECT DISTINCT dir FROM paths) d JOIN given g ON d.dir = g.up OR starts_with(d.dir, g.up || '/')
  QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(up) DESC) = 1
)
SELECT doc_id, p.path, coalesce(o.license, g.license) AS license, coalesce(o.score, g.score) AS score,
       CASE WHEN o.license IS NOT NULL THEN 'header' WHEN g.license IS NOT NULL THEN 'directory' ELSE 'none' END AS origin,
       CASE WHEN o.license IS NULL AND g.license IS NOT NULL THEN g.up END AS from_dir
FROM paths p LEFT JOIN own o ON p.path = o.path LEFT JOIN near g ON p.dir = g.dir
"""
