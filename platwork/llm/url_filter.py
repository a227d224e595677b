"""URL filtering by allow and block rules: the longest matching rule decides.

Method: one trie over reversed host labels (``com`` -> ``example`` -> ``www``); each host node has
a trie over path segments whose last segment is matched as a prefix. The trie is broadcast while
its rules stay below ``TRIE_BYTES``; larger rule sets are joined by host suffix instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platwork.llm.common import table

# Rules above this many characters are not broadcast.
TRIE_BYTES = 32 << 20
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


class UrlTrie:
    """``find(host, path)`` gives the rule with the most host labels, then the longest path."""

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root: dict = {"kids": {}, "paths": None}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node["kids"].setdefault(label, {"kids": {}, "paths": None})
            *segments, tail = rule.path.split("/")
            spot = node["paths"] = node["paths"] or {"kids": {}, "tails": {}}
            for segment in segments:
                spot = spot["kids"].setdefault(segment, {"kids": {}, "tails": {}})
            known = spot["tails"].get(tail)
            # The same host and path both allowed and blocked: blocked.
            if known is None or rule.verdict == "block":
                spot["tails"][tail] = rule

    @staticmethod
    def _longest(spot: dict | None, path: str) -> Rule | None:
        best = None
        for segment in path.split("/"):
            if spot is None:
                break
            fits = [tail for tail in spot["tails"] if segment.startswith(tail)] if len(spot["tails"]) <= len(segment) else [
                segment[:n] for n in range(len(segment) + 1) if segment[:n] in spot["tails"]
            ]
            if fits:
                best = spot["tails"][max(fits, key=len)]
            spot = spot["kids"].get(segment)
        return best

    def find(self, host: str, path: str) -> Rule | None:
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node["kids"].get(label)
            if node is None:
                break
            best = self._longest(node["paths"], path) or best
        return best


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _checked(rules: Sequence[Rule]) -> list[Rule]:
    out = [Rule(*r) for r in rules]
    if any(r.verdict not in ("allow", "block") or not r.host for r in out):
        raise ValueError("A rule is ('allow' or 'block', host, path) with a host")
    return out


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = DEFAULT, trie_bytes: int = TRIE_BYTES
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced.

    A rule fits its host and every subdomain if the path starts with the rule's path. The most
    specific host wins, then the longest path, then block. Without a fitting rule ``rule`` is null
    and ``verdict`` the default. A null url, or one without ``://``, has empty host and path and
    meets no rule. Repeated rows stay; an empty table gives an empty one.
    """
    rules = _checked(rules)
    parts = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    if sum(len(r.text) + 8 for r in rules) > trie_bytes:
        return _judge_by_join(parts, rules, default)
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("struct<rule:string,verdict:string>")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = [trie.value.find(h, p) for h, p in zip(host, path)]
        return pd.DataFrame({"rule": [f and f.text for f in found], "verdict": [f.verdict if f else default for f in found]})

    verdict = parts.withColumn("_judged", judge("host", "path"))
    return verdict.withColumns({"rule": F.col("_judged.rule"), "verdict": F.col("_judged.verdict")}).drop("_judged")


def _judge_by_join(parts: DataFrame, rules: Sequence[Rule], default: str) -> DataFrame:
    """The same for rule sets too large to broadcast: distinct (host, path) joined by host suffix."""
    spark = parts.sparkSession
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )
    wanted = parts.select("host", "path").distinct().withColumn("_suffix", F.explode(suffixes))
    known = spark.createDataFrame([tuple(r) for r in rules], "_verdict string, _suffix string, _prefix string")
    order = F.struct(
        F.size(F.split("_suffix", r"\.")).alias("n"), F.length("_prefix").alias("l"), F.col("_verdict").alias("v"),
        F.concat("_suffix", "_prefix").alias("r"),
    )
    best = (
        wanted.join(known, "_suffix").filter(F.col("path").startswith(F.col("_prefix")))
        .groupBy("host", "path").agg(F.max(order).alias("_best"))
    )
    return (
        parts.drop("rule", "verdict").join(best, ["host", "path"], "left")
        .withColumns({"rule": F.col("_best.r"), "verdict": F.coalesce("_best.v", F.lit(default))}).drop("_best")
    )


# The rules of the registered query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = """
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), best AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts)
  JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""
