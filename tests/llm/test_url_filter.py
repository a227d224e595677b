"""URL rules against a plain search over all rules."""

import pytest

from platwork.llm.url_filter import RULES, Rule, judge_urls, op3_url_filter

URLS = [
    "http://example.org/en/12", "http://www.example.org/es/1?q=1", "HTTPS://Sub.EXAMPLE.org/en/2#top", "http://notexample.org/es/x", "x://com/de/",
    "http://a.com/fr/x", "http://a.com/de", "http://a.net", "http://org", "http://org/", "no scheme", "", None, "a://b://org/", "http://example.org?x=/es/",
    "http://example.org/en/1", "http://é.com/fr/é", "http://example.org:80/es/", "mailto:x", "http:///fr/", "http://com/de/de/" * 50, "http://a.net",
]


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else default


MORE = (*RULES, Rule("block", "org", "/"), Rule("allow", "b.example.org", ""), Rule("block", "net", ""), Rule("allow", "com", "/de/de"))


@pytest.mark.parametrize("rules", [RULES, MORE, ()])
@pytest.mark.parametrize("trie_bytes", [1 << 20, -1])
def test_equals_plain_search(spark, rules, trie_bytes):
    """The broadcast trie and the join of large rule sets give the same verdicts."""
    if not rules and trie_bytes < 0:
        pytest.skip("no rules are never too large")
    rows = [(i, u, "clash") for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = judge_urls(pages, rules, trie_bytes=trie_bytes).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == [(i, *plain(u, rules)) for i, u in enumerate(URLS)]


def test_empty_table_and_bad_rules(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(empty, RULES).collect() == []
    with pytest.raises(ValueError):
        judge_urls(empty, [Rule("maybe", "org", "/")])


def test_query(spark, folder):
    rows = op3_url_filter(spark, folder).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    assert len(rows) == len(urls)
    assert all((r.host, r.path, r.rule, r.verdict) == plain(urls[r.page_id], RULES) for r in rows)
