import re

import pytest

from strataline.llm import url_filter
from strataline.llm.queries import URL_RULES

URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "http://a.NET/x", "https://x.example.net/en/1?q#f", "https://example.net/en", "https://example.net:80/en/", "http://notnet/", "http://example.com/de/a", "http://b.org/fr/", "http://b.org/fr?x", "a://b://net/", "http://x.net?q=/", "http://net./", "http://.net/", "http://example.com//de/", "ftp://u@example.com/de/"]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    found = []
    for rule, verdict in URL_RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            found.append((len(rule), rule, verdict))
    best = max(found, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_judgements(spark):
    pages = spark.createDataFrame([(i, u, "x", "clash", "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, html string, host string, rule string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, url_filter.rules_table(spark, URL_RULES)).collect()}
    assert len(got) == 2 * len(URLS)
    for i, u in enumerate(URLS * 2):
        assert tuple(got[i])[1:] == judged(u), u


def test_no_rows_and_no_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, url_filter.rules_table(spark, URL_RULES)).count() == 0
    one = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    assert url_filter.judge(one, url_filter.rules_table(spark, [])).first()["verdict"] == "allow"


def test_block_wins_at_equal_length_and_bad_rules_are_refused(spark):
    one = spark.createDataFrame([(1, "http://a.b/c/")], "page_id long, url string")
    rules = url_filter.rules_table(spark, [("a.b/c/", "allow"), ("a.b/c/", "block")])
    assert url_filter.judge(one, rules).first()["verdict"] == "block"
    for bad in (("/x/", "block"), ("a/x", "block"), ("a/", "maybe")):
        with pytest.raises(ValueError):
            url_filter.rules_table(spark, [bad])


def test_one_host_on_most_pages(spark):
    urls = [f"http://hot.net/p{i}" if i % 10 else f"http://site{i}.org/fr/x" for i in range(500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(6)
    got = {r["page_id"]: r for r in url_filter.judge(pages, url_filter.rules_table(spark, URL_RULES)).collect()}
    assert all(tuple(got[i])[1:] == judged(u) for i, u in enumerate(urls))
