import re

import pytest

from refmask.llm.url_filter import Rule, features, filter_urls, labelled_urls, train

RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]
URLS = [
    "http://a.example.net/en/1", "http://a.example.net/de/1", "HTTP://A.Example.NET/en/x?y", "http://example.net", "http://net/", "http://net?x=/", "http://internet/x",
    "https://example.com/de/", "https://notexample.com/de/", "https://m.example.com/de?x", "https://b.org/fr/#t", "https://b.org/FR/", "org/fr/", None, "", "://", "x://y://z/fr/",
    "http://É.org/fr/a\nb", "http://h.org#/fr/", "a://b.net/%20?", "http://free-bets.example.com/en/1", "http://www.station.example.com/en/2", "http://free-bets.example.com/en/1",
]


def brute(url):
    if not url or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(labelled_urls(), "url string, label int")


def test_parts_and_rules(spark, labelled):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id bigint, url string, host string")
    rows = filter_urls(pages, RULES, labelled).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path, rule, verdict = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), URLS[r.page_id]
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow")) and 0 <= r.score <= 1
    by_url = {URLS[r.page_id]: r.verdict for r in rows}
    assert by_url["http://free-bets.example.com/en/1"] == "block" and by_url["http://www.station.example.com/en/2"] == "allow"
    assert filter_urls(pages.limit(0), RULES, labelled).count() == 0


def test_unlabelled_and_one_sided_tables(spark, labelled):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (None, None)], "page_id bigint, url string")
    assert {r.score for r in filter_urls(pages, [], labelled.limit(0)).collect()} == {0.5}
    assert all(r.score > 0.5 for r in filter_urls(pages.limit(1), [], labelled.where("label = 1")).collect())
    assert train(labelled.selectExpr("url", "cast(null as int) as label")) == train(labelled.limit(0))


def test_held_out_names(spark, labelled):
    """Names that were not in the training table are told apart by their n-grams."""
    weights_from = labelled.where("url NOT RLIKE 'casino|bets|station|nation'")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://cheap-win.example.com/en/9", "http://ads-click.example.org/de/7", "http://newsreading.example.com/en/9", "http://m.thegarden.example.org/de/7"])], "page_id bigint, url string")
    assert [r.verdict for r in filter_urls(pages, [], weights_from).orderBy("page_id").collect()] == ["block", "block", "allow", "allow"]


def test_grams_are_distinct_and_in_range(spark):
    rows = features(spark.createDataFrame([("aaaaaaa", ""), ("", "/x")], "host string, path string")).collect()
    assert all(len(set(r.grams)) == len(r.grams) and all(0 <= g < 4096 for g in r.grams) for r in rows)
