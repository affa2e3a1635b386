from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from shelfmark.model import CrawlConfig
from shelfmark.operators import filters as X
from shelfmark.operators import robots as RB

AGENT = "Shelfmark/1.0 (+https://example.org)"

FILES = {
    "star": "User-agent: *\nDisallow: /private\nAllow: /private/open\n",
    "order": "User-agent: *\nAllow: /private/open\nDisallow: /private\n",
    "named": "User-agent: *\nDisallow: /\n\nUser-agent: shelf\nDisallow: /x\n",
    "two-agents": "User-agent: foo\nUser-agent: SHELFMARK\nDisallow: /x\n\nUser-agent: *\nDisallow: /\n",
    "empty-rule": "User-agent: *\nDisallow:\nDisallow: /x\n",
    "no-blank": "User-agent: foo\nDisallow: /\nUser-agent: *\nDisallow: /x\n",
    "orphan-rule": "Disallow: /\n\nUser-agent: *\nDisallow: /x\n",
    "agent-then-blank": "User-agent: *\n\nDisallow: /\n",
    "comments": "# top\nUser-agent: * # all\nDisallow: /x # no\n#Disallow: /\n",
    "quoted": "User-agent: *\nDisallow: /a%20b\nDisallow: /%C3%BC\n",
    "query": "User-agent: *\nDisallow: /s?q=\n",
    "star-path": "User-agent: *\nDisallow: *\n",
    "wildcards": "User-agent: *\nDisallow: /*.html\n",
    "crawl-delay": "User-agent: *\nCrawl-delay: 10\nUser-agent: foo\nDisallow: /\n",
    "two-stars": "User-agent: *\nDisallow: /x\n\nUser-agent: *\nDisallow: /\n",
    "spaces": "  user-AGENT :  *  \r\n  DISALLOW :  /x  \r\n",
    "blank-with-space": "User-agent: *\n \nDisallow: /x\n",
    "empty": "",
    "other": "User-agent: foo\nDisallow: /\n",
}
PATHS = ["", "/", "/x", "/x/y", "/private", "/private/open/1", "/a%20b", "/a b", "/ü", "/s?q=1", "/s", "/i.html", "/*.html", "/y#x"]


def test_verdicts_match_the_standard_library(spark):
    robots = spark.createDataFrame(
        [(f"{name}.org", 200, body) for name, body in FILES.items()], "host string, status_code int, body string"
    )
    cases = [(f"https://{name}.org{path}",) for name in FILES for path in PATHS]
    urls = spark.createDataFrame(cases, "url string")
    for url, allowed in RB.robots_allowed(urls, robots, AGENT).collect():
        parser = RobotFileParser()
        parser.parse(FILES[url.split("/")[2].removesuffix(".org")].splitlines())
        assert allowed == parser.can_fetch(AGENT, url), url


@pytest.mark.parametrize("code, allowed, strict", [(401, False, False), (403, False, False), (404, True, True), (503, True, False)])
def test_unreadable_files(spark, code, allowed, strict):
    robots = spark.createDataFrame([("a.org", code, "")], "host string, status_code int, body string")
    urls = spark.createDataFrame([("https://a.org/x",)], "url string")
    assert RB.robots_allowed(urls, robots, AGENT).first().allowed is allowed
    assert RB.robots_allowed(urls, robots, AGENT, "deny").first().allowed is strict


def test_sitemap_directives(spark):
    body = "Sitemap: https://a.org/1.xml\n  SITEMAP:https://a.org/2.xml \nsitemap:\nSitemaps: x\n# Sitemap: y\n"
    robots = spark.createDataFrame([("a.org", body)], "host string, body string")
    rows = [(r.pos, r.sitemap_url) for r in RB.robots_sitemaps(robots).orderBy("pos").collect()]
    assert rows == [(0, "https://a.org/1.xml"), (1, "https://a.org/2.xml")]
    assert RB.robots_sitemaps(robots, keep_empty=True).count() == 3


def test_first_failing_reason_and_stats(spark):
    robots = spark.createDataFrame([("a.org", 200, "User-agent: *\nDisallow: /de/no\n")], "host string, status_code int, body string")
    wanted = {
        "https://b.org/de/no": "domain",
        "https://a.org/de/no": "robots",
        "https://a.org/de/x": "lang",
        "https://a.org/en/x": "path",
        "https://a.org/en/blog/x": None,
        "https://a.org/x?blog/": "path",
    }
    urls = spark.createDataFrame([(u,) for u in wanted], "url string")
    config = CrawlConfig("https://a.org", lang_filter="en", path_filter="blog/")
    classified = X.classify_urls(urls, config, robots)
    assert {r.url: r.drop_reason for r in classified.collect()} == wanted
    assert X.filter_stats(classified).first().asDict() == {
        "n_domain": 1, "n_robots": 1, "n_lang": 1, "n_path": 2, "n_remaining": 1,
    }
    off = X.classify_urls(urls, CrawlConfig("https://a.org", lang_filter="", path_filter=""), robots)
    assert X.kept_urls(off).count() == 4


def test_selection(spark):
    rows = [(s, f"https://{s}/{i:03}{'/blogs/' if s == 'a' and i < 2 else ''}") for s in "ab" for i in range(30)]
    urls = spark.createDataFrame(rows, "site string, url string")
    top = X.select_preset(urls, 10)
    assert {r.site: r.n_selected for r in X.selection_summary(top).collect()} == {"a": 10, "b": 10}
    assert top.filter("selected").agg(F.max("url")).first()[0].startswith("https://b/009")
    matched = X.select_matching(top, " /BLOGS/ ")
    assert {r.site: r.n_selected for r in X.selection_summary(matched).collect()} == {"a": 2, "b": 10}
    none = X.selection_summary(X.select_preset(urls, "none")).collect()
    assert {(r.n_listed, r.n_selected, r.can_import) for r in none} == {(30, 0, False)}
    assert X.import_list(X.select_preset(urls, "all")).count() == 60
    assert X.search_urls(urls, "").count() == 60


def test_two_files_of_a_host_are_not_merged(spark):
    from shelfmark.operators.robots import robots_allowed as allowed

    files = spark.createDataFrame(
        [("a.com", 200, "User-agent: *\nDisallow: /x", "2024-01-01"), ("a.com", 200, "User-agent: *\nDisallow: /y", "2024-01-02")],
        "host string, status_code int, body string, fetched_at string",
    )
    urls = spark.createDataFrame([("https://a.com/x",), ("https://a.com/y",)], "url string")
    assert sorted(tuple(r) for r in allowed(urls, files, "bot").collect()) == [("https://a.com/x", True), ("https://a.com/y", False)]
