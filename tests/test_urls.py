from __future__ import annotations

import re
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import urls as U
from shelfmark.functions.text import percent_decode, strip

ADDRESSES = [
    "https://example.com/blog/my-post/",
    "http://user:pw@Example.com:8080/a//b;v=1/c;p?q=1#f",
    "https://example.com",
    "HTTP://example.com?x=/y",
    "https://example.com/über/日本語_-x%20y",
    "/only/path",
    "mailto:me@example.com",
    "https://example.com/" + "x" * 300,
    "https://exa mple.com/a b",
    "//host/p;a/b;c",
    "https://[::1]:80/x",
    "",
]


@pytest.fixture(scope="module")
def addresses(spark):
    return spark.createDataFrame([(a,) for a in ADDRESSES], "url string")


def test_parts_match_the_standard_library(addresses):
    rows = addresses.select("url", U.url_parts(F.col("url")).alias("p")).select("url", "p.*").collect()
    for row in rows:
        wanted = urlparse(row.url)
        assert (row.scheme, row.netloc, row.path) == (wanted.scheme, wanted.netloc, wanted.path), row.url


def test_slug(addresses):
    for url, slug in addresses.select("url", U.url_slug(F.col("url"))).collect():
        wanted = urlparse(url)
        text = re.sub(r"[^\w\-]", "_", (wanted.netloc + wanted.path).strip("/"))
        assert slug == re.sub("_+", "_", text).strip("_")[:200], url
        assert len(slug) <= 200


def test_slug_example(spark):
    row = spark.range(1).select(U.url_slug(F.lit("https://example.com/blog/my-post/"))).first()
    assert row[0] == "example_com_blog_my-post"


@pytest.mark.parametrize(
    "path, prefix, excluded",
    [
        ("/de/blog/post", "de", True),
        ("/blog/post", "", False),
        ("/en/x", "en", False),
        ("/en", "", False),
        ("/en/", "en", False),
        ("/us/", "us", True),
        ("/zh-hans/x", "zh", True),
        ("/en-GB/x", "en", False),
        ("/pt_BR/x", "pt", True),
        ("/EN/x", "", False),
        ("/de-abcde/x", "", False),
        ("/a/de/", "", False),
    ],
)
def test_language_prefix(spark, path, prefix, excluded):
    row = spark.range(1).select(U.lang_prefix(F.lit(path)), U.lang_excluded(F.lit(path), "en")).first()
    assert tuple(row) == (prefix, excluded)


@pytest.mark.parametrize(
    "seed, base",
    [
        ("example.com/", "https://example.com"),
        (" \thttp://example.com/a// \n", "http://example.com/a"),
        ("HTTP://example.com", "https://HTTP://example.com"),
        ("https://example.com", "https://example.com"),
        ("  example.com　", "https://example.com"),
    ],
)
def test_seed(spark, seed, base):
    assert spark.range(1).select(U.normalize_seed(F.lit(seed))).first()[0] == base


@pytest.mark.parametrize(
    "url, base, same",
    [
        ("https://a.com/x", "https://a.com", True),
        ("http://a.com/x", "https://a.com", True),
        ("https://www.a.com/x", "https://a.com", False),
        ("https://a.com:443/x", "https://a.com", False),
        ("https://a.com.evil.org/", "https://a.com", False),
    ],
)
def test_same_domain(spark, url, base, same):
    assert spark.range(1).select(U.same_domain(F.lit(url), base)).first()[0] is same


def test_strip_matches_the_standard_library(spark):
    samples = ["\x1c a \x1f", " b ", "​c​", "  ", "d\n \te", "﻿f"]
    rows = spark.createDataFrame([(s,) for s in samples], "t string").select("t", strip(F.col("t"))).collect()
    assert all(stripped == text.strip() for text, stripped in rows)


def test_percent_decode_keeps_what_it_cannot_decode(spark):
    rows = spark.createDataFrame([("/a+b%20c",), ("/100%",), ("/%zz",)], "t string")
    assert [r[0] for r in rows.select(percent_decode(F.col("t"))).collect()] == ["/a+b c", "/100%", "/%zz"]


def test_site_and_target(spark):
    url = "https://a.com:8080/x/y?q=1#top"
    row = spark.range(1).select(U.site(F.lit(url)), U.request_target(F.lit(url)), U.request_target(F.lit("https://a.com")))
    assert tuple(row.first()) == ("https://a.com:8080", "/x/y?q=1#top", "/")
