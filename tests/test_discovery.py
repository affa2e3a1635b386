from __future__ import annotations

import gzip
from urllib.parse import quote

import pytest

from shelfmark.operators import discovery as D
from shelfmark.sources.readers import read_progress, read_robots, read_sitemaps

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def docs(spark, **files):
    return spark.createDataFrame(list(files.items()), "sitemap_url string, xml string")


def entries(spark, xml):
    return [(r.kind, r.loc) for r in D.parse_sitemaps(docs(spark, a=xml)).orderBy("pos").collect()]


@pytest.mark.parametrize(
    "xml, wanted",
    [
        (f"<urlset {NS}><url><loc> https://a/1 </loc></url><url><loc>https://a/?a=1&amp;b=2</loc></url></urlset>",
         [("page", "https://a/1"), ("page", "https://a/?a=1&b=2")]),
        (f"<sitemapindex {NS}><sitemap><loc>https://a/s.xml</loc></sitemap></sitemapindex>",
         [("sitemap", "https://a/s.xml")]),
        (f'<?xml version="1.0"?><!-- <sitemapindex> --><urlset {NS} xmlns:image="http://i">'
         "<url><loc>https://a/1</loc><lastmod>x</lastmod><image:image><image:loc>https://i</image:loc></image:image></url></urlset>",
         [("page", "https://a/1")]),
        ('<sm:urlset xmlns:sm="http://www.sitemaps.org/schemas/sitemap/0.9"><sm:url><sm:loc>https://a/1</sm:loc></sm:url></sm:urlset>',
         [("page", "https://a/1")]),
        ("<urlset><url><loc>https://a/1</loc></url></urlset>", []),
        ('<urlset xmlns="http://other"><url><loc>https://a/1</loc></url></urlset>', []),
        (f"<urlset {NS}><url><loc></loc></url><url/></urlset>", []),
        (f"<urlset {NS}><sitemap><loc>https://a/1</loc></sitemap></urlset>", []),
        (f"<urlset {NS}><url><loc>https://a/1</loc></url>", []),
        ("not xml", []),
        ("", []),
        (None, []),
    ],
)
def test_parse(spark, xml, wanted):
    assert entries(spark, xml) == wanted


def edges(spark, *pairs):
    rows = [(p, c, i) for i, (p, c) in enumerate(pairs)]
    return spark.createDataFrame(rows, "parent string, child string, pos bigint")


def seeds(spark, *rows):
    return spark.createDataFrame([(s, u, i) for i, (s, u) in enumerate(rows)], "site string, sitemap_url string, pos bigint")


def reached(df):
    return [r.sitemap_url for r in df.orderBy("site", "level", "order_key").collect()]


def test_frontier_ends_on_cycles_in_breadth_first_order(spark):
    cycle = edges(spark, ("root", "b"), ("root", "a"), ("a", "c"), ("b", "d"), ("c", "root"), ("d", "a"), ("x", "y"))
    assert reached(D.expand_frontier(seeds(spark, ("s", "root")), cycle)) == ["root", "b", "a", "d", "c"]


def test_frontier_of_several_sites(spark):
    shared = edges(spark, ("r1", "a"), ("r2", "a"), ("a", "b"))
    out = D.expand_frontier(seeds(spark, ("s1", "r1"), ("s2", "r2"), ("s2", "r2")), shared)
    assert sorted((r.site, r.sitemap_url) for r in out.collect()) == [
        ("s1", "a"), ("s1", "b"), ("s1", "r1"), ("s2", "a"), ("s2", "b"), ("s2", "r2"),
    ]


def test_frontier_without_seeds(spark):
    assert D.expand_frontier(spark.createDataFrame([], "site string, sitemap_url string, pos bigint"), edges(spark, ("a", "b"))).count() == 0


@pytest.mark.parametrize("budget", [1, 2, 5, 8, 100])
def test_budget_is_strict(spark, budget):
    tree = edges(spark, *[("root", f"c{i}") for i in range(5)], *[(f"c{i}", f"g{i}") for i in range(5)])
    out = reached(D.expand_frontier(seeds(spark, ("s", "root")), tree, max_sitemaps=budget))
    assert out == (["root"] + [f"c{i}" for i in range(5)] + [f"g{i}" for i in range(5)])[:budget]


LINKS = """<a href="/x">1</a><a href='//cdn/x'>2</a><A class="k" HREF = "/y#top">3</A><a href="#a">4</a>
<a href="mailto:a@b">5</a><a href=" /z ">6</a><a href="https://a.org/in">7</a><a href="https://a.organic/">8</a>
<a href="https://b.org/">9</a><a href="https://a.org">10</a><a name="n">11</a><a href="/q?a=1&amp;b=2">12</a><a href=/bare>13</a>
<a data-href="/no">14</a><a href="x.html">15</a><abbr href="/no">16</abbr>"""


def test_links(spark):
    page = spark.createDataFrame([("https://a.org", LINKS)], "site string, html string")
    strict = [r.link for r in D.extract_links(page).orderBy("pos").collect()]
    assert strict == [
        "https://a.org/x", "https://a.org/y#top", "https://a.org/z", "https://a.org/in", "https://a.org",
        "https://a.org/q?a=1&b=2", "https://a.org/bare",
    ]
    loose = [r.link for r in D.extract_links(page, strict=False).orderBy("pos").collect()]
    assert loose == strict[:4] + ["https://a.organic/"] + strict[4:]


def test_links_keep_the_path_of_the_base(spark):
    page = spark.createDataFrame([("https://a.org/docs", '<a href="/x">')], "site string, html string")
    assert D.extract_links(page).first().link == "https://a.org/docs/x"


def test_discover_falls_back_step_by_step(spark):
    sites = spark.createDataFrame([("https://map.org",), ("https://link.org",), ("https://bare.org",)], "site string")
    robots = spark.createDataFrame(
        [("map.org", 200, "Sitemap: https://map.org/s.xml")], "host string, status_code int, body string"
    )
    maps = docs(spark, **{
        "https://map.org/s.xml": f"<sitemapindex {NS}><sitemap><loc>https://map.org/t.xml</loc></sitemap></sitemapindex>",
        "https://map.org/t.xml": f"<urlset {NS}><url><loc>https://map.org/2</loc></url><url><loc>https://map.org/1</loc></url>"
                                 "<url><loc>https://map.org/2</loc></url></urlset>",
    })
    home = spark.createDataFrame(
        [("https://map.org", '<a href="/no">'), ("https://link.org", '<a href="/b"><a href="/a"><a href="/b">')],
        "site string, html string",
    )
    batch = D.discover(sites, robots, maps, home)
    assert [(r.site, r.url) for r in batch.orderBy("site", "pos").collect()] == [
        ("https://link.org", "https://link.org/b"), ("https://link.org", "https://link.org/a"),
        ("https://map.org", "https://map.org/2"), ("https://map.org", "https://map.org/1"),
    ]
    result = D.discovery_result(D.discover(sites, robots, maps, home, "always", 30, include_base=True))
    assert [(r.base_url, r.total_urls, r.pos, r.url) for r in result.orderBy("base_url", "pos").collect()] == [
        ("https://bare.org", 1, 1, "https://bare.org"),
        ("https://link.org", 2, 1, "https://link.org/a"), ("https://link.org", 2, 2, "https://link.org/b"),
        ("https://map.org", 2, 1, "https://map.org/1"), ("https://map.org", 2, 2, "https://map.org/2"),
    ]


def test_seed_modes(spark):
    sites = spark.createDataFrame([("https://a.org/docs",), ("https://b.org",)], "site string")
    declared = spark.createDataFrame(
        [("https://b.org", "https://b.org/wp-sitemap.xml", 3)], "site string, sitemap_url string, pos bigint"
    )
    once = D.seed_sitemaps(sites, declared)
    assert {r.sitemap_url for r in once.collect()} == {"https://a.org/sitemap.xml", "https://b.org/wp-sitemap.xml"}
    always = D.seed_sitemaps(sites, declared, "always").orderBy("site", "pos").collect()
    assert [r.sitemap_url for r in always] == [
        "https://a.org/docs/sitemap.xml", "https://a.org/docs/sitemap_index.xml", "https://a.org/docs/wp-sitemap.xml",
        "https://b.org/wp-sitemap.xml", "https://b.org/sitemap.xml", "https://b.org/sitemap_index.xml",
    ]
    with pytest.raises(ValueError):
        D.seed_sitemaps(sites, declared, "sometimes")


def test_sitemap_stats_count_empty_documents(spark):
    files = docs(spark, a=f"<urlset {NS}><url><loc>https://a/1</loc></url></urlset>", b="broken")
    stats = D.sitemap_stats(files, D.parse_sitemaps(files))
    assert {(r.sitemap_url, r.n_pages, r.n_children) for r in stats.collect()} == {("a", 1, 0), ("b", 0, 0)}


def test_stored_files(spark, tmp_path):
    address = "https://a.org/map one.xml?x=1&y=ü"
    folder = tmp_path / "maps"
    folder.mkdir()
    (folder / quote(address, safe="")).write_text("<urlset/>\n<!-- 2 -->", encoding="utf-8")
    with gzip.open(folder / (quote("https://a.org/z.xml.gz", safe="") + ".gz"), "wt") as out:
        out.write("<zipped/>")
    found = {r.sitemap_url: r.xml for r in read_sitemaps(spark, str(folder)).collect()}
    assert found == {address: "<urlset/>\n<!-- 2 -->", "https://a.org/z.xml.gz": "<zipped/>"}
    robots = tmp_path / "robots"
    robots.mkdir()
    (robots / "a.org%3A8080.txt").write_text("User-agent: *\nDisallow: /x\n")
    assert [(r.host, r.body) for r in read_robots(spark, str(robots)).collect()] == [
        ("a.org:8080", "User-agent: *\nDisallow: /x\n")
    ]


def test_files_in_folders_named_by_address(spark, tmp_path):
    rows = [("https://a.org/x+y z%20.xml?q=1&r=[2]", "<urlset/>"), ("https://a.org/ü.xml", "<other/>")]
    folder = str(tmp_path / "maps")
    spark.createDataFrame(rows, "sitemap_url string, value string").write.partitionBy("sitemap_url").text(folder)
    assert {(r.sitemap_url, r.xml.strip()) for r in read_sitemaps(spark, folder).collect()} == set(rows)
    hosts = str(tmp_path / "robots")
    one = spark.createDataFrame([("a.org:8080", "Disallow: /x")], "host string, value string")
    one.write.partitionBy("host").option("compression", "gzip").text(hosts)
    assert [tuple(r) for r in read_robots(spark, hosts).collect()] == [("a.org:8080", 200, "Disallow: /x\n")]


def test_progress_file(spark, tmp_path):
    good, broken = tmp_path / "progress.json", tmp_path / "broken.json"
    good.write_text('{"completed": {"https://a/1": "success", "https://a/2": "failed"}}')
    broken.write_text('{"completed": {"https://a/1"')
    assert {tuple(r) for r in read_progress(spark, str(good)).collect()} == {
        ("https://a/1", "success"), ("https://a/2", "failed"),
    }
    assert read_progress(spark, str(broken)).count() == 0
    assert read_progress(spark, str(tmp_path / "missing.json")).count() == 0


def test_first_seen(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 1), ("a", 2)], "url string, pos bigint")
    assert {tuple(r) for r in D.dedup_first_seen(rows, ["url"]).collect()} == {("a", 2), ("b", 1)}
