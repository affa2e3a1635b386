from __future__ import annotations

import html as stdlib_html
import json
import time
from collections import Counter
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import html as H
from shelfmark.operators import extraction as X
from shelfmark.operators import fetchlog as L
from shelfmark.operators import output as O
from shelfmark.operators import report as R

NOW = "2024-05-06 07:08:09"


def markdown(spark, text):
    return spark.createDataFrame([(text,)], "html string").select(H.extract_markdown(F.col("html"))).first()[0]


@pytest.mark.parametrize(
    "html, wanted",
    [
        ("<h1>A</h1><p>b  c\n d</p>", "# A\n\nb c d"),
        ("<H2 class='x'>A</H2>t<h6>B</h6>", "## A\n\nt\n\n###### B"),
        ("<ul><li>a</li><li>b <b>c</b></li></ul>", "- a\n- b c"),
        ("<p>a<br>b<br/>c</p>", "a\nb\nc"),
        ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", "| a | b |\n| --- | --- |\n| 1 | 2 |"),
        (
            "<p>x</p><table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><th>r</th><td>2</td></tr></tbody></table>y",
            "x\n\n| a | b |\n| --- | --- |\n| r | 2 |\n\ny",
        ),
        ("<p>a\nb</p><pre class='c'>one\n  two\r\nthree</pre>", "a b\n\none\ntwo\nthree"),
        ("<div class='ad'>x</div><div class='top ads'>y</div>z", "z"),
        ('<p>see <a href="/x">this</a> <img src="i.png" alt="no"></p>', "see this"),
        ("<script>var t='</p>';</script><p>a</p>", "a"),
        ("<p>a</p><script>never closed <p>b</p>", "a"),
        ("<!-- <script> --><p>a</p><!-- </script> --><p>b</p>", "a\n\nb"),
        ("<script>'<!--'</script><p>a</p>", "a"),
        ("<p>a</p><!-- open", "a"),
        ("<nav><script>'</nav>'</script>menu</nav><p>a</p>", "a"),
        ("<header>h</header><p>a</p><footer>f</footer><aside>s</aside>", "a"),
        ("<nav>never closed<p>a</p>", "never closed\n\na"),
        ("<navigation>kept</navigation>", "kept"),
        ('<div class="ad">x</div><div class="top ads">y</div><div class="adult">z</div>', "z"),
        ('<div class="ad">x<div>in<div>deeper</div></div>leak</div><div>kept</div>', "kept"),
        ("<div class='ad'><div class='b'><p>x</p></div><DIV >y</DIV >z</div ><p>kept</p>", "kept"),
        ("<div class='ad'>" + "<div>" * 20 + "x" + "</div>" * 21 + "<p>kept</p>", "kept"),
        ("<div class='ad'>x<div>never closed</div><p>kept</p>", "kept"),
        ("<div class='ad'>x<divider>y</divider></div>kept", "kept"),
        ('<div class="ad">' * 50 + "x" + "</div>" * 50 + "<p>kept</p>", "kept"),
        ("<nav>" * 50 + "menu" + "</nav>" * 50 + "<p>kept</p>", "kept"),
        ("<div><aside><div>x</aside>y</div>z", "y\n\nz"),
        ("<article><nav>open<p>a</p></article>", "open\n\na"),
        ("<head><meta charset=x><body><p>a</p>", "a"),
        ("<div class=ad>x</div><div data-x='a>b' class='ad big'>y</div>z", "z"),
        ("<svg/><p>a</p><svg viewBox='0'><title>no</title></svg>b", "a\n\nb"),
        ("a < b and 2<3 <!doctype html><?xml ?>c", "a < b and 2<3 c"),
        ("<p>one<p>two <b>three", "one\n\ntwo three"),
        ("a&amp;lt;b &lt;c&gt; &quot;d&quot;&nbsp;e &copy; &#39;&#8217;&#x1F600;&#0;&#xD800;", "a&lt;b <c> \"d\" e © '’😀&#0;&#xD800;"),
        ("", ""),
        (None, ""),
        (" \n\t ", ""),
    ],
)
def test_markdown(spark, html, wanted):
    assert markdown(spark, html) == wanted


def test_every_named_reference_is_known(spark):
    names = sorted(n for n in html5 if n.endswith(";") and not html5[n].isspace())
    text = " ".join(f"x&{n}x" for n in names) + " &#8364; &#x20AC; &#65; caf&eacute; M&uuml;ller &copy2024 AT&T &unknown; a&b"
    found = markdown(spark, text.replace("&NewLine;", ""))
    assert found == " ".join(stdlib_html.unescape(text.replace("&NewLine;", "")).replace("\xa0", " ").split(" "))


@pytest.mark.parametrize(
    "page",
    ["<nav>" * 200_000, "<nav>" * 100_000 + "</div>" * 100_000, "<div class='ad'>" * 30_000 + "</div>" * 30_000, "<" * 10**6,
     '<a "' * 250_000, '<a ">' * 200_000, "<a href=" * 120_000, "<!--" * 250_000, "<svg " * 200_000, "&#" * 500_000, "<h1>" * 200_000],
    ids=lambda page: page[:14],
)
def test_a_megabyte_of_anything_left_open_takes_linear_time(page):
    started = time.process_time()
    H.Article(page).markdown()
    H.links(page)
    assert time.process_time() - started < 4


def test_links_of_any_quoting(spark):
    page = """<a href="/a?x=1&copy=2&amp;y=3">1</a><a title='b>c' href = '/b'>2</a><A HREF=/c>3</A><a name=x>4</a>
        <!-- <a href="/no"> --><script>'<a href="/no">'</script><a href=" /d\n">5</a><area href="/no"><a href>6</a><a href="/caf&eacute;">"""
    assert spark.createDataFrame([(page,)], "html string").select(H.hrefs(F.col("html"))).first()[0] == [
        "/a?x=1&copy=2&y=3", "/b", "/c", "/d", "/café",
    ]


def test_long_pages(spark):
    page = "<div class='x'>" + "<p>word &amp; word</p>\n" * 100_000
    assert len(markdown(spark, page)) == 100_000 * len("word & word\n\n") - 2


def test_long_furniture(spark):
    inner = "<div><span>more</span> <a href='x'>text</a></div>\n" * 50_000
    assert markdown(spark, f"<p>a</p><div class='ad'>{inner}</div><p>b</p>") == "a\n\nb"


@pytest.mark.parametrize(
    "html, title, language",
    [
        ('<html lang="de"><meta property="og:title" content="OG &amp; co"><title>T</title><h1>H</h1>', "OG & co", "de"),
        ('<HTML data-x="1" LANG="en-GB"><meta content="turned" property="og:title">', "turned", "en-GB"),
        ("<html><title>T</title><h1 id='a'>H <b>x</b></h1>", "H x", ""),
        ("<html><title>\n T\n</title><h1> </h1>", "T", ""),
        ("<html hreflang='x'>", "", ""),
        ("<html lang='en'><meta property='og:title' content='it is &quot;it&quot;'>", 'it is "it"', "en"),
        ("<html class=x lang=de><meta content=short property = og:title >", "short", "de"),
        ("<!-- <html lang='xx'><title>no</title> --><html lang = 'fr' ><title>caf&eacute; M&uuml;ller</title>", "café Müller", "fr"),
        ("<svg><title>no</title></svg><title>yes &amp; <b>no</b></title><title>late</title>", "yes & no", ""),
        ("<h1>never closed<p>text", "", ""),
        (None, "", ""),
    ],
)
def test_title_and_language(spark, html, title, language):
    row = spark.createDataFrame([(html,)], "html string").select(
        H.extract_title(F.col("html")), H.extract_language(F.col("html"))
    )
    assert tuple(row.first()) == (title, language)


PAGES = [
    ("https://a/1", '<html lang="en"><title>One</title><article><h1>Say "hi"</h1><p>text</p></article>'),
    ("https://a/2", "<html><title>Two</title><nav>menu</nav>"),
    ("https://a/3", "<p>lost</p>"),
    ("https://a/4", "<p>untitled</p>"),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "url string, html string")


def test_profiles(spark, pages):
    resolved = spark.createDataFrame([("https://a/3", "failed", "Status 404"), ("https://a/1", "success", "")], "url string, status string, error string")
    cli = {r.url: r for r in X.build_page_results(pages, NOW, resolved=resolved).collect()}
    assert (cli["https://a/1"].status, cli["https://a/1"].content) == ("success", '# Say "hi"\n\ntext')
    assert (cli["https://a/2"].status, cli["https://a/2"].title, cli["https://a/2"].error) == ("failed", "Two", X.NO_CONTENT)
    assert (cli["https://a/3"].status, cli["https://a/3"].title, cli["https://a/3"].error) == ("failed", "", "Status 404")
    assert (cli["https://a/4"].title, len(cli)) == ("", 4)
    api = {r.url: r for r in X.build_page_results(pages, NOW, "api", resolved).collect()}
    assert api["https://a/4"].title == "https://a/4"
    assert (api["https://a/3"].title, api["https://a/3"].content, api["https://a/3"].error) == ("", "", "")
    with pytest.raises(ValueError):
        X.build_page_results(pages, NOW, "other")


def test_text_is_computed_once(pages):
    """Neither a filter nor a second use of the content scans the pages again."""
    rows = X.extract_pages(pages, NOW).filter("status = 'failed'").select("url", "content", "error")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == plan.count("page_fields(") == 1


@pytest.mark.parametrize("max_rep, min_len", [(2, 5), (1, 1), (3, 100)])
def test_repeated_segments_against_brute_force(spark, max_rep, min_len):
    texts = ["header text\nbody a\nx", "header text\nheader text\nbody b", "header text\n\nx\nx", "", "x\nbody a\nheader text"]
    seen, wanted = Counter(), {}
    for i, text in enumerate(texts):
        kept = []
        for segment in text.split("\n"):
            if len(segment) >= min_len:
                seen[segment] += 1
                if seen[segment] > max_rep:
                    continue
            kept.append(segment)
        wanted[i] = "\n".join(kept)
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    found = X.drop_repeated_segments(docs, "id", "text", max_rep, min_len)
    assert {r.id: r.text for r in found.collect()} == wanted
    copies = {r.copies for r in X.repeated_segments(docs, "text", max_rep, min_len).collect()}
    assert copies == {n for s, n in seen.items() if n > max_rep}


def test_page_left_without_text_has_failed(spark):
    body = "<p>" + "same words " * 20 + "</p>"
    pages = spark.createDataFrame([(f"https://a/{i}", body) for i in range(4)], "url string, html string")
    rows = X.build_page_results(pages, NOW, drop_repeats=True).orderBy("url").collect()
    assert [r.status for r in rows] == ["success", "success", "failed", "failed"]


def test_markdown_and_json(spark, pages):
    rows = X.build_page_results(pages, NOW)
    texts = {r.filename: r.body for r in O.to_markdown(rows).collect()}
    assert texts["a_1.md"] == (
        "---\nurl: https://a/1\ntitle: \"Say 'hi'\"\nlanguage: en\nscraped_at: 2024-05-06T07:08:09+00:00\n---\n"
        '# Say "hi"\n\n# Say "hi"\n\ntext'
    )
    assert texts["a_4.md"].endswith("\n---\nuntitled")
    record = json.loads(O.to_json_record(rows).filter("url = 'https://a/1'").first().json)
    assert list(record) == ["url", "title", "language", "scraped_at", "content"]
    stamp = spark.sql("SELECT timestamp'2024-05-06 07:08:09.000120' AS t").select(O.iso_utc(F.col("t"))).first()[0]
    assert stamp == "2024-05-06T07:08:09.000120+00:00"


def test_sinks_append_successes(spark, pages, tmp_path):
    rows = X.build_page_results(pages, NOW)
    for _ in range(2):
        O.write_jsonl(rows, str(tmp_path / "json"))
        O.write_markdown(rows, str(tmp_path / "md"))
    O.write_markdown(rows, str(tmp_path / "files"), as_files=True)
    lines = [json.loads(line) for f in (tmp_path / "json").glob("*.json") for line in f.read_text().splitlines()]
    assert Counter(line["url"] for line in lines) == {"https://a/1": 2, "https://a/3": 2, "https://a/4": 2}
    assert spark.read.parquet(str(tmp_path / "md")).count() == 6
    assert spark.read.text(str(tmp_path / "files")).select("filename").distinct().count() == 3


def test_progress(spark):
    old = spark.createDataFrame([("a", "failed"), ("b", "success")], "url string, status string")
    new = spark.createDataFrame([("a", "success"), ("c", "failed")], "url string, status string")
    assert {tuple(r) for r in O.merge_progress(old, new).collect()} == {("a", "success"), ("b", "success"), ("c", "failed")}


def test_slug_collisions(spark):
    urls = spark.createDataFrame([("http://a.org/x?1",), ("https://a.org/x/",), ("https://a.org/y",)], "url string")
    assert {(r.slug, r.n) for r in O.slug_groups(urls).collect()} == {("a_org_x", 2), ("a_org_y", 1)}
    assert {r.url for r in O.slug_members(urls).collect()} == {"http://a.org/x?1", "https://a.org/x/"}


ATTEMPTS = {
    "a": [429, 429, 200],
    "b": [404, 200],
    "c": ["timeout", "timeout", "timeout", 200],
    "d": ["refused", 200],
    "e": [503, 503, 500],
    "f": [200],
    "g": [503, 304],
    "h": [500],
}


def test_fetch_outcomes(spark):
    rows = [
        (url, i + 1, a if isinstance(a, int) else None, a == "timeout", "refused" if a == "refused" else None)
        for url, log in ATTEMPTS.items()
        for i, a in enumerate(log)
    ]
    log = spark.createDataFrame(rows, "url string, attempt int, status_code int, timed_out boolean, error string")
    found = {r.url: (r.status, r.attempts, r.error) for r in L.resolve_fetch(log).collect()}
    assert found == {
        "a": ("success", 3, ""), "b": ("failed", 1, "Status 404"), "c": ("failed", 3, "timed out"),
        "d": ("failed", 1, "refused"), "e": ("failed", 3, "Retryable status 500"), "f": ("success", 1, ""),
        "g": ("failed", 2, "Status 304"), "h": ("failed", 1, "Retryable status 500"),
    }
    waits = {r.url: r.backoff_seconds for r in L.backoff_seconds(log).collect()}
    assert waits == {"a": 6, "b": 0, "c": 6, "d": 0, "e": 6, "f": 0, "g": 2, "h": 2}


def test_reports(spark):
    rows = [(f"u{i:02}", "failed" if i % 2 else "success", f"e{i}") for i in range(30)]
    results = spark.createDataFrame(rows, "url string, status string, error string")
    skipped = spark.createDataFrame([(7,)], "skipped bigint")
    assert tuple(R.run_summary(results, skipped).first()) == (30, 15, 15, 7)
    assert tuple(R.run_summary(results.limit(0)).first()) == (0, 0, 0, 0)
    sample = R.failed_sample(results).collect()
    assert [r.url for r in sample] == [f"u{i:02}" for i in range(1, 20, 2)] and {r.n_more for r in sample} == {5}
    urls = spark.createDataFrame([("s", f"u{i:02}") for i in range(20)], "site string, url string")
    batches = R.batch_progress(urls).orderBy("batch_no").collect()
    assert [(r.n, r.completed, r.percent) for r in batches] == [(6, 6, 30), (6, 12, 60), (6, 18, 90), (2, 20, 100)]


def test_repeated_keys_keep_their_own_texts(spark):
    a, b = "first long line of a page", "second long line of a page"
    rows = spark.createDataFrame([("u", f"{a}\nx"), ("u", f"{b}\n{a}"), ("v", a), ("w", a)], "url string, content string")
    found = X.drop_repeated_segments(rows, "url", "content", max_rep=2, min_len=10)
    assert sorted((r.url, r.content) for r in found.collect()) in (
        [("u", f"{a}\nx"), ("u", f"{b}\n{a}"), ("v", ""), ("w", "")],
    )
