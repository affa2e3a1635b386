from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from shelfmark.model import CrawlConfig
from shelfmark.operators import totals as T
from shelfmark.plans.crawl import run_crawl, saved_progress, saved_stats, saved_totals, write_run

ROWS = "url string, status string, content string, error string"


def rows(spark, n):
    # Addresses repeat; every seventh page failed, with errors of different frequency.
    data = [
        (f"https://{'a' if i % 3 else 'b'}.org/{i % 4000}", "failed" if i % 7 == 0 else "success", "x" * (i % 500), f"e{min(i % 5, 2)}" if i % 7 == 0 else "")
        for i in range(n)
    ]
    return data, spark.createDataFrame(data, ROWS)


def test_merged_states_tell_what_one_pass_over_all_runs_tells(spark, tmp_path):
    data, df = rows(spark, 6000)
    for run in range(3):
        part = df.filter(F.pmod(F.xxhash64("url", "content"), F.lit(3)) == run)
        T.write_state(T.run_state(part), str(tmp_path), run)
        T.write_state(T.run_state(part), str(tmp_path), run)  # done again
    states = T.read_states(spark, str(tmp_path))
    found = T.figures(states).first()
    assert (found.total, found.succeeded, found.failed) == (6000, 6000 - 858, 858)
    addresses = len({url for url, *_ in data})
    assert abs(found.n_urls - addresses) < 0.06 * addresses
    lengths = sorted(len(c) for _, s, c, _ in data if s == "success")
    for share, value in zip(T.QUANTILES, (found.length_50, found.length_90, found.length_99)):
        assert lengths[int((share - 0.04) * len(lengths))] <= value <= lengths[min(len(lengths) - 1, int((share + 0.04) * len(lengths)))]
    assert {r.error: r.copies for r in T.frequent_errors(states).collect()} == Counter(e for _, s, _, e in data if s == "failed")
    earlier = T.figures(T.read_states(spark, str(tmp_path), before=1)).first()
    assert 0 < earlier.total < 6000


def test_states_of_sites_merge_into_one(spark):
    data, df = rows(spark, 700)
    df = df.withColumn("site", F.substring("url", 9, F.lit(1)))
    sites = T.run_state(df, ["site"])
    assert {r.site: r.total for r in T.figures(sites, ["site"]).collect()} == Counter(u[8] for u, *_ in data)
    assert T.figures(T.merged_states(sites)).first()[:3] == (700, 600, 100)
    assert {r.site for r in T.frequent_errors(sites, 1, ["site"]).collect()} == {"a", "b"}


def test_no_rows_and_null_values(spark, tmp_path):
    nothing = T.read_states(spark, str(tmp_path / "none"))
    assert tuple(T.figures(nothing).first()) == (0, 0, 0, 0, None, None, None) and T.frequent_errors(nothing).count() == 0
    some = spark.createDataFrame([(None, "failed", None, None), (None, None, None, None), ("u", "success", None, "")], ROWS)
    state = T.run_state(some)
    assert tuple(T.figures(state).first())[:4] == (3, 1, 1, 1) and T.frequent_errors(state).count() == 0
    T.write_state(state, str(tmp_path / "s"), 0)
    T.write_state(T.run_state(some.limit(0)), str(tmp_path / "s"), 1)
    assert T.figures(T.read_states(spark, str(tmp_path / "s"))).first().total == 3


def test_runs_leave_totals(spark, tmp_path):
    urls = spark.createDataFrame([(f"https://a.org/{p}/{i}",) for p in ("en", "de") for i in range(4)], "url string")
    pages = urls.select("url", F.when(F.col("url").endswith("2"), "").otherwise("<p>text</p>").alias("html"))
    root = str(tmp_path)
    assert saved_stats(spark, root).first().n_remaining == 0
    for config in (CrawlConfig("https://a.org", lang_filter="en"), CrawlConfig("https://a.org")):
        write_run(run_crawl(urls, pages, config, "2024-05-06 07:08:09", saved_progress(spark, root)), root)
    assert tuple(T.figures(saved_totals(spark, root)).first())[:4] == (8, 6, 2, 8)
    assert saved_stats(spark, root).first().asDict() == {"n_domain": 0, "n_robots": 0, "n_lang": 4, "n_path": 0, "n_remaining": 12}
