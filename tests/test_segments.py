from __future__ import annotations

from collections import Counter

import pytest

from shelfmark.model import CrawlConfig
from shelfmark.operators import extraction as X
from shelfmark.plans.crawl import run_crawl, saved_progress, saved_segments, write_run
from shelfmark.sources.segments import add_segments, fold_segments, seen_segments

NOW = "2024-05-06 07:08:09"
RUNS = [
    ["the header line\nbody a", "the header line\nthe footer line"],
    ["the header line\nbody b\n\nbody b", "", "the footer line\nthe footer line"],
    ["the footer line\nthe header line", "another long line\nx"],
]


def brute_force(runs, max_rep, min_len):
    seen, wanted = Counter(), []
    for texts in runs:
        for text in texts:
            kept = []
            for segment in text.split("\n"):
                seen[segment] += 1
                if len(segment) < min_len or seen[segment] <= max_rep:
                    kept.append(segment)
            wanted.append("\n".join(kept))
    return wanted


@pytest.mark.parametrize("max_rep,min_len", [(1, 8), (2, 8), (3, 6)])
def test_runs_know_the_segments_of_earlier_runs(spark, tmp_path, max_rep, min_len):
    path, found = str(tmp_path / "segments"), []
    for run, texts in enumerate(RUNS):
        docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").repartition(2)
        for _ in range(2):  # the second time stands for a run that was stopped and started again
            seen = seen_segments(spark, path, before=run)
            kept = X.drop_repeated_segments(docs, "id", "text", max_rep, min_len, seen=seen).cache()
            rows = [r.text for r in kept.orderBy("id").collect()]
            add_segments(kept, path, run, "text", min_len, "\n")
        found += rows
    assert found == brute_force(RUNS, max_rep, min_len)
    fold_segments(spark, path, str(tmp_path / "folded"))
    folded = seen_segments(spark, str(tmp_path / "folded"))
    assert sorted(folded.collect()) == sorted(seen_segments(spark, path).collect()) and folded.count() > 0
    assert max(r.copies for r in folded.collect()) <= max_rep


def test_null_texts_and_no_runs(spark, tmp_path):
    assert seen_segments(spark, str(tmp_path / "none")).count() == 0
    docs = spark.createDataFrame([(1, None), (2, "")], "id bigint, text string")
    add_segments(docs, str(tmp_path / "s"), 0, "text")
    assert seen_segments(spark, str(tmp_path / "s")).count() == 0
    found = X.drop_repeated_segments(docs, "id", "text", seen=seen_segments(spark, str(tmp_path / "s")))
    assert {r.id: r.text for r in found.collect()} == {r.id: r.text for r in X.drop_repeated_segments(docs, "id", "text").collect()}


def test_crawl_runs_share_their_segments(spark, tmp_path):
    notice = "<p>" + "the same notice on every page of the site " * 4 + "</p>"
    pages = spark.createDataFrame([(f"https://a.org/{i}", f"{notice}<p>own {i}</p>") for i in range(4)], "url string, html string")
    config, root, contents = CrawlConfig("https://a.org"), str(tmp_path), []
    for part in (pages.filter("url < 'https://a.org/2'"), pages.filter("url >= 'https://a.org/2'")):
        run = run_crawl(part.select("url"), part, config, NOW, saved_progress(spark, root), seen=saved_segments(spark, root))
        write_run(run, root)
        contents += [r.content for r in run.results.orderBy("url").collect()]
    assert ["notice" in c for c in contents] == [True, True, False, False]
    assert all(f"own {i}" in c for i, c in enumerate(contents))
