from __future__ import annotations

import datetime
import itertools
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from shelfmark.catalog import streams
from shelfmark.functions.text import is_blank
from shelfmark.model import KB_TABLES, PAGE_RESULTS, CrawlConfig
from shelfmark.operators import spread, store
from shelfmark.operators.store import append_notebooks, upsert_sources
from shelfmark.operators.output import write_markdown
from shelfmark.plans.crawl import run_crawl, saved_progress, write_run
from shelfmark.plans.notebooks import delete_stored_notebooks, delete_stored_sources, upsert_stored
from shelfmark.operators.report import failed_sample
from shelfmark.sources.changes import bucket_of, read_log
from shelfmark.sources.pages import pages_at, save_pages, saved_pages
from shelfmark.sources.readers import compact_kb, read_kb, write_kb
from shelfmark.streaming import jobs as S
from shelfmark.streaming.attempts import VERDICTS, stream_verdicts, verdict

NOW = "2024-05-06 07:08:09"
CHANGE = "notebook_id bigint, url string, title string, content string, status string, last_updated timestamp"


def add_pages(spark, folder, first, last):
    rows = spark.range(first, last).select(
        F.col("id").alias("page_id"),
        F.concat(F.lit("https://a.org/"), F.col("id").cast("string")).alias("url"),
        F.concat(F.lit("<h1>t</h1><p>page "), F.col("id").cast("string")).alias("html"),
    )
    rows.coalesce(1).write.mode("append").parquet(str(folder))


def test_ingest_resumes_with_new_files_only(spark, tmp_path):
    source, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        S.stream_ingest(S.page_stream(spark, str(source), files_per_trigger=1), out, ck, NOW)
        return spark.read.schema(PAGE_RESULTS).parquet(out)

    add_pages(spark, source, 0, 10)
    assert run().count() == 10
    assert run().count() == 10
    add_pages(spark, source, 10, 15)
    rows = run()
    assert rows.count() == 15 and rows.select("url").distinct().count() == 15


def change_file(spark, folder, rows):
    df = spark.createDataFrame([(*r[:5], None) for r in rows], CHANGE)
    stamps = spark.createDataFrame([(r[0], r[1], r[4], r[5]) for r in rows], "notebook_id bigint, url string, status string, t string")
    joined = df.drop("last_updated").join(stamps, ["notebook_id", "url", "status"])
    joined.select("notebook_id", "url", "title", "content", "status", F.col("t").cast("timestamp").alias("last_updated")).coalesce(
        1
    ).write.mode("append").parquet(str(folder))


BATCHES = [
    [(1, "b", "B", "b1", "success", "2024-01-01"), (1, "a", "A", "a1", "success", "2024-01-01")],
    [(1, "a", "", "", "failed", "2024-01-02"), (2, "a", "A", "x", "success", "2024-01-02")],
    [(1, "b", "B2", "b2", "success", "2024-01-03"), (1, "0", "Z", "z", "failed", "2024-01-03")],
]


def test_streamed_sources_equal_batches_in_turn(spark, tmp_path):
    folder, log, ck = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "ck")
    for keep in (True, False):
        expected = spark.createDataFrame([], "id bigint, " + CHANGE)
        for i, rows in enumerate(BATCHES):
            part = tmp_path / f"batch{i}{keep}"
            change_file(spark, part, rows)
            if keep:
                change_file(spark, folder, rows)
                stream = spark.readStream.schema(CHANGE).parquet(str(folder))
                S.stream_upsert(stream, log, ck)
            expected = upsert_sources(expected, spark.read.schema(CHANGE).parquet(str(part)), keep)
        found = S.current_sources(spark, log, keep).select(expected.columns)
        assert sorted(found.collect()) == sorted(expected.collect())


def test_dedup(spark, tmp_path):
    folder = tmp_path / "in"
    add_pages(spark, folder, 0, 10)
    add_pages(spark, folder, 5, 15)
    urls = S.page_stream(spark, str(folder), files_per_trigger=1).select("url")
    S.stream_dedup(urls, str(tmp_path / "out"), str(tmp_path / "ck1"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15
    S.stream_new_urls(urls, str(tmp_path / "seen"), str(tmp_path / "ck2"))
    add_pages(spark, folder, 0, 20)
    S.stream_new_urls(urls, str(tmp_path / "seen"), str(tmp_path / "ck2"))
    seen = spark.read.schema(S.SEEN).parquet(str(tmp_path / "seen"))
    assert seen.count() == seen.select("url").distinct().count() == 20
    timed = urls.withColumn("t", F.lit(NOW).cast("timestamp"))
    S.stream_dedup(timed, str(tmp_path / "timed"), str(tmp_path / "ck3"), event_time="t")
    assert spark.read.parquet(str(tmp_path / "timed")).count() == 20


def test_new_checkpoints_go_on_where_a_log_ends(spark, tmp_path):
    folder, log = tmp_path / "in", str(tmp_path / "log")
    for i in range(4):
        add_pages(spark, folder, 100 * i, 100 * i + 150)
    urls = S.page_stream(spark, str(folder), files_per_trigger=1).select("url")
    S.stream_new_urls(urls, log, str(tmp_path / "ck1"))
    again = tmp_path / "again"
    add_pages(spark, again, 440, 460)
    known = S.page_stream(spark, str(again)).select("url")
    S.stream_new_urls(known, log, str(tmp_path / "ck2"))
    seen = spark.read.schema(S.SEEN).parquet(log)
    assert seen.count() == seen.select("url").distinct().count() == 460
    assert seen.select("query").distinct().count() == 2
    assert seen.select("prefix").distinct().count() > 100
    S.compact_urls(spark, log, str(tmp_path / "compact"))
    S.stream_new_urls(known, str(tmp_path / "compact"), str(tmp_path / "ck3"))
    assert spark.read.schema(S.SEEN).parquet(str(tmp_path / "compact")).count() == 460


def test_a_batch_that_is_run_again_overwrites_its_own_rows(spark, tmp_path, monkeypatch):
    folder, log, ck = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "ck")
    add_pages(spark, folder, 0, 10)
    urls = S.page_stream(spark, str(folder)).select("url")
    ran = S._batch_place
    monkeypatch.setattr(S, "_batch_place", lambda *a: (ran(*a), 1 / 0) if a[-1] == 1 else ran(*a))
    S.stream_new_urls(urls, log, ck)
    add_pages(spark, folder, 5, 15)
    with pytest.raises(StreamingQueryException):
        S.stream_new_urls(urls, log, ck)
    monkeypatch.setattr(S, "_batch_place", ran)
    S.stream_new_urls(urls, log, ck)
    seen = spark.read.schema(S.SEEN).parquet(log)
    assert seen.count() == seen.select("url").distinct().count() == 15


def test_streamed_texts_are_numbered_by_their_keys_alone(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i}", "de" if i % 2 else "en", None, 6) for i in range(20)]
    spark.createDataFrame(rows, streams.DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    kept, ran = [], spread.durable
    monkeypatch.setattr(spread, "durable", lambda df: kept.append(set(df.columns)) or ran(df))
    labels, wrote = [], store.stored
    monkeypatch.setattr(store, "stored", lambda df, label: labels.append(label) or wrote(df, label))
    found = streams.stream_upsert(spark, str(tmp_path)).collect()
    assert kept and not any({"title", "content"} & columns for columns in kept)
    # A copy of each micro-batch, and none of the log.
    assert labels.count("batch") == 3
    keys = sorted((1 if i % 2 else 2, f"doc://{i}", f"text {i}") for i in range(20))
    assert sorted((r.id, r.notebook_id, r.url, r.content) for r in found) == [(n, *key) for n, key in enumerate(keys, 1)]


def test_blank_texts_are_told_without_reading_them_over(spark):
    signs = [chr(i) for i in (*range(1, 0x180), *range(0x1680, 0x1690), *range(0x1FF0, 0x2070), 0x3000, 0xFEFF, 0x1F600)]
    blank = [c.isspace() for c in signs]
    texts = [*signs, *[f" {c}\u3000" for c in signs], "", " \n", None, "a\n", "\na"]
    expected = [*blank, *blank, True, True, True, False, False]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    found = rows.select("n", is_blank(F.col("text")).alias("blank")).orderBy("n").collect()
    assert [r.blank for r in found] == expected
    gap = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), 200_000), F.lit("a")).alias("text"))
    began = time.time()
    assert not gap.select(is_blank(F.col("text"))).first()[0]
    assert time.time() - began < 10


def test_a_log_is_folded_into_the_stored_sources(spark, tmp_path):
    folder, log, kb = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "kb")
    for rows in BATCHES:
        change_file(spark, folder, rows)
        S.stream_upsert(spark.readStream.schema(CHANGE).parquet(str(folder)), log, str(tmp_path / "ck"))
    expected = sorted(S.current_sources(spark, log).select(*SOURCE_NAMES).collect())
    S.fold_changes(spark, log, kb)
    assert sorted(read_kb(spark, kb, "sources").collect()) == expected
    S.fold_changes(spark, log, kb)
    assert sorted(read_kb(spark, kb, "sources").collect()) == expected
    # A second log, with a query of its own, goes on from there.
    more = tmp_path / "more"
    change_file(spark, more, [(1, "a", "A3", "a3", "success", "2024-01-04")])
    S.stream_upsert(spark.readStream.schema(CHANGE).parquet(str(more)), str(tmp_path / "log2"), str(tmp_path / "ck2"))
    now = S.current_sources(spark, str(tmp_path / "log2"), base=read_kb(spark, kb, "sources"))
    assert {r.id: r.content for r in now.collect()} == {r.id: r.content for r in expected} | {
        r.id: "a3" for r in expected if (r.notebook_id, r.url) == (1, "a")
    }


def test_resumed_pages_are_read_where_they_lie(spark, tmp_path):
    rows = [(i, f"https://a.org/{i}", f"<p>page {i}") for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    save_pages(pages, "resume_test", str(tmp_path / "pages"), 16)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(limit, "-1")
    try:
        urls = spark.createDataFrame([(f"https://a.org/{i}",) for i in range(0, 60, 2)], "url string")
        wanted = pages_at(saved_pages(spark, "resume_test"), urls)
        lines = plan_of(wanted).splitlines()
        scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "html#" in line)
        assert "Bucketed: true" in lines[scan] and not any("Exchange" in line for line in lines[:scan])
        assert wanted.count() == 25
        done = spark.createDataFrame([("https://a.org/2", "success")], "url string, status string")
        run = run_crawl(urls, saved_pages(spark, "resume_test"), CrawlConfig("https://a.org"), NOW, done)
        assert tuple(run.summary.first()) == (24, 24, 0, 1)
    finally:
        spark.conf.unset(limit)
        spark.sql("DROP TABLE resume_test")


ATTEMPT = "url string, attempt bigint, status_code int, timed_out boolean, error string, t string"


def add_attempts(spark, folder, rows):
    df = spark.createDataFrame([(u, n, c, False, None, t) for u, n, c, t in rows], ATTEMPT)
    df.withColumn("at", F.col("t").cast("timestamp")).drop("t").coalesce(1).write.mode("append").parquet(str(folder))


def test_verdicts_on_a_stream_of_attempts(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    schema = "url string, attempt bigint, status_code int, timed_out boolean, error string, at timestamp"

    def run():
        stream_verdicts(spark.readStream.schema(schema).parquet(str(folder)), out, str(tmp_path / "ck"), "10 minutes", 600_000)
        return {(r.url, r.status, r.attempts, r.error) for r in spark.read.schema(VERDICTS).parquet(out).collect()}

    add_attempts(spark, folder, [
        ("final", 1, 200, "2024-01-01 00:00:00"), ("gone", 1, 404, "2024-01-01 00:00:00"), ("slow", 1, 503, "2024-01-01 00:00:00"),
        ("turned", 2, 200, "2024-01-01 00:00:10"), ("stopped", 1, 503, "2024-01-01 00:00:00"), ("hole", 2, 429, "2024-01-01 00:00:00"),
    ])
    first = {("final", "success", 1, ""), ("gone", "failed", 1, "Status 404")}
    assert run() == first
    add_attempts(spark, folder, [
        ("slow", 2, 503, "2024-01-01 00:01:00"), ("slow", 3, 429, "2024-01-01 00:02:00"), ("slow", 4, 200, "2024-01-01 00:03:00"),
        ("turned", 1, 503, "2024-01-01 00:00:00"), ("final", 2, 503, "2024-01-01 00:02:00"),
    ])
    second = first | {("slow", "failed", 3, "Retryable status 429"), ("turned", "success", 2, "")}
    assert run() == second
    # The event time passes the expiry of the addresses whose attempts stopped.
    add_attempts(spark, folder, [("later", 1, 200, "2024-01-01 02:00:00")])
    run()
    add_attempts(spark, folder, [("latest", 1, 200, "2024-01-01 02:00:01")])
    assert run() == second | {
        ("later", "success", 1, ""), ("latest", "success", 1, ""), ("stopped", "failed", 1, "Retryable status 503"),
        ("hole", "failed", 2, "Retryable status 429"),
    }
    assert spark.read.schema(VERDICTS).parquet(out).count() == 8


def test_verdicts_do_not_hang_on_the_order_of_arrival():
    kinds = {"success": "", "failed": "f", "retry": "r"}
    for outcomes in itertools.product(kinds, repeat=3):
        final = next((i for i, o in enumerate(outcomes) if o != "retry"), None)
        wanted = ("failed", 3, "r") if final is None else (outcomes[final], final + 1, kinds[outcomes[final]])
        for order in itertools.permutations(range(3)):
            known, given = {}, []
            for i in order:
                known[i + 1] = (outcomes[i], kinds[outcomes[i]])
                given.append(verdict(known, 3, False))
            assert {g for g in given if g} == {wanted}


def test_failures_are_extracted_once(spark, monkeypatch):
    results = spark.createDataFrame([(f"u{i:02}", "failed", "e") for i in range(12)] + [("v", "success", "")], "url string, status string, error string")
    sample = failed_sample(results)
    assert "ExistingRDD" not in plan_of(sample) and [r.n_more for r in sample.collect()] == [2] * 10


def test_crawl_run(spark, tmp_path):
    urls = spark.createDataFrame(
        [(u,) for u in ("https://a.org/en/1", "https://a.org/en/2", "https://a.org/de/3", "https://b.org/4", "https://a.org/en/5")],
        "url string",
    )
    pages = urls.select("url", F.when(F.col("url").endswith("2"), "").otherwise("<p>text</p>").alias("html"))
    done = spark.createDataFrame([("https://a.org/en/5", "failed")], "url string, status string")
    run = run_crawl(urls, pages, CrawlConfig("https://a.org", lang_filter="en"), NOW, done)
    assert run.stats.first().asDict() == {"n_domain": 1, "n_robots": 0, "n_lang": 1, "n_path": 0, "n_remaining": 3}
    assert tuple(run.summary.first()) == (2, 1, 1, 1)
    assert [r.url for r in run.failures.collect()] == ["https://a.org/en/2"]
    assert saved_progress(spark, str(tmp_path)).count() == 0
    # A run that was interrupted before its checkpoint leaves nothing behind when it is started again.
    write_markdown(run.results, str(tmp_path / "pages" / "run=0"))
    write_run(run, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "pages")).count() == 1
    saved = saved_progress(spark, str(tmp_path))
    assert {r.url: r.status for r in saved.collect()} == {
        "https://a.org/en/1": "success", "https://a.org/en/2": "failed", "https://a.org/en/5": "failed",
    }
    again = run_crawl(urls, pages, CrawlConfig("https://a.org"), NOW, saved)
    assert tuple(again.summary.first()) == (1, 1, 0, 3)
    write_run(again, str(tmp_path))
    assert saved_progress(spark, str(tmp_path)).count() == 4
    assert spark.read.json(str(tmp_path / "combined")).count() == 2


def test_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "n")], "id bigint, name string").withColumn("created_at", F.lit(NOW).cast("timestamp"))
    folder = str(tmp_path)
    assert read_kb(spark, folder, "notebooks").count() == 0
    assert write_kb(rows, folder, "notebooks") == 0
    more = append_notebooks(read_kb(spark, folder, "notebooks"), spark.createDataFrame([("m",)], "name string"), NOW)
    assert write_kb(more, folder, "notebooks") == 1
    assert {r.name for r in read_kb(spark, folder, "notebooks").collect()} == {"n", "m"}
    assert write_kb(rows, folder, "notebooks") == 2
    assert [r.name for r in read_kb(spark, folder, "notebooks").collect()] == ["n"]


SOURCE_NAMES = ["id", "notebook_id", "url", "title", "content", "status", "last_updated"]
WHEN = datetime.datetime(2024, 1, 1)
LATER = WHEN + datetime.timedelta(days=1)


def stored_sources(spark, folder):
    rows = [(i, i % 20, f"u{i}", "t", "text", "success", WHEN) for i in range(1, 101)]
    write_kb(spark.createDataFrame(rows, KB_TABLES["sources"]), folder, "sources")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def log_of(spark, folder):
    return read_log(spark, f"{folder}/sources", KB_TABLES["sources"])


def test_changes_are_appended_and_resolved_on_read(spark, tmp_path):
    folder = str(tmp_path)
    stored_sources(spark, folder)
    assert read_kb(spark, folder, "sources").schema.simpleString() == KB_TABLES["sources"].simpleString()
    batch = spark.createDataFrame(
        [(3, "u3", "v2", "new", "success", LATER), (3, "fresh", "v1", "new", "success", LATER), (4, "u4", "", "", "failed", LATER)], CHANGE
    )
    upsert_stored(batch, folder)
    after = read_kb(spark, folder, "sources")
    changed = {r.url: tuple(r[c] for c in SOURCE_NAMES[:5]) for r in after.filter(F.col("last_updated") == LATER).collect()}
    assert changed == {"u3": (3, 3, "u3", "v2", "new"), "fresh": (101, 3, "fresh", "v1", "new"), "u4": (4, 4, "u4", "t", "text")}
    assert after.count() == 101 and log_of(spark, folder).filter("change = 1").count() == 3
    # Readers of some notebooks look at the files of their buckets only.
    english = read_kb(spark, folder, "sources", batch)
    assert "PartitionFilters: [" in plan_of(english) and "bucket#" in plan_of(english).split("PartitionFilters: [")[1].split("]")[0]
    assert {r[0] for r in english.select(bucket_of(F.col("notebook_id"))).collect()} == {
        r[0] for r in batch.select(bucket_of(F.col("notebook_id"))).collect()
    }
    # Deleting all rows of a notebook leaves nothing of it behind.
    gone = after.filter("notebook_id = 3").select("id", "notebook_id")
    delete_stored_sources(gone.unionByName(spark.createDataFrame([(7, 999)], gone.schema)), folder)
    left = [i for i in range(1, 101) if i % 20 != 3]
    assert sorted(r.id for r in read_kb(spark, folder, "sources").collect()) == left
    # A deleted address comes back under a new id.
    upsert_stored(batch.filter("url = 'u3'"), folder)
    assert read_kb(spark, folder, "sources").filter("url = 'u3'").first().id == 98 + 3
    upsert_stored(batch.limit(0), folder)
    compact_kb(spark, folder, f"{folder}-compact")
    for path in (folder, f"{folder}-compact"):
        assert sorted(r.id for r in read_kb(spark, path, "sources").collect()) == [*left, 101]
    assert log_of(spark, f"{folder}-compact").count() == 96
    stored_sources(spark, folder)
    assert read_kb(spark, folder, "sources").count() == 100


def test_buckets_are_replaced_and_a_stopped_write_is_made_good(spark, tmp_path):
    folder = str(tmp_path)
    stored_sources(spark, folder)
    three = spark.createDataFrame([(3,)], "notebook_id bigint")
    rows = read_kb(spark, folder, "sources", three)
    write_kb(rows.filter("notebook_id <> 3"), folder, "sources", three)
    assert sorted({r.notebook_id for r in read_kb(spark, folder, "sources").collect()}) == [n for n in range(20) if n != 3]
    # Half of a change is there, then the whole change is written again.
    batch = spark.createDataFrame([(1, "u1", "v2", "new", "success", LATER), (5, "x", "v", "new", "success", LATER)], CHANGE)
    upsert_stored(batch.limit(1), folder)
    upsert_stored(batch, folder)
    assert sorted(r.url for r in read_kb(spark, folder, "sources").filter("content = 'new'").collect()) == ["u1", "x"]


def test_unchanged_texts_are_not_moved_by_a_read(spark, tmp_path):
    folder = str(tmp_path)
    stored_sources(spark, folder)
    upsert_stored(spark.createDataFrame([(3, "u3", "v2", "new", "success", LATER)], CHANGE), folder)
    plan = plan_of(read_kb(spark, folder, "sources"))
    texts = next(line for line in plan.splitlines() if "FileScan" in line and "content#" in line)
    above = plan.splitlines()[:plan.splitlines().index(texts)]
    assert sum("BroadcastHashJoin" in line for line in above) == 2 and not any("Exchange hashpartitioning" in line for line in above)


def test_upserts_do_not_aggregate_texts(spark):
    current = spark.createDataFrame([(1, 1, "u", "t", "text", "success", WHEN)], KB_TABLES["sources"])
    batch = spark.createDataFrame([(1, "u", "v2", "new", "success", LATER), (1, "w", "x", "y", "success", LATER)], CHANGE)
    rows = upsert_sources(current, batch)
    assert "Aggregate" not in plan_of(rows)
    assert {(r.id, r.url, r.content) for r in rows.collect()} == {(1, "u", "new"), (2, "w", "y")}


def test_delete_stored_notebooks(spark, tmp_path):
    folder = str(tmp_path)
    stamp = F.lit(NOW).cast("timestamp")
    notebooks = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string").withColumn("created_at", stamp)
    chats = spark.createDataFrame(
        [(1, 1, "q", "a"), (2, None, "q", "a"), (3, 2, "q", "a")], "id bigint, notebook_id bigint, query string, answer string"
    ).withColumn("created_at", stamp)
    write_kb(notebooks, folder, "notebooks")
    write_kb(chats, folder, "chat_logs")
    delete_stored_notebooks(spark.createDataFrame([(1,), (7,)], "id bigint"), folder)
    assert [r.id for r in read_kb(spark, folder, "notebooks").collect()] == [2]
    assert {r.id for r in read_kb(spark, folder, "chat_logs").collect()} == {2, 3}
    assert read_kb(spark, folder, "sources").count() == 0
