"""One batch run over many sites: filter, resume, extract, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.model import CrawlConfig
from shelfmark.operators.discovery import discover
from shelfmark.operators.extraction import build_page_results
from shelfmark.operators.fetchlog import resolve_fetch
from shelfmark.operators.filters import REASONS, classify_urls, filter_stats, kept_urls, pending_urls, skipped_count
from shelfmark.operators.output import merge_progress, progress_of, write_jsonl, write_markdown
from shelfmark.operators.report import failed_sample, run_summary
from shelfmark.operators.totals import read_states, run_state, write_state
from shelfmark.session import stored
from shelfmark.sources.changes import read_or_none
from shelfmark.sources.pages import pages_at
from shelfmark.sources.segments import add_segments, seen_segments


@dataclass
class CrawlRun:
    stats: DataFrame
    results: DataFrame
    progress: DataFrame
    summary: DataFrame
    failures: DataFrame


def run_crawl(
    urls: DataFrame,
    pages: DataFrame,
    config: CrawlConfig,
    scraped_at,
    progress: DataFrame,
    robots: DataFrame | None = None,
    attempts: DataFrame | None = None,
    drop_repeats: bool = True,
    seen: DataFrame | None = None,
) -> CrawlRun:
    """Results of one run. ``urls`` were discovered, ``pages`` hold what was fetched.

    Verdicts on addresses are stored once, narrow, for the five that read them. Pass ``pages`` as a table of
    ``save_pages``, and their HTML is read where it lies; of other tables it is moved to the pending addresses. ``seen`` are the
    segments of earlier runs, as ``seen_segments`` reads them.
    """
    classified = stored(classify_urls(urls, config, robots), "classified")
    kept = kept_urls(classified)
    pending = pending_urls(kept, progress)
    resolved = None
    if attempts is not None:
        resolved = resolve_fetch(attempts.join(pending.select("url"), "url", "left_semi"))
    wanted = pages_at(pages, pending)
    # Extraction is the costly step and has five readers.
    rows = build_page_results(wanted, scraped_at, resolved=resolved, drop_repeats=drop_repeats, seen=seen)
    results = stored(rows, "results")
    return CrawlRun(
        stats=filter_stats(classified),
        results=results,
        progress=merge_progress(progress, progress_of(results)),
        summary=run_summary(results, skipped_count(kept, progress)),
        failures=failed_sample(results),
    )


def crawl_sites(
    sites: DataFrame,
    robots: DataFrame,
    sitemap_docs: DataFrame,
    home_pages: DataFrame,
    pages: DataFrame,
    config: CrawlConfig,
    scraped_at,
    progress: DataFrame,
    attempts: DataFrame | None = None,
    mode: str = "if_none",
    drop_repeats: bool = True,
    seen: DataFrame | None = None,
) -> CrawlRun:
    """From sites to results: their addresses are discovered, and each is filtered by its own site.

    The addresses are stored once, since statistics, filters and counts all read them.
    """
    found = discover(sites, robots, sitemap_docs, home_pages, mode)
    urls = stored(found.select(F.col("site").alias("base_url"), "url"), "discovered")
    return run_crawl(urls, pages, config, scraped_at, progress, robots, attempts, drop_repeats, seen)


PROGRESS = "url string, status string, run bigint"


def _next_run(spark: SparkSession, root: str) -> int:
    """The number after the last run that was written to the end."""
    before = read_or_none(spark, f"{root}/progress", PROGRESS)
    last = None if before is None else before.agg(F.max("run")).first()[0]
    return 0 if last is None else last + 1


def write_run(run: CrawlRun, path: str) -> None:
    """Markdown, JSON lines, copies of segments, totals, filter statistics and the progress of a run below ``path``.

    Each run has a folder of its own, which it overwrites, and its progress comes last: a run that was
    interrupted and is started again leaves each page once. Of the progress only what is new is written.
    """
    root, spark = path.rstrip("/"), run.results.sparkSession
    number = _next_run(spark, root)
    write_markdown(run.results, f"{root}/pages/run={number}", mode="overwrite")
    write_jsonl(run.results, f"{root}/combined/run={number}", mode="overwrite")
    add_segments(run.results, f"{root}/segments", number)
    write_state(run_state(run.results), f"{root}/totals", number)
    run.stats.write.mode("overwrite").parquet(f"{root}/stats/run={number}")
    new = run.progress.join(saved_progress(spark, root), ["url", "status"], "left_anti")
    new.write.mode("overwrite").parquet(f"{root}/progress/run={number}")


def saved_progress(spark: SparkSession, path: str) -> DataFrame:
    """What the runs below ``path`` left, the last run of an address deciding; no rows before the first run."""
    rows = read_or_none(spark, f"{path.rstrip('/')}/progress", PROGRESS)
    if rows is None:
        return spark.createDataFrame([], "url string, status string")
    return rows.groupBy("url").agg(F.max_by("status", "run").alias("status"))


def saved_segments(spark: SparkSession, path: str) -> DataFrame:
    """Copies of long segments kept by the finished runs below ``path``, to be passed on as ``seen``."""
    root = path.rstrip("/")
    return seen_segments(spark, f"{root}/segments", before=_next_run(spark, root))


def saved_totals(spark: SparkSession, path: str) -> DataFrame:
    """The merged state of the finished runs below ``path``, for ``figures`` and ``frequent_errors``."""
    root = path.rstrip("/")
    return read_states(spark, f"{root}/totals", before=_next_run(spark, root))


def saved_stats(spark: SparkSession, path: str) -> DataFrame:
    """Addresses dropped by reason and kept, summed over the finished runs below ``path``; an address that several
    runs looked at counts in each."""
    root, names = path.rstrip("/"), [*[f"n_{r}" for r in REASONS], "n_remaining"]
    rows = read_or_none(spark, f"{root}/stats", ", ".join([*[f"{n} bigint" for n in names], "run bigint"]))
    if rows is None:
        return spark.createDataFrame([tuple(0 for _ in names)], ", ".join(f"{n} bigint" for n in names))
    done = rows.filter(F.col("run") < _next_run(spark, root))
    return done.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
