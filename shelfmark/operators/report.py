"""Counts and summaries for people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import first_nonempty
from shelfmark.model import FAILED, SUCCESS
from shelfmark.operators.spread import positions, spread_lookup
from shelfmark.session import stored

# Labels of the source list.
SAVED_LABEL, FAILED_LABEL, UNTITLED_LABEL = "TERSIMPAN", "GAGAL", "Dokumen Tanpa Judul"
IMPORT_BATCH = 6


def run_summary(results: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Pages processed, succeeded and failed, and those skipped by the checkpoint."""
    before = F.lit(0).cast("bigint") if skipped is None else skipped.select("skipped").scalar()
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == SUCCESS).alias("succeeded"),
        F.count_if(F.col("status") == FAILED).alias("failed"),
    ).withColumn("skipped", before)


def failed_sample(results: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` failures by URL, and how many more there are. Addresses and errors of the failures are
    stored in one pass, so that the pages are extracted once."""
    failed = stored(results.filter(F.col("status") == FAILED).select("url", "error"), "failures")
    more = failed.agg(F.greatest(F.count("*") - n, F.lit(0))).scalar()
    return failed.orderBy("url").limit(n).withColumn("n_more", more)


def batch_progress(urls: DataFrame, size: int = IMPORT_BATCH) -> DataFrame:
    """Progress after each batch of ``size`` URLs of a site, in rounded percent."""
    batches = (
        positions(urls.select("site", "url"), ["site"], ["url"])
        .groupBy("site", F.ceil(F.col("pos") / size).alias("batch_no"))
        .agg(F.count("*").alias("n"), F.max("pos").alias("completed"))
    )
    total = batches.groupBy("site").agg(F.max("completed").alias("total"))
    joined = spread_lookup(batches, total, ["site"], spread_by=["batch_no"])
    percent = F.floor(F.col("completed") / F.col("total") * 100 + 0.5)
    return joined.select("site", "batch_no", "n", "completed", "total", percent.alias("percent"))


def display_status(sources: DataFrame) -> DataFrame:
    """Badge and shown title of each source."""
    badge = F.when(F.col("status") == SUCCESS, SAVED_LABEL).otherwise(FAILED_LABEL)
    shown = first_nonempty(F.col("title"), F.lit(UNTITLED_LABEL))
    return sources.select("id", "url", badge.alias("badge"), shown.alias("shown_title"))


def source_counts(sources: DataFrame, notebooks: DataFrame | None = None) -> DataFrame:
    """Sources per notebook; notebooks without any count zero when they are given."""
    counts = sources.groupBy("notebook_id").agg(F.count("*").alias("n_sources"))
    if notebooks is None:
        return counts
    known = notebooks.select(F.col("id").alias("notebook_id"))
    return known.join(counts, "notebook_id", "left").select(
        "notebook_id", F.coalesce("n_sources", F.lit(0).cast("bigint")).alias("n_sources")
    )
