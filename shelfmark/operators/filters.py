"""Which URLs to fetch, why others are dropped, and selections from a URL list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import urls as U
from shelfmark.functions.text import literal, strip
from shelfmark.model import SUCCESS, CrawlConfig
from shelfmark.operators.robots import agent_policy, allowed_by
from shelfmark.operators.spread import spread_lookup

# Reasons in the order in which they are tested, and the preset sizes.
REASONS = ("domain", "robots", "lang", "path")
PRESET_SIZES = (10, 25, 50, 100)


def drop_reason(
    url: Column, base: Column, allowed: Column, lang: str | None = None, path_filter: str | None = None
) -> Column:
    """The first test a URL fails, in the order of ``REASONS``; NULL for a URL that is kept."""
    url_path = U.path(url)
    reason = F.when(~U.same_domain(url, base), "domain").when(~allowed, "robots")
    if lang:
        reason = reason.when(U.lang_excluded(url_path, lang), "lang")
    if path_filter:
        reason = reason.when(~U.path_contains(url_path, path_filter), "path")
    return reason


def classify_urls(urls: DataFrame, config: CrawlConfig, robots: DataFrame | None = None) -> DataFrame:
    """``urls`` with ``drop_reason``.

    Rows may carry a ``base_url`` of their own, for a run over many sites; else the base of
    the configuration holds for all.
    """
    base = F.col("base_url") if "base_url" in urls.columns else F.lit(config.base_url)
    if robots is None:
        reason = drop_reason(F.col("url"), base, F.lit(True), config.lang_filter, config.path_filter)
        return urls.withColumn("drop_reason", reason)
    # Off-domain rows are decided without their rules; a key without a match skips the lookup.
    on_site = F.when(U.same_domain(F.col("url"), base), U.netloc(F.col("url")))
    rows = spread_lookup(
        urls.withColumn("host", on_site), agent_policy(robots, config.agent), ["host"], spread_by=["url"]
    )
    allowed = allowed_by(F.col("url"), F.col("policy"), F.col("rules"), config.robots_on_missing)
    reason = drop_reason(F.col("url"), base, allowed, config.lang_filter, config.path_filter)
    return rows.select(*urls.columns, reason.alias("drop_reason"))


def kept_urls(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("drop_reason").isNull()).drop("drop_reason")


def filter_stats(classified: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Dropped URLs per reason and those that remain."""
    reason = F.col("drop_reason")
    return classified.groupBy(*(by or [])).agg(
        *[F.count_if(reason == r).alias(f"n_{r}") for r in REASONS],
        F.count_if(reason.isNull()).alias("n_remaining"),
    )


def _done(progress: DataFrame, retry_failed: bool) -> DataFrame:
    done = progress.filter(F.col("status") == SUCCESS) if retry_failed else progress
    return done.select("url")


def pending_urls(kept: DataFrame, progress: DataFrame, retry_failed: bool = False) -> DataFrame:
    """URLs not in the checkpoint; failed ones count as done unless they are to be retried."""
    return kept.join(_done(progress, retry_failed), "url", "left_anti")


def skipped_count(kept: DataFrame, progress: DataFrame, retry_failed: bool = False) -> DataFrame:
    skipped = kept.join(_done(progress, retry_failed), "url", "left_semi")
    return skipped.agg(F.count("*").alias("skipped"))


def url_matches(url: Column, needle: str | Column) -> Column:
    """Case-insensitive search; the empty needle matches everything."""
    return F.lower(url).contains(strip(F.lower(literal(needle))))


def search_urls(urls: DataFrame, needle: str) -> DataFrame:
    return urls.filter(url_matches(F.col("url"), needle))


def select_preset(urls: DataFrame, preset: str | int) -> DataFrame:
    """``urls`` with ``selected``: all, none, or the first N of each site in URL order.

    URLs are distinct within a site. Only the N-th URL of each site is looked up.
    """
    if preset in ("all", "none"):
        return urls.withColumn("selected", F.lit(preset == "all"))
    rank = F.row_number().over(Window.partitionBy("site").orderBy("url"))
    last = (
        urls.select("site", "url")
        .withColumn("rank", rank)
        .filter(F.col("rank") <= int(preset))
        .groupBy("site")
        .agg(F.max("url").alias("_last"))
    )
    marked = spread_lookup(urls, last, ["site"], spread_by=["url"])
    return marked.select(*urls.columns, (F.col("url") <= F.col("_last")).alias("selected"))


def select_matching(urls: DataFrame, needle: str) -> DataFrame:
    """Select exactly the matching URLs of a site; without a match its selection stays."""
    match = url_matches(F.col("url"), needle)
    hits = urls.filter(match).select("site").distinct().withColumn("_hit", F.lit(True))
    marked = spread_lookup(urls, hits, ["site"], spread_by=["url"])
    others = [c for c in urls.columns if c != "selected"]
    selected = F.when(F.col("_hit"), match).otherwise(F.col("selected"))
    return marked.select(*others, selected.alias("selected"))


def selection_summary(selection: DataFrame) -> DataFrame:
    """Selected and listed URLs per site, and whether an import can start."""
    chosen = F.count_if(F.col("selected"))
    return selection.groupBy("site").agg(
        F.count("*").alias("n_listed"), chosen.alias("n_selected"), (chosen > 0).alias("can_import")
    )


def import_list(selection: DataFrame) -> DataFrame:
    return selection.filter("selected").drop("selected")
