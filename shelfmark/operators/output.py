"""Markdown, JSON lines and checkpoint out of page rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import or_empty
from shelfmark.functions.urls import url_slug
from shelfmark.model import SUCCESS
from shelfmark.operators.spread import spread_lookup

RECORD_FIELDS = ("url", "title", "language", "scraped_at", "content")


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text in UTC, whatever the session's zone; microseconds only where there are any."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    fine = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(F.pmod(F.unix_micros(ts), F.lit(1_000_000)) == 0, whole).otherwise(fine)
    return F.concat(text, F.lit("+00:00"))


def slug_groups(df: DataFrame) -> DataFrame:
    """Slugs shared by several URLs, which overwrite each other as files.

    Counts and the two ends, never the whole group in one row; ``slug_members`` has the rows.
    """
    return (
        df.select(url_slug(F.col("url")).alias("slug"), "url")
        .groupBy("slug")
        .agg(F.count("*").alias("n"), F.min("url").alias("first_url"), F.max("url").alias("last_url"))
    )


def slug_members(df: DataFrame) -> DataFrame:
    """The URLs, one per row, behind each slug that several URLs share."""
    slugs = df.select(url_slug(F.col("url")).alias("slug"), "url")
    shared = slugs.groupBy("slug").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    return spread_lookup(slugs, shared, ["slug"], how="inner", spread_by=["url"]).select("slug", "n", "url")


def to_markdown(results: DataFrame) -> DataFrame:
    """``filename, body``: front matter, heading if there is a title, and the text."""
    title = or_empty(F.col("title"))
    lines = [
        F.lit("---"),
        F.concat(F.lit("url: "), F.col("url")),
        F.concat(F.lit('title: "'), F.replace(title, F.lit('"'), F.lit("'")), F.lit('"')),
        F.concat(F.lit("language: "), or_empty(F.col("language"))),
        F.concat(F.lit("scraped_at: "), F.coalesce(iso_utc(F.col("scraped_at")), F.lit(""))),
        F.lit("---"),
    ]
    heading = F.when(title != "", F.concat(F.lit("# "), title, F.lit("\n\n"))).otherwise("")
    body = F.concat(F.concat_ws("\n", *lines), F.lit("\n"), heading, or_empty(F.col("content")))
    return results.select(F.concat(url_slug(F.col("url")), F.lit(".md")).alias("filename"), body.alias("body"))


def write_markdown(results: DataFrame, path: str, as_files: bool = False, mode: str = "append") -> None:
    """Texts of the successful pages, as a Parquet table or, for small exports, one folder each."""
    texts = to_markdown(results.filter(F.col("status") == SUCCESS))
    if as_files:
        texts.select("filename", F.col("body").alias("value")).write.mode(mode).partitionBy("filename").text(path)
    else:
        texts.write.mode(mode).parquet(path)


def _record(results: DataFrame) -> list[Column]:
    stamp = F.coalesce(iso_utc(F.col("scraped_at")), F.lit(""))
    return [stamp.alias(c) if c == "scraped_at" else or_empty(F.col(c)).alias(c) for c in RECORD_FIELDS]


def to_json_record(results: DataFrame) -> DataFrame:
    """``url, json`` with the fields of one line of the JSON export."""
    return results.select("url", F.to_json(F.struct(*_record(results)), {"ignoreNullFields": "false"}).alias("json"))


def write_jsonl(results: DataFrame, path: str, mode: str = "append") -> None:
    """The successful pages as JSON lines."""
    done = results.filter(F.col("status") == SUCCESS)
    done.select(*_record(done)).write.mode(mode).option("ignoreNullFields", False).json(path)


def merge_progress(old: DataFrame, new: DataFrame) -> DataFrame:
    """``url, status`` of both; the newer run wins."""
    fresh = new.select("url", F.col("status").alias("_new"))
    return old.join(fresh, "url", "full_outer").select("url", F.coalesce("_new", "status").alias("status"))


def progress_of(results: DataFrame) -> DataFrame:
    return results.select("url", "status")
