"""Fetched pages in buckets by address, so that a resumed run finds its pages without moving their HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Buckets of a page table; files of a bucket are read by one task, so set it by the size of the table.
PAGE_BUCKETS = 64


def save_pages(pages: DataFrame, table: str, path: str | None = None, buckets: int = PAGE_BUCKETS) -> None:
    """Write a catalog table of pages with rows of one address in one bucket, below ``path`` if it is given.

    The pages are shuffled once, here. A join of the table with addresses then shuffles the addresses alone.
    """
    writer = pages.repartition(buckets, "url").write.mode("overwrite").bucketBy(buckets, "url").sortBy("url")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def saved_pages(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def pages_at(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """The pages at ``urls``. Of a table in buckets no HTML is moved, whatever the number of addresses: their
    column is dealt out to the buckets, and each bucket is joined where it lies."""
    return pages.join(urls.select("url"), "url", "left_semi")
