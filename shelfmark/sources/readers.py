"""Readers with fixed schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.model import KB_KEYS, KB_TABLES, PAGES, PROGRESS_FILE
from shelfmark.sources.changes import BUCKETS, append_change, buckets_of, compact, read_table


INPUT_PARTITIONS = "spark.shelfmark.inputPartitions"


def evened(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by ``key`` over as many partitions as the session's ``spark.shelfmark.inputPartitions``
    says, for texts in few files; as its files lie without that setting."""
    partitions = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(partitions), key) if partitions else df


def read_pages(spark: SparkSession, path: str, even: bool = False) -> DataFrame:
    """Fetched pages: ``page_id, url, html``; ``even`` for work on the texts of few files."""
    rows = spark.read.schema(PAGES).parquet(path)
    return evened(rows, "page_id") if even else rows


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True)


def _decoded(name: Column) -> Column:
    """Percent-decoded; a plus stays a plus."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _original_address(column: str, suffix: str = "") -> Column:
    """The address a stored file was fetched from: its percent-encoded file name, or the value of its folder
    ``column=value``, as Spark's partitioned writers name it."""
    path = F.input_file_name()
    folder = F.regexp_extract(path, rf"/{column}=([^/]*)/[^/]*\z", 1)
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), r"\.gz\z", "")
    # The path is encoded once more by the file listing.
    return F.when(folder != "", _decoded(_decoded(folder))).otherwise(
        F.regexp_replace(_decoded(_decoded(name)), suffix + r"\z", "")
    )


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """Stored sitemap files, plain or gzip: ``sitemap_url, xml``.

    A file is named by the percent-encoded address it was fetched from, or lies in a folder
    ``sitemap_url=address``.
    """
    return _whole_files(spark, path).select(
        _original_address("sitemap_url").alias("sitemap_url"), F.col("value").alias("xml")
    )


def read_robots(spark: SparkSession, path: str) -> DataFrame:
    """Stored robots files, named by the percent-encoded host and ``.txt`` or in folders ``host=name``:
    ``host, status_code, body``."""
    return _whole_files(spark, path).select(
        _original_address("host", r"\.txt").alias("host"), F.lit(200).alias("status_code"), F.col("value").alias("body")
    )


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The checkpoint as rows ``url, status``; a missing or broken file gives no rows. A store that cannot be
    read is an error, so that a crawl does not start again by mistake."""
    try:
        stored = spark.read.schema(PROGRESS_FILE).option("multiLine", True).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "url string, status string")
    return stored.select(F.explode("completed").alias("url", "status"))


def _buckets(notebooks: DataFrame | None) -> list[int] | None:
    return None if notebooks is None else buckets_of(notebooks, "notebook_id")


def _place(path: str, table: str) -> str:
    return f"{path.rstrip('/')}/{table}"


def read_kb(spark: SparkSession, path: str, table: str, notebooks: DataFrame | None = None) -> DataFrame:
    """One of the tables ``notebooks``, ``sources`` and ``chat_logs`` as its changes leave it.

    With ``notebooks`` (``notebook_id``) only their buckets are read: all their rows, and those of other
    notebooks in the same buckets.
    """
    return read_table(spark, _place(path, table), KB_TABLES[table], _buckets(notebooks))


def write_kb(df: DataFrame, path: str, table: str, notebooks: DataFrame | None = None) -> int:
    """Replace a table by ``df``, or with ``notebooks`` the rows in the buckets of these; ``df`` must then hold all
    rows of these buckets, as ``read_kb`` gives them. The number of the change is returned."""
    anew = list(range(BUCKETS)) if notebooks is None else _buckets(notebooks)
    return append_change(df, _place(path, table), KB_TABLES[table], KB_KEYS[table], anew=anew)


def change_kb(rows: DataFrame, path: str, table: str, deleted: DataFrame | None = None) -> int:
    """Append rows that are new or changed, and the ids (with the key of the table) that go. Nothing else is read
    or written."""
    return append_change(rows, _place(path, table), KB_TABLES[table], KB_KEYS[table], deleted)


def compact_kb(spark: SparkSession, path: str, out: str) -> None:
    """Write the tables that ``path`` holds to ``out``, each as one change."""
    for table in KB_TABLES:
        compact(spark, _place(path, table), KB_TABLES[table], KB_KEYS[table], _place(out, table))
