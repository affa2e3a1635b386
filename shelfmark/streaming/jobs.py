"""Incremental runs: pages in, sources kept up to date, URLs seen once.

Each job handles what is new and ends. Progress lies in the checkpoint of the query. A micro-batch writes a folder of
its own, named by the query and a number that goes on over all queries of a log, so a batch that is run again
overwrites its own rows only, and a query with a new checkpoint goes on where the log ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.model import KB_TABLES, PAGES
from shelfmark.operators.extraction import extract_pages
from shelfmark.operators.store import changed_sources, decisive_changes, upsert_sources
from shelfmark.session import stored
from shelfmark.sources.changes import read_or_none
from shelfmark.sources.readers import change_kb, read_kb

FILES_PER_TRIGGER = 100

CHANGES = (
    "notebook_id bigint, url string, title string, content string, status string, "
    "last_updated timestamp, query string, batch bigint"
)
SEEN = "url string, query string, batch bigint, prefix string"
#: Batches of one query in the numbering of a log.
QUERY_BATCHES = 1 << 40
#: Hexadecimal digits of the hash of an address by which the log of addresses is partitioned.
PREFIX_DIGITS = 2


def page_stream(
    spark: SparkSession, path: str, glob: str = "*.parquet", files_per_trigger: int = FILES_PER_TRIGGER
) -> DataFrame:
    """Page files as they arrive in a folder."""
    return (
        spark.readStream.schema(PAGES)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def _run(writer, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_ingest(pages: DataFrame, out: str, checkpoint: str, scraped_at, profile: str = "cli") -> None:
    """Extract each new page file once and append the page rows to ``out``."""
    rows = extract_pages(pages, scraped_at, profile)
    _run(rows.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint)


def _query_id(spark: SparkSession) -> str:
    """The id of the streaming query that runs this batch; it lasts as long as the query's checkpoint."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId")


def _batch_place(spark: SparkSession, path: str, schema: str, batch_id: int) -> tuple[int, str, DataFrame | None]:
    """The number of a batch in the log at ``path``, its folder, and the log so far. Only the names of folders
    are read for the number."""
    own, log = _query_id(spark), read_or_none(spark, path, schema)
    turns = {} if log is None else dict(log.groupBy("query").agg(F.max(F.floor(F.col("batch") / QUERY_BATCHES))).collect())
    turn = turns.get(own, max([t + 1 for q, t in turns.items() if q != own], default=0))
    number = turn * QUERY_BATCHES + batch_id
    return number, f"{path.rstrip('/')}/query={own}/batch={number}", log


def stream_upsert(changes: DataFrame, path: str, checkpoint: str) -> None:
    """Log the decisive changes per source of every micro-batch below ``path``.

    A batch costs its own size, never that of the table; ``current_sources`` reads the result and ``fold_changes``
    takes it into a stored table.
    """

    def log(batch: DataFrame, batch_id: int) -> None:
        _, folder, _ = _batch_place(batch.sparkSession, path, CHANGES, batch_id)
        decisive_changes(batch).write.mode("overwrite").parquet(folder)

    _run(changes.writeStream.foreachBatch(log), checkpoint)


def logged_changes(spark: SparkSession, path: str) -> DataFrame:
    """All logged changes with the place of each in the files, ``_row``, so that no copy of the log is numbered."""
    log = read_or_none(spark, path, CHANGES)
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return spark.createDataFrame([], CHANGES) if log is None else log.withColumn("_row", place)


def current_sources(
    spark: SparkSession, path: str, keep_on_fail: bool = True, base: DataFrame | None = None
) -> DataFrame:
    """Sources after all logged batches, as if each had been upserted in turn into ``base``, whose sources keep
    their ids (into an empty table if there is none)."""
    if base is None:
        base = spark.createDataFrame([], KB_TABLES["sources"])
    return upsert_sources(base, logged_changes(spark, path), keep_on_fail, order=["batch"])


def fold_changes(spark: SparkSession, path: str, kb: str, keep_on_fail: bool = True) -> int:
    """Compact a log of changes: append what it changes to the stored sources at ``kb``. The streams then go on
    with a log at a new path, and the reader of both gives ``read_kb(...)`` as ``base``. Doing it again changes
    nothing more. The number of the change is returned."""
    current = read_kb(spark, kb, "sources")
    return change_kb(changed_sources(current, logged_changes(spark, path), keep_on_fail, order=["batch"]), kb, "sources")


def stream_dedup(urls: DataFrame, out: str, checkpoint: str, event_time: str | None = None, delay: str = "1 day") -> None:
    """Write the first row of every URL.

    With an event time the state is dropped after ``delay``. Without one it holds every URL;
    for very long runs ``stream_new_urls`` keeps them in a table instead.
    """
    if event_time:
        first = urls.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["url"])
    else:
        first = urls.dropDuplicates(["url"])
    _run(first.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint)


def _prefix(url: Column) -> Column:
    return F.substring(F.md5(url), 1, PREFIX_DIGITS)


def stream_new_urls(urls: DataFrame, path: str, checkpoint: str) -> None:
    """Log the URLs of every micro-batch that the log does not have yet; the log is the state.

    It is partitioned by the first digits of a hash, and a batch reads only the partitions of its own URLs. Batches
    of all queries count, but for the one that is run again.
    """

    def log(batch: DataFrame, batch_id: int) -> None:
        fresh = stored(batch.select("url").distinct().withColumn("prefix", _prefix(F.col("url"))), "urls")
        number, folder, seen = _batch_place(batch.sparkSession, path, SEEN, batch_id)
        if seen is not None:
            prefixes = sorted(r[0] for r in fresh.select("prefix").distinct().collect() if r[0] is not None)
            earlier = seen.filter(F.col("prefix").isin(prefixes) & (F.col("batch") != number))
            fresh = fresh.join(earlier.select("prefix", "url"), ["prefix", "url"], "left_anti")
        fresh.hint("rebalance", "prefix").write.mode("overwrite").partitionBy("prefix").parquet(folder)

    _run(urls.writeStream.foreachBatch(log), checkpoint)


def compact_urls(spark: SparkSession, path: str, out: str) -> None:
    """The URLs of a log in few files at a new path, from which ``stream_new_urls`` can go on."""
    seen = read_or_none(spark, path, SEEN)
    if seen is not None:
        rows = seen.select("url", "prefix").hint("rebalance", "prefix")
        rows.write.mode("overwrite").partitionBy("prefix").parquet(f"{out.rstrip('/')}/query=compacted/batch=0")
