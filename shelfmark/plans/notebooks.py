"""Notebook work end to end: import pages as sources, and contexts for tables of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import literal
from shelfmark.functions.tokens import WINDOW, Codec
from shelfmark.functions.urls import with_scheme
from shelfmark.model import KB_KEYS, KB_TABLES
from shelfmark.operators.chunks import cap_chunks, chunk_notebook
from shelfmark.operators.extraction import drop_repeated_segments, extract_pages, extraction_status, failure_rows
from shelfmark.operators.retrieval import (
    TOP_K, Encoder, assemble_context, assemble_prompt, embed, guard_empty, retrieve,
)
from shelfmark.operators.spread import spread_lookup
from shelfmark.operators.store import changed_sources, notebook_corpus, upsert_sources
from shelfmark.session import small_batches, stored
from shelfmark.sources.readers import change_kb, read_kb


def import_pages(
    current: DataFrame,
    pages: DataFrame,
    scraped_at,
    resolved: DataFrame | None = None,
    keep_on_fail: bool = True,
    drop_repeats: bool = True,
) -> DataFrame:
    """``pages(notebook_id, url, html)`` extracted and upserted into ``current``.

    ``html`` is NULL where the fetch failed; such a source has an empty title. Pages are extracted where they
    lie, and only the stored page rows move: the HTML never does. With ``drop_repeats`` segments that occur
    again and again over the pages go, as in a crawl run, and a page left without text has failed.
    """
    addressed = pages.withColumn("url", with_scheme(F.col("url")))
    rows = extract_pages(addressed, scraped_at, "api", keep=["notebook_id", "html"])
    rows = rows.withColumn("title", F.when(F.col("html").isNull(), "").otherwise(F.col("title")))
    rows = stored(rows.drop("html"), "imported")
    if drop_repeats:
        rows = extraction_status(drop_repeated_segments(rows, "url", "content", separator="\n\n"), "api")
    if resolved is not None:
        lost = failure_rows(resolved, scraped_at, "api")
        failed = rows.select("notebook_id", "url").distinct().join(lost, "url")
        rows = rows.join(lost.select("url"), "url", "left_anti").unionByName(failed.select(rows.columns))
    batch = rows.select(
        "notebook_id", "url", "title", "content", "status",
        literal(scraped_at).cast("timestamp").alias("last_updated"),
    )
    return upsert_sources(current, batch, keep_on_fail)


def upsert_stored(batch: DataFrame, kb: str, keep_on_fail: bool = True) -> int:
    """A batch upserted into the stored sources: only rows that change are written. The buckets of the batch's
    notebooks are read; of the others the ids are."""
    spark = batch.sparkSession
    batch = stored(batch, "changes")
    current = read_kb(spark, kb, "sources", batch)
    every = read_kb(spark, kb, "sources").select("id")
    return change_kb(changed_sources(current, batch, keep_on_fail, numbered=every), kb, "sources")


def delete_stored_sources(keys: DataFrame, kb: str) -> int:
    """The ``id, notebook_id`` pairs go from the stored sources; their rows are neither read nor moved. A pair
    whose notebook is another one matches nothing."""
    spark = keys.sparkSession
    known = read_kb(spark, kb, "sources", keys).select("id", "notebook_id")
    gone = known.join(keys.select("id", "notebook_id"), ["id", "notebook_id"], "left_semi")
    return change_kb(spark.createDataFrame([], KB_TABLES["sources"]), kb, "sources", gone)


def delete_stored_notebooks(ids: DataFrame, kb: str) -> None:
    """Notebooks (``id``) go from the stored tables with all that belongs to them, the notebooks last, so that a
    run that was stopped can be started again. Of the rows that go only their ids are read."""
    spark = ids.sparkSession
    touched = ids.select(F.col("id").alias("notebook_id")).distinct()
    for name in ("sources", "chat_logs", "notebooks"):
        rows = read_kb(spark, kb, name, touched)
        owner = F.col(KB_KEYS[name]).alias("notebook_id")
        # A notebook may own any share of the rows.
        gone = spread_lookup(rows.select("id", owner), touched, ["notebook_id"], "left_semi", ["id"])
        gone = gone.select("id", *([] if KB_KEYS[name] == "id" else ["notebook_id"]))
        change_kb(spark.createDataFrame([], KB_TABLES[name]), kb, name, gone)


def chunk_table(
    sources: DataFrame,
    size: int = WINDOW,
    cap: int | None = None,
    encoder: Encoder | None = None,
    load_codec: Callable[[], Codec] | None = None,
) -> DataFrame:
    """Windows with vectors, written once, to be asked many times; all of them unless a ``cap`` is wanted."""
    small_batches(sources.sparkSession)
    chunks = cap_chunks(chunk_notebook(notebook_corpus(sources), size, load_codec), cap)
    return stored(chunks.withColumn("vec", embed(F.col("text"), encoder)), "chunks")


def question_contexts(
    sources: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    size: int = WINDOW,
    cap: int | None = None,
    encoder: Encoder | None = None,
    load_codec: Callable[[], Codec] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Prompts for the questions whose notebook has text, and fixed answers for the others."""
    chunks = chunk_table(sources, size, cap, encoder, load_codec)
    prompts = assemble_prompt(assemble_context(retrieve(queries, chunks, k, encoder)), queries)
    return prompts, guard_empty(queries, notebook_corpus(sources))
