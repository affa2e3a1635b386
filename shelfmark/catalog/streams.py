"""Streams over the given files, run to their end and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.catalog import inputs as I
from shelfmark.catalog.crawl import ATTEMPTS
from shelfmark.catalog.pages import EXTRACTED, SCRAPED_AT
from shelfmark.catalog.registry import query
from shelfmark.catalog.store import SOURCES, day
from shelfmark.model import PAGE_RESULTS
from shelfmark.operators.spread import positions
from shelfmark.session import run_folder
from shelfmark.streaming import attempts as A
from shelfmark.streaming import jobs as S

#: Files that the streams of the queries find, and how many a micro-batch takes.
FILES, FILES_PER_TRIGGER = 6, 2
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def arrived(spark, sf: str, table: str) -> str:
    """A folder with all rows of a table in several files, as if they had come one after the other."""
    folder = run_folder(spark, f"arrived-{table}")
    I.table(spark, sf, table).repartition(FILES).write.parquet(folder)
    return folder


@query(f"WITH {EXTRACTED} SELECT url, title, language, content, 'success' AS status FROM extracted")
def stream_ingest(spark, sf):
    """Page files extracted by a stream; a second run of it finds nothing new."""
    folder, files = run_folder(spark, "ingest"), arrived(spark, sf, "pages")
    for _ in range(2):
        pages = S.page_stream(spark, files, files_per_trigger=FILES_PER_TRIGGER)
        S.stream_ingest(pages, f"{folder}/out", f"{folder}/ck", I.ts(SCRAPED_AT))
    rows = spark.read.schema(PAGE_RESULTS).parquet(f"{folder}/out")
    return rows.select("url", "title", "language", "content", "status")


@query(
    f"""WITH {SOURCES}
SELECT row_number() OVER (ORDER BY notebook_id, url) AS id, notebook_id, url, title, content, status, last_updated FROM sources"""
)
def stream_upsert(spark, sf):
    """Documents as changes that arrive by a stream; sources resolved from the log."""
    folder, files = run_folder(spark, "upsert"), arrived(spark, sf, "documents")
    docs = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", FILES_PER_TRIGGER).parquet(files)
    url = F.concat(F.lit("doc://"), F.col("doc_id").cast("string"))
    changes = docs.select(
        I.language_notebook(F.col("lang")).alias("notebook_id"), url.alias("url"), url.alias("title"),
        F.col("text").alias("content"), F.lit("success").alias("status"), I.ts(I.FIRST).alias("last_updated"),
    )
    S.stream_upsert(changes, f"{folder}/log", f"{folder}/ck")
    # The order of arrival decides on ids; the key stands in for it here, as files come in any order.
    current = S.current_sources(spark, f"{folder}/log").withColumnRenamed("id", "arrived")
    # Numbered on keys alone; the texts meet the numbers once.
    places = positions(current.select("arrived", "notebook_id", "url"), [], ["notebook_id", "url"], out="id")
    return day(current.join(places.select("arrived", "id"), "arrived").drop("arrived"))


ADDRESSES = "SELECT DISTINCT regexp_replace(url, '[?#].*', '') AS url FROM pages"


def addresses(spark, sf):
    return S.page_stream(spark, arrived(spark, sf, "pages"), files_per_trigger=FILES_PER_TRIGGER).select(F.regexp_replace("url", "[?#].*", "").alias("url"))


@query(ADDRESSES)
def stream_dedup(spark, sf):
    """Addresses without query and fragment, each once, with the state kept by Spark."""
    folder = run_folder(spark, "dedup")
    S.stream_dedup(addresses(spark, sf), f"{folder}/out", f"{folder}/ck")
    return spark.read.schema("url string").parquet(f"{folder}/out")


@query(ADDRESSES)
def stream_new_urls(spark, sf):
    """The same with a table as state; a query with a new checkpoint adds nothing to it."""
    folder = run_folder(spark, "seen")
    for run in range(2):
        S.stream_new_urls(addresses(spark, sf), f"{folder}/log", f"{folder}/ck{run}")
    return spark.read.schema(S.SEEN).parquet(f"{folder}/log").select("url")


@query(
    f"""WITH {ATTEMPTS}, counted AS (SELECT url, count(DISTINCT attempt) AS n FROM attempts WHERE attempt <= 3 GROUP BY url)
SELECT url, status, attempts, error FROM resolved JOIN first_final USING (url) JOIN counted USING (url)
WHERE final IS NOT NULL OR n = 3"""
)
def stream_resolve(spark, sf):
    """Verdicts out of a stream of attempts, in files that come in any order; addresses whose attempts may still go
    on have none."""
    folder = run_folder(spark, "verdicts")
    I.attempts(spark, sf).withColumn("at", I.ts(I.FIRST)).repartition(FILES).write.parquet(f"{folder}/in")
    schema = "url string, attempt bigint, status_code int, timed_out boolean, error string, at timestamp"
    attempts = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER).parquet(f"{folder}/in")
    for _ in range(2):
        A.stream_verdicts(attempts, f"{folder}/out", f"{folder}/ck")
    return spark.read.schema(A.VERDICTS).parquet(f"{folder}/out")
