"""WARC archives: written from pages, read back by boundary-chain verification.

Reading tasks cut the files at the magic of a record and emit for each cut the offset of a candidate record
and of its successor, as its length field has it. A magic inside a payload makes false candidates, so the
candidates form chains, and only those that can be reached from offset 0 of their file are records. Reached
offsets double in each round by pointer jumping. A record whose payload holds the magic is put together again
from its pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.operators.spread import running_offsets
from shelfmark.session import run_folder, stored

# The format.
MAGIC = "WARC/1.1\r\n"
LINE, BLANK = "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
LEAST_BYTES = 100
RECORDS_A_FILE = 20_000


def digest(html: Column) -> Column:
    return F.sha2(html.cast("binary"), 256)


def first_holders(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``payload_digest, first_id, first_url``: for payloads that several ids have, the smallest id."""
    rows = pages.filter(F.octet_length("html") >= least_bytes).select("page_id", digest(F.col("html")).alias("payload_digest"))
    return stored(
        rows.groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.unhex("payload_digest").alias("held"), "first_id"),
        "payloads",
    )


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``value``: the text of a record for each row, without the two line ends after it."""
    plain = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = plain.withColumn("payload_digest", digest(F.col("html")))
    rows = rows.join(first_holders(plain, least_bytes), F.unhex("payload_digest") == F.col("held"), "left")
    repeat = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False))
    rows = rows.withColumn("repeat", repeat)

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE)), F.lit(""))

    # Line ends in an address would end its header.
    safe = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def uuid(name: Column) -> Column:
        return F.regexp_replace(F.md5(name), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")

    own = F.concat_ws(":", F.lit("page"), F.col("page_id").cast("string"), "payload_digest")
    other = F.concat_ws(":", F.lit("page"), F.col("first_id").cast("string"), "payload_digest")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        F.octet_length("html").cast("string"), F.lit(BLANK),
    )
    block = F.concat(http, F.when(F.col("repeat"), "").otherwise(F.col("html")))
    kind = F.when(F.col("repeat"), "revisit").otherwise("response")
    return rows.withColumn("block", block).select(
        F.concat(
            F.lit(MAGIC), header("WARC-Type", kind), header("WARC-Record-ID", uuid(own)),
            header("WARC-Date", F.lit(DATE)), header("WARC-Target-URI", safe),
            header("WARC-Page-ID", F.col("page_id").cast("string")),
            header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
            F.when(
                F.col("repeat"),
                F.concat(
                    header("WARC-Profile", F.lit(PROFILE)), header("WARC-Refers-To", uuid(other)),
                    header("WARC-Refers-To-Page-ID", F.col("first_id").cast("string")),
                ),
            ).otherwise(""),
            header("Content-Type", F.lit("application/http;msgtype=response")),
            header("Content-Length", F.octet_length("block").cast("string")), F.lit(LINE), "block",
        ).alias("value")
    )


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, records_a_file: int = RECORDS_A_FILE) -> None:
    """Write ``pages`` (``page_id, url, html``) as plain WARC files below ``folder``.

    The payload is the html in UTF-8, empty if NULL. Of records with equal payloads of at least
    ``least_bytes`` bytes, that with the smallest ``page_id`` is a response and the others revisit it; with
    a NULL id a page revisits, too, if another has one. Rows that repeat the smallest id and its payload are
    responses like it. A NULL url or id has no header. An empty table gives no record. Line ends in an
    address are percent-encoded.
    """
    records(pages, least_bytes).write.option("lineSep", BLANK).option("maxRecordsPerFile", records_a_file).text(folder)


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    """``file, block, at, value``: the text after each magic (the first piece of a file is before it), in the
    order of ``block`` and ``at`` within a file."""
    read = spark.read.option("lineSep", MAGIC).text(folder)
    return read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
    )


def with_offsets(rows: DataFrame) -> DataFrame:
    """``rows`` with ``start``: the offset of the magic before a piece, negative for the piece before the first."""
    size = F.col("bytes") + len(MAGIC)
    return running_offsets(rows, ["file"], ["block", "at"], size, "start").withColumn("start", F.col("start") - len(MAGIC))


def field(headers: Column, name: str) -> Column:
    found = F.regexp_extract(headers, rf"(?m)^{name}: ([^\r\n]*)\r?$", 1)
    return F.when(found != "", found)


def parsed(rows: DataFrame, value: str = "value") -> DataFrame:
    """``rows`` with the fields of a record, ``declared`` bytes after its magic, and its payload's digest;
    NULL fields where the text is no record. The text itself is dropped."""
    text = F.col(value)
    found = rows.withColumn("stop", F.locate(BLANK, text))
    found = found.withColumn("headers", F.when(F.col("stop") > 0, F.substring(text, F.lit(1), F.col("stop") + 1)))
    found = found.withColumn("inner", F.when(F.col("stop") > 0, F.position(F.lit(BLANK), text, F.col("stop") + 4)))
    headers = F.col("headers")
    length = F.try_to_number(field(headers, "Content-Length"), F.lit("9" * 18)).cast("bigint")
    # The payload lies between the blank line after the HTTP headers and the one that ends the record.
    payload = F.substring(text, F.col("inner") + 4, F.length(text) - F.col("inner") - 7)
    http = F.substring(text, F.col("stop") + 4, F.col("inner") - F.col("stop") - 3)
    full = F.try_to_number(field(http, "Content-Length"), F.lit("9" * 18)).cast("bigint")
    kind = field(headers, "WARC-Type")
    return found.select(
        *[c for c in rows.columns if c != value],
        (F.octet_length(headers) + 2 + length + 4).alias("declared"),
        kind.alias("record_type"),
        field(headers, "WARC-Target-URI").alias("url"),
        field(headers, "WARC-Page-ID").cast("bigint").alias("page_id"),
        field(headers, "WARC-Refers-To-Page-ID").cast("bigint").alias("refers_to"),
        F.when(kind == "revisit", full).otherwise(F.octet_length(payload)).cast("bigint").alias("payload_bytes"),
        F.when(kind == "revisit", F.regexp_replace(field(headers, "WARC-Payload-Digest"), "^sha256:", ""))
        .otherwise(F.sha2(payload.cast("binary"), 256)).alias("payload_digest"),
    )


def reachable(candidates: DataFrame) -> DataFrame:
    """``file, start`` of the candidates that chains from offset 0 reach.

    ``candidates`` has ``file, start, next``. In round k the reached set grows by everything 2**k records
    further, and each pointer is joined with the pointer it leads to; rows are narrow and keyed by offset. Stored
    paths and offsets shrink many times, so Spark takes these tables for small; the hints keep it from sending them
    to every executor.
    """
    jump = stored(
        candidates.join(
            candidates.select("file", F.col("start").alias("next")).hint("merge"), ["file", "next"], "left_semi"
        ).select("file", "start", "next"),
        "jumps",
    )
    reached = candidates.filter("start = 0").select("file", "start")
    while not jump.isEmpty():
        further = reached.join(jump.hint("merge"), ["file", "start"]).select("file", F.col("next").alias("start"))
        reached = stored(reached.unionByName(further).distinct(), "reached")
        beyond = jump.toDF("file", "next", "beyond")
        jump = stored(
            jump.join(beyond.hint("merge"), ["file", "next"]).select("file", "start", F.col("beyond").alias("next")), "jumps"
        )
    return reached


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``file, start, page_id, url, record_type, refers_to, payload_bytes, payload_digest`` of every record."""
    cut = pieces(spark, folder).withColumn("bytes", F.octet_length("value").cast("bigint"))
    cuts = stored(with_offsets(parsed(cut)).filter("start >= 0"), "candidates")
    candidates = cuts.filter("declared is not null").select(
        "file", "start", (F.col("start") + F.col("declared") + len(MAGIC)).alias("next")
    )
    found = cuts.join(reachable(candidates).hint("merge"), ["file", "start"], "left_semi")
    whole = F.col("declared") == F.col("bytes")
    fields = ["file", "start", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    broken = stored(found.filter(~whole).select("file", "start"), "broken-records")
    if broken.isEmpty():
        return found.select(*fields)
    return found.filter(whole).select(*fields).unionByName(joined_records(spark, folder, broken).select(*fields))


def joined_records(spark: SparkSession, folder: str, broken: DataFrame) -> DataFrame:
    """The records at the offsets ``broken``, whose payloads hold the magic, from all their pieces.

    Only files with such records are read again, and their pieces written once, so that offsets and texts
    belong together."""
    files = broken.select("file").distinct()
    again = stored(
        pieces(spark, folder).join(files, "file", "left_semi").withColumn("bytes", F.octet_length("value").cast("bigint")),
        "pieces",
    )
    placed = with_offsets(again.select("file", "block", "at", "bytes"))
    marked = placed.join(broken.withColumn("head", F.col("start")).hint("merge"), ["file", "start"], "left")
    # A file is bounded by its number of records, and these rows are narrow.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    owned = marked.withColumn("head", F.last("head", ignorenulls=True).over(before)).filter("head is not null")
    texts = again.select("file", "block", "at", "value").join(owned.hint("merge"), ["file", "block", "at"])
    head = texts.filter("start = head").withColumn("value", F.col("value"))
    length = parsed(head).select("file", "head", "declared")
    own = texts.join(length, ["file", "head"]).filter(F.col("start") - F.col("head") < F.col("declared"))
    text = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]), MAGIC
    )
    record = own.groupBy("file", F.col("head").alias("start")).agg(text.alias("value"))
    return parsed(record)


def archived(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write ``pages`` into archives of this run, read them back, and return a row for each record:
    ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    spark = pages.sparkSession
    folder = run_folder(spark, "warc")
    write_archives(pages, folder, least_bytes)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
