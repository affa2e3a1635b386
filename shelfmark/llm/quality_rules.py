"""Quality rules on documents with the frequency of their lines across documents.

Lines are normalised (lower case, single spaces) and hashed together with their host. For each host the
different documents that hold a line are counted, and the different documents of the host; copies of one text count
once in both. A line in more than a share of these, and in more than a few, is boilerplate and removed; a document
that keeps too little is rejected, as is one that fails the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import SPACES, WORD, fresh, text_key, text_of
from shelfmark.session import stored

SYMBOLS = "[#*$%&|<>]"
GRAM = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
#: A line of a host is frequent in more than this share of its different texts, and in more than so many.
LIMIT_SHARE = 0.05
LEAST_DOCS = 5
LEAST_LEFT = 0.3


def line_key(host: Column, line: Column) -> Column:
    """Hash of a normalised line of a host."""
    plain = F.trim(F.regexp_replace(F.lower(line), SPACES, " "))
    return F.xxhash64(F.coalesce(host.cast("string"), F.lit("")), plain)


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """``row, doc_id, tkey, host_key``, the base measures, and ``lines``: key, words and count of each line.

    A text is read once. Repeated windows are found by sorting 64-bit codes of the windows, and only in
    texts whose codes are not all different.
    """
    def has_word(line: Column) -> Column:
        return line.rlike(WORD)

    def line_words(line: Column) -> Column:
        return F.regexp_count(line, F.lit(WORD))

    texts = docs.select("doc_id", F.col(host).cast("string").alias("host"), text_of().alias("text"))
    split = texts.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "host",
        F.xxhash64("text").alias("tkey"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split("text", "\n"), has_word).alias("worded"),
    )
    starts = F.when(F.size("words") >= GRAM, F.sequence(F.lit(0), F.size("words") - GRAM)).otherwise(
        F.array().cast("array<int>")
    )
    coded = split.select(
        "row", "doc_id", "host", "tkey", "n_symbols",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("bigint").alias("n_dup_lines"),
        F.transform(
            "worded",
            lambda line: F.struct(line_key(F.col("host"), line).alias("key"), line_words(line).alias("n")),
        ).alias("lines"),
        F.transform(starts, lambda i: F.xxhash64(*[F.col("words")[i + k] for k in range(GRAM)])).alias("grams"),
    )
    pairs = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    marked = coded.withColumn("repeats", F.size(F.array_distinct("grams")) < F.size("grams")).withColumn(
        "sorted", F.when(F.col("repeats"), pairs)
    )

    def again(x: Column, k: Column) -> Column:
        near = lambda j: F.get(F.col("sorted"), j)["g"].eqNullSafe(x["g"])
        return near(k - 1) | near(k + 1)

    def cover(seen: Column, start: Column) -> Column:
        fresh_words = F.lit(GRAM) - F.greatest(seen["end"] - start, F.lit(0))
        return F.struct((start + GRAM).alias("end"), (seen["n"] + fresh_words).alias("n"))

    found = marked.withColumn("at", F.sort_array(F.transform(F.filter("sorted", again), lambda x: x["i"])))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.when(F.col("repeats"), F.aggregate("at", none, cover, lambda seen: seen["n"])).otherwise(0)
    return stored(
        found.select(
            "row", "doc_id", "tkey", F.xxhash64(F.coalesce("host", F.lit(""))).alias("host_key"),
            "n_words", "word_chars", "n_symbols", "n_dup_lines",
            covered.cast("bigint").alias("n_repeat_words"), "lines",
        ),
        "measures",
    )


def frequent_lines(
    measures: DataFrame, limit_share: float = LIMIT_SHARE, least_docs: int = LEAST_DOCS
) -> DataFrame:
    """``key, docs``: lines in more than ``limit_share`` of the different texts of a host, and in more than
    ``least_docs`` of them. All lines of all texts are counted; each step combines in the map tasks, so a line of
    every document sends a row a task."""
    texts = measures.select("host_key", "tkey").distinct()
    hosts = texts.groupBy(F.col("host_key").alias("of_host")).agg(F.count("*").alias("host_docs"))
    lines = measures.select("host_key", "tkey", F.explode("lines.key").alias("key")).distinct()
    counts = lines.groupBy("key").agg(F.count("*").alias("docs"), F.first("host_key").alias("of_host"))
    often = counts.filter(F.col("docs") > least_docs).join(hosts, "of_host")
    return stored(
        often.filter(F.col("docs") > limit_share * F.col("host_docs")).select("key", "docs"), "frequent-lines"
    )


def verdicts(
    docs: DataFrame, host: str = "source", limit_share: float = LIMIT_SHARE, least_docs: int = LEAST_DOCS,
    least_left: float = LEAST_LEFT,
) -> DataFrame:
    """Base measures and verdict for every row of ``docs``.

    ``base_failed``: fewer than 10 words, or over 20 % of the words in repeated five-word windows. A document
    is depleted if, without the lines above the limit, less than ``least_left`` of its words are left. ``kept`` is false in both cases. ``n_frequent_lines`` and ``words_left`` tell the effect
    of the lines. A NULL text has no words; a NULL host is a host of its own, the empty name. Rows that
    repeat id and text get a row each; copies of a text count once in line frequencies. An empty table gives
    no rows; other columns are not read.
    """
    measures = measured(docs, host)
    frequent = frequent_lines(measures, limit_share, least_docs)
    removed = (
        measures.select("row", F.explode("lines").alias("line"))
        .select("row", "line.key", "line.n")
        .join(frequent.select("key"), "key")
        .groupBy("row")
        .agg(F.count("*").alias("n_frequent_lines"), F.sum("n").alias("gone"))
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    depleted = F.col("words_left") < least_left * F.col("n_words")
    return (
        measures.drop("lines")
        .join(removed, "row", "left")
        .withColumn("words_left", left.cast("bigint"))
        .withColumn("base_failed", failed)
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            (~F.col("base_failed") & ~depleted).alias("kept"),
            F.coalesce("n_frequent_lines", F.lit(0)).cast("bigint").alias("n_frequent_lines"), "words_left", "tkey",
        )
    )


def without_frequent_lines(
    docs: DataFrame, host: str = "source", limit_share: float = LIMIT_SHARE, least_docs: int = LEAST_DOCS
) -> DataFrame:
    """``docs`` with the lines above the limit taken out of ``text``, all columns and rows kept.

    A NULL host is the host of the empty name, a NULL text stays NULL. Rows that repeat id and text lose the same
    lines each; an empty table gives no rows; columns of any other name pass through.
    """
    measures = measured(docs, host)
    frequent = frequent_lines(measures, limit_share, least_docs)
    of_id, of_key, gone, key = fresh(docs, "of_id", "of_key", "gone", "tkey")
    removed = (
        measures.select("doc_id", "tkey", F.explode("lines.key").alias("key"))
        .join(frequent.select("key"), "key")
        .groupBy(F.col("doc_id").alias(of_id), F.col("tkey").alias(of_key))
        .agg(F.collect_set("key").alias(gone))
    )
    rows = docs.withColumn(key, text_key())
    joined = rows.join(removed, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(key) == F.col(of_key)), "left")
    left = F.filter(
        F.split(text_of(), "\n"), lambda line: ~F.array_contains(gone, line_key(F.col(host), line))
    )
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])
