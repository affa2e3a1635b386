"""Fixed windows of tokens over notebooks and over single documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.tokens import WINDOW, Codec, codec_count, codec_cut, cut, token_count, windows
from shelfmark.operators.spread import running_offsets, spread_lookup
from shelfmark.operators.store import SEPARATOR
from shelfmark.session import durable

SEARCHED_CHUNKS = 100


def chunk_notebook(
    corpus: DataFrame, size: int = WINDOW, load_codec: Callable[[], Codec] | None = None
) -> DataFrame:
    """Windows over all texts of a notebook joined by the separator, so that a window may hold
    the end of one text and the start of the next: ``notebook_id, chunk_no, text, n_tokens``.

    Each text learns how many tokens lie before it, from counts alone; it is then cut in place,
    and only the pieces of one window, at most ``size`` tokens, come together again. No task
    ever holds a notebook. Tokens are words, or those of a model whose codec ``load_codec``
    returns.
    """

    texts = corpus.filter(F.length("text") > 0)
    joined_text = F.concat(F.lit(SEPARATOR), F.col("text"))
    if load_codec:
        alone, together = codec_count(F.col("text"), load_codec), codec_count(joined_text, load_codec)
    else:
        # The separator is one word, and the white space at its end belongs to the next.
        alone, together = token_count(F.col("text")), F.col("alone") + 1
    # Stored first, because the range partitioning of the offsets would count the texts twice.
    counted = texts.withColumn("alone", alone).withColumn("n", together)
    counts = durable(counted.select("notebook_id", "id", "alone", "n"))
    # All but the first text of a notebook have the separator in front; all offsets but the
    # first are too large by what the separator of the first would have added.
    surplus = counts.groupBy("notebook_id").agg(F.min_by(F.col("n") - F.col("alone"), "id").alias("surplus"))
    offsets = spread_lookup(
        running_offsets(counts, ["notebook_id"], ["id"], F.col("n")), surplus, ["notebook_id"], spread_by=["id"]
    )
    first = F.col("offset") == 0
    # Both sides grow with the texts, so neither is broadcast.
    placed = texts.join(offsets.hint("merge"), ["notebook_id", "id"]).select(
        "notebook_id",
        F.when(first, F.col("text")).otherwise(joined_text).alias("text"),
        F.when(first, F.lit(0)).otherwise(F.col("offset") - F.col("surplus")).alias("start"),
        F.when(first, F.col("alone")).otherwise(F.col("n")).alias("n"),
    )
    text, start = F.col("text"), F.col("start")
    cut_text = codec_cut(text, start, load_codec, size) if load_codec else cut(text, start, size)
    pieces = placed.select("notebook_id", "start", "n", cut_text.alias("pieces")).select(
        "notebook_id", "start", "n", F.posexplode("pieces").alias("i", "piece")
    )
    pieces = pieces.withColumn("chunk_no", F.floor(start / size) + F.col("i"))
    begin = F.greatest(start, F.col("chunk_no") * size)
    end = F.least(start + F.col("n"), (F.col("chunk_no") + 1) * size)
    in_order = F.array_sort(F.collect_list(F.struct("start", "piece")))
    return (
        pieces.groupBy("notebook_id", "chunk_no")
        .agg(in_order.alias("parts"), F.sum(end - begin).alias("n_tokens"))
        .select(
            "notebook_id",
            "chunk_no",
            F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("text"),
            "n_tokens",
        )
    )


def chunk_document(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Windows within each document, without a shuffle: the columns of ``docs`` but ``text``,
    and ``chunk_no, text, n_tokens``. A document without tokens has no window."""
    kept = [c for c in docs.columns if c != "text"]
    cut = docs.select(*kept, F.posexplode(windows(F.col("text"), size)).alias("chunk_no", "text"))
    return cut.select(
        *kept, F.col("chunk_no").cast("bigint").alias("chunk_no"), "text", token_count(F.col("text")).alias("n_tokens")
    )


def cap_chunks(chunks: DataFrame, limit: int | None = SEARCHED_CHUNKS) -> DataFrame:
    """The first ``limit`` windows of each notebook; all of them for ``None``."""
    return chunks if limit is None else chunks.filter(F.col("chunk_no") < limit)
