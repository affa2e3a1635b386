"""Exact de-duplication by deterministic block naming.

Texts are cut into blocks of a fixed number of characters. Equal blocks get one integer name, in sorted
order. Adjacent names are paired and the pairs named again in the same way, which halves the number of names,
until each document has a single one. Texts are equal exactly when level and name are equal.

The first names come from 64-bit codes of the blocks. Before they are used, the job counts the different
contents of every code over the whole input; if any code has two, all blocks are coded again with the next
seed. So a name never stands for two contents, and blocks move only once, one copy of each from a task.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import SPACES, rows_by_key, text_of
from shelfmark.session import stored

BLOCK_CHARS = 1024


def normalised(column: str = "text") -> Column:
    """Every run of white space as one space; NULL counts as empty."""
    return F.regexp_replace(text_of(column), SPACES, " ")


def block_code(block: Column, seed: int) -> Column:
    return F.xxhash64(block, F.lit(seed))


def blocks_of(text: Column, block_chars: int) -> Column:
    """The text in blocks, the last one shorter; the empty text is one empty block."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(cut)


def coded(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``row, doc_id, text_sha256, codes``: the codes of each row's blocks, without collision."""
    texts = docs.select("doc_id", normalised().alias("norm"))
    blocks = texts.select(F.explode(blocks_of(F.col("norm"), block_chars)).alias("block"))
    for seed in count():
        contents = blocks.groupBy(block_code(F.col("block"), seed).alias("code")).agg(
            F.count_distinct("block").alias("contents")
        )
        if contents.filter("contents > 1").isEmpty():
            break
    codes = F.transform(blocks_of(F.col("norm"), block_chars), lambda b: block_code(b, seed))
    return stored(
        texts.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("norm", 256).alias("text_sha256"),
            codes.alias("codes"),
        ),
        "block-codes",
    )


def named(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the column ``name``: one integer for each different ``by``, in sorted order."""
    names = rows.select(*by).distinct().orderBy(*by).withColumn("name", F.monotonically_increasing_id())
    return rows.join(names, by).drop(*by)


def identities(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``row, doc_id, text_sha256, level, name``: equal level and name mean equal normalised texts."""
    rows = coded(docs, block_chars)
    most = rows.agg(F.max(F.size("codes"))).first()[0] or 1
    blocks = rows.select("row", F.size("codes").cast("bigint").alias("size"), F.posexplode("codes").alias("pos", "code"))
    current = stored(named(blocks.withColumn("pos", F.col("pos").cast("bigint")), ["code"]), "block-names")
    single = [current.filter("size = 1").select("row", F.lit(0).alias("level"), "name")]
    for level in range(1, (most - 1).bit_length() + 1):
        even = F.col("pos") % 2 == 0
        pairs = (
            current.filter("size > 1")
            .groupBy("row", ((F.col("size") + 1) / 2).cast("bigint").alias("size"), F.floor(F.col("pos") / 2).alias("pos"))
            .agg(
                F.max(F.when(even, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
            )
        )
        current = stored(named(pairs, ["left", "right"]), "block-names")
        single.append(current.filter("size = 1").select("row", F.lit(level).alias("level"), "name"))
    names = single[0]
    for more in single[1:]:
        names = names.unionByName(more)
    return rows.select("row", "doc_id", "text_sha256").join(names, "row")


def exact_groups(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Of rows with equal normalised texts the one with the smallest ``doc_id`` stays. NULL texts count as
    empty. A NULL id counts as larger than any other; of rows that repeat an id, one stays, so each group
    keeps exactly one row. An empty table gives no rows; other columns are not read.
    """
    rows = stored(identities(docs, block_chars), "identities")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    # Stored, so that the join deals out a large group anew instead of reading the partitions of the groups.
    groups = stored(
        rows.groupBy("level", "name").agg(F.min(order).alias("first"), F.count("*").alias("group_size")), "groups"
    )
    return rows.join(groups, ["level", "name"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256",
    )


def drop_copies(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat id and text, the first
    by the other columns."""
    chosen = exact_groups(docs, block_chars).filter("kept").select("doc_id", F.col("text_sha256").alias("key"))
    return rows_by_key(docs, chosen, F.sha2(normalised(), 256))
