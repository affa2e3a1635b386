"""Sharding by a Feistel permutation over global row numbers.

Rows get gapless numbers in the order of their id and content. A keyed Feistel network over Z_a x Z_b with
a * b >= n permutes them; a value outside [0, n) is sent through again until it lies inside (cycle walking),
which keeps it a permutation of [0, n). Permuted number ``y`` goes to shard ``y mod shards`` at slot
``y div shards``. Anyone who knows n, the number of shards and the key can compute the place of a row.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import text_of
from shelfmark.operators.spread import running_offsets

SHARDS = 16
KEY = 20240607
ROUNDS = 4
MOST_STEPS = 64


def domain(n: int) -> tuple[int, int]:
    """Sides a and b of the smallest nearly square domain that holds n numbers."""
    a = isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def permuted_once(x: Column, n: int, key: int) -> Column:
    """One pass through the network: a permutation of [0, a * b)."""
    a, b = domain(n)

    def double_round(half: Column, k: Column) -> Column:
        left = F.pmod(half["l"] + F.pmod(F.xxhash64(half["r"], k), F.lit(a)), F.lit(a))
        right = F.pmod(half["r"] + F.pmod(F.xxhash64(left, -k), F.lit(b)), F.lit(b))
        return F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    keys = F.array(*[F.lit(key * 1000 + i + 1).cast("bigint") for i in range(ROUNDS)])
    start = F.struct(F.floor(x / F.lit(b)).cast("bigint").alias("l"), F.pmod(x, F.lit(b)).cast("bigint").alias("r"))
    return F.aggregate(keys, start, double_round, lambda h: h["l"] * F.lit(b) + h["r"])


def permuted(x: Column, n: int, key: int = KEY) -> Column:
    """The place of row number ``x`` in a keyed permutation of [0, n).

    At most a * b - n < a values lie outside, so a walk takes at most that many steps and one; beyond
    ``MOST_STEPS`` steps (chance below n ** -32) the job fails instead of giving a wrong place.
    """
    a, b = domain(n)
    steps = min(a * b - n + 1, MOST_STEPS)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), x,
        lambda y, i: F.when((i > 1) & (y < n), y).otherwise(permuted_once(y, n, key)),
    )
    stop = F.raise_error(F.lit("cycle walk did not end")).cast("bigint")
    return F.transform(F.array(walked), lambda y: F.when(y < n, y).otherwise(stop))[0]


def shards_of(docs: DataFrame, shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    The law is ``rows``: shards hold equal numbers of rows, at most one apart, and slots run from 0 without
    gaps; ``grown_shard`` is therefore NULL. ``size`` is the UTF-8 bytes of the text plus 1, so a NULL text
    has size 1. NULL ids come first in the numbering. Rows that repeat id and text are interchangeable
    neighbours with places of their own. Equal texts are not kept together. An empty table gives no rows;
    with fewer rows than shards some shards stay empty. Other columns are not read.
    """
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text_of()) + 1).cast("bigint").alias("size"),
        F.crc32(text_of()).alias("text_crc32"),
        F.xxhash64(text_of()).alias("content"),
    )
    numbered = running_offsets(narrow, [], ["doc_id", "content", "size"], out="number")
    n = numbered.count()
    place = numbered.withColumn("place", permuted(F.col("number"), n, key))
    return place.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
