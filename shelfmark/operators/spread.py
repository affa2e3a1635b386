"""Ordered positions and lookups that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import durable

SALTS = 16


def running_offsets(
    df: DataFrame, keys: list[str], order: list[str], value: Column | None = None, out: str = "offset"
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same key, as column ``out``.

    ``order`` must be unique within a key. A window per key would send a key with a third of
    all rows to one task. Here rows are range-partitioned by key and order, so a large key
    lies in many even partitions; the sums of the partitions, one small row each, are added
    up, and the window only runs inside one partition. Pass narrow rows: they are written
    once to the shared folder so that both uses see the same partitions.
    """
    amount = F.lit(1).cast("bigint") if value is None else value.cast("bigint")
    # As one struct, keys that are NULL are equal to each other in groups and joins alike.
    key = F.struct(*keys) if keys else F.lit(0)
    ranged = durable(
        df.withColumn("_key", key)
        .withColumn("_amount", amount)
        .repartitionByRange(*[F.col(c) for c in [*keys, *order]])
        .withColumn("_part", F.spark_partition_id())
    )
    totals = ranged.groupBy("_key", "_part").agg(F.sum("_amount").alias("_total"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_key", "_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    # Join and window share one partitioning, by key and part, which is even for any key.
    inside = Window.partitionBy("_key", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("_before") + F.coalesce(F.sum("_amount").over(inside), F.lit(0))
    return ranged.join(before, ["_key", "_part"]).withColumn(out, offset).select(*df.columns, out)


def positions(df: DataFrame, keys: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """1, 2, 3, ... within each key in the given order."""
    return running_offsets(df, keys, order, out="_offset").withColumn(out, F.col("_offset") + 1).drop("_offset")


def spread_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "left",
    spread_by: list[str] | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join to a table with one or few rows per key, where a key may own any share of ``rows``.

    Each key of ``rows`` is cut into ``salts`` parts by a hash of ``spread_by`` and the lookup
    rows are repeated for each part, so that a large key is joined by many tasks; no later
    grouping by the key relies on the partitions of the join, which leaves adaptive execution
    free to split parts that are still too large. The hash is fixed by the row, so a task that
    is run again gives the same parts.
    """
    by = spread_by or [c for c in rows.columns if c not in on]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
