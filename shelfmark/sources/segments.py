"""Copies of long segments kept by earlier runs, so that repeats are known across runs.

A run adds one folder ``run=N`` of ``hash, copies`` and overwrites it when it is done again. Counts add up when they
are read; ``fold_segments`` writes them as one folder to a new path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.extraction import MIN_SEGMENT, PARAGRAPH, segment_copies
from shelfmark.sources.changes import read_or_none

COPIES = "hash binary, copies bigint"


def add_segments(
    kept: DataFrame, path: str, run: int, text: str = "content", min_len: int = MIN_SEGMENT, separator: str = PARAGRAPH
) -> None:
    """Write the segments of the rows that a run kept, one narrow row for each different one."""
    copies = segment_copies(kept, text, min_len, separator)
    copies.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run}")


def seen_segments(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """``hash, copies`` over all runs, or those with a smaller number than ``before``: pass it when a run is done
    again, so that it does not meet its own segments. No rows before the first run."""
    rows = read_or_none(spark, path, f"{COPIES}, run bigint")
    if rows is None:
        return spark.createDataFrame([], COPIES)
    if before is not None:
        rows = rows.filter(F.col("run") < before)
    return rows.groupBy("hash").agg(F.sum("copies").alias("copies"))


def fold_segments(spark: SparkSession, path: str, out: str) -> None:
    """The counts of all runs as the one run 0 of a new ``out``, which the next run reads in place of ``path``."""
    seen_segments(spark, path).write.mode("errorifexists").parquet(f"{out.rstrip('/')}/run=0")
