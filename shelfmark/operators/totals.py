"""Totals over many runs from small states that are kept per run and merged, so that no run is read again.

A state has exact counts and three sketches of bounded size: different addresses (HyperLogLog), lengths of texts
(KLL quantiles) and frequent errors. Sketches are built in the map tasks and merged after the shuffle, so a site
with a third of all rows sends one state per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.model import FAILED, SUCCESS
from shelfmark.sources.changes import read_or_none

# Errors whose counts are exact as long as there are no more different ones, and the size of the other sketches:
# about 1.6 % for different addresses, 1.3 % of rank for quantiles.
MOST_ERRORS = 1024
HLL_BITS = 12
KLL_SIZE = 200
QUANTILES = (0.5, 0.9, 0.99)
COUNTS = ("total", "succeeded", "failed")


def run_state(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row for the page rows of a run, or for each group of ``by``: counts, ``urls``, ``lengths``, ``errors``.

    NULL addresses, texts and errors count as rows and are in no sketch. An empty table without ``by`` gives one
    row of zeros.
    """
    good, bad = F.col("status") == SUCCESS, F.col("status") == FAILED
    rows = results.select(
        *(by or []), "url", "status", F.when(good, F.length("content").cast("bigint")).alias("_length"),
        F.when(bad, F.col("error")).alias("_error"),
    )
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), F.count_if(good).alias("succeeded"), F.count_if(bad).alias("failed"),
        F.hll_sketch_agg("url", HLL_BITS).alias("urls"),
        F.kll_sketch_agg_bigint("_length", KLL_SIZE).alias("lengths"),
        F.expr(f"approx_top_k_accumulate(_error, {MOST_ERRORS}) FILTER (WHERE _error IS NOT NULL)").alias("errors"),
    )


def merged_states(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """States of runs, or of groups finer than ``by``, as states again."""
    return states.groupBy(*(by or [])).agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        F.hll_union_agg("urls").alias("urls"),
        F.kll_merge_agg_bigint("lengths", KLL_SIZE).alias("lengths"),
        F.expr(f"approx_top_k_combine(errors, {MOST_ERRORS})").alias("errors"),
    )


def figures(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What states tell: the counts, ``n_urls``, and a quantile ``length_50``, ... of each share in ``QUANTILES``."""
    quantiles = [
        F.when(F.kll_sketch_get_n_bigint("lengths") > 0, F.kll_sketch_get_quantile_bigint("lengths", F.lit(q))).alias(f"length_{round(q * 100)}")
        for q in QUANTILES
    ]
    return states.select(*(by or []), *COUNTS, F.hll_sketch_estimate("urls").alias("n_urls"), *quantiles)


def frequent_errors(states: DataFrame, n: int = 10, by: list[str] | None = None) -> DataFrame:
    """The ``n`` most frequent errors with their failures: ``error, copies``."""
    top = F.expr(f"approx_top_k_estimate(errors, {n})")
    return states.select(*(by or []), F.inline(top)).withColumnRenamed("item", "error").withColumnRenamed("count", "copies")


def write_state(state: DataFrame, path: str, run: int) -> None:
    """Keep the state of a run; a run that is done again replaces its own."""
    state.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run}")


def read_states(spark: SparkSession, path: str, by: list[str] | None = None, before: int | None = None) -> DataFrame:
    """The merged states of all runs below ``path`` or those with a smaller number than ``before``; the state of no
    rows before the first. The columns ``by`` are texts."""
    none = spark.createDataFrame(
        [], ", ".join([*[f"{c} string" for c in by or []], "url string, status string, content string, error string"])
    )
    empty = run_state(none, by)
    rows = read_or_none(spark, path, T.StructType([*empty.schema.fields, T.StructField("run", T.LongType())]))
    if rows is None:
        return empty
    rows = rows if before is None else rows.filter(F.col("run") < before)
    return merged_states(rows.drop("run").unionByName(empty), by)
