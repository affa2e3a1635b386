"""Outcome of fetches from a log of attempts: ``url, attempt, status_code, timed_out, error``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.model import FAILED, SUCCESS

# The codes worth another attempt, and the attempts made in all.
RETRYABLE = (429, 500, 502, 503, 504)
MAX_ATTEMPTS = 3
RETRY = "retry"


def outcome(status_code: Column, timed_out: Column) -> Column:
    """``retry``, ``failed`` or ``success``; connection errors have no code and are final."""
    return (
        F.when(timed_out | status_code.isin(*RETRYABLE), RETRY)
        .when(status_code.between(200, 299), SUCCESS)
        .otherwise(FAILED)
    )


def attempt_error(status_code: Column, timed_out: Column, error: Column) -> Column:
    wording = F.when(timed_out, F.lit("timed out")).when(
        status_code.isin(*RETRYABLE), F.concat(F.lit("Retryable status "), status_code.cast("string"))
    )
    wording = wording.otherwise(F.concat(F.lit("Status "), status_code.cast("string")))
    return F.coalesce(error, wording, F.lit("Unknown error"))


def classify_attempt(attempts: DataFrame) -> DataFrame:
    result = outcome(F.col("status_code"), F.col("timed_out"))
    error = attempt_error(F.col("status_code"), F.col("timed_out"), F.col("error"))
    return attempts.withColumn("outcome", result).withColumn("error", F.when(result != SUCCESS, error))


def _first_final(attempts: DataFrame, max_attempts: int) -> DataFrame:
    """Per URL the first attempt that was not to be retried, and the last that was."""
    final = F.when(F.col("outcome") != RETRY, F.col("attempt"))
    return (
        classify_attempt(attempts)
        .filter(F.col("attempt") <= max_attempts)
        .groupBy("url")
        .agg(
            F.min(final).alias("final"),
            F.max("attempt").alias("last"),
            F.min_by(F.when(final.isNotNull(), F.struct("outcome", "error")), final).alias("ended"),
            F.max_by("error", "attempt").alias("last_error"),
        )
    )


def resolve_fetch(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """``url, status, attempts, error``: the first final attempt decides, else the URL failed
    with the error of its last attempt."""
    return _first_final(attempts, max_attempts).select(
        "url",
        F.coalesce("ended.outcome", F.lit(FAILED)).alias("status"),
        F.coalesce("final", "last").cast("bigint").alias("attempts"),
        F.coalesce(
            F.when(F.col("final").isNull(), F.col("last_error")).otherwise(F.col("ended.error")), F.lit("")
        ).alias("error"),
    )


def backoff_seconds(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Seconds waited per URL: 2 to the power of the attempt, after every retried attempt
    but the last."""
    waits = (
        F.when(F.col("final").isNull(), F.least(F.col("last"), F.lit(max_attempts - 1)))
        .otherwise(F.col("final") - 1)
        .cast("int")
    )
    # 2 + 4 + ... + 2^n
    return _first_final(attempts, max_attempts).select(
        "url", (F.pow(F.lit(2), waits + 1) - 2).cast("bigint").alias("backoff_seconds")
    )
