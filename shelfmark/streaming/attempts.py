"""Verdicts on addresses while their fetch attempts still come in.

The state of an address is its attempts so far, at most as many as there may be. A verdict is written once, when
the attempts up to a final one or to the last allowed one are there, in whatever order they came, or when the event
time has passed the expiry of an address whose attempts stopped. It then says what ``resolve_fetch`` says of the
attempts seen. After the verdict the state is kept until the expiry, so that late attempts start nothing anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfmark.model import FAILED
from shelfmark.operators.fetchlog import MAX_ATTEMPTS, RETRY, classify_attempt

VERDICTS = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("attempts", T.LongType()), T.StructField("error", T.StringType()),
])
STATE = T.StructType([
    T.StructField("seen", T.ArrayType(T.LongType())), T.StructField("outcomes", T.ArrayType(T.StringType())),
    T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("done", T.BooleanType()),
])


def verdict(attempts: dict[int, tuple[str, str]], max_attempts: int, expired: bool) -> tuple[str, int, str] | None:
    """Status, attempt and error, or None while attempts that may decide are missing."""
    for number in sorted(attempts):
        outcome, error = attempts[number]
        if not expired and any(k not in attempts for k in range(1, number)):
            return None
        if outcome != RETRY:
            return outcome, number, error
    if attempts and (expired or all(k in attempts for k in range(1, max_attempts + 1))):
        last = max(attempts)
        return FAILED, last, attempts[last][1]
    return None


def resolve_stream(
    attempts: DataFrame, delay: str = "1 hour", expire_ms: int = 3_600_000, max_attempts: int = MAX_ATTEMPTS,
    event_time: str = "at",
) -> DataFrame:
    """``url, status, attempts, error`` of a stream of ``url, attempt, status_code, timed_out, error`` and an event
    time. Rows later than ``delay`` are dropped by the watermark; an address expires ``expire_ms`` after its
    newest attempt. Repeated attempts count once, the first that came; rows without address or number are left out."""

    def update(
        key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        seen, outcomes, errors, done = state.get if state.exists else ([], [], [], False)
        known = {n: (o, e) for n, o, e in zip(seen, outcomes, errors, strict=True)}
        expired, newest = state.hasTimedOut, 0
        for batch in batches:
            for number, outcome, error, at in zip(batch["attempt"], batch["outcome"], batch["error"], batch["_at"], strict=True):
                known.setdefault(int(number), (outcome, error or ""))
                newest = max(newest, int(at))
        found = None if done else verdict(known, max_attempts, expired)
        if expired:
            state.remove()
        else:
            numbers = [] if found or done else sorted(known)
            state.update((numbers, [known[n][0] for n in numbers], [known[n][1] for n in numbers], done or found is not None))
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + expire_ms)
        if found:
            yield pd.DataFrame([(key[0], *found)], columns=VERDICTS.names)

    told = classify_attempt(attempts.withWatermark(event_time, delay)).filter(
        F.col("attempt").between(1, max_attempts) & F.col("url").isNotNull()
    )
    rows = told.select("url", F.col("attempt").cast("bigint").alias("attempt"), "outcome", "error", event_time, F.unix_millis(event_time).alias("_at"))
    return rows.groupBy("url").applyInPandasWithState(update, VERDICTS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_verdicts(
    attempts: DataFrame, out: str, checkpoint: str, delay: str = "1 hour", expire_ms: int = 3_600_000,
    max_attempts: int = MAX_ATTEMPTS, event_time: str = "at",
) -> None:
    """Append the verdicts of what is new to ``out``."""
    rows = resolve_stream(attempts, delay, expire_ms, max_attempts, event_time)
    writer = rows.writeStream.format("parquet").option("path", out).outputMode("append")
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
