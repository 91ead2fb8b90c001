"""Streaming daily counts, distinct and new customers that appear once their day is closed."""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DAY = "created"


def closed_day_counts(
    stream: DataFrame, timestamp: str, keys: Sequence[str] = (), *, lateness: str = "1 hour"
) -> DataFrame:
    """(keys, created, orders) per day in append mode: a day is emitted when the watermark has
    passed its end, so the open last day never appears. State is one counter per open day.
    Day windows start at midnight UTC, so the session has to run in UTC.
    """
    counted = (
        _timed(stream, timestamp, lateness)
        .groupBy(F.window("_ts", "1 day"), *keys)
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    return counted.select(*keys, F.to_date("window.start").alias(DAY), "orders")


def write_closed_days(
    counts: DataFrame, path: str, checkpoint: str, *, available_now: bool = True
) -> StreamingQuery:
    """Start the query into a Parquet folder; ``available_now`` drains the input and stops."""
    writer = (
        counts.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _timed(stream: DataFrame, timestamp: str, lateness: str) -> DataFrame:
    zone = stream.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone.upper() not in ("UTC", "ETC/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"closed days need a session in UTC, not {zone}")
    return stream.withColumn("_ts", F.col(timestamp).cast("timestamp")).withWatermark("_ts", lateness)


def closed_day_customers(
    stream: DataFrame,
    timestamp: str,
    customer: str,
    keys: Sequence[str] = (),
    *,
    lateness: str = "1 hour",
) -> DataFrame:
    """(keys, created, unique_customers) per day in append mode, days appearing once closed.

    Two stateful operators in a row: the first one lets a customer pass once a day, with one entry of
    state per customer of an open day, the second one counts. Both forget a day when the watermark
    passes its end. A customer is spread by (keys, day, customer), so no day meets in one task before
    it is counted. NULL customers are nobody, but their days appear.
    """
    daily = _timed(stream, timestamp, lateness).withColumn("_day", F.window("_ts", "1 day"))
    once = daily.select(*keys, "_day", customer).dropDuplicates([*keys, "_day", customer])
    counted = once.groupBy("_day", *keys).agg(F.count(customer).alias("unique_customers"))
    return counted.select(*keys, F.to_date("_day.start").alias(DAY), "unique_customers")


def first_seen_customers(
    stream: DataFrame,
    timestamp: str,
    customer: str,
    *,
    lateness: str = "1 hour",
    remember_days: int = 3650,
) -> DataFrame:
    """(customer, created): every new customer once, with the first day of it, after that day closed.

    State per customer outlives the watermark: the first day seen and whether it was reported. It is
    forgotten when the watermark is ``remember_days`` days beyond the first day; a customer that
    returns later is new again. Rows earlier than a reported first day do not change it: they are
    older than the watermark, which drops them. NULL customers are nobody. Daily counts are those of
    the written rows by ``created``, which stay few.
    """
    timed = _timed(stream, timestamp, lateness).filter(F.col(customer).isNotNull())
    kind = stream.schema[customer].dataType.simpleString()
    day_ms = 24 * 3600 * 1000

    def update(key, batches: Iterator, state) -> Iterator:
        first, reported = state.get if state.exists else (None, False)
        if not state.hasTimedOut:
            for rows in batches:
                if not reported and len(rows):
                    low = int(rows["_ms"].min() // day_ms)
                    first = low if first is None else min(first, low)
        now = state.getCurrentWatermarkMs()
        if first is not None and not reported and now >= (first + 1) * day_ms:
            yield pd.DataFrame({customer: [key[0]], DAY: [datetime.date(1970, 1, 1) + datetime.timedelta(first)]})
            reported = True
        end = (first + (remember_days if reported else 1)) * day_ms
        if reported and now >= end:
            state.remove()
            return
        state.update((first, reported))
        state.setTimeoutTimestamp(max(end, now + 1))

    return (
        timed.select(customer, F.unix_millis("_ts").alias("_ms"), "_ts")
        .groupBy(customer)
        .applyInPandasWithState(
            update, f"`{customer}` {kind}, {DAY} date", "first int, reported boolean", "append", "EventTimeTimeout"
        )
    )


def late_rows(query: StreamingQuery) -> int:
    """How many rows of a run the stateful operators dropped for being later than the watermark."""
    return sum(
        op.numRowsDroppedByWatermark for progress in query.recentProgress for op in progress.stateOperators
    )
