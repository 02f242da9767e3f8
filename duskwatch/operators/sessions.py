"""Inactivity sessions per pair of addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.operators.running import running_sums


# Of a row with its addresses and ``session_seq``.
SESSION_ID = "concat(coalesce(source_ip, '?'), '>', coalesce(destination_ip, '?'), '#', session_seq)"


def sessionize(events: DataFrame, time_us: Column | None = None, timeout_seconds: int = 120) -> DataFrame:
    """Add ``session_seq`` and a printable ``session_id`` to every event; without a time both are null.

    Within a pair, in order of time, a session starts at the first event, when the transport changes, and after more
    than ``timeout_seconds`` of silence. ``session_seq`` counts the sessions of the pair from 1.
    """
    timeout = timeout_seconds * 1_000_000
    span = 10 * timeout
    moment = F.unix_micros("event_time") if time_us is None else time_us
    placed = events.withColumn("_t", moment).withColumn("_span", F.floor(F.col("_t") / span))
    # The last event of the span before is the only one outside a span that can continue a session into it.
    last = (
        placed.filter("_t is not null")
        .groupBy("source_ip", "destination_ip", "_span")
        .agg(F.max(F.struct("_t", "network_transport")).alias("_last"))
        .select("source_ip", "destination_ip", (F.col("_span") + 1).alias("_span"), "_last.*", F.lit(False).alias("_mine"))
    )
    in_span = Window.partitionBy("source_ip", "destination_ip", "_span").orderBy("_t", "network_transport")
    before = F.lag("_t").over(in_span)
    same_proto = F.col("network_transport").eqNullSafe(F.lag("network_transport").over(in_span))
    starts = before.isNull() | ~same_proto | (F.col("_t") - before > timeout)
    flagged = (
        placed.withColumn("_mine", F.lit(True))
        .unionByName(last, allowMissingColumns=True)
        .withColumn("session_seq", F.when(F.col("_t").isNull(), 0).otherwise(starts.cast("int")).cast("bigint"))
        .filter("_mine")
    )
    counted = running_sums(flagged, ["source_ip", "destination_ip"], "_span", ["_t", "network_transport"], {"session_seq": "session_seq"})
    counted = counted.withColumn("session_seq", F.when(F.col("_t").isNotNull(), F.col("session_seq")))
    return counted.selectExpr(*[f"`{c}`" for c in events.columns], "session_seq", f"{SESSION_ID} as session_id")


def session_stats(events: DataFrame) -> DataFrame:
    """Start, end and number of events of every session."""
    return events.groupBy("session_id", "source_ip", "destination_ip", "session_seq").agg(
        F.min("event_time").alias("session_start"),
        F.max("event_time").alias("session_end"),
        F.count(F.lit(1)).alias("n_events"),
    )
