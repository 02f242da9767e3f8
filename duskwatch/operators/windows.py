"""Tumbling windows: assignment, classification, meta rows, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.operators.rules import control_hits, technique_hits, technique_ids


def window_start(moment: Column, minutes: int = 10) -> Column:
    """Start of the half-open window ``[start, start + minutes)`` that holds a moment; windows divide the hour."""
    width = minutes * 60_000_000
    micros = F.unix_micros(moment)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(width)))


def closing_boundary(moment: Column, minutes: int = 10) -> Column:
    """End of the window to run at a moment: its own minute when that is a boundary, else the next boundary."""
    minute = F.date_trunc("minute", moment)
    start = window_start(minute, minutes)
    return F.when(start == minute, start).otherwise(start + F.make_dt_interval(mins=F.lit(minutes)))


def with_window(df: DataFrame, minutes: int = 10) -> DataFrame:
    start = window_start(F.col("event_time"), minutes)
    return df.withColumns({"window_start": start, "window_end": start + F.make_dt_interval(mins=F.lit(minutes))})


def classify_windows(scored: DataFrame, threshold: Column, column: str = "anom_score", minutes: int = 10) -> DataFrame:
    """One row per window: ANOMALY when any score reaches the threshold, else NORMAL."""
    hit = F.bool_or(F.coalesce(F.col(column) >= threshold, F.lit(False)))
    return (
        with_window(scored, minutes)
        .groupBy("window_start", "window_end")
        .agg(F.when(hit, "ANOMALY").otherwise("NORMAL").alias("classification"))
    )


def window_meta(
    scored: DataFrame,
    threshold: Column,
    column: str = "anom_score",
    minutes: int = 10,
    warmup_minutes: int = 20,
) -> DataFrame:
    """One row per window: class, rows scored, rows including the warm-up before it, and alerts."""
    alert = F.coalesce(F.col(column) >= threshold, F.lit(False))
    width = minutes * 60_000_000
    meta = (
        with_window(scored, minutes)
        .groupBy("window_start", "window_end")
        .agg(
            F.when(F.bool_or(alert), "ANOMALY").otherwise("NORMAL").alias("classification"),
            F.count(F.lit(1)).alias("rows_scored"),
            F.count_if(alert).alias("alerts"),
        )
    )
    # Every event is warm-up for the windows that start within ``warmup_minutes`` after it.
    micros = F.unix_micros("event_time")
    own = micros - F.pmod(micros, F.lit(width))
    last = micros + warmup_minutes * 60_000_000
    starts = F.explode(F.sequence(own, last - F.pmod(last, F.lit(width)), F.lit(width)))
    fetched = (
        scored.select(starts.alias("_start"))
        .groupBy("_start")
        .agg(F.count(F.lit(1)).alias("rows_with_warmup"))
        .select(F.timestamp_micros("_start").alias("window_start"), "rows_with_warmup")
    )
    return meta.join(fetched, "window_start").withColumns(
        {"window_day": F.to_date("window_end"), "baseline_threshold": threshold}
    )


def window_technique_counts(scored: DataFrame, threshold: Column, column: str = "anom_score", minutes: int = 10) -> DataFrame:
    """Alerts per window and technique (kind ``technique``) or control function (kind ``function``)."""
    alerts = scored.filter(F.col(column) >= threshold)
    hits = technique_hits(alerts)
    functions = F.array_distinct(F.transform(control_hits(hits), lambda hit: F.upper(hit["function"])))
    tagged = with_window(alerts, minutes).select(
        "window_start",
        F.explode(
            F.concat(
                F.transform(technique_ids(hits), lambda name: F.struct(F.lit("technique").alias("kind"), name.alias("name"))),
                F.transform(functions, lambda name: F.struct(F.lit("function").alias("kind"), name.alias("name"))),
            )
        ).alias("tag"),
    )
    return tagged.groupBy("window_start", "tag.kind", "tag.name").agg(F.count(F.lit(1)).alias("count"))


def latest_window(windows: DataFrame) -> DataFrame:
    """The rows of the newest window."""
    newest = windows.agg(F.max("window_start")).scalar()
    return windows.filter(F.col("window_start") == newest)


def normal_history(features: DataFrame, windows: DataFrame, parts: int = 500, minutes: int = 10) -> DataFrame:
    """Features of the newest ``parts`` windows classified NORMAL. ``windows`` has one row per window."""
    newest = (
        windows.filter(F.col("classification") == "NORMAL")
        .select("window_start")
        .distinct()
        .orderBy(F.desc("window_start"))
        .limit(parts)
    )
    return with_window(features, minutes).join(newest, "window_start", "left_semi")


def retrain_set(baseline: DataFrame, normal: DataFrame) -> DataFrame:
    """Training rows of a day: the saved baseline and the recent normal windows, columns matched by name."""
    return baseline.unionByName(normal, allowMissingColumns=True)
