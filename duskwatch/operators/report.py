"""Summaries of scores and alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.operators.rules import technique_ids


def source_breakdown(df: DataFrame) -> DataFrame:
    """Rows per module and dataset, the most frequent first."""
    names = [c for c in ("event_module", "event_dataset") if c in df.columns]
    keys = [F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in names]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), *names)


def risk_distribution(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("risk_level").agg(F.count(F.lit(1)).alias("count"))


def _per_alert(alerts: DataFrame, names: Column, label: str) -> DataFrame:
    return (
        alerts.select(F.explode(names).alias(label))
        .groupBy(label)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), label)
    )


def technique_counts(mapped: DataFrame) -> DataFrame:
    """Alerts per technique; an alert counts once for each of its techniques."""
    return _per_alert(mapped, technique_ids(F.col("technique_hits")), "technique")


def named(hits: str, field: str) -> Column:
    """Distinct upper-case values of one field of the hits."""
    names = F.transform(F.col(hits), lambda hit: F.upper(F.trim(hit[field])))
    return F.array_distinct(F.filter(names, lambda name: F.length(name) > 0))


def control_counts(mapped: DataFrame, field: str = "function") -> DataFrame:
    """Alerts per control function, or per category with ``field='category'``."""
    return _per_alert(mapped, named("control_hits", field), field)


def distinct_techniques(annotated: DataFrame) -> DataFrame:
    """Distinct ``(technique, name)`` in the printable technique lists, whatever the case, ordered by id."""
    parts = annotated.select(F.explode(F.split("mitre_techniques", ",")).alias("_part"))
    parts = parts.select(F.trim("_part").alias("_part")).filter(F.length("_part") > 0)
    ids = F.split("_part", " ")[0]
    return (
        parts.select(ids.alias("technique"), F.trim(F.expr("substring(_part, length(split(_part, ' ')[0]) + 1)")).alias("name"))
        .groupBy(F.lower("technique").alias("_key"))
        .agg(F.min(F.struct("technique", "name")).alias("_first"))
        .select("_first.*")
        .orderBy("technique")
    )


def score_histogram(df: DataFrame, column: str = "anom_score", bins: int = 30) -> DataFrame:
    """Rows in ``bins`` equal pieces between the least and the greatest score; the last piece holds its upper end.

    When all scores are equal the range is half a unit to either side.
    """
    ends = df.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high")).alias("e")).scalar()
    flat = ends.getField("low") == ends.getField("high")
    low = F.when(flat, ends.getField("low") - 0.5).otherwise(ends.getField("low"))
    high = F.when(flat, ends.getField("high") + 0.5).otherwise(ends.getField("high"))
    width = (high - low) / bins
    piece = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
    counts = df.filter(F.col(column).isNotNull()).groupBy(piece.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return (
        every.join(counts, "bin", "left")
        .select(
            "bin",
            (low + F.col("bin") * width).alias("bin_start"),
            (low + (F.col("bin") + 1) * width).alias("bin_end"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
        .orderBy("bin")
    )


def alert_timeline(alerts: DataFrame) -> DataFrame:
    """Alerts per minute from the first to the last alert; minutes without alerts count 0."""
    minute = F.date_trunc("minute", "event_time")
    counts = alerts.groupBy(minute.alias("minute")).agg(F.count(F.lit(1)).alias("count"))
    ends = counts.agg(F.min("minute").alias("a"), F.max("minute").alias("b"))
    every = ends.filter("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 minute"))).alias("minute"))
    return every.join(counts, "minute", "left").select("minute", F.coalesce("count", F.lit(0)).alias("count")).orderBy("minute")


DETAIL_COLUMNS = [
    "event_time",
    "host_name",
    "user_name",
    "source_ip",
    "destination_ip",
    "destination_port",
    "anom_score",
    "risk_level",
    "mitre_techniques",
    "nist_functions",
]


def alert_detail(
    annotated: DataFrame,
    risks: list[str] | None = None,
    techniques: list[str] | None = None,
    functions: list[str] | None = None,
) -> DataFrame:
    """The alert table, filtered by any of the given risks, techniques and functions, in order of time.

    A technique selects its sub-techniques too, since names are looked for inside the printable list.
    """
    chosen = annotated
    if risks:
        chosen = chosen.filter(F.col("risk_level").isin(risks))
    for column, names in (("mitre_techniques", techniques), ("nist_functions", functions)):
        if names:
            chosen = chosen.filter(reduce(Column.__or__, [F.col(column).contains(name) for name in names]))
    return chosen.select(*[c for c in DETAIL_COLUMNS if c in chosen.columns]).orderBy("event_time")


def tag_counts(df: DataFrame, tags: dict[str, Column]) -> DataFrame:
    """``(kind, name, count)`` for several arrays of names in one pass; kind ``rows`` counts the rows themselves."""

    def tagged(kind: str, names: Column) -> Column:
        return F.transform(names, lambda name: F.struct(F.lit(kind).alias("kind"), name.alias("name")))

    lists = [tagged(kind, names) for kind, names in tags.items()]
    own = F.array(F.struct(F.lit("rows").alias("kind"), F.lit("rows").alias("name")))
    return (
        df.select(F.explode(F.concat(own, *lists)).alias("tag"))
        .groupBy("tag.kind", "tag.name")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def summary(scores: DataFrame, annotated: DataFrame) -> DataFrame:
    """The report payload as ``(section, name, value)`` rows: totals, threshold, risks, techniques, functions.

    ``annotated`` are the alerts of ``scores`` with mappings, risk and ``threshold``.
    """
    counts = tag_counts(
        annotated,
        {
            "risk": F.array("risk_level"),
            "technique": technique_ids(F.col("technique_hits")),
            "functions": F.array("nist_functions"),
            "threshold": F.array(F.col("threshold").cast("string")),
        },
    )
    is_total = F.col("kind").isin("rows", "threshold")
    rows = counts.select(
        F.when(is_total, "total").otherwise(F.col("kind")).alias("section"),
        F.when(F.col("kind") == "rows", "alerts")
        .when(F.col("kind") == "threshold", "threshold")
        .otherwise(F.col("name"))
        .alias("name"),
        F.when(F.col("kind") == "threshold", F.col("name").try_cast("double"))
        .otherwise(F.col("count").cast("double"))
        .alias("value"),
    )
    totals = scores.agg(F.count(F.lit(1)).cast("double").alias("value"))
    return totals.select(F.lit("total").alias("section"), F.lit("events").alias("name"), "value").unionByName(rows)
