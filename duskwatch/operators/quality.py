"""Data-quality gate over events, features and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskwatch.operators.quantile import exact_quantile
from duskwatch.operators.report import named, tag_counts
from duskwatch.operators.rules import technique_ids, with_mappings
from duskwatch.schema import FLAGS, WINDOWS_MIN

# The columns and techniques a healthy data set has.
IMPORTANT_COLUMNS = [
    "event_time",
    "message",
    "event_original",
    "host_name",
    "host_ip",
    "user_name",
    "source_ip",
    "source_port",
    "destination_ip",
    "destination_port",
    "network_transport",
    "event_code",
    "event_action",
    "event_outcome",
    "event_module",
    "event_dataset",
    "network_bytes",
    "network_packets",
    "rule_id",
    "rule_name",
]
CRITICAL_FEATURES = ["login_failed_count_5m", "uniq_dport_per_src_1m", "action_allow_count_1m", "action_deny_count_1m"]
EXPECTED_TECHNIQUES = ["T1110", "T1046", "T1021"]
MAX_TIME_FAILURES = 0.2

_ROWS = "metric string, name string, value double, status string"


def expected_features() -> list[str]:
    names = ["login_failed", "conn_suspicious", "action_allow", "action_deny", "ips_alert", "cbs_failed"]
    names += [f"{flag}_count_{w}m" for flag in FLAGS for w in WINDOWS_MIN]
    names += ["uniq_dst_per_src_1m", "uniq_dport_per_src_1m", "deny_ratio_5m", "login_failed_ratio_5m"]
    return names + ["text_entropy", "session_id"]


def _long(one_row: DataFrame, metric: str) -> DataFrame:
    """The columns of a one-row frame as ``(metric, name, value, status)`` rows."""
    pairs = [F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in one_row.columns]
    return one_row.select(F.inline(F.array(*pairs))).select(
        F.lit(metric).alias("metric"), "name", "value", F.lit("info").alias("status")
    )


def _fixed(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, _ROWS)


def quality_events(events: DataFrame, raw_time: str = "event_time") -> DataFrame:
    """Non-null share of the important columns, what is missing or still nested, and the share of unreadable times.

    ``raw_time`` names the column the time was read from, which may be text.
    """
    present = [c for c in IMPORTANT_COLUMNS if c in events.columns]
    shares = {c: F.avg(F.col(c).isNotNull().cast("double")) for c in present}
    unreadable = F.avg(F.col(raw_time).try_cast("timestamp").isNull().cast("double"))
    one = events.agg(*[share.alias(c) for c, share in shares.items()], unreadable.alias("_unreadable"))
    failures = one.select(
        F.lit("time_parse_failures").alias("metric"),
        F.lit(raw_time).alias("name"),
        F.col("_unreadable").alias("value"),
        F.when(F.col("_unreadable").isNull() | (F.col("_unreadable") > MAX_TIME_FAILURES), "error")
        .otherwise("ok")
        .alias("status"),
    )
    missing = [("missing_column", c, None, "warning") for c in IMPORTANT_COLUMNS if c not in events.columns]
    nested = [("nested_column", f.name, None, "info") for f in events.schema if isinstance(f.dataType, T.StructType)]
    report = _long(one.drop("_unreadable"), "non_null").unionByName(failures)
    return report.unionByName(_fixed(events, missing + nested)) if missing or nested else report


def quality_features(features: DataFrame) -> DataFrame:
    """Share of positive values per expected numeric feature, of non-null ones per id; error if all critical are 0."""
    expected = expected_features()
    present = [c for c in expected if c in features.columns]

    def share(name: str) -> Column:
        if isinstance(features.schema[name].dataType, T.NumericType):
            return F.avg((F.coalesce(F.col(name), F.lit(0)) > 0).cast("double"))
        return F.avg(F.col(name).isNotNull().cast("double"))

    critical = [F.coalesce(F.col(c) > 0, F.lit(False)) for c in CRITICAL_FEATURES if c in features.columns]
    alive = F.bool_or(reduce(Column.__or__, critical, F.lit(False)))
    one = features.agg(*[share(c).alias(c) for c in present], alive.alias("_alive"))
    verdict = one.select(
        F.lit("critical_features").alias("metric"),
        F.lit("any_positive").alias("name"),
        F.col("_alive").cast("double").alias("value"),
        F.when(F.col("_alive"), "ok").otherwise("error").alias("status"),
    )
    missing = [("missing_feature", c, None, "warning") for c in expected if c not in features.columns]
    report = _long(one.drop("_alive"), "coverage").unionByName(verdict)
    return report.unionByName(_fixed(features, missing)) if missing else report


def quality_scores(scores: DataFrame, column: str = "anom_score", expected: list[str] = EXPECTED_TECHNIQUES) -> DataFrame:
    """Rows, threshold, alerts, technique and function counts, and the expected techniques no alert has.

    The alerts are mapped and counted in one pass; the counts, one row per technique and function, are then laid out.
    """
    limit, n_rows = exact_quantile(scores, column, 0.95).first()
    bound = F.lit(limit).cast("double")
    alerts = with_mappings(scores.filter(F.col(column) >= bound))
    counted = tag_counts(alerts, {"technique": technique_ids(F.col("technique_hits")), "function": named("control_hits", "function")})
    one = counted.agg(
        F.array_sort(F.collect_list(F.struct("kind", "name", "count"))).alias("tags"),
        F.coalesce(F.max(F.when(F.col("kind") == "rows", F.col("count"))), F.lit(0)).alias("alerts"),
    )

    def of(kind: str) -> Column:
        return F.filter("tags", lambda tag: tag["kind"] == kind)

    def row(metric: str, name: Column, value: Column, status: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"), name.alias("name"), value.cast("double").alias("value"), status.alias("status")
        )

    def some(value: Column) -> Column:
        return F.when(value > 0, "ok").otherwise("error")

    info, nothing = F.lit("info"), F.lit(None)
    techniques, functions = of("technique"), of("function")
    absent = F.array_except(F.array(*[F.lit(e) for e in expected]), F.transform(techniques, lambda tag: tag["name"]))
    rows = F.concat(
        F.array(
            row("rows", F.lit("scores"), F.lit(n_rows), info),
            row("threshold", F.lit(column), bound, info),
            row("alerts", F.lit("at_or_above_threshold"), F.col("alerts"), some(F.col("alerts"))),
            row("techniques", F.lit("matched"), F.size(techniques), some(F.size(techniques))),
            row("functions", F.lit("matched"), F.size(functions), some(F.size(functions))),
        ),
        F.transform(techniques, lambda tag: row("technique", tag["name"], tag["count"], info)),
        F.transform(functions, lambda tag: row("function", tag["name"], tag["count"], info)),
        F.transform(absent, lambda name: row("expected_missing", name, nothing, F.lit("warning"))),
    )
    return one.select(F.inline(rows))


def verdict(*reports: DataFrame) -> DataFrame:
    """One row: ``passed`` is false when any report row is an error."""
    rows = reduce(DataFrame.unionByName, reports)
    return rows.agg(
        (F.count_if(F.col("status") == "error") == 0).alias("passed"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "warning").alias("warnings"),
    )
