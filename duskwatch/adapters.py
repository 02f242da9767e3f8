"""The generic ``events`` table read as security events.

``events(event_id, ts, user_id, event_type, value, props)`` has no addresses or ports, so they are derived from its
columns with whole-number arithmetic. Time is compressed 1800-fold, which turns 30 days into 24 minutes and fills the
minute windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.schema import conform
from duskwatch.session import configure

TIME_FACTOR = 1800


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    """The table with ``t_us``, compressed microseconds since 1970, and ``k``, the number inside ``props``."""
    return events_with_keys(table(spark, folder, "events"))


def events_with_keys(events: DataFrame) -> DataFrame:
    return events.withColumns(
        {
            "t_us": F.expr(f"unix_micros(cast(ts as timestamp)) div {TIME_FACTOR}"),
            "k": F.get_json_object("props", "$.k").cast("bigint"),
        }
    )


def security_events(events: DataFrame) -> DataFrame:
    """Event-schema columns plus ``t_us`` for a table that has ``t_us`` and ``k``."""
    k, user, kind = F.col("k"), F.col("user_id"), F.col("event_type")

    def text(column: Column) -> Column:
        return column.cast("string")

    failed = kind == "error"
    source_ip = F.when(failed, F.concat(F.lit("10.0.0."), text(user % 3))).otherwise(
        F.concat(F.lit("10.0.1."), text(user % 50))
    )
    port = (
        F.when(k % 6 == 0, 22).when(k % 6 == 1, 3389).when(k % 6 == 2, 445).when(k % 6 == 3, 4444).when(k % 6 == 4, 80)
    ).otherwise(443)
    action = (
        F.when(kind == "purchase", "allow")
        .when(kind == "click", "accept")
        .when(kind == "view", "http_request")
        .when((kind == "signup") & (k % 3 == 0), "deny")
        .otherwise("user_login")
    )
    servicing = (k % 13 != 0) & (k % 11 == 0)
    verb = F.when(failed, "Failed").otherwise("Accepted")
    message = F.concat(
        verb, F.lit(" password for user-"), text(user), F.lit(" from "), source_ip, F.lit(" port "), text(port), F.lit(" ssh2")
    )
    derived = events.select(
        text(F.col("event_id")).alias("event_id"),
        F.timestamp_micros("t_us").alias("event_time"),
        "t_us",
        F.when(k % 13 == 0, "ips").when(servicing, "windows").otherwise("network").alias("event_module"),
        F.when(k % 13 == 0, "ips.alert").when(servicing, "cbs").otherwise("flow").alias("event_dataset"),
        action.alias("event_action"),
        F.when(failed, "failure").when(k % 17 == 0, "S0").otherwise("success").alias("event_outcome"),
        (k % 5).cast("int").alias("event_severity"),
        F.concat(F.lit("host-"), text(user % 50)).alias("host_name"),
        F.concat(F.lit("user-"), text(user)).alias("user_name"),
        source_ip.alias("source_ip"),
        (F.lit(40000) + k).cast("int").alias("source_port"),
        F.concat(F.lit("192.168.0."), text(k % 10)).alias("destination_ip"),
        port.cast("int").alias("destination_port"),
        F.when(k % 2 == 0, "tcp").otherwise("udp").alias("network_transport"),
        F.col("value").alias("network_bytes"),
        k.cast("double").alias("network_packets"),
        F.concat(F.lit("proc-"), text(k % 7)).alias("process_name"),
        F.when(k % 4 != 0, F.concat(kind, F.lit(" --k="), text(k))).alias("process_command_line"),
        message.alias("message"),
    )
    return conform(derived, keep=["t_us"])


def ecs(spark: SparkSession, folder: str) -> DataFrame:
    return security_events(raw_events(spark, folder))
