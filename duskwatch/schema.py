"""The fixed event schema and the names of every feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("event_module", T.StringType()),
        T.StructField("event_dataset", T.StringType()),
        T.StructField("event_code", T.StringType()),
        T.StructField("event_action", T.StringType()),
        T.StructField("event_outcome", T.StringType()),
        T.StructField("event_category", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_severity", T.IntegerType()),
        T.StructField("event_date", T.StringType()),
        T.StructField("event_clock", T.StringType()),
        T.StructField("host_name", T.StringType()),
        T.StructField("host_ip", T.StringType()),
        T.StructField("user_name", T.StringType()),
        T.StructField("user_target_name", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("event_original", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("source_port", T.IntegerType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("destination_port", T.IntegerType()),
        T.StructField("network_transport", T.StringType()),
        T.StructField("network_protocol", T.StringType()),
        T.StructField("network_direction", T.StringType()),
        T.StructField("network_bytes", T.DoubleType()),
        T.StructField("network_packets", T.DoubleType()),
        T.StructField("process_name", T.StringType()),
        T.StructField("process_command_line", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("rule_name", T.StringType()),
        T.StructField("rule_version", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("log_level", T.StringType()),
        T.StructField("log_file_path", T.StringType()),
        T.StructField("labels_is_attack", T.IntegerType()),
        T.StructField("labels_attack_type", T.StringType()),
    ]
)
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()

# Dotted names whose column is not simply the name with "." replaced by "_".
_SPECIAL_NAMES = {"@timestamp": "event_time", "event.time": "event_clock", "anom.score": "anom_score"}


def column_name(dotted: str) -> str:
    """Column that holds a dotted field name: ``source.ip`` -> ``source_ip``."""
    return _SPECIAL_NAMES.get(dotted, dotted.replace(".", "_"))


WINDOWS_MIN = (1, 5, 15)
FLAGS = ["login_failed", "conn_suspicious", "action_deny", "action_allow", "ips_alert"]
BASE_FEATURES = [
    "login_failed",
    "conn_suspicious",
    "action_allow",
    "action_deny",
    "ips_alert",
    "text_entropy",
    "process_command_line_entropy",
    "message_entropy",
    "cbs_failed",
]
ID_COLUMNS = [
    "event_time",
    "host_name",
    "user_name",
    "source_ip",
    "source_port",
    "destination_ip",
    "destination_port",
    "session_id",
    "event_action",
    "event_module",
    "event_dataset",
    "event_severity",
    "network_protocol",
    "labels_is_attack",
    "labels_attack_type",
]


def feature_columns(windows: tuple[int, ...] = WINDOWS_MIN) -> list[str]:
    """The numeric features, 96 of them with the standard windows."""
    names = list(BASE_FEATURES)
    for suffix in ("", "_host", "_user", "_dst"):
        names += [f"{flag}_count{suffix}_{w}m" for flag in FLAGS for w in windows]
    names += [f"cbs_failed_count_{suffix}_{w}m" for suffix in ("host", "proc") for w in windows]
    names += [f"{ratio}_{w}m" for ratio in ("deny_ratio", "login_failed_ratio") for w in windows]
    names += [
        f"{prefix}_{w}m" for prefix in ("uniq_dst_per_src", "uniq_src_per_dst", "uniq_dport_per_src") for w in windows
    ]
    names += [f"{measure}_sum_{w}m" for measure in ("network_bytes", "network_packets") for w in windows]
    return names


def conform(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Select the full event schema; columns the input lacks become typed nulls, wrong types are cast or nulled.

    Where the input has a ``line_id``, rows without an id of their own get that.
    """
    if "line_id" in df.columns:
        own = "coalesce(event_id, line_id)" if "event_id" in df.columns else "line_id"
        df = df.withColumn("event_id", F.expr(own))
    def pick(field: T.StructField) -> str:
        kind = field.dataType.simpleString()
        if field.name not in df.columns:
            return f"cast(null as {kind}) as {field.name}"
        if df.schema[field.name].dataType == field.dataType:
            return field.name
        return f"try_cast({field.name} as {kind}) as {field.name}"

    extra = [name for name in keep or [] if name not in EVENT_COLUMNS]
    return df.selectExpr(*[pick(field) for field in EVENT_SCHEMA], *extra)
