"""Firewall logs of ``key=value`` pairs and intrusion-detection alert lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions.timeparse import parse_time
from duskwatch.schema import column_name, conform
from duskwatch.sources.lines import carried, read_numbered

# Pair layout, and firewall key -> event field.
PAIR = '(\\w+)=(".*?"|\\S+)'
FIREWALL_FIELDS = {
    "date": "event.date",
    "time": "event.time",
    "devid": "device.id",
    "devname": "host.name",
    "type": "event.category",
    "subtype": "event.type",
    "level": "log.level",
    "severity": "event.severity",
    "srcip": "source.ip",
    "srcport": "source.port",
    "dstip": "destination.ip",
    "dstport": "destination.port",
    "proto": "network.transport",
    "action": "event.action",
    "outcome": "event.outcome",
    "policyid": "rule.id",
    "service": "network.protocol",
    "msg": "message",
}

SEPARATOR = "\u0001"

# Alert layout (time, classification, priority, protocol, both ends), and the optional rule part.
ALERT_LINE = (
    "(\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(?:\\.\\d+)?Z)?\\s*.*?"
    "\\[Classification:\\s*([^\\]\\x01]+)\\]\\s*\\[Priority:\\s*(\\d+)\\]\\s*\\{([A-Za-z0-9]+)\\}\\s*"
    "(\\d{1,3}(?:\\.\\d{1,3}){3})(?::(\\d+))?\\s*->\\s*(\\d{1,3}(?:\\.\\d{1,3}){3})(?::(\\d+))?"
)
ALERT_RULE = "\\[(\\d+):(\\d+):(\\d+)\\]\\s*(.*?)\\s*\\[\\*\\*\\]"


def _not_blank(lines: DataFrame) -> DataFrame:
    return lines.withColumn("value", F.trim("value")).filter("value != ''")


def pair_value(keys: Column, values: Column, key: str) -> Column:
    """The value of a key in two parallel arrays that were reversed, so that the last pair of a key wins."""
    return F.trim(F.get(values, F.nullif(F.array_position(keys, key), F.lit(0)) - 1), F.lit('"'))


def firewall_events(lines: DataFrame) -> DataFrame:
    """Events of ``key=value`` lines. Time is date and time, else the epoch; bytes are sent plus received."""
    pairs = _not_blank(lines).select(
        "*",
        F.reverse(F.regexp_extract_all("value", F.lit(PAIR), F.lit(1))).alias("_keys"),
        F.reverse(F.regexp_extract_all("value", F.lit(PAIR), F.lit(2))).alias("_values"),
    )

    def get(key: str) -> Column:
        return pair_value(F.col("_keys"), F.col("_values"), key)

    sent, received = get("sentbyte").try_cast("double"), get("rcvdbyte").try_cast("double")
    both = F.when(
        sent.isNotNull() | received.isNotNull(), F.coalesce(sent, F.lit(0.0)) + F.coalesce(received, F.lit(0.0))
    )
    kept = carried(lines)
    fields = pairs.select(
        *kept,
        *[get(key).alias(column_name(field)) for key, field in FIREWALL_FIELDS.items()],
        both.alias("network_bytes"),
        F.concat(get("date"), F.lit(" "), get("time")).alias("_when"),
        get("eventtime").alias("_epoch"),
        F.lit("fortigate").alias("event_module"),
        F.lit("fortigate.traffic").alias("event_dataset"),
    )
    stamp = F.coalesce(parse_time(F.col("_when")), parse_time(F.col("_epoch")))
    return conform(fields.withColumn("event_time", stamp))


def ids_events(lines: DataFrame) -> DataFrame:
    """Events of intrusion-detection alerts; a line of another layout keeps its message only."""
    text = _not_blank(lines)

    def split(pattern: str, groups: int) -> Column:
        """The groups of the first match, cut out in one pass; null without a match."""
        marked_up = F.regexp_replace("value", f"^{pattern}.*$" if pattern == ALERT_LINE else f"^.*?{pattern}.*$", SEPARATOR.join(f"${i}" for i in range(1, groups + 1)))
        return F.when(F.col("value").rlike(pattern), F.split(marked_up, SEPARATOR, groups))

    def part(of: str, group: int) -> Column:
        return F.nullif(F.get(of, F.lit(group - 1)), F.lit(""))

    text = text.select("*", split(ALERT_LINE, 8).alias("_alert"), split(ALERT_RULE, 4).alias("_rule"))
    kept = carried(lines)
    return conform(
        text.select(
            *kept,
            part("_alert", 1).alias("_when"),
            part("_alert", 2).alias("event_category"),
            part("_alert", 3).try_cast("int").alias("event_severity"),
            part("_alert", 4).alias("network_transport"),
            part("_alert", 5).alias("source_ip"),
            part("_alert", 6).try_cast("int").alias("source_port"),
            part("_alert", 7).alias("destination_ip"),
            part("_alert", 8).try_cast("int").alias("destination_port"),
            F.coalesce(part("_rule", 2), part("_rule", 1)).alias("rule_id"),
            part("_rule", 3).alias("rule_version"),
            part("_rule", 4).alias("rule_name"),
            F.col("value").alias("message"),
            F.lit("ips").alias("event_module"),
            F.lit("ips.alert").alias("event_dataset"),
        ).withColumn("event_time", parse_time(F.col("_when")))
    )


def read_firewall(spark: SparkSession, path) -> DataFrame:
    return firewall_events(read_numbered(spark, path))


def read_ids(spark: SparkSession, path) -> DataFrame:
    return ids_events(read_numbered(spark, path))
