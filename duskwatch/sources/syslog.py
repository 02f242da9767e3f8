"""Text logs: syslog (logins and switches) and Windows servicing logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions.timeparse import parse_time
from duskwatch.schema import conform
from duskwatch.sources.lines import carried, first_address, once, read_numbered

# Line layouts and the words that classify a line.
SYSLOG_LINE = "^(\\w{3})\\s+(\\d{1,2})\\s(\\d{2}:\\d{2}:\\d{2})\\s([^\\s\\x01]+)\\s([^:\\x01]+):\\s(.*)$"
SERVICING_LINE = "^(\\d{4}-\\d{2}-\\d{2}\\s+\\d{2}:\\d{2}:\\d{2}),\\s*(\\w+)\\s+([A-Za-z0-9_.-]+)\\s+(.*)$"
FAILED_USER = "Failed password for (?:invalid user\\s+)?([\\w\\-\\.\\$]+)"
ACCEPTED_USER = "Accepted (?:password|publickey) for ([\\w\\-\\.\\$]+)"
SWITCH_MARKS = ["%LINK-", "%LINEPROTO-", "%SYS-", "%CONFIG_I", "%SEC-"]
SEPARATOR = "\u0001"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _marked(layout: str, groups: int) -> Column:
    """The line with the groups of a layout behind separators, the first before them; as it is if it has another layout."""
    return F.regexp_replace("value", layout, "".join(f"{SEPARATOR}${i}" for i in range(1, groups + 1)))


def log_events(lines: DataFrame, year: int, zone: str = "UTC", host: str | None = None) -> DataFrame:
    """Events of text-log lines ``(value, log_file_path)``, in one scan; lines of neither layout are dropped.

    Syslog lines have no year and no zone, so both are given. Lines of servicing logs carry no host.
    """
    # What was cut out begins with a separator, which no line does that is looked at.
    plain = lines.select("value", *carried(lines)).filter(~F.col("value").startswith(SEPARATOR))
    first = once(plain, _cut=_marked(SYSLOG_LINE, 6))
    both = once(first, _syslog=F.col("_cut").startswith(SEPARATOR), _else=F.when(~F.col("_cut").startswith(SEPARATOR), _marked(SERVICING_LINE, 4)))
    known = both.filter(F.col("_syslog") | F.col("_else").startswith(SEPARATOR))
    parts = once(known, _part=F.when(F.col("_syslog"), F.split("_cut", SEPARATOR, 7)).otherwise(F.split("_else", SEPARATOR, 5)))

    def part(syslog: int | None, servicing: int | None) -> Column:
        def at(place):
            return F.lit(None).cast("string") if place is None else F.get("_part", F.lit(place + 1))

        return F.when(F.col("_syslog"), at(syslog)).otherwise(at(servicing))

    rows = once(
        parts,
        _month=part(0, None),
        _day=part(1, None),
        _clock=part(2, 0),
        _level=part(None, 1),
        host_name=F.coalesce(part(3, None), F.when(~F.col("_syslog"), F.lit(host))),
        process_name=part(4, 2),
        message=part(5, 3),
    )
    message, process, is_syslog = F.col("message"), F.col("process_name"), F.col("_syslog")
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.initcap("_month")), F.lit(0)).cast("int")
    hour, minute, second = (F.substring("_clock", i, 2).cast("int") for i in (1, 4, 7))
    wall = F.try_make_timestamp(F.lit(year), month, F.col("_day").cast("int"), hour, minute, second, F.lit("UTC"))
    servicing_time = parse_time(F.regexp_replace(F.when(~is_syslog, F.col("_clock")), "\\s+", " "))
    failed = message.contains("Failed password") | message.contains("authentication failure")
    accepted = message.contains("Accepted ")
    outcome = F.when(failed, "Failure").when(accepted, "Success")
    user = F.when(failed, F.regexp_extract("message", FAILED_USER, 1)).when(accepted, F.regexp_extract("message", ACCEPTED_USER, 1))
    rows = once(rows, _user=user)
    upper_message = F.upper(message)
    marked = F.lit(False)
    for mark in SWITCH_MARKS:
        marked = marked | upper_message.contains(mark) | F.upper(process).contains(mark)
    switch = ~(F.lower(process).contains("sshd") | failed | accepted) & marked
    switch_action = (
        F.when(upper_message.contains("UPDOWN"), "interface_state")
        .when(upper_message.contains("CONFIG"), "config_change")
        .otherwise("syslog_event")
    )
    servicing_failed = message.contains("Failed") | message.contains("Error")
    servicing_action = F.when(process.contains("CBS") | process.contains("CSI"), "system_update").otherwise("log_event")

    def either(of_switch, of_login, of_servicing) -> Column:
        return F.when(~is_syslog, of_servicing).when(switch, of_switch).otherwise(of_login)

    events = rows.select(
        *carried(lines),
        "host_name",
        "process_name",
        "message",
        F.when(is_syslog, F.to_utc_timestamp(wall, zone)).otherwise(servicing_time).alias("event_time"),
        either(F.lit("network"), F.lit("syslog"), F.lit("windows")).alias("event_module"),
        either(F.lit("switch.syslog"), F.lit("auth"), F.lit("cbs")).alias("event_dataset"),
        either(switch_action, F.lit("user_login"), servicing_action).alias("event_action"),
        either(F.lit("info"), outcome, F.when(servicing_failed, "Failure").otherwise(F.col("_level"))).alias("event_outcome"),
        F.when(is_syslog & (F.col("_user") != ""), F.col("_user")).alias("user_name"),
        first_address(message).alias("source_ip"),
    )
    return conform(events).filter("event_time is not null")


def read_logs(spark: SparkSession, path, year: int, zone: str = "UTC", host: str | None = None) -> DataFrame:
    return log_events(read_numbered(spark, path, "*.log"), year, zone, host)
