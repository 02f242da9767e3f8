"""Security flags of one event, as 0/1 integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as allowed, denied and failed.
ALLOW_ACTIONS = ["allow", "allowed", "permit", "accept", "close"]
DENY_ACTIONS = ["deny", "denied", "drop", "blocked", "reset"]
FAILED_LOGIN_CODE = "4625"
FAILED_LOGIN_TEXT = "failed password|authentication failure|invalid user"
SUSPICIOUS_PORT = 4444
SUSPICIOUS_OUTCOME = "S0"
SERVICING_ERROR_TEXT = "(?i)(fail|error|0x[0-9a-f]{2,})"


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _any(*conditions: Column) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | F.coalesce(condition, F.lit(False))
    return result.cast("int")


def login_failed(code: Column, outcome: Column, message: Column) -> Column:
    plain_code = F.regexp_replace(code.cast("string"), "\\.0+$", "")
    return _any(
        plain_code == FAILED_LOGIN_CODE, F.lower(outcome) == "failure", F.lower(message).rlike(FAILED_LOGIN_TEXT)
    )


def conn_suspicious(port: Column, outcome: Column) -> Column:
    return _any(port == SUSPICIOUS_PORT, outcome == SUSPICIOUS_OUTCOME)


def action_allow(action: Column) -> Column:
    return _flag(F.lower(action).isin(ALLOW_ACTIONS))


def action_deny(action: Column) -> Column:
    return _flag(F.lower(action).isin(DENY_ACTIONS))


def ips_alert(module: Column) -> Column:
    return _flag(F.lower(module) == "ips")


def cbs_failed(module: Column, dataset: Column, message: Column) -> Column:
    servicing = (F.lower(module) == "windows") & (F.lower(dataset) == "cbs")
    return _flag(servicing & message.rlike(SERVICING_ERROR_TEXT))


def entity_key(source_ip: Column, user: Column, host: Column) -> Column:
    """Who an event is about: source address, else user, else host."""
    return F.coalesce(source_ip, user, host, F.lit("unknown"))


def add_flags(events: DataFrame) -> DataFrame:
    c = F.col
    return events.withColumns(
        {
            "login_failed": login_failed(c("event_code"), c("event_outcome"), c("message")),
            "conn_suspicious": conn_suspicious(c("destination_port"), c("event_outcome")),
            "action_allow": action_allow(c("event_action")),
            "action_deny": action_deny(c("event_action")),
            "ips_alert": ips_alert(c("event_module")),
            "cbs_failed": cbs_failed(c("event_module"), c("event_dataset"), c("message")),
        }
    )
