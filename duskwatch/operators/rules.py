"""Rules over rows: conditions compiled to expressions, techniques, controls and the alert columns made of them."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskwatch.schema import column_name

# Technique rules. A text such as "> 10" compares numbers, a list means membership.
TECHNIQUE_RULES = [
    {
        "id": "rule_bruteforce",
        "description": "Many failed logins within five minutes",
        "tactic": "Credential Access",
        "technique": "T1110",
        "subtechnique": "T1110.001",
        "conditions": {"login_failed_count_5m": "> 10", "login_failed_ratio_5m": "> 0.4"},
    },
    {
        "id": "rule_bruteforce_label",
        "description": "Event labelled as brute force",
        "tactic": "Credential Access",
        "technique": "T1110",
        "conditions": {"labels.attack_type": ["brute_force_rdp", "brute_force_ssh", "bruteforce"]},
    },
    {
        "id": "rule_remote_service",
        "description": "Allowed connection to SSH, RDP or SMB",
        "tactic": "Lateral Movement",
        "technique": "T1021",
        "conditions": {
            "destination.port": [22, 3389, 445],
            "event.action": ["allow", "allowed", "permit", "accept", "close"],
        },
    },
    {
        "id": "rule_lateral_label",
        "description": "Event labelled as lateral movement",
        "tactic": "Lateral Movement",
        "technique": "T1021",
        "conditions": {"labels.attack_type": ["lateral_movement"]},
    },
    {
        "id": "rule_port_scan",
        "description": "Several ports tried within a minute, with suspicious connections",
        "tactic": "Discovery",
        "technique": "T1046",
        "conditions": {"uniq_dport_per_src_1m": "> 3", "conn_suspicious": "== 1"},
    },
    {
        "id": "rule_port_scan_label",
        "description": "Event labelled as port scan",
        "tactic": "Discovery",
        "technique": "T1046",
        "conditions": {"labels.attack_type": ["port_scan"]},
    },
    {
        "id": "rule_switch_interface_flap",
        "description": "Switch interface going up or down",
        "tactic": "Impact",
        "technique": "T1499",
        "conditions": {"event.dataset": ["switch.syslog"], "event.action": ["interface_state"]},
    },
]

# Control rules, by technique.
CONTROL_RULES = [
    {
        "id": "nist_detect_bruteforce",
        "description": "Detect login brute force",
        "function": "DETECT",
        "category": "DE.CM",
        "subcategory": "DE.CM-7",
        "techniques": ["T1110"],
    },
    {
        "id": "nist_detect_portscan",
        "description": "Monitor for port scans",
        "function": "DETECT",
        "category": "DE.CM",
        "subcategory": "DE.CM-8",
        "techniques": ["T1046"],
    },
    {
        "id": "nist_respond_lateral",
        "description": "Respond to lateral movement",
        "function": "RESPOND",
        "category": "RS.MI",
        "subcategory": "RS.MI-1",
        "techniques": ["T1021"],
    },
]

# Words in an alert's text and the technique each one names.
KEYWORD_TECHNIQUES = [
    ("brute force", "T1110 Brute Force"),
    ("port scan", "T1046 Network Service Discovery"),
    ("lateral", "T1021 Remote Services"),
    ("powershell", "T1059.001 PowerShell"),
    ("rundll32", "T1218 Signed Binary Proxy Execution"),
    ("beacon", "TA0011 Command and Control"),
]
REMOTE_PORTS = [3389, 445]
REMOTE_TECHNIQUE = "T1021 Remote Services"

_COMPARISON = re.compile(r"\s*(>=|<=|==|>|<)\s*([-+]?\d+(?:\.\d+)?)\s*")
_COMPARE = {
    ">": Column.__gt__,
    ">=": Column.__ge__,
    "<": Column.__lt__,
    "<=": Column.__le__,
    "==": Column.__eq__,
}


def _field(df: DataFrame, name: str) -> tuple[Column, T.DataType] | None:
    """A rule's field as a column: by its dotted name, by the column it maps to, or inside a struct."""
    for candidate in (name, column_name(name)):
        if candidate in df.columns:
            return F.col(f"`{candidate}`"), df.schema[candidate].dataType
    kind, column = df.schema, None
    for part in name.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
            return None
        column = F.col(f"`{part}`") if column is None else column.getField(part)
        kind = kind[part].dataType
    return None if column is None else (column, kind)


def _equals(actual: Column, kind: T.DataType, wanted) -> Column:
    """Text against text ignores case; otherwise both sides must be numbers."""
    if isinstance(kind, T.StringType):
        return F.lower(actual) == wanted.lower() if isinstance(wanted, str) else F.lit(False)
    if isinstance(wanted, (int, float)) and isinstance(kind, (T.NumericType, T.BooleanType)):
        return actual.cast("double") == float(wanted)
    return F.lit(False)


def condition(df: DataFrame, name: str, wanted) -> Column:
    """One condition as a boolean that is never null; an absent or null field does not match."""
    found = _field(df, name)
    if found is None or wanted is None:
        return F.lit(False)
    actual, kind = found
    comparison = _COMPARISON.fullmatch(wanted) if isinstance(wanted, str) else None
    if comparison:
        matched = _COMPARE[comparison[1]](actual.try_cast("double"), F.lit(float(comparison[2])))
    elif isinstance(wanted, list):
        matched = F.lit(False)
        for item in wanted:
            matched = matched | _equals(actual, kind, item)
    else:
        matched = _equals(actual, kind, wanted)
    return F.coalesce(matched, F.lit(False))


def conditions(df: DataFrame, wanted: dict) -> Column:
    """All conditions together; none at all is true."""
    return reduce(and_, [condition(df, name, value) for name, value in wanted.items()], F.lit(True))


def _tags(rule: dict, names: list[str]) -> Column:
    return F.struct(
        F.lit(rule["id"]).alias("rule_id"), *[F.lit(rule.get(n)).cast("string").alias(n) for n in names]
    )


_TECHNIQUE_FIELDS = ["description", "tactic", "technique", "subtechnique"]
_CONTROL_FIELDS = ["description", "function", "category", "subcategory"]


def _empty(names: list[str]) -> Column:
    return F.array().cast("array<struct<" + ",".join(f"{n}:string" for n in ["rule_id", *names]) + ">>")


def technique_hits(df: DataFrame, rules: list[dict] = TECHNIQUE_RULES) -> Column:
    """Array of the rules a row meets, in rule order."""
    usable = [rule for rule in rules if isinstance(rule.get("conditions", {}), dict)]
    if not usable:
        return _empty(_TECHNIQUE_FIELDS)
    hits = [F.when(conditions(df, r.get("conditions", {})), _tags(r, _TECHNIQUE_FIELDS)) for r in usable]
    return F.array_compact(F.array(*hits))


def technique_ids(hits: Column) -> Column:
    """Distinct technique ids of the hits, upper case."""
    ids = F.transform(hits, lambda hit: F.upper(F.trim(hit["technique"])))
    return F.array_distinct(F.filter(ids, lambda name: F.length(name) > 0))


def control_hits(hits: Column, rules: list[dict] = CONTROL_RULES) -> Column:
    """Array of the control rules that name any technique of the row; a rule that names none always applies."""
    if not rules:
        return _empty(_CONTROL_FIELDS)
    ids = technique_ids(hits)
    found = []
    for rule in rules:
        named = [name.upper() for name in rule.get("techniques") or []]
        applies = F.arrays_overlap(ids, F.array(*[F.lit(n) for n in named])) if named else F.lit(True)
        found.append(F.when(applies, _tags(rule, _CONTROL_FIELDS)))
    return F.array_compact(F.array(*found))


def with_mappings(
    df: DataFrame, technique_rules: list[dict] = TECHNIQUE_RULES, control_rules: list[dict] = CONTROL_RULES
) -> DataFrame:
    """Add the arrays ``technique_hits`` and ``control_hits``."""
    tagged = df.withColumn("technique_hits", technique_hits(df, technique_rules))
    return tagged.withColumn("control_hits", control_hits(F.col("technique_hits"), control_rules))


def _joined(hits: str, field: str) -> Column:
    names = F.filter(F.transform(F.col(hits), lambda hit: hit[field]), lambda name: F.length(name) > 0)
    return F.array_join(F.array_sort(F.array_distinct(names)), ", ")


def annotate(df: DataFrame, **rules) -> DataFrame:
    """Add the printable mapping columns and a risk level to alerts."""
    mapped = df if "technique_hits" in df.columns else with_mappings(df, **rules)
    named = mapped.withColumns(
        {
            "mitre_tactics": _joined("technique_hits", "tactic"),
            "mitre_techniques": _joined("technique_hits", "technique"),
            "nist_functions": _joined("control_hits", "function"),
            "nist_categories": _joined("control_hits", "category"),
        }
    )
    fallback = F.when(F.col("mitre_techniques") != "", "MEDIUM").otherwise("LOW")
    if "risk_level" in df.columns:
        fallback = F.when(F.length("risk_level") > 0, F.col("risk_level")).otherwise(fallback)
    return named.withColumn("risk_level", fallback)


def first_threat(df: DataFrame) -> DataFrame:
    """Add the tactic, technique and sub-technique of the first hit."""
    first = F.get("technique_hits", F.lit(0))
    return df.withColumns(
        {
            "threat_tactic_name": first["tactic"],
            "threat_technique_name": first["technique"],
            "threat_technique_id": first["technique"],
            "threat_technique_subtechnique": first["subtechnique"],
        }
    )


def keyword_techniques(df: DataFrame, top_features: str | None = None) -> Column:
    """Technique names found by keyword in the text of an alert, and by its destination port."""
    parts = [c for c in ("message", "event_action", "event_dataset", "rule_name") if c in df.columns]
    pieces = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts]
    if top_features:
        pieces.append(F.coalesce(F.array_join(F.transform(top_features, lambda item: item["feature"]), " "), F.lit("")))
    blob = F.lower(F.concat_ws(" ", *pieces))
    found = [F.when(blob.contains(word), F.lit(name)) for word, name in KEYWORD_TECHNIQUES]
    if "destination_port" in df.columns:
        found.append(F.when(F.col("destination_port").try_cast("int").isin(REMOTE_PORTS), F.lit(REMOTE_TECHNIQUE)))
    return F.array_distinct(F.array_compact(F.array(*found)))
