"""JSON-lines sources: Windows events, Sysmon, Zeek, Beats and exported search documents.

Each line is parsed once into a VARIANT, so no schema is inferred and records may differ in shape. Fields are looked up
by path, first as one dotted key, then as nested objects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions.timeparse import parse_time
from duskwatch.schema import column_name, conform
from duskwatch.sources.lines import read_numbered

# Raw field -> event field, per source. Where several fill one field, the later entry wins.
FIELD_MAPS = {
    "windows": [
        ("Event.System.Computer", "host.name"),
        ("Event.System.EventID", "event.code"),
        ("Event.EventData.TargetUserName", "user.name"),
        ("Event.EventData.IpAddress", "source.ip"),
        ("Event.EventData.SubjectUserName", "user.target.name"),
        ("Event.EventData.LogonType", "event.action"),
        ("Event.EventData.Status", "event.outcome"),
        ("Event.EventData.ProcessName", "process.name"),
        ("Event.EventData.CommandLine", "process.command_line"),
    ],
    "sysmon": [
        ("UtcTime", "@timestamp"),
        ("Computer", "host.name"),
        ("EventID", "event.code"),
        ("Image", "process.name"),
        ("CommandLine", "process.command_line"),
        ("User", "user.name"),
        ("SourceIp", "source.ip"),
        ("DestinationIp", "destination.ip"),
        ("SourcePort", "source.port"),
        ("DestinationPort", "destination.port"),
        ("Protocol", "network.transport"),
    ],
    "zeek": [
        ("ts", "@timestamp"),
        ("id.orig_h", "source.ip"),
        ("id.orig_p", "source.port"),
        ("id.resp_h", "destination.ip"),
        ("id.resp_p", "destination.port"),
        ("proto", "network.transport"),
        ("service", "network.protocol"),
        ("conn_state", "event.outcome"),
        ("uid", "event.id"),
        ("local_orig", "network.direction"),
    ],
    "beats": [
        ("@timestamp", "@timestamp"),
        ("host.name", "host.name"),
        ("source.ip", "source.ip"),
        ("source.port", "source.port"),
        ("destination.ip", "destination.ip"),
        ("destination.port", "destination.port"),
        ("network.transport", "network.transport"),
        ("network.protocol", "network.protocol"),
        ("network.bytes", "network.bytes"),
        ("network.packets", "network.packets"),
        ("event.dataset", "event.dataset"),
        ("event.module", "event.module"),
        ("event.action", "event.action"),
        ("event.category", "event.category"),
        ("event.severity", "event.severity"),
    ],
}

# The dotted name of every event field.
EVENT_FIELDS = [
    "@timestamp",
    "event.id",
    "event.module",
    "event.dataset",
    "event.code",
    "event.action",
    "event.outcome",
    "event.category",
    "event.type",
    "event.severity",
    "event.original",
    "host.name",
    "host.ip",
    "user.name",
    "user.target.name",
    "message",
    "source.ip",
    "source.port",
    "destination.ip",
    "destination.port",
    "network.transport",
    "network.protocol",
    "network.direction",
    "network.bytes",
    "network.packets",
    "process.name",
    "process.command_line",
    "rule.id",
    "rule.name",
    "rule.version",
    "device.id",
    "log.level",
    "log.file.path",
    "labels.is_attack",
    "labels.attack_type",
]


def read_jsonl(spark: SparkSession, path, pattern: str | None = None) -> DataFrame:
    """Records of JSON-lines files as VARIANT column ``raw``; blank and malformed lines are dropped."""
    return parse_records(read_numbered(spark, path, pattern))


def parse_records(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.withColumn("raw", F.try_parse_json(F.col(column))).filter("raw is not null").drop(column)


def at_path(raw: Column, path: str) -> Column:
    """A field as text: the exact dotted key if there is one, else nested objects step by step."""
    exact = F.try_variant_get(raw, f"$['{path}']", "string")
    if "." not in path:
        return exact
    nested = "$" + "".join(f"['{step}']" for step in path.split("."))
    return F.coalesce(exact, F.try_variant_get(raw, nested, "string"))


def field_columns(
    records: DataFrame, mapping: list[tuple[str, str]], time_path: str = "@timestamp", raw: str = "raw", extra: dict[str, Column] | None = None
) -> dict[str, Column]:
    """Event columns as expressions over a record; ``_when`` is the text of its time."""
    sources: dict[str, list[Column]] = {}
    for path, target in mapping:
        sources.setdefault(column_name(target), []).insert(0, at_path(F.col(raw), path))
    mapped_time = sources.pop("event_time", [])
    if "log_file_path" in records.columns:
        sources.setdefault("log_file_path", []).append(F.col("log_file_path"))
    columns = {target: F.coalesce(*found) for target, found in sources.items()} | (extra or {})
    columns["_when"] = F.coalesce(at_path(F.col(raw), time_path), *mapped_time, at_path(F.col(raw), "@timestamp"))
    return columns


def _events(records: DataFrame, columns: dict[str, Column]) -> DataFrame:
    if "line_id" in records.columns:
        columns = columns | {"line_id": F.col("line_id")}
    # The text of the time is looked up once, then read.
    found = records.select(*[expression.alias(name) for name, expression in columns.items()])
    return conform(found.withColumn("event_time", parse_time(F.col("_when"))))


def map_fields(
    records: DataFrame,
    mapping: list[tuple[str, str]],
    time_path: str = "@timestamp",
    raw: str = "raw",
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Event-schema rows from records. The time is the field ``time_path`` if present, else the mapped one.

    ``extra`` gives further event columns as ready expressions over the record.
    """
    return _events(records, field_columns(records, mapping, time_path, raw, extra))


def _defaults(events: DataFrame, module: str, dataset: str) -> DataFrame:
    """Fill module and dataset where they are empty."""
    return events.withColumns(
        {
            name: F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(value))
            for name, value in (("event_module", module), ("event_dataset", dataset))
        }
    )


def _tagged(events: DataFrame, module: str, dataset: str) -> DataFrame:
    return events.withColumns({"event_module": F.lit(module), "event_dataset": F.lit(dataset)})


def _mapped_or_ready(records: DataFrame, source: str, mapped_tags: tuple[str, str], ready_tags: tuple[str, str]) -> DataFrame:
    """Map raw records; records that already carry a flat time and event code keep their event fields."""
    raw = F.col("raw")
    has_both = F.lit(True)
    for name in ("@timestamp", "event.code"):
        has_both = has_both & F.try_variant_get(raw, f"$['{name}']", "string").isNotNull()
    ready = field_columns(records, [(name, name) for name in EVENT_FIELDS])
    mapped = field_columns(records, FIELD_MAPS[source])
    for place, name in enumerate(("event_module", "event_dataset")):
        ready[name] = F.coalesce(F.nullif(ready[name], F.lit("")), F.lit(ready_tags[place]))
        mapped[name] = F.lit(mapped_tags[place])
    nothing = F.lit(None).cast("string")
    flat = records.withColumn("_flat", has_both)
    both = {n: F.when(F.col("_flat"), ready.get(n, nothing)).otherwise(mapped.get(n, nothing)) for n in [*ready, *(n for n in mapped if n not in ready)]}
    return _events(flat, both).filter("event_time is not null")


def windows_events(records: DataFrame) -> DataFrame:
    return _mapped_or_ready(records, "windows", ("windows", "security"), ("windows", "windows.security"))


def sysmon_events(records: DataFrame) -> DataFrame:
    return _mapped_or_ready(records, "sysmon", ("sysmon", "sysmon"), ("sysmon", "sysmon"))


def zeek_events(records: DataFrame) -> DataFrame:
    return _tagged(map_fields(records, FIELD_MAPS["zeek"]), "zeek", "zeek.conn").filter("event_time is not null")


def beats_events(records: DataFrame) -> DataFrame:
    return _defaults(map_fields(records, FIELD_MAPS["beats"]), "packetbeat", "packetbeat.flow")


def document_events(records: DataFrame) -> DataFrame:
    """Exported search documents. The host may be an object or a text, its address a list or a text."""
    raw = F.col("raw")

    def text(path: str) -> Column:
        return F.try_variant_get(raw, path, "string")

    mapping = [(name, name) for name in EVENT_FIELDS if name not in ("host.name", "host.ip")]
    host = F.coalesce(
        text("$['host.name']"),
        text("$.host.name"),
        text("$.host.hostname"),
        text("$.hostname"),
        text("$.winlog.computer_name"),
    )
    address = F.coalesce(text("$['host.ip'][0]"), text("$.host.ip[0]"), text("$['host.ip']"), text("$.host.ip"))
    return map_fields(records, mapping, extra={"host_name": host, "host_ip": address})
