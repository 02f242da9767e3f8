"""CSV flow records with varying headers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions.timeparse import parse_day_first
from duskwatch.schema import conform
from duskwatch.sources.lines import read_numbered

# Header names looked for, the first one present is used.
TIME_NAMES = ["timestamp", "datetime", "date_time", "time", "ts", "flow_start", "starttime", "start_time"]
FIELD_NAMES = {
    "source_ip": ["src_ip", "source_ip", "ip_src", "srcip", "sourceaddress"],
    "destination_ip": ["dst_ip", "destination_ip", "ip_dst", "dstip", "destinationaddress"],
    "source_port": ["src_port", "sport", "source_port"],
    "destination_port": ["dst_port", "dport", "destination_port"],
    "network_transport": ["protocol", "proto"],
    "event_action": ["label", "attack_cat", "attack_category"],
    "host_name": ["host", "hostname"],
    "user_name": ["user", "username", "account"],
}
FORWARD_BYTES = ["tot_fwd_bytes", "total_fwd_bytes"]
BACKWARD_BYTES = ["tot_bwd_bytes", "total_bwd_bytes"]


def normal_name(header: str) -> str:
    """Header in lower case, blanks as ``_``, other signs removed."""
    return re.sub(r"[^0-9a-z_]", "", re.sub(r"\s+", "_", header.strip().lower()))


def _wanted(time_column: str | None) -> dict[str, list[str]]:
    """Header names to look for, by field."""
    times = ([normal_name(time_column)] if time_column else []) + TIME_NAMES
    return {"event_time": times, **FIELD_NAMES, "forward": FORWARD_BYTES, "backward": BACKWARD_BYTES}


def flow_events(table: DataFrame, time_column: str | None = None) -> DataFrame:
    """Events of one table of text columns. A table without a time column, and rows without a time, give nothing."""
    names: dict[str, str] = {}
    for original in table.columns:
        names.setdefault(normal_name(original), original)
    found = {field: next((names[c] for c in candidates if c in names), None) for field, candidates in _wanted(time_column).items()}
    if found["event_time"] is None:
        return conform(table.limit(0).select())
    return _events(table, {field: F.col(f"`{name}`") for field, name in found.items() if name is not None}, lambda field: F.lit(found[field] is not None))


def _events(table: DataFrame, columns: dict[str, Column], given: Callable[[str], Column]) -> DataFrame:
    """Events from the texts of the fields; ``given`` tells whether a field has a column, whatever is in it."""
    columns = columns | {"event_time": parse_day_first(columns["event_time"])}
    for port in ("source_port", "destination_port"):
        if port in columns:
            columns[port] = columns[port].try_cast("double").try_cast("int")
    if "network_transport" in columns:
        columns["network_transport"] = F.lower(columns["network_transport"].cast("string"))
    columns["event_action"] = F.when(given("event_action"), columns.get("event_action", F.lit(None)).cast("string")).otherwise("flow")
    forward, backward = columns.pop("forward", None), columns.pop("backward", None)
    if forward is not None and backward is not None:
        both = F.coalesce(forward.try_cast("double"), F.lit(0.0)) + F.coalesce(backward.try_cast("double"), F.lit(0.0))
        columns["network_bytes"] = F.when(given("forward") & given("backward"), both)
    columns["event_dataset"] = F.lit("custom_csv")
    if "line_id" in table.columns:
        columns["line_id"] = F.col("line_id")
    selected = table.select(*[column.alias(name) for name, column in columns.items()])
    return conform(selected.filter("event_time is not null"))


def header_names(header: Column) -> Column:
    """The names in a CSV header line, normalised like ``normal_name``."""
    bare = F.regexp_replace(F.lower(header), '["\ufeff]', "")
    return F.transform(F.split(bare, ","), lambda n: F.regexp_replace(F.regexp_replace(F.trim(n), r"\s+", "_"), "[^0-9a-z_]", ""))


def read_flows(spark: SparkSession, path, time_column: str | None = None) -> DataFrame:
    """Events of all CSV files at a path, in one reading whatever their headers.

    Each line meets its own file's header on the executors; from it comes, for every event field, the place of the first
    column whose name is looked for. Files without a time column give nothing. To the driver comes the number of columns of
    the widest header.
    """
    lines = read_numbered(spark, path, "*.csv", header=True).withColumn("_names", header_names(F.col("header")))
    width = lines.where("line_no = 0").agg(F.max(F.size("_names"))).first()[0] or 1
    names = [f"_{k}" for k in range(width)]
    parsed = F.from_csv("value", ", ".join(f"{n} string" for n in names))
    rows = lines.where("line_no > 0 and trim(value) <> ''").select("line_id", "_names", parsed.alias("_row"))
    wanted = _wanted(time_column)

    def place(candidates: list[str]) -> Column:
        """Where the first candidate stands that the header has, from 0; null if it has none."""
        return F.coalesce(*[F.nullif(F.array_position("_names", name), F.lit(0).cast("long")) for name in candidates]).cast("int") - 1

    places = [place(candidates).alias(f"_at_{field}") for field, candidates in wanted.items()]
    located = rows.select("line_id", F.array(*[F.col(f"_row.{n}") for n in names]).alias("_fields"), *places)
    texts = {field: F.get("_fields", F.col(f"_at_{field}")) for field in wanted}
    return _events(located.where("_at_event_time is not null"), texts, lambda field: F.col(f"_at_{field}").isNotNull())
