"""All readers together."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.sources import firewall, flows, jsonl, syslog
from duskwatch.sources.store import write_events


def readers(year: int, zone: str = "UTC") -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Source name -> reader of its files at a path. Every reader gives no rows when there are no files."""
    return {
        "windows": lambda spark, path: jsonl.windows_events(jsonl.read_jsonl(spark, path)),
        "sysmon": lambda spark, path: jsonl.sysmon_events(jsonl.read_jsonl(spark, path)),
        "zeek": lambda spark, path: jsonl.zeek_events(jsonl.read_jsonl(spark, path)),
        "beats": lambda spark, path: jsonl.beats_events(jsonl.read_jsonl(spark, path)),
        "documents": lambda spark, path: jsonl.document_events(jsonl.read_jsonl(spark, path)),
        "syslog": lambda spark, path: syslog.read_logs(spark, path, year, zone),
        "firewall": firewall.read_firewall,
        "ids": firewall.read_ids,
        "flows": flows.read_flows,
    }


def ingest(spark: SparkSession, paths: dict[str, str], year: int, zone: str = "UTC") -> DataFrame:
    """Events of several sources in one table, with the column ``source``; ``paths`` maps source name to files."""
    known = readers(year, zone)
    parts = [known[name](spark, path).withColumn("source", F.lit(name)) for name, path in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def ingest_to_store(spark: SparkSession, paths: dict[str, str], store: str, year: int, zone: str = "UTC") -> None:
    """Read all sources and replace their days in the event store in one write."""
    write_events(ingest(spark, paths, year, zone), store)
