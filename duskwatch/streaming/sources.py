"""Streams of log files that a collector drops into a folder; parsing is the same as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.sources import firewall, jsonl, syslog


def stream_lines(spark: SparkSession, path: str, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """``(value, log_file_path)`` of the lines of new files."""
    reader = spark.readStream
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("log_file_path"))


def stream_firewall(spark: SparkSession, path: str, **options) -> DataFrame:
    return firewall.firewall_events(stream_lines(spark, path, **options))


def stream_ids(spark: SparkSession, path: str, **options) -> DataFrame:
    return firewall.ids_events(stream_lines(spark, path, **options))


def stream_logs(spark: SparkSession, path: str, year: int, zone: str = "UTC", **options) -> DataFrame:
    return syslog.log_events(stream_lines(spark, path, **options), year, zone)


def stream_beats(spark: SparkSession, path: str, **options) -> DataFrame:
    return jsonl.beats_events(jsonl.parse_records(stream_lines(spark, path, **options)))
