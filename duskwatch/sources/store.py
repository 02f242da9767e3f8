"""The day-partitioned event store and the other tables on disk."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from duskwatch.functions.timeparse import utc_date
from duskwatch.operators.firstk import hash_sample
from duskwatch.schema import EVENT_SCHEMA, conform


def _by_day(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a time, with their UTC day, rebalanced so that big days get several files and small ones one."""
    dated = df.filter("event_time is not null").withColumn("dt", utc_date(F.col("event_time")))
    return dated.hint("rebalance", *[F.col(k) for k in keys])


def _write(df: DataFrame, path: str, keys: list[str], mode: str) -> None:
    writer = df.write.mode(mode).option("compression", "zstd").partitionBy(*keys)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_events(events: DataFrame, path: str, source: str | None = None) -> None:
    """Replace the days present in ``events``, per source; rows without a time are dropped."""
    named = events if source is None else events.withColumn("source", F.lit(source))
    _write(_by_day(named, ["source", "dt"]), path, ["source", "dt"], "overwrite")


def append_events(events: DataFrame, path: str, source: str | None = None) -> None:
    """Add files to the days present in ``events``."""
    named = events if source is None else events.withColumn("source", F.lit(source))
    _write(_by_day(named, ["source", "dt"]), path, ["source", "dt"], "append")


def read_events(
    spark: SparkSession,
    path: str,
    sources: list[str] | None = None,
    days: tuple[str, str] | None = None,
    skip_corrupt: bool = False,
) -> DataFrame:
    """The event store, of all or the named sources, of all days or a span of days, both ends included.

    The schema is fixed, so no footer is read to find it. A file that cannot be read is an error, unless ``skip_corrupt``.
    """
    schema = StructType(list(EVENT_SCHEMA.fields)).add("source", "string").add("dt", "date")
    stored = spark.read.schema(schema).option("ignoreCorruptFiles", str(skip_corrupt).lower()).parquet(path)
    if sources is not None:
        stored = stored.filter(F.col("source").isin(sources))
    if days is not None:
        stored = stored.filter(F.col("dt").between(F.to_date(F.lit(days[0])), F.to_date(F.lit(days[1]))))
    return conform(stored, keep=["source", "dt"])


def partitions(spark: SparkSession, path: str) -> DataFrame:
    """The ``(source, dt)`` pairs of the store, from the folder names alone: one row per folder, no file is opened."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/source=*/dt=*")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    pairs = [(f.getPath().getParent().getName(), f.getPath().getName()) for f in found or [] if f.isDirectory()]
    rows = [(unquote(s.removeprefix("source=")), unquote(d.removeprefix("dt="))) for s, d in pairs]
    return spark.createDataFrame(rows, "source string, dt string").select("source", F.col("dt").cast("date").alias("dt"))


def write_features(features: DataFrame, path: str) -> None:
    """Replace the days present in the feature table."""
    _write(_by_day(features, ["dt"]), path, ["dt"], "overwrite")


def training_sample(features: DataFrame, per_day: int, seed: int = 42, id_col: str = "event_id") -> DataFrame:
    """At most ``per_day`` rows of each UTC day, chosen by hash."""
    dated = features if "dt" in features.columns else features.withColumn("dt", utc_date(F.col("event_time")))
    return hash_sample(dated, per_day, id_col, seed, by=["dt"])


def write_scores(scores: DataFrame, path: str) -> None:
    _write(_by_day(scores, ["dt"]), path, ["dt"], "overwrite")


def read_scores(
    spark: SparkSession, path: str, max_rows: int | None = None, seed: int = 42, id_col: str = "event_id"
) -> DataFrame:
    """All scores, or a hash sample of at most ``max_rows`` of them."""
    scores = read_table(spark, path)
    return scores if max_rows is None else hash_sample(scores, max_rows, id_col, seed)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by extension: ``.csv`` with a header, anything else Parquet.

    With a ``schema`` (DDL) a CSV file is read once; without one its types are found by reading it once more.
    """
    if path.lower().endswith(".csv"):
        reader = spark.read.option("header", "true")
        return (reader.option("inferSchema", "true") if schema is None else reader.schema(schema)).csv(path)
    return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of few rows as one JSON-lines file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def append_audit(plan: DataFrame, path: str) -> None:
    """Add planned responses to the audit log as JSON lines, with the time of planning."""
    audit = plan.select(
        F.current_timestamp().alias("time"),
        "dry_run",
        "rule",
        "row_time",
        "score",
        F.struct(F.col("action_type").alias("type"), F.col("action_cmd").alias("cmd")).alias("action"),
        F.lit(0).alias("return_code"),
        F.concat(F.lit("DRY-RUN "), F.col("action_type"), F.lit(": "), F.col("action_cmd")).alias("output"),
    )
    audit.write.mode("append").json(path)
