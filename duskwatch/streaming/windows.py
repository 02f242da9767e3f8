"""Detection on a stream: tumbling windows, warm-up, late events, stored artefacts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from duskwatch.functions.timeparse import utc_date
from duskwatch.operators.forest import ForestModel, score
from duskwatch.operators.windows import window_meta, with_window
from duskwatch.plans.features import build_features
from duskwatch.schema import EVENT_COLUMNS, EVENT_SCHEMA
from duskwatch.session import materialize, scratch_path


def tumbling_counts(events: DataFrame, minutes: int = 10, late_minutes: int = 20, flags: list[str] | None = None) -> DataFrame:
    """Events and flag sums per window. Events later than ``late_minutes`` behind the newest are dropped and counted by
    Spark in the query progress."""
    sums = [F.sum(flag).alias(flag) for flag in flags or []]
    return (
        events.withWatermark("event_time", f"{late_minutes} minutes")
        .groupBy(F.window("event_time", f"{minutes} minutes"))
        .agg(F.count(F.lit(1)).alias("n_events"), *sums)
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n_events", *flags or [])
    )


def stream_sessions(events: DataFrame, timeout_seconds: int = 120, late_minutes: int = 20) -> DataFrame:
    """Sessions per address pair and transport; a silence longer than the timeout ends one.

    A session window ends one timeout after its last event and two of them merge when they touch.
    """
    gap = F.session_window("event_time", f"{timeout_seconds} seconds")
    return (
        events.withWatermark("event_time", f"{late_minutes} minutes")
        .groupBy(gap, "source_ip", "destination_ip", "network_transport")
        .agg(F.count(F.lit(1)).alias("n_events"), F.max("event_time").alias("session_end"))
        .select(
            "source_ip",
            "destination_ip",
            "network_transport",
            F.col("session_window.start").alias("session_start"),
            "session_end",
            "n_events",
        )
    )


def _read(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


class WindowSink:
    """Micro-batch handler: features with warm-up, scores, alerts and window meta, as four tables under ``path``.

    Tables are partitioned by day and batch. A batch that runs again replaces its own partitions, and never reads
    itself or later batches as warm-up, so the result does not depend on retries.
    """

    def __init__(
        self, path: str, model: ForestModel, threshold: float = 0.0, minutes: int = 10, warmup_minutes: int = 20
    ):
        self.path = path.rstrip("/")
        self.model, self.threshold = model, threshold
        self.minutes, self.warmup_minutes = minutes, warmup_minutes

    def history(self, spark: SparkSession, batch_id: int, first: Column) -> DataFrame | None:
        """Stored events of earlier batches, from ``warmup_minutes`` before a moment on."""
        stored = _read(spark, f"{self.path}/events")
        if stored is None:
            return None
        since = first - F.make_dt_interval(mins=F.lit(self.warmup_minutes))
        return stored.filter(
            (F.col("window_day") >= utc_date(since)) & (F.col("batch_id") < batch_id) & (F.col("event_time") >= since)
        )

    def _write(self, df: DataFrame, table: str, batch_id: int) -> None:
        (
            df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("window_day", "batch_id")
            .parquet(f"{self.path}/{table}")
        )

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = materialize(batch.select(*EVENT_COLUMNS).filter("event_time is not null"), "stream-batch")
        if new.isEmpty():
            return
        dated = with_window(new, self.minutes).withColumn("window_day", utc_date(F.col("window_end")))
        self._write(dated.drop("window_start", "window_end"), "events", batch_id)
        first = new.agg(F.min("event_time")).scalar()
        earlier = self.history(spark, batch_id, first)
        everything = new.withColumn("_new", F.lit(1))
        if earlier is not None:
            everything = everything.unionByName(earlier.select(*EVENT_COLUMNS, F.lit(0).alias("_new")))
        featured = build_features(everything, carry=("_new",)).filter("_new = 1").drop("_new")
        scored = materialize(
            with_window(score(featured, self.model), self.minutes).withColumn("window_day", utc_date(F.col("window_end"))),
            "stream-scores",
        )
        self._write(scored, "scores", batch_id)
        self._write(scored.filter(F.col("anom_score") >= self.threshold), "alerts", batch_id)
        meta = window_meta(scored, F.lit(self.threshold), minutes=self.minutes, warmup_minutes=self.warmup_minutes)
        self._write(meta.drop("rows_with_warmup"), "meta", batch_id)


def window_table(meta: DataFrame) -> DataFrame:
    """One row per window from the per-batch meta rows: ANOMALY if any batch found one."""
    anomalous = F.bool_or(F.col("classification") == "ANOMALY")
    return meta.groupBy("window_start", "window_end", "window_day").agg(
        F.when(anomalous, "ANOMALY").otherwise("NORMAL").alias("classification"),
        F.sum("rows_scored").alias("rows_scored"),
        F.sum("alerts").alias("alerts"),
        F.max("baseline_threshold").alias("baseline_threshold"),
    )


def progress(meta: DataFrame) -> DataFrame:
    """How far a stream came: last window end and number of windows, per day."""
    return meta.groupBy("window_day").agg(
        F.max("window_end").alias("last_window_end"), F.countDistinct("window_start").alias("windows_processed")
    )


def start(events: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run a batch handler on a stream; without a trigger interval it takes what is there and stops.

    The checkpoint folder holds the progress of the stream, so a restart continues where the last run ended.
    """
    writer = events.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_to_table(query: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming query over all available input and return the final rows.

    In ``complete`` mode each batch holds the whole result and the last one counts.
    """
    spark = query.sparkSession
    out = scratch_path(spark, "stream-out")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={batch_id}")

    writer = query.writeStream.outputMode(mode).foreachBatch(keep)
    running = writer.option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True).start()
    running.awaitTermination()
    rows = _read(spark, out)
    return rows.select(*query.columns) if rows is not None else spark.createDataFrame([], query.schema)


def run_to_latest(query: DataFrame, keys: list[str]) -> DataFrame:
    """Run a query in update mode over all available input; of the rows of equal ``keys`` the last batch's counts.

    State that the watermark has passed is dropped as the stream goes, unlike in ``complete`` mode.
    """
    spark = query.sparkSession
    out = scratch_path(spark, "stream-out")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    writer = query.writeStream.outputMode("update").foreachBatch(keep)
    writer.option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    rows = _read(spark, out)
    if rows is None:
        return spark.createDataFrame([], query.schema)
    others = [c for c in query.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "_batch").alias(c) for c in others]).select(*query.columns)


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream over event-schema Parquet files."""
    return spark.readStream.schema(EVENT_SCHEMA).parquet(path)
