"""Detection on a stream that revises: late events change the windows they belong to and those they reach into.

Every batch stores its events by window, finds the windows whose rolling features the new events can change, and computes
these windows anew from the stored events, with the warm-up they need and nothing else. The new rows of a window are a new
version of it; a batch counts when its row in ``progress`` is there, which is written last. Readers take the newest version of
each window up to the last batch that counts, so a batch that fails or runs again changes nothing they see before it is done.

Events older than the watermark (the newest event of earlier batches less the tolerated lateness) change nothing any more.
They are kept in the table ``late`` with the batch that brought them and its watermark, and counted in ``progress``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from duskwatch.operators.model_store import Detector
from duskwatch.plans.features import build_features
from duskwatch.schema import EVENT_COLUMNS, EVENT_SCHEMA
from duskwatch.session import materialize, scratch_folder
from duskwatch.streaming.windows import _read

MINUTE_US = 60_000_000

PROGRESS = "batch_id long, n_events long, n_late long, watermark_us long, newest_us long, windows_revised long, threshold double, model_version long"
_STORED = StructType(list(EVENT_SCHEMA.fields)).add("window_us", "long").add("batch_id", "long")


def _spans(starts: list[int], width: int) -> list[tuple[int, int]]:
    """First and last of each unbroken series of window starts."""
    spans: list[tuple[int, int]] = []
    for start in sorted(starts):
        if spans and start == spans[-1][1] + width:
            spans[-1] = (spans[-1][0], start)
        else:
            spans.append((start, start))
    return spans


def _within(spans: list[tuple[int, int]]) -> Column:
    return reduce(or_, [F.col("window_us").between(low, high) for low, high in spans], F.lit(False))


class RevisingSink:
    """Batch handler for ``foreachBatch``: tables events, late, scores, alerts, meta and progress under ``path``.

    ``detector`` is called with the session at the start of each batch, for instance ``model_store.detector(root)``.
    ``featurize`` makes features from events; a feature may depend on events up to ``reach_minutes`` before its own.
    """

    def __init__(
        self,
        path: str,
        detector: Callable[[SparkSession], Detector],
        minutes: int = 10,
        reach_minutes: int = 15,
        late_minutes: int = 20,
        featurize: Callable[[DataFrame], DataFrame] = build_features,
    ):
        self.path, self.detector, self.featurize = path.rstrip("/"), detector, featurize
        self.width, self.reach, self.late = minutes * MINUTE_US, reach_minutes * MINUTE_US, late_minutes * MINUTE_US

    def _window(self, us: Column) -> Column:
        return us - F.pmod(us, F.lit(self.width))

    def _write(self, df: DataFrame, table: str, *parts: str) -> None:
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts)
        writer.parquet(f"{self.path}/{table}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        with scratch_folder(batch.sparkSession, "batch"):
            self._handle(batch, batch_id)

    def _handle(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        detector = self.detector(spark)
        before = progress(spark, self.path)
        newest = before.where(F.col("batch_id") < batch_id).agg(F.max("newest_us")).first()[0]
        watermark = None if newest is None else newest - self.late
        us = F.unix_micros("event_time")
        is_late = F.lit(False) if watermark is None else us < F.lit(watermark)
        dated = batch.select(*EVENT_COLUMNS).filter("event_time is not null").withColumn("_late", is_late)
        new = materialize(dated.withColumn("window_us", self._window(us)).withColumn("batch_id", F.lit(batch_id).cast("long")), "new")
        n_late, n_events, last = new.agg(F.count_if("_late"), F.count_if(~F.col("_late")), F.max(us)).first()
        if n_late:
            late = new.filter("_late").drop("_late", "window_us").withColumn("watermark_us", F.lit(watermark))
            self._write(late, "late", "batch_id")
        accepted = new.filter("not _late").drop("_late")
        revised = 0
        if n_events:
            self._write(accepted.hint("rebalance", "window_us"), "events", "window_us", "batch_id")
            # An event counts in the features of what follows it within the reach. Starts are as many as windows in that time.
            touched = F.sequence("window_us", self._window(us + F.lit(self.reach)), F.lit(self.width))
            starts = [r[0] for r in accepted.select(F.explode(touched)).distinct().collect()]
            revised = self._revise(spark, _spans(starts, self.width), batch_id, detector)
        row = (batch_id, n_events, n_late, watermark, max(filter(None, (newest, last)), default=None), revised, detector.threshold, detector.version)
        spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/progress/batch={batch_id}")

    def _revise(self, spark: SparkSession, spans: list[tuple[int, int]], batch_id: int, detector: Detector) -> int:
        """Compute these windows anew as version ``batch_id``; returns their number."""
        warm_up = -(-self.reach // self.width) * self.width
        # Only folders of these windows are listed, however long the stream has run; those just written are there.
        needed = sorted({start for low, high in spans for start in range(low - warm_up, high + 1, self.width)})
        chosen = f"{self.path}/events/window_us={{{','.join(map(str, needed))}}}"
        stored = spark.read.schema(_STORED).option("basePath", f"{self.path}/events").parquet(chosen)
        needed = stored.filter(F.col("batch_id") <= batch_id)
        found = self.featurize(needed.select(*EVENT_COLUMNS)).withColumn("window_us", self._window(F.unix_micros("event_time")))
        found = detector.score(found.filter(_within(spans))).withColumn("version", F.lit(batch_id).cast("long"))
        scored = materialize(found, "scored")
        alert = F.coalesce(F.col("anom_score") >= F.lit(detector.threshold), F.lit(False))
        self._write(scored.hint("rebalance", "window_us"), "scores", "window_us", "version")
        self._write(scored.filter(alert).hint("rebalance", "window_us"), "alerts", "window_us", "version")
        meta = scored.groupBy("window_us", "version").agg(
            F.when(F.bool_or(alert), "ANOMALY").otherwise("NORMAL").alias("classification"),
            F.count(F.lit(1)).alias("rows_scored"),
            F.count_if(alert).alias("alerts"),
            F.lit(detector.threshold).alias("baseline_threshold"),
            F.lit(detector.version).cast("long").alias("model_version"),
        )
        self._write(meta.coalesce(1), "meta", "version")
        return _read(spark, f"{self.path}/meta/version={batch_id}").count()


def progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch that is done: events taken and late, the watermark that held, windows revised, model version."""
    found = _read(spark, f"{path}/progress", StructType.fromDDL(PROGRESS))
    return spark.createDataFrame([], PROGRESS) if found is None else found.drop("batch")


def late_events(spark: SparkSession, path: str) -> DataFrame:
    """The events that came behind the watermark, with ``batch_id`` and ``watermark_us``, of the batches that are done."""
    schema = StructType(list(EVENT_SCHEMA.fields)).add("watermark_us", "long").add("batch_id", "long")
    found = _read(spark, f"{path}/late", schema)
    found = spark.createDataFrame([], schema) if found is None else found
    return found.join(progress(spark, path).select("batch_id"), "batch_id", "left_semi")


def window_versions(spark: SparkSession, path: str) -> DataFrame:
    """Meta rows of all versions of all windows, of the batches that are done."""
    done = progress(spark, path).select(F.col("batch_id").alias("version"))
    return spark.read.parquet(f"{path}/meta").join(done, "version", "left_semi")


def current(spark: SparkSession, path: str, table: str = "scores") -> DataFrame:
    """Rows of ``scores``, ``alerts`` or ``meta`` in each window's newest version."""
    newest = window_versions(spark, path).groupBy("window_us").agg(F.max("version").alias("version"))
    rows = spark.read.parquet(f"{path}/{table}")
    return rows.join(newest, ["window_us", "version"], "left_semi")
