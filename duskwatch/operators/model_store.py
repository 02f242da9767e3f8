"""Versions of a trained model with its threshold, and the one in force.

A version is a folder that is written once: nodes, scaler and features. What is in force is the last row of a log of
pointers. A pointer is one small file that appears as a whole when its version is complete, so a reader sees either the old
model or the new one, and a job that fails while it writes leaves the old one in force.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.operators import forest
from duskwatch.operators.quantile import threshold_value
from duskwatch.operators.windows import normal_history, retrain_set, with_window
from duskwatch.session import materialize

POINTER = "sequence long, version long, threshold double, n_rows long, n_baseline long, n_features int, trained_from timestamp, trained_to timestamp"


def pointers(spark: SparkSession, root: str) -> DataFrame:
    """All that was ever put in force, by ``sequence``."""
    try:
        return spark.read.schema(POINTER).parquet(f"{root}/pointers").drop("at")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POINTER)


def _point(spark: SparkSession, root: str, row: tuple) -> None:
    # An existing folder of that number is an error: somebody else put a model in force meanwhile.
    spark.createDataFrame([row], POINTER).coalesce(1).write.mode("error").parquet(f"{root}/pointers/at={row[0]}")


def in_force(spark: SparkSession, root: str):
    """The pointer row in force, or none."""
    return pointers(spark, root).agg(F.max_by(F.struct("*"), "sequence")).first()[0]


def publish(spark: SparkSession, root: str, model: forest.ForestModel, threshold: float, n_rows: int, n_baseline: int = 0, trained_from=None, trained_to=None) -> int:
    """Store a model as a new version and put it in force; returns the version."""
    last = in_force(spark, root)
    sequence = 1 if last is None else last["sequence"] + 1
    # A version is named by the sequence number that first points to it, which no other version can have.
    forest.save(model, spark, f"{root}/versions/{sequence}")
    _point(spark, root, (sequence, sequence, threshold, n_rows, n_baseline, len(model.features), trained_from, trained_to))
    return sequence


def restore(spark: SparkSession, root: str, version: int) -> None:
    """Put an earlier version in force again."""
    row = pointers(spark, root).where(F.col("sequence") == version).first()
    if row is None or row["version"] != version:
        raise ValueError(f"there is no model version {version}")
    _point(spark, root, (in_force(spark, root)["sequence"] + 1, *tuple(row)[1:]))


def load(spark: SparkSession, root: str) -> tuple[forest.ForestModel, float, int]:
    """Model, threshold and version in force."""
    row = in_force(spark, root)
    if row is None:
        raise ValueError(f"no model is in force under {root}")
    return forest.load(spark, f"{root}/versions/{row['version']}"), row["threshold"], row["version"]


@dataclass
class Detector:
    """What turns features into scores and scores into alerts, and the model version it comes from."""

    score: Callable[[DataFrame], DataFrame]
    threshold: float
    version: int | None = None


def detector(root: str) -> Callable[[SparkSession], Detector]:
    """For a sink: the model in force when a batch begins."""

    def ask(spark: SparkSession) -> Detector:
        model, threshold, version = load(spark, root)
        return Detector(lambda features: forest.score(features, model), threshold, version)

    return ask


def retrain(
    baseline: DataFrame,
    features: DataFrame,
    windows: DataFrame,
    root: str,
    names: list[str],
    parts: int = 500,
    minutes: int = 10,
    contamination: float = 0.05,
    **growth,
) -> int:
    """Train on the saved baseline and the newest ``parts`` NORMAL windows, set the threshold, put the model in force.

    ``windows`` has one row per window with its classification; ``features`` are the rows of all windows. The training rows are
    written once. Other arguments go to ``forest.train``. Returns the new version.
    """
    spark = features.sparkSession
    normal = normal_history(features, windows, parts, minutes).withColumn("_kind", F.lit("normal"))
    rows = retrain_set(with_window(baseline, minutes).withColumn("_kind", F.lit("baseline")), normal)
    rows = materialize(rows.select("event_id", "event_time", "_kind", *names), "training-rows")
    model = forest.train(rows, names, contamination=contamination, **growth)
    scores = materialize(forest.score(rows, model).select("anom_score"), "training-scores")
    threshold = threshold_value(scores, contamination=contamination)
    n_rows, n_baseline, first, last = rows.agg(F.count(F.lit(1)), F.count_if(F.col("_kind") == "baseline"), F.min("event_time"), F.max("event_time")).first()
    return publish(spark, root, model, float(threshold), n_rows, n_baseline, first, last)
