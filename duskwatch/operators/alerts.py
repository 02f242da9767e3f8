"""Alert selection, labels and detection quality."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.operators.firstk import required_id
from duskwatch.operators.quantile import threshold_value

# What identifies an event in a label file.
LABEL_KEYS = ["event_time", "source_ip", "destination_ip", "host_name", "session_id"]


def above_threshold(
    scores: DataFrame, column: str = "anom_score", contamination: float = 0.05, threshold: float | None = None
) -> DataFrame:
    """All rows at or above the alert threshold, which is added as ``threshold``.

    The scores are read twice to find a threshold that is not given, so they should be a stored table.
    """
    limit = threshold_value(scores, column, contamination) if threshold is None else threshold
    bound = F.lit(limit).cast("double")
    return scores.filter(F.col(column) >= bound).withColumn("threshold", bound)


def select_alerts(
    scores: DataFrame, top_n: int = 10, column: str = "anom_score", contamination: float = 0.05, id_col: str = "event_id"
) -> DataFrame:
    """The ``top_n`` highest scores among the rows at or above the threshold. An alert without an id is an error."""
    found = above_threshold(scores, column, contamination)
    return found.withColumn(id_col, required_id(found, id_col)).orderBy(F.desc(column), F.asc(id_col)).limit(top_n)


def label_join(
    scores: DataFrame, labels: DataFrame | None, label_col: str = "label", keys: list[str] | None = None
) -> DataFrame:
    """Scores with their label. A label column already there is kept; otherwise labels join on the common keys.

    Several labels of one key count as the largest, so no score row is ever repeated. Null keys match null keys.
    """
    if label_col in scores.columns:
        return scores
    if labels is None:
        raise ValueError(f"no column {label_col} in the scores and no labels given")
    wanted = LABEL_KEYS if keys is None else keys
    common = [k for k in wanted if k in scores.columns and k in labels.columns]
    if not common:
        raise ValueError("scores and labels share no key; rows have no position to match by, so name a key column")
    one = labels.groupBy(*[F.col(k).alias(f"_label_{k}") for k in common]).agg(F.max(label_col).alias(label_col))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_label_{k}")) for k in common])
    return scores.join(one, same, "left").drop(*[f"_label_{k}" for k in common])


def evaluate(
    labelled: DataFrame,
    column: str = "anom_score",
    label_col: str = "label",
    positive: int = 1,
    contamination: float = 0.05,
) -> DataFrame:
    """One row: threshold, confusion counts and rates. A row without a label is a negative."""
    bound = F.lit(threshold_value(labelled, column, contamination)).cast("double")
    truth = F.coalesce(F.col(label_col) == positive, F.lit(False))
    guess = F.coalesce(F.col(column) >= bound, F.lit(False))
    cells = labelled.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(truth).alias("positive"),
        F.count_if(truth & guess).alias("tp"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
        F.count_if(~truth & ~guess).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    return cells.select(
        bound.alias("threshold"),
        "total",
        "positive",
        (F.col("total") - F.col("positive")).alias("negative"),
        "tp",
        "fp",
        "fn",
        "tn",
        (tp / (tp + fn + F.lit(1e-9))).alias("tpr"),
        (fp / (fp + tn + F.lit(1e-9))).alias("fpr"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0)).alias("f1"),
    )
