"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each class has a mean and a covariance of its own, the latter drawn towards the pooled covariance and towards a multiple
of the unit matrix. The Cholesky factors are kept, so a row's squared Mahalanobis distance is one triangular product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import arrow_map, held_out, labelled_sample, texts_of
from duskwatch.llm.textstats import COUNTS, MORE, counts_of

NAMES = COUNTS + MORE
FEATURES = ["length", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "marks", "shouts", "top_word", "line_words", "collision"]


def transform(counts: np.ndarray) -> np.ndarray:
    """Counts (rows x NAMES) to features: logs of lengths, smoothed log-odds of shares, so that classes are near normal."""
    c = {name: counts[:, k].astype(float) for k, name in enumerate(NAMES)}
    words, chars, lines = c["n_words"], c["word_chars"], c["n_lines"]

    def odds(part: np.ndarray, whole: np.ndarray, weight: float) -> np.ndarray:
        share = (part + 0.5) / (whole + weight)
        return np.log(share / np.maximum(1 - share, 1e-3))

    return np.stack(
        [
            np.log1p(words),
            chars / np.maximum(words, 1),
            odds(c["n_symbols"], chars, 50),
            odds(c["n_dup_lines"], lines, 5),
            odds(c["n_repeat_words"], words, 20),
            odds(c["n_distinct_words"], words, 20),
            odds(c["n_upper"], c["n_upper"] + c["n_lower"], 50),
            odds(c["n_digits"], chars, 50),
            odds(c["n_marks"], words, 20),
            odds(c["n_shouts"], words, 20),
            odds(c["most_frequent"], words, 20),
            np.log1p(words / np.maximum(lines, 1)),
            np.log((c["squared_counts"] + 1) / (words + 1)),
        ],
        axis=1,
    )


@dataclass
class Discriminant:
    """Fitted classes and their cached factors; ``slope`` and ``shift`` turn the log-density difference into log-odds."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverse of each class's Cholesky factor
    log_dets: list[float]
    slope: float
    shift: float

    def difference(self, features: np.ndarray) -> np.ndarray:
        """Log density as class 1 minus that as class 0."""
        z = (features - self.centre) / self.scale
        density = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets):
            density.append(-0.5 * (((z - mean) @ factor.T) ** 2).sum(axis=1) - 0.5 * log_det)
        return density[1] - density[0]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(features) + self.shift, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of a one-dimensional logistic fit, by Newton's method."""
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + ridge * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def learn(features: np.ndarray, good: np.ndarray, to_pooled: float = 0.1, to_unit: float = 0.02) -> Discriminant:
    """Fit on rows of features; a class with fewer than two rows gets the pooled covariance and its own or the common mean.

    Without any row every score is one half.
    """
    d = features.shape[1]
    if not len(features):
        return Discriminant(np.zeros(d), np.ones(d), [np.zeros(d)] * 2, [np.eye(d)] * 2, [0.0, 0.0], 0.0, 0.0)
    centre, scale = features.mean(axis=0), np.maximum(features.std(axis=0), 1e-6)
    z = (features - centre) / scale
    parts = [z[~good], z[good]]
    means = [p.mean(axis=0) if len(p) else np.zeros(d) for p in parts]
    scatter = [(p - m).T @ (p - m) for p, m in zip(parts, means)]
    pooled = sum(scatter) / max(len(z) - 2, 1)
    factors, log_dets = [], []
    for p, s in zip(parts, scatter):
        own = s / (len(p) - 1) if len(p) > 1 else pooled
        mixed = (1 - to_pooled) * own + to_pooled * pooled
        mixed = (1 - to_unit) * mixed + to_unit * max(np.trace(mixed) / d, 1e-6) * np.eye(d)
        root = np.linalg.cholesky(mixed)
        factors.append(np.linalg.solve(root, np.eye(d)))
        log_dets.append(float(2 * np.log(np.diag(root)).sum()))
    fitted = Discriminant(centre, scale, means, factors, log_dets, 1.0, 0.0)
    if not good.any() or good.all():
        prior = (good.sum() + 0.5) / (len(good) + 1)
        fitted.slope, fitted.shift = 0.0, float(np.log(prior / (1 - prior)))
    else:
        # The difference has heavy tails; its signed root keeps the calibration from being ruled by them.
        fitted.slope, fitted.shift = logistic(fitted.difference(features), good.astype(float))
        fitted.slope = max(fitted.slope, 1e-6)
    return fitted


def _features(texts: list[str | None]) -> np.ndarray:
    return transform(np.array([counts_of(t) for t in texts], dtype=np.int64).reshape(-1, len(NAMES)))


def fit(documents: DataFrame, labels: DataFrame, rows: int = 20_000, **options) -> Discriminant:
    """Fit on at most ``rows`` labelled documents outside the held-out fifth; their features come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in texts_of(batch, 2):
                found = _features(texts)
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(first, last - first) for k in (0, 1)] + [pa.array(list(found))], names=["doc_id", "label", "f"])

    sample = labelled_sample(documents, labels, "quality", rows).select("doc_id", "label", "text")
    got = arrow_map(sample, run, "doc_id long, label int, f array<double>").toPandas()
    features = np.stack(got["f"].to_numpy()) if len(got) else np.zeros((0, len(FEATURES)))
    order = np.lexsort([*features.T, got["doc_id"].to_numpy()])  # the sums must not depend on the order of arrival
    return learn(features[order], got["label"].to_numpy()[order] == 1, **options)


def scores(documents: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts are scored as texts without words. Repeated rows and null ids are scored each for itself; other
    columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in texts_of(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(model.score(_features(texts)))], names=["doc_id", "score"])

    kind = documents.select("doc_id").schema
    scored = arrow_map(documents.select("doc_id", F.col("text").cast("string").alias("_text")), run, kind.add("score", "double"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(documents: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """The documents, all columns, that score at least ``threshold``; one pass, no shuffle."""
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in texts_of(batch, place):
                stay = model.score(_features(texts)) >= threshold
                yield batch.slice(first, last - first).filter(pa.array(stay))

    return arrow_map(documents, run, documents.schema)
