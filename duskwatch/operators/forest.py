"""Isolation forest as a distributed job: scaling, training, scoring, attribution.

Method: F. T. Liu, K. M. Ting, Z.-H. Zhou, "Isolation Forest", ICDM 2008. Every draw, of rows, features and cuts, is an MD5 of
seed, tree and place, so a forest is the same wherever and in whatever engine it is grown.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.operators.firstk import required_id
from duskwatch.operators.quantile import column_quantiles, threshold_value
from duskwatch.session import materialize

# Python workers get the functions below by value, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE_SCHEMA = (
    "tree_id int, node_id int, feature int, split double, left int, right int, depth int, n long"
)
EULER_GAMMA = 0.5772156649


@dataclass
class ForestModel:
    """Node table plus what is needed to prepare rows: feature names, medians, ranges, sample size, score offset."""

    nodes: pd.DataFrame
    features: list[str]
    center: list[float]
    scale: list[float]
    sample_size: int
    offset: float = 0.0


def mean_path(n):
    """Mean length of an unsuccessful search among ``n`` points, the part of a path a leaf leaves out."""
    n = np.asarray(n, dtype="float64")
    big = np.maximum(n, 3.0)
    grown = 2.0 * (np.log(big - 1.0) + EULER_GAMMA) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, grown, np.where(n == 2, 1.0, 0.0))


def prepared(features: list[str]) -> list[str]:
    """Model inputs as SQL: what is null, NaN or no number becomes 0."""
    return [f"coalesce(nanvl(try_cast(`{name}` as double), 0D), 0D)" for name in features]


def _scaled(features: list[str], center: list[float], scale: list[float]) -> list[str]:
    return [f"(({v}) - ({c!r}D)) / ({s!r}D)" for v, c, s in zip(prepared(features), map(float, center), map(float, scale))]


def scaler_table(df: DataFrame, features: list[str]) -> DataFrame:
    """Median and quartile distance per feature, with 0 for null, and whether the feature is constant."""
    spread = F.col("q75") - F.col("q25")
    return column_quantiles(df, features).select(
        "feature",
        F.col("q50").alias("center"),
        F.when(spread == 0, 1.0).otherwise(spread).alias("scale"),
        (F.col("low") == F.col("high")).alias("constant"),
        "n_rows",
    )


def scale_columns(df: DataFrame, features: list[str], center: list[float], scale: list[float]) -> DataFrame:
    """``(value - center) / scale`` in place, null counted as 0."""
    scaled = dict(zip(features, _scaled(features, center, scale)))
    return df.selectExpr(*[f"{scaled[n]} as `{n}`" if n in scaled else f"`{n}`" for n in df.columns])


def robust_scale(df: DataFrame, features: list[str]) -> DataFrame:
    """Fit and apply: each feature less its median, over its quartile distance (or 1 where that is 0)."""
    fitted = {row["feature"]: row for row in scaler_table(df, features).collect()}  # one row per feature
    return scale_columns(df, features, [fitted[f]["center"] for f in features], [fitted[f]["scale"] for f in features])


def _vector(model_features: list[str], center: list[float], scale: list[float]) -> Column:
    return F.expr("array(" + ", ".join(_scaled(model_features, center, scale)) + ")")


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5, the same wherever the row is."""
    digits = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long").cast("double") * F.lit(2.0**-52)


def _draw(*parts) -> float:
    """What ``_uniform`` gives for the same values."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) * 2.0**-52


def tree_samples(rows: DataFrame, id_col: str, n_rows: int, trees: int, sample_size: int, seed: int) -> DataFrame:
    """``(tree_id, _order, x)``: for each tree the ``sample_size`` rows with the smallest hash of row and tree.

    Every tree draws each row with the same chance, which leaves some more than it needs, and the smallest hashes decide.
    The first tree that draws a row is found from one number, so rows that no tree draws, nearly all of a large table, cost
    one hash; the later trees of the others draw one by one. The draw is the same at every size and partitioning.
    """
    chance = min(1.0, (sample_size + 8.0 * math.sqrt(sample_size) + 8.0) / max(n_rows, 1))
    if chance < 1.0:
        # The number of trees that pass a row over before one draws it is geometric.
        first = F.floor(F.log1p(-_uniform(F.lit(seed), F.col(id_col))) / F.lit(math.log1p(-chance))).cast("long")
    else:
        first = F.lit(0).cast("long")
    begun = rows.withColumn("_first", first).filter(F.col("_first") < trees)
    drawn = F.filter(
        F.sequence(F.col("_first"), F.lit(trees - 1).cast("long")),
        lambda tree: (tree == F.col("_first")) | (_uniform(F.lit(seed + 1), F.col(id_col), tree) < F.lit(chance)),
    )
    spread = begun.withColumn("tree_id", F.explode(F.transform(drawn, lambda tree: tree.cast("int")))).withColumn("_order", _uniform(F.lit(seed + 2), F.col(id_col), F.col("tree_id")))
    place = F.row_number().over(Window.partitionBy("tree_id").orderBy("_order", id_col))
    return spread.withColumn("_place", place).filter(F.col("_place") <= sample_size).select("tree_id", "_order", "x")


def _grow(sample: pd.DataFrame, sample_size: int, seed: int) -> pd.DataFrame:
    """One tree from its sample, level by level: a drawn feature among those that vary, a drawn cut between their ends.

    Draws go by the place in the tree: the root is 1, the children of p are 2p and 2p + 1. Node ids number the places.
    """
    points = np.stack(sample["x"].to_numpy())
    tree = int(sample["tree_id"].iloc[0])
    limit = math.ceil(math.log2(max(sample_size, 2)))
    nodes: list[list] = []
    waiting = [(np.arange(len(points)), 0, 1, -1, "")]
    for members, depth, place, parent, side in waiting:
        node = len(nodes)
        if parent >= 0:
            nodes[parent][4 if side == "left" else 5] = node
        nodes.append([tree, node, -1, 0.0, -1, -1, depth, len(members)])
        if depth >= limit or len(members) < 2:
            continue
        low, high = points[members].min(axis=0), points[members].max(axis=0)
        varying = np.flatnonzero(high > low)
        if not len(varying):
            continue
        feature = int(varying[int(_draw(seed, tree, place, "feature") * len(varying))])
        cut = float(low[feature] + (high[feature] - low[feature]) * _draw(seed, tree, place, "cut"))
        goes_left = points[members, feature] <= cut
        nodes[node][2], nodes[node][3] = feature, cut
        waiting.append((members[goes_left], depth + 1, 2 * place, node, "left"))
        waiting.append((members[~goes_left], depth + 1, 2 * place + 1, node, "right"))
    return pd.DataFrame(nodes, columns=["tree_id", "node_id", "feature", "split", "left", "right", "depth", "n"])


def train_nodes(
    rows: DataFrame, id_col: str, n_rows: int, trees: int = 150, max_samples: int = 256, seed: int = 42
) -> DataFrame:
    """Node table of a forest over ``rows(id_col, x)``; each tree is grown from at most ``max_samples`` rows."""
    size = min(max_samples, n_rows)
    sample = tree_samples(rows, id_col, n_rows, trees, size, seed)
    return sample.groupBy("tree_id").applyInPandas(lambda pdf: _grow(pdf, size, seed), NODE_SCHEMA)


class _Walker:
    """The node table as arrays, walked by all rows and trees at once."""

    def __init__(self, nodes: pd.DataFrame, sample_size: int):
        ordered = nodes.sort_values(["tree_id", "node_id"])
        sizes = ordered.groupby("tree_id").size().to_numpy()
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        shift = np.repeat(starts, sizes)
        own = np.arange(len(ordered))
        leaf = ordered["feature"].to_numpy() < 0
        self.roots = starts
        self.feature = np.where(leaf, 0, ordered["feature"].to_numpy())
        self.split = np.where(leaf, np.inf, ordered["split"].to_numpy())
        self.left = np.where(leaf, own, ordered["left"].to_numpy() + shift)
        self.right = np.where(leaf, own, ordered["right"].to_numpy() + shift)
        self.depth = ordered["depth"].to_numpy().astype("float64")
        self.count = ordered["n"].to_numpy().astype("float64")
        self.length = self.depth + mean_path(self.count)
        self.levels = int(self.depth.max()) if len(ordered) else 0
        self.trees = max(len(sizes), 1)
        self.norm = max(float(mean_path(sample_size)), 1e-12)
        self.leaf = leaf
        # Mean length below each node, from the deepest level up.
        self.expected = self.length.copy()
        for level in range(self.levels - 1, -1, -1):
            inner = np.flatnonzero(~leaf & (self.depth == level))
            a, b = self.left[inner], self.right[inner]
            total = self.count[a] + self.count[b]
            self.expected[inner] = (self.expected[a] * self.count[a] + self.expected[b] * self.count[b]) / total

    def scores(self, points: np.ndarray) -> np.ndarray:
        rows = np.arange(len(points))[:, None]
        at = np.tile(self.roots, (len(points), 1))
        for _ in range(self.levels):
            at = np.where(points[rows, self.feature[at]] <= self.split[at], self.left[at], self.right[at])
        return np.power(2.0, -self.length[at].mean(axis=1) / self.norm)

    def contributions(self, points: np.ndarray) -> np.ndarray:
        """Per row and feature: how much shorter the splits on that feature make the mean path (positive = anomalous)."""
        expected = self.expected
        gained = np.zeros(points.shape)
        rows = np.arange(len(points))[:, None]
        at = np.tile(self.roots, (len(points), 1))
        for _ in range(self.levels):
            after = np.where(points[rows, self.feature[at]] <= self.split[at], self.left[at], self.right[at])
            np.add.at(gained, (np.broadcast_to(rows, at.shape), self.feature[at]), expected[at] - expected[after])
            at = after
        return gained / self.trees


def _points(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def path_score(model: ForestModel) -> Column:
    """``2^(-mean path / expected path)`` of each row, between 0 and 1."""
    nodes, size = model.nodes, model.sample_size

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        walker = _Walker(nodes, size)
        for batch in batches:
            points = _points(batch)
            pieces = [walker.scores(points[i : i + 2048]) for i in range(0, len(points), 2048)]
            yield pa.array(np.concatenate(pieces) if pieces else np.zeros(0))

    # Declared non-deterministic: a filter on the score must neither run the forest twice nor enter the constraints that
    # the optimizer derives, whose number explodes with the many inputs. Filter other columns before scoring.
    return score.asNondeterministic()(_vector(model.features, model.center, model.scale))


def train(
    table: DataFrame,
    features: list[str],
    id_col: str = "event_id",
    trees: int = 150,
    max_samples: int = 256,
    contamination: float = 0.05,
    seed: int = 42,
) -> ForestModel:
    """Drop constant features, fit the scaler, grow the forest and set the score offset.

    What comes back to the driver is one row per feature and the node table, at most ``trees * (2 * max_samples - 1)``
    rows; the table itself is only aggregated, hashed and sampled.
    """
    fitted = {row["feature"]: row for row in scaler_table(table, features).collect()}
    used = [f for f in features if f in fitted and not fitted[f]["constant"]]
    if not used:
        raise ValueError("no feature varies, nothing to train on")
    center, scale = [fitted[f]["center"] for f in used], [fitted[f]["scale"] for f in used]
    n_rows = int(fitted[used[0]]["n_rows"])
    rows = table.select(required_id(table, id_col), _vector(used, center, scale).alias("x"))
    nodes = train_nodes(rows, id_col, n_rows, trees, max_samples, seed).toPandas()
    if nodes["tree_id"].nunique() != trees:
        raise ValueError(f"{nodes['tree_id'].nunique()} of {trees} trees drew rows; are the ids distinct?")
    model = ForestModel(nodes, used, center, scale, min(max_samples, n_rows))
    own = materialize(table.select(path_score(model).alias("s")), "training-scores")
    model.offset = float(threshold_value(own, "s", contamination))
    return model


def score(df: DataFrame, model: ForestModel, column: str = "anom_score") -> DataFrame:
    """Add the anomaly score; above 0 lie ``contamination`` of the training rows. Absent features count as 0."""
    absent = {name: F.lit(0.0) for name in model.features if name not in df.columns}
    ready = df.withColumns(absent) if absent else df
    return ready.withColumn(column, path_score(model) - F.lit(model.offset)).drop(*absent)


def top_features(names: list[str], values: Column, k: int = 5) -> Column:
    """The ``k`` largest entries by absolute value as ``(feature, value)`` pairs; ties go by name."""
    labels = F.split(F.lit("\n".join(names)), "\n")
    pairs = F.zip_with(
        labels, values, lambda name, v: F.struct((-F.abs(v)).alias("_rank"), name.alias("feature"), v.alias("value"))
    )
    return F.transform(
        F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(p["feature"].alias("feature"), p["value"].alias("value"))
    )


def top_raw_features(features: list[str], k: int = 5) -> Column:
    """Rank features by absolute value in the row, for when there is no model."""
    return top_features(features, F.expr("array(" + ", ".join(prepared(features)) + ")"), k)


def attribution(alerts: DataFrame, model: ForestModel, k: int = 5) -> DataFrame:
    """Add ``top_features``: the features whose splits shorten or lengthen the path of an alert most, ties by name."""
    nodes, size, names = model.nodes, model.sample_size, np.array(model.features)

    @F.arrow_udf("array<struct<feature:string,value:double>>")
    def strongest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        walker = _Walker(nodes, size)
        kind = pa.list_(pa.struct([("feature", pa.string()), ("value", pa.float64())]))
        for batch in batches:
            points, ranked = _points(batch), []
            for start in range(0, len(points), 1024):
                for row in walker.contributions(points[start : start + 1024]):
                    best = np.lexsort((names, -np.abs(row)))[:k]
                    ranked.append([{"feature": str(names[i]), "value": float(row[i])} for i in best])
            yield pa.array(ranked, type=kind)

    return alerts.withColumn(
        "top_features", strongest.asNondeterministic()(_vector(model.features, model.center, model.scale))
    )


def save(model: ForestModel, spark, path: str) -> None:
    """The model as two small Parquet tables: ``nodes`` and ``features``."""
    spark.createDataFrame(model.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    rows = [
        (place, name, float(c), float(s), model.sample_size, model.offset)
        for place, (name, c, s) in enumerate(zip(model.features, model.center, model.scale))
    ]
    schema = "place int, feature string, center double, scale double, sample_size int, offset double"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def load(spark, path: str) -> ForestModel:
    rows = spark.read.parquet(f"{path}/features").orderBy("place").collect()
    return ForestModel(
        spark.read.parquet(f"{path}/nodes").toPandas(),
        [r["feature"] for r in rows],
        [r["center"] for r in rows],
        [r["scale"] for r in rows],
        rows[0]["sample_size"],
        rows[0]["offset"],
    )
