"""Exact quantiles and the alert threshold."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.session import materialize

# Python workers get the functions below by value, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows the sketch may be off by: one in this many.
ACCURACY = 100_000


def exact_quantile(df: DataFrame, column: str, probability: float, accuracy: int = ACCURACY, most_values: int = 50_000) -> DataFrame:
    """One row ``(threshold, n_rows)``: the linearly interpolated quantile of all non-null values.

    A sketch brackets the wanted rank, and again inside the bracket until that holds at most ``most_values`` distinct
    values; each round leaves a few in ``accuracy`` of the rows and takes three numbers to the driver. Only what is in the
    last bracket is counted and ordered, so the one task that orders it has a bound. A bracket that misses the rank is an
    error, never a wrong answer.
    """
    values = df.select(F.col(column).cast("double").alias("_v")).filter("_v is not null")
    n, low, high = values.agg(F.count("_v"), F.min("_v"), F.max("_v")).first()
    if n == 0:
        return df.sparkSession.createDataFrame([(None, 0)], "threshold double, n_rows bigint")
    rank = probability * (n - 1)
    below, above, part = math.floor(rank), math.ceil(rank), rank - math.floor(rank)
    inside, before, margin = n, 0, 3.0 / accuracy
    while True:
        # Ranks within the bracket, widened by the sketch's error and by one row.
        ends = [max(0.0, (below - before - 1) / inside - margin), min(1.0, (above - before + 2) / inside + margin)]
        bracket = values.filter(F.col("_v").between(low, high))
        around = bracket.agg(F.percentile_approx("_v", ends, accuracy)).first()[0]
        narrower = (around[0], around[1]) != (low, high)
        low, high = around
        held = F.col("_v").between(low, high)
        inside, before, distinct = values.agg(
            F.count_if(held), F.count_if(F.col("_v") < low), F.approx_count_distinct(F.when(held, F.col("_v")))
        ).first()
        if distinct <= most_values or not narrower:
            break
    counted = values.filter(F.col("_v").between(low, high)).groupBy("_v").count()
    ranked = counted.selectExpr("_v", f"{before} + sum(count) over (order by _v rows unbounded preceding) as _upto")
    found = ranked.agg(
        F.expr(f"min(case when _upto > {below} then struct(_upto, _v) end)._v").alias("_low"),
        F.expr(f"min(case when _upto > {above} then struct(_upto, _v) end)._v").alias("_high"),
        F.lit(before <= below and before + inside > above).alias("_holds"),
    )
    missed = "cast(raise_error('quantile bracket missed its rank; raise the accuracy') as double)"
    return found.selectExpr(f"if(_holds, _low + (_high - _low) * {part}D, {missed}) as threshold", f"bigint({n}) as n_rows")


def threshold_value(
    scores: DataFrame, column: str = "anom_score", contamination: float = 0.05, method: str = "quantile"
) -> float | None:
    """The score from which on a row is an alert; none when there are no scores.

    Method ``quantile`` takes the exact quantile ``1 - contamination``, any other the mean plus one sample deviation.
    """
    if method == "quantile":
        return exact_quantile(scores, column, 1.0 - contamination).first()["threshold"]
    return scores.agg(F.avg(column) + F.stddev_samp(column)).first()[0]


def compute_threshold(
    scores: DataFrame, column: str = "anom_score", contamination: float = 0.05, method: str = "quantile"
) -> DataFrame:
    """One row ``(threshold, n_alerts)``: the threshold and how many rows reach it."""
    limit = threshold_value(scores, column, contamination, method)
    return scores.agg(
        F.lit(limit).cast("double").alias("threshold"), F.count_if(F.col(column) >= F.lit(limit)).alias("n_alerts")
    )


#: Bits of a value that one pass over the rows settles.
DIGIT = 16


def _ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order; both zeros are one. ``_value`` is the way back."""
    bits = (values + 0.0).view("int64")
    return bits ^ ((bits >> 63) & 0x7FFF_FFFF_FFFF_FFFF)


def _value(key: int) -> float:
    return float(np.array([key ^ ((key >> 63) & 0x7FFF_FFFF_FFFF_FFFF)], "int64").view("float64")[0])


def _digit_counts(prefixes: list[list[int] | None], shift: int, most_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per column: how many values share their bits above ``shift``, and the least and greatest of them.

    ``prefixes`` holds per column the places, a digit shorter, to look into, or none for all of it.
    """
    names = ["place", "bin", "n", "low", "high"]

    def added(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts).groupby(["place", "bin"], as_index=False).agg({"n": "sum", "low": "min", "high": "max"})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pd.DataFrame] = []
        gathered = 0
        for batch in batches:
            for place, wanted in enumerate(prefixes):
                keys = _ordered(batch.column(place).to_numpy(zero_copy_only=False))
                if wanted is not None:
                    keys = keys[np.isin(keys >> (shift + DIGIT), wanted)]
                if not len(keys):
                    continue
                keys = np.sort(keys)
                bins = keys >> shift
                first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
                after = np.append(first[1:], len(keys))
                parts.append(pd.DataFrame(dict(zip(names, (place, bins[first], after - first, keys[first], keys[after - 1])))))
                gathered += len(first)
            if gathered > most_rows:
                parts = [added(parts)]
                gathered = len(parts[0])
                if gathered > most_rows // 2:
                    yield pa.RecordBatch.from_pandas(parts[0][names], preserve_index=False)
                    parts, gathered = [], 0
        if parts:
            yield pa.RecordBatch.from_pandas(added(parts)[names], preserve_index=False)

    return count


def column_quantiles(df: DataFrame, columns: list[str], most_rows: int = 500_000) -> DataFrame:
    """Per column: rows, least and greatest value, and the exact quartiles, with null and what is no number taken as 0.

    Returns ``(feature, n_rows, low, q25, q50, q75, high)``. Values are searched digit by digit: each pass counts, for all
    columns at once, the values by their next 16 bits and looks only into the places that hold a wanted rank. A place whose
    values are all equal is an answer, so most columns need one pass, and none more than four. Only counts are shuffled, at
    most 65,536 for each place looked into, whatever the rows; a task gathers ``most_rows`` of them before it adds them up. To the driver come a few numbers per column and quartile.
    """
    spark, probabilities = df.sparkSession, [0.25, 0.5, 0.75]
    done: dict[tuple[str, int], int] = {}
    ends: dict[str, tuple[int, int]] = {}
    n, ranks = 0, []
    # What is still looked for: the column and rank, the place that holds it and the values before that place.
    looked: dict[tuple[str, int], tuple[int | None, int]] = {}
    for shift in range(64 - DIGIT, -1, -DIGIT):
        names = list(columns) if not ends else sorted({c for c, _ in looked})
        if not names:
            break
        filled = df.selectExpr(*[f"coalesce(nanvl(try_cast(`{c}` as double), 0D), 0D) as `{c}`" for c in names])
        within = [sorted({p for (c, _), (p, _) in looked.items() if c == name}) if looked else None for name in names]
        pieces = filled.mapInArrow(_digit_counts(within, shift, most_rows), "place long, bin long, n long, low long, high long")
        counts = pieces.groupBy("place", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        if not ends:
            counts = materialize(counts, "digits")
            shape = counts.groupBy("place").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
            if not shape:
                return spark.createDataFrame([], "feature string, n_rows long, low double, q25 double, q50 double, q75 double, high double")
            n = shape[0]["n"]
            ranks = [p * (n - 1) for p in probabilities]
            ends = {names[r["place"]]: (r["low"], r["high"]) for r in shape}
            looked = {(c, rank): (None, 0) for c in names for r in ranks for rank in (math.floor(r), math.ceil(r))}
        wanted = [(names.index(c), rank, prefix, rank - before) for (c, rank), (prefix, before) in looked.items()]
        asked = F.broadcast(spark.createDataFrame(wanted, "at long, rank long, prefix long, inner long"))
        group = F.lit(0) if wanted[0][2] is None else F.shiftright("bin", DIGIT)
        order = Window.partitionBy("place", "prefix_of").orderBy("bin")
        ranked = counts.withColumn("prefix_of", group.cast("long")).withColumn("upto", F.sum("n").over(order))
        here = (F.col("place") == F.col("at")) & (F.col("prefix_of") == F.coalesce("prefix", F.lit(0)))
        holds = (F.col("upto") > F.col("inner")) & (F.col("upto") - F.col("n") <= F.col("inner"))
        for r in ranked.join(asked, here & holds).collect():
            target = (names[r["place"]], r["rank"])
            if r["low"] == r["high"]:
                done[target] = r["low"]
                del looked[target]
            else:
                looked[target] = (r["bin"], looked[target][1] + r["upto"] - r["n"])

    def quartile(c: str, rank: float) -> float:
        below, above = (_value(done[c, end]) for end in (math.floor(rank), math.ceil(rank)))
        return below + (above - below) * (rank - math.floor(rank))

    found = [(c, n, _value(ends[c][0]), *[quartile(c, rank) for rank in ranks], _value(ends[c][1])) for c in ends]
    return spark.createDataFrame(found, "feature string, n_rows long, low double, q25 double, q50 double, q75 double, high double")


def sketch_error(k: int) -> float:
    """Rank error, as a share of all rows, that a KLL sketch of size ``k`` keeps with a probability of 99 %, merged or not."""
    return 2.296 / k**0.9433


def score_sketches(scores: DataFrame, by: list[str], column: str = "anom_score", k: int = 1_024) -> DataFrame:
    """``(by..., sketch, n_rows)``: a KLL sketch of the scores of each group, some kilobytes however many rows it has.

    To be stored with the scores, a row for each window. Null scores are left out; a group of nothing else has no row.
    """
    given = scores.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("_v"))
    return given.groupBy(*by).agg(F.kll_sketch_agg_double("_v", k).alias("sketch"), F.count("_v").alias("n_rows"))


def merged_threshold(sketches: DataFrame, by: list[str] | None = None, contamination: float = 0.05) -> DataFrame:
    """``(by..., threshold, n_rows)``: the quantile ``1 - contamination`` of all scores in the groups' merged sketches.

    Any span of windows has its threshold so, without a look at its scores; off by at most ``sketch_error`` of the ranks.
    """
    merged = sketches.groupBy(*(by or [])).agg(F.kll_merge_agg_double("sketch").alias("_sketch"), F.sum("n_rows").alias("n_rows"))
    return merged.select(*(by or []), F.kll_sketch_get_quantile_double("_sketch", F.lit(1.0 - contamination)).alias("threshold"), "n_rows")
