"""The first k rows in some order, for k too large to keep in one heap; and samples built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_SLICES = 65_536


def first_k(df: DataFrame, k: int, slice_of: Column, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The first ``k`` rows by ``order``, per group of ``by`` where given.

    ``slice_of`` is a whole number that never falls along the order. Counting rows per slice tells which slice holds
    row k, and only that slice is ordered. The result itself is in no order.
    """
    by = by or []
    marked = df.withColumn("_slice", slice_of)
    counts = marked.groupBy(*by, "_slice").count()
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).filter(F.col("_before") < k)
    # Slices before the last one needed are kept whole and unordered; only the last is ordered and cut.
    if not by:
        last = needed.agg(F.max(F.struct("_slice", "_before")).alias("_end")).first()["_end"]
        if last is None:
            return df.limit(0)
        whole = marked.filter(F.col("_slice") < last["_slice"])
        cut = marked.filter(F.col("_slice") == last["_slice"]).orderBy(*order).limit(k - last["_before"])
        return whole.union(cut).drop("_slice")
    last = needed.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.max(F.struct("_slice", "_before")).alias("_end"))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    kept = marked.join(last, same, "inner")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    whole = kept.filter(F.col("_slice") < F.col("_end._slice"))
    cut = kept.filter(F.col("_slice") == F.col("_end._slice")).withColumn("_place", place)
    cut = cut.filter(F.col("_place") <= F.lit(k) - F.col("_end._before")).drop("_place")
    return whole.union(cut).drop("_slice", "_end", *[f"_by_{c}" for c in by])


def required_id(df: DataFrame, id_col: str) -> Column:
    """The id column, or an error at the first row without an id: draws and ties would be undefined."""
    return F.coalesce(F.col(id_col), F.raise_error(F.lit(f"a row has no {id_col}")).cast(df.schema[id_col].dataType)).alias(id_col)


def hash_sample(df: DataFrame, k: int, id_col: str, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """A repeatable sample of at most ``k`` rows (per group): those whose seeded id hash is smallest.

    The hash is the first 60 bits of the MD5 of seed and id, as every SQL engine has it. The sample depends only on the rows
    and the seed, not on how the table is partitioned. A null id is an error.
    """
    df = df.withColumn(id_col, required_id(df, id_col))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    code = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    return first_k(df, k, F.shiftright(code, 60 - HASH_SLICES.bit_length() + 1), [code, F.col(id_col)], by)


def time_range(
    events: DataFrame,
    start: Column,
    end: Column,
    max_rows: int | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Events with ``start <= event_time <= end``, the earliest ``max_rows`` of them where a limit is given.

    Tables with a ``dt`` partition column also get the date bounds, so that other days are not listed or read.
    """
    moment = F.col("event_time")
    found = events.filter((moment >= start) & (moment <= end))
    if "dt" in events.columns:
        found = found.filter((F.col("dt") >= F.to_date(start)) & (F.col("dt") <= F.to_date(end)))
    if where is not None:
        found = found.filter(where)
    if max_rows is None:
        return found
    return first_k(found, max_rows, F.floor(F.unix_micros(moment) / 60_000_000), [moment, F.col("event_id")])
