"""Running sums that split a long key into time slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_sums(
    rows: DataFrame, keys: list[str], slice_col: str, order: list[str], deltas: dict[str, str], totals_of: DataFrame | None = None
) -> DataFrame:
    """Add, by name, the sum of each delta over all rows of the key up to this one (peers in ``order`` included).

    A window over the key alone would put a busy key in one task, so it is cut into slices that follow the order. The
    total of all earlier slices enters each slice as one extra first row. Only slice totals, one row per key and slice,
    are ever windowed by key. Deltas are expressions over the rows, computed where the sums run: the rows are shuffled as
    they come. A name that is a column of the rows is replaced. ``totals_of`` has the same rows where ``rows`` are dear to make
    twice.
    """
    by, within = ", ".join(keys), ", ".join([*keys, slice_col])
    totals = (rows if totals_of is None else totals_of).groupBy(*keys, slice_col).agg(*[F.expr(f"sum({d})").alias(n) for n, d in deltas.items()])
    earlier = f"over (partition by {by} order by {slice_col} rows between unbounded preceding and 1 preceding)"
    before = ", ".join(f"'{n}', coalesce(sum({n}) {earlier}, 0L)" for n in deltas)
    carried = totals.selectExpr(*keys, slice_col, f"named_struct({before}) as _carried", "0 as _own")
    both = rows.selectExpr("*", "1 as _own").unionByName(carried, allowMissingColumns=True).repartition(*keys, slice_col)
    so_far = f"over (partition by {within} order by {', '.join(['_own', *order])} range unbounded preceding)"
    kept = [f"`{c}`" for c in rows.columns if c not in deltas]
    sums = [f"sum(case _own when 0 then _carried.{n} else {d} end) {so_far} as {n}" for n, d in deltas.items()]
    return both.selectExpr("_own", *kept, *sums).filter("_own = 1").drop("_own")
