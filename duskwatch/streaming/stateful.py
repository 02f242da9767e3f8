"""Rolling counters kept as stream state.

The trailing counts of an entity need only its last few minutes. They are held as one row per instant, and each
micro-batch is first reduced to such rows, so neither the state nor a call grows with the number of equal instants.
For entities too busy for one task use ``streaming.windows.WindowSink``, whose counts are not tied to one task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MINUTE_US = 60_000_000


def _merge(times: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort by time and add up equal times."""
    unique, place = np.unique(times, return_inverse=True)
    summed = np.zeros((len(unique), values.shape[1]), dtype="int64")
    np.add.at(summed, place, values)
    return unique, summed


def rolling_counts(
    events: DataFrame, key: Column, flags: list[str], windows: tuple[int, ...] = (1, 5, 15), late_minutes: int = 20
) -> DataFrame:
    """``(entity, t_us, version, <flag>_count_<w>m ...)`` in update mode: a row whenever an instant's counts may have changed.

    Later events of the same instant, and late ones up to a window before it, give the instant a new row with a higher
    ``version``; ``latest`` keeps the last. Events later than ``late_minutes`` are dropped by the watermark, and so is an
    entity's state when the watermark has left it behind.
    """
    span = max(windows) * MINUTE_US
    keep = span + late_minutes * MINUTE_US
    names = [f"{flag}_count_{w}m" for flag in flags for w in windows]

    def update(entity: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            old_times, old_flat, version = state.get
            times = np.array(old_times, dtype="int64")
            values = np.array(old_flat, dtype="int64").reshape(len(times), len(flags))
        else:
            times, values, version = np.zeros(0, dtype="int64"), np.zeros((0, len(flags)), dtype="int64"), 0
        new_times = np.zeros(0, dtype="int64")
        for batch in batches:
            moments = batch["t_us"].to_numpy(dtype="int64")
            new_times = np.union1d(new_times, moments)
            times, values = _merge(np.concatenate([times, moments]), np.vstack([values, batch[flags].to_numpy(dtype="int64")]))
        before = np.vstack([np.zeros((1, len(flags)), dtype="int64"), values.cumsum(axis=0)])
        # Changed: instants with a new event in the longest window that ends with them.
        changed = times[np.searchsorted(new_times, times, side="right") > np.searchsorted(new_times, times - span, side="right")]
        upto = np.searchsorted(times, changed, side="right")
        result = {"entity": [entity[0]] * len(changed), "t_us": changed, "version": np.full(len(changed), version + 1, dtype="int64")}
        for i, flag in enumerate(flags):
            for w in windows:
                gone = np.searchsorted(times, changed - w * MINUTE_US, side="right")
                result[f"{flag}_count_{w}m"] = before[upto, i] - before[gone, i]
        recent = times > times[-1] - keep
        state.update((times[recent].tolist(), values[recent].ravel().tolist(), version + 1))
        state.setTimeoutTimestamp(max(int(times[-1] + keep) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(result)

    flag_columns = [F.coalesce(F.col(flag), F.lit(0)).cast("bigint").alias(flag) for flag in flags]
    return (
        events.withWatermark("event_time", f"{late_minutes} minutes")
        .select("event_time", key.alias("entity"), F.unix_micros("event_time").alias("t_us"), *flag_columns)
        .groupBy("entity")
        .applyInPandasWithState(
            update,
            "entity string, t_us bigint, version bigint, " + ", ".join(f"{n} bigint" for n in names),
            "times array<bigint>, counts array<bigint>, version bigint",
            "update",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each entity and instant, without its version."""
    counts = [c for c in rows.columns if c not in ("entity", "t_us", "version")]
    return rows.groupBy("entity", "t_us").agg(*[F.max_by(c, "version").alias(c) for c in counts])
