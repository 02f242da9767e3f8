"""Reading times and dates from text, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HAS_ZONE = "(Z|[+-]\\d{2}:?\\d{2}|UTC|GMT)$"
_EPOCH = "^\\d{9,19}(\\.\\d+)?$"


def parse_time(text: Column) -> Column:
    """A timestamp from ISO-like text or an epoch number; text without a zone is UTC, unreadable text is null.

    An epoch counts seconds, milli-, micro- or nanoseconds, told apart by its size.
    """
    plain = F.trim(text.cast("string"))
    zoned = (
        F.when(plain.rlike(_HAS_ZONE), plain)
        .when(F.length(plain) == 10, F.concat(plain, F.lit(" 00:00:00Z")))
        .otherwise(F.concat(plain, F.lit("Z")))
    )
    number = plain.try_cast("decimal(38,9)")
    micros = (
        F.when(number < F.lit(10**11), number * 1_000_000)
        .when(number < F.lit(10**14), number * 1_000)
        .when(number < F.lit(10**17), number)
        .otherwise(number / 1_000)
    )
    return F.when(plain.rlike(_EPOCH), F.timestamp_micros(F.floor(micros).cast("bigint"))).otherwise(
        zoned.try_cast("timestamp")
    )


def utc_date(moment: Column) -> Column:
    """The UTC day of a timestamp."""
    return F.date_from_unix_date(F.floor(F.unix_micros(moment) / 86_400_000_000).cast("int"))


# The date layouts of flow files, day first; tried in this order.
DAY_FIRST_LAYOUTS = [
    "d/M/yyyy H:m:s",
    "d/M/yyyy H:m",
    "d/M/yyyy h:m:s a",
    "d/M/yyyy h:m a",
    "d/M/yyyy",
    "d-M-yyyy H:m:s",
    "d-M-yyyy H:m",
    "d.M.yyyy H:m:s",
]


def parse_day_first(text: Column) -> Column:
    """``parse_time`` that also reads day-first dates."""
    plain = F.trim(text.cast("string"))
    wall = [
        F.try_to_timestamp(F.concat(plain, F.lit(" +0000")), F.lit(f"{layout} Z")) for layout in DAY_FIRST_LAYOUTS
    ]
    return F.coalesce(parse_time(plain), *wall)
