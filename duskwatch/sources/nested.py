"""Nested event documents that are already a DataFrame with struct columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskwatch.schema import column_name

# The fields lifted out of each nested object.
NESTED_FIELDS = {
    "event": ["code", "outcome", "action", "dataset", "module", "severity"],
    "source": ["ip", "port"],
    "destination": ["ip", "port"],
    "network": ["bytes", "packets", "protocol", "transport"],
}


def flatten(df: DataFrame) -> DataFrame:
    """Lift the nested fields into flat columns, row by row, where the flat column is absent or null.

    Flat columns may be dotted (``source.ip``) or already named ``source_ip``; the result uses the latter. Ports become
    whole numbers, unreadable ones null. The nested columns are dropped.
    """
    flat: dict[str, list] = {}
    nested = []
    for name in df.columns:
        kind = df.schema[name].dataType
        if name in NESTED_FIELDS and isinstance(kind, T.StructType):
            nested.append(name)
        else:
            flat.setdefault(column_name(name), []).append(F.col(f"`{name}`"))
    for name in nested:
        inside = df.schema[name].dataType
        for field in NESTED_FIELDS[name]:
            if field in inside.fieldNames():
                flat.setdefault(f"{name}_{field}", []).append(F.col(f"`{name}`").getField(field))
    columns = []
    for name, found in flat.items():
        if name in ("source_port", "destination_port"):
            value = F.coalesce(*[c.try_cast("double") for c in found]).try_cast("int")
        elif len(found) > 1:
            value = F.coalesce(*[c.cast("string") for c in found])
        else:
            value = found[0]
        columns.append(value.alias(name))
    return df.select(*columns)
