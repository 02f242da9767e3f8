"""Trailing time-window counts, sums and distinct counts per key.

The frame of an event at time t is (t - w, t]: events of the same instant are in, an event exactly w old is out.

Every value enters a running sum at its own time and leaves it w later, so the work is linear in the rows however full a
frame is. The events themselves go through the sums, so nothing has to be joined back to them, and the sums run in time
slices (``running_sums``), so no task ever holds a whole key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.operators.running import running_sums

MINUTE_US = 60_000_000
# Traffic amounts are summed as decimals, so that adding and removing leaves no rounding drift.
AMOUNT = "decimal(38,6)"


def as_amount(value: Column) -> Column:
    """A byte or packet amount to a millionth; what is no number or has over 32 whole digits is null and adds nothing."""
    return value.try_cast("double").try_cast(AMOUNT)


def _names(template: str, windows: tuple[int, ...]) -> list[str]:
    return [template.format(w=w) for w in windows]


def _with_exits(placed: DataFrame, values: list[str], windows: tuple[int, ...]) -> DataFrame:
    """Each row and, where it has values, one more per window for when they leave again, with key and values only.

    All come of one pass over the rows, as their values may be dear to find. The outer form keeps the optimizer from
    asking first whether there is anything to repeat, which would find the values a second time.
    """
    something = " or ".join(f"{c} != 0" for c in values)
    ages = ", ".join(f"{w * MINUTE_US}L" for w in windows)
    every = placed.selectExpr("*", f"explode_outer(if(_at is not null and ({something}), array(0L, {ages}), array(0L))) as _age")
    kept = ["_key", *values]
    bare = [f"if(_age = 0, `{c}`, null) as `{c}`" for c in placed.columns if c not in (*kept, "_at")]
    return every.selectExpr(*kept, *bare, "_at + _age as _at", "_age", "if(_age = 0, 1, 0) as _enters", "_age = 0 as _event")


def _presence(source: DataFrame, value: str, template: str, windows: tuple[int, ...]) -> DataFrame:
    """Rows that add 1 when a value becomes present for its key and take 1 off when it has been gone for a window.

    Of equal moments only the first can begin a presence and only the last can end one, so they need not be made distinct.
    """
    span = max(windows) * MINUTE_US
    seen = (
        source.filter(f"{value} is not null")
        .selectExpr("_key", f"string({value}) as _value", "_t", f"floor(_t / {span}) as _span")
    )
    # A neighbour further away than the longest window has no effect, so the nearest instants of the two adjacent
    # spans are all the context a span needs.
    context = (
        seen.groupBy("_key", "_value", "_span")
        .agg(F.expr("array(struct(_span + 1, max(_t)), struct(_span - 1, min(_t)))").alias("_edges"))
        .selectExpr("_key", "_value", "inline(_edges) as (_span, _t)", "false as _own")
    )
    in_span = "over (partition by _key, _value, _span order by _t)"
    names = _names(template, windows)
    steps = ["_t, 1", *[f"bigint(_prev is null or _prev <= _t - {w * MINUTE_US})" for w in windows]]
    for w, name in zip(windows, names):
        gone = f"-bigint(_next is null or _next >= _t + {w * MINUTE_US})"
        steps += [f"_t + {w * MINUTE_US}, 0", *[gone if n == name else "0L" for n in names]]
    return (
        seen.selectExpr("*", "true as _own")
        .unionByName(context)
        .selectExpr("_key", "_t", "_own", f"lag(_t) {in_span} as _prev", f"lead(_t) {in_span} as _next")
        .filter("_own")
        .selectExpr("_key", f"stack({len(windows) + 1}, {', '.join(steps)}) as (_at, _enters, {', '.join(names)})")
        .filter(" or ".join(f"{n} != 0" for n in names))
    )


def rolling(
    events: DataFrame,
    key: Column,
    sums: dict[str, str] | None = None,
    distincts: dict[str, str] | None = None,
    time_us: Column | None = None,
    windows: tuple[int, ...] = (1, 5, 15),
    slice_seconds: int = 60,
    of: DataFrame | None = None,
) -> DataFrame:
    """The same events with the rolling features of their key and instant; without a time these are null.

    ``sums`` maps a whole-number column to the name of its trailing sum, ``distincts`` a column to the name of its
    trailing distinct count; ``{w}`` in a name stands for the minutes. ``of`` is
    the same events without other features they already have, so that those are made once only.
    """
    sums, distincts = sums or {}, distincts or {}
    moment = F.unix_micros("event_time") if time_us is None else time_us
    # Decimal amounts stay decimals; flags and other numbers are counted as whole numbers.
    kinds = {c: AMOUNT if events.schema[c].dataType.typeName() == "decimal" else "bigint" for c in sums}
    values = {
        f"_value_{i}": F.expr(f"if(_at is null, 0, coalesce(cast({c} as {kind}), 0))").cast(kind)
        for i, (c, kind) in enumerate(kinds.items())
    }
    source = events if of is None else of

    steps, deltas = [], {}
    for value, template in zip(values, sums.values()):
        for w, name in zip(windows, _names(template, windows)):
            deltas[name] = f"case _age when 0 then {value} when {w * MINUTE_US} then -{value} else 0L end"
    for value, template in distincts.items():
        seen = source.select(key.alias("_key"), moment.alias("_t"), value).filter("_t is not null")
        steps.append(_presence(seen, value, template, windows))
        # The running sum takes the name over from the steps.
        deltas |= {name: f"coalesce({name}, 0L)" for name in _names(template, windows)}

    def points(table: DataFrame) -> DataFrame:
        placed = table.withColumns({"_key": key, "_at": moment})
        if sums:
            moving = _with_exits(placed.withColumns(values), list(values), windows)
        else:
            moving = placed.withColumns({"_enters": F.lit(1), "_event": F.lit(True)})
        every = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), [moving, *steps])
        return every.withColumn("_slice", F.expr(f"floor(_at / {slice_seconds * 1_000_000})"))

    summed = running_sums(points(events), ["_key"], "_slice", ["_at", "_enters"], deltas, points(source))
    features = [f"if(_at is null, null, double({n})) as {n}" for n in deltas]
    return summed.filter("_event").selectExpr(*[f"`{c}`" for c in events.columns], *features)


def add_ratios(events: DataFrame, windows: tuple[int, ...] = (1, 5, 15)) -> DataFrame:
    """Share of denied and of failed events among the decided ones, per window."""
    ratios = []
    for w in windows:
        deny, allow, failed = (f"{c}_count_{w}m" for c in ("action_deny", "action_allow", "login_failed"))
        ratios.append(f"{deny} / ({deny} + {allow} + 1e-6D) as deny_ratio_{w}m")
        ratios.append(f"{failed} / ({failed} + {allow} + {deny} + 1e-6D) as login_failed_ratio_{w}m")
    return events.selectExpr("*", *ratios)
