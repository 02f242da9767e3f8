"""Events to the feature table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.flags import add_flags, entity_key
from duskwatch.functions.text import shannon_entropy
from duskwatch.operators.rolling import MINUTE_US, add_ratios, as_amount, rolling
from duskwatch.operators.sessions import SESSION_ID, sessionize
from duskwatch.schema import BASE_FEATURES, FLAGS, ID_COLUMNS, WINDOWS_MIN, conform, feature_columns
from duskwatch.session import materialize

_AMOUNTS = ["network_bytes", "network_packets"]


def add_entropies(events: DataFrame) -> DataFrame:
    scored = events.withColumns(
        {
            "process_command_line_entropy": shannon_entropy(F.col("process_command_line")),
            "message_entropy": shannon_entropy(F.col("message")),
        }
    )
    has_command = F.length("process_command_line") > 0
    return scored.withColumn(
        "text_entropy", F.when(has_command, F.col("process_command_line_entropy")).otherwise(F.col("message_entropy"))
    )


def feature_base(events: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Everything that depends on one event alone; long texts are dropped here."""
    ready = add_entropies(add_flags(conform(events.filter("event_time is not null"), keep=list(carry))))
    kept = dict.fromkeys(["event_id", *[c for c in ID_COLUMNS if c != "session_id"], "network_transport", "process_name"])
    return ready.select(
        *kept,
        *BASE_FEATURES,
        *[as_amount(F.col(c)).alias(c) for c in _AMOUNTS],
        entity_key(F.col("source_ip"), F.col("user_name"), F.col("host_name")).alias("entity"),
        F.unix_micros("event_time").alias("_us"),
        *carry,
    )


def rolling_plan() -> list[tuple[str, dict[str, str], dict[str, str]]]:
    """Per key column: what is summed and what is counted distinct."""

    def counts(suffix: str) -> dict[str, str]:
        return {flag: f"{flag}_count{suffix}_{{w}}m" for flag in FLAGS}

    return [
        ("entity", counts(""), {}),
        ("host_name", {**counts("_host"), "cbs_failed": "cbs_failed_count_host_{w}m"}, {}),
        ("user_name", counts("_user"), {}),
        (
            "destination_ip",
            {**counts("_dst"), **{c: f"{c}_sum_{{w}}m" for c in _AMOUNTS}},
            {"source_ip": "uniq_src_per_dst_{w}m"},
        ),
        (
            "source_ip",
            {},
            {"destination_ip": "uniq_dst_per_src_{w}m", "destination_port": "uniq_dport_per_src_{w}m"},
        ),
        ("process_name", {"cbs_failed": "cbs_failed_count_proc_{w}m"}, {}),
    ]


def rolling_wide(base: DataFrame, wanted: Column, row: str, windows: tuple[int, ...]) -> DataFrame:
    """``(row, features)``: every rolling feature of the ``wanted`` rows, rolled over the events of ``base``.

    Each kind of key is rolled by itself, on rows of its own measures only. The kinds then meet on the row, each shuffled
    once for that; their compressed sizes say little, so no side is ever broadcast.
    """
    found = []
    for kind, sums, distincts in rolling_plan():
        narrow = base.select(*dict.fromkeys([row, "_us", kind, *sums, *distincts]))
        rolled = rolling(narrow, F.col(kind), sums, distincts, F.col("_us"), windows).filter(wanted)
        names = [t.format(w=w) for t in (*sums.values(), *distincts.values()) for w in windows]
        found.append(rolled.select(row, *names))
    return reduce(lambda left, right: left.join(right.hint("merge"), row), found)


def build_features(
    events: DataFrame,
    window_start: Column | None = None,
    window_end: Column | None = None,
    windows: tuple[int, ...] = WINDOWS_MIN,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """The feature table: event id, id columns, then the numeric features, one row per event with a time.

    The per-event part is written out once, because every key below reads a few columns of it. Bounds, where given,
    are inclusive on both sides. Earlier events still count as warm-up, all of them for sessions and as far as the longest
    window reaches for rolling features; later ones change nothing and are left out. ``carry`` names further columns to keep.
    """
    if window_end is not None:
        events = events.filter(F.col("event_time") <= window_end)
    # The number of a row is written with it, so it stays whatever reads the table later.
    base = materialize(feature_base(events, carry).withColumn("_row", F.monotonically_increasing_id()), "features-base")
    moment = F.col("_us")
    wanted, reached = F.lit(True), base
    if window_start is not None:
        wanted = moment >= F.unix_micros(window_start)
        reached = base.filter(moment > F.unix_micros(window_start) - max(windows) * MINUTE_US)
    # Only narrow rows are shuffled by key; the wide ones once, to meet the results.
    pairs = base.select("_row", "source_ip", "destination_ip", "network_transport", "_us")
    sessions = sessionize(pairs, moment).filter(wanted).select("_row", "session_seq")
    rolled = rolling_wide(reached, wanted, "_row", windows)
    wide = base.filter(wanted).join(sessions.hint("merge"), "_row").join(rolled.hint("merge"), "_row")
    wide = add_ratios(wide.withColumn("session_id", F.expr(SESSION_ID)), windows)
    numeric = [f"double({c}) as {c}" for c in feature_columns(windows)]
    return wide.selectExpr("event_id", *ID_COLUMNS, *numeric, *carry)
