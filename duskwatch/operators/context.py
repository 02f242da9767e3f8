"""What happened around an alert: events, correlated activity, entities, digest."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.functions.text import truncate
from duskwatch.operators.response import escalate_risk, recommended_actions
from duskwatch.operators.rules import annotate, keyword_techniques
from duskwatch.session import materialize

MINUTE_US = 60_000_000
ENTITY_COLUMNS = {
    "src": "source_ip",
    "dst": "destination_ip",
    "user": "user_name",
    "host": "host_name",
    "action": "event_action",
    "module": "event_module",
}
IOC_COLUMNS = {
    "host.name": "host_name",
    "user.name": "user_name",
    "source.ip": "source_ip",
    "destination.ip": "destination_ip",
}


def _spread(alerts: DataFrame, minutes: int, *columns: Column) -> DataFrame:
    """Alerts with their interval, one row per time piece it touches; a piece is half as long as the interval."""
    width = minutes * MINUTE_US
    moment = F.unix_micros("event_time")
    return (
        alerts.select(*columns, (moment - width).alias("_from"), (moment + width).alias("_to"))
        .withColumn("_piece", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor(F.col("_to") / width))))
    )


def _piece(minutes: int) -> Column:
    return F.floor(F.unix_micros("event_time") / (minutes * MINUTE_US))


def alert_context(events: DataFrame, alerts: DataFrame, minutes: int = 5, alert_id: str = "event_id") -> DataFrame:
    """Every event within ``minutes`` of each alert, both ends included.

    The interval becomes an equality on time pieces plus a check, so Spark may hash, sort or, when the alerts turn out
    small at run time, broadcast them.
    """
    wanted = _spread(alerts, minutes, F.col(alert_id).alias("alert_id"), F.col("event_time").alias("alert_time"))
    moment = F.unix_micros("event_time")
    near = events.withColumn("_piece", _piece(minutes)).join(wanted, "_piece")
    return near.filter(moment.between(F.col("_from"), F.col("_to"))).drop("_piece", "_from", "_to")


def _seen(events: DataFrame, minutes: int, columns: list[Column]) -> DataFrame:
    """Distinct values per time piece with the first and last moment of each.

    A piece is at most half an interval, so it holds at most one end of it, and first and last moment decide exactly
    whether any event of the piece lies inside. Busy values shrink to one row per piece before anything is shuffled.
    """
    moment = F.unix_micros("event_time")
    return events.groupBy(_piece(minutes).alias("_piece"), *columns).agg(
        F.min(moment).alias("_first"), F.max(moment).alias("_last")
    )


def _inside() -> Column:
    return (F.col("_last") >= F.col("_from")) & (F.col("_first") <= F.col("_to"))


def correlated(events: DataFrame, alerts: DataFrame, minutes: int = 10, alert_id: str = "event_id") -> DataFrame:
    """Distinct ``(alert_id, module, action)`` of events near an alert that share an address or the user with it."""
    module = F.coalesce(F.nullif("event_module", F.lit("")), F.lit("unknown")).alias("module")
    action = F.coalesce(F.nullif("event_action", F.lit("")), F.lit("n/a")).alias("action")
    found = []
    for column in ("source_ip", "destination_ip", "user_name"):
        shared = F.col(column).alias("_shared")
        mine = _spread(alerts, minutes, F.col(alert_id).alias("alert_id"), shared).filter(F.length("_shared") > 0)
        seen = _seen(events.filter(F.length(column) > 0), minutes, [shared, module, action])
        found.append(seen.join(mine, ["_piece", "_shared"]).filter(_inside()).select("alert_id", "module", "action"))
    return reduce(DataFrame.unionAll, found).distinct()


def _long(df: DataFrame, columns: dict[str, str], *keep: Column) -> DataFrame:
    pairs = [F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")) for kind, c in columns.items()]
    return df.select(*keep, F.inline(F.array(*pairs))).filter(F.length("value") > 0)


def _present(seen: DataFrame, minutes: int, columns: list[str]) -> DataFrame:
    """``(columns, _from, _to)``: when an alert has the value of ``seen`` near it, as intervals that do not touch.

    Moments of a piece are never further apart than two intervals' halves, so first and last of each piece decide where a
    value's presence breaks off. One small row per value and piece is windowed by value.
    """
    width = minutes * MINUTE_US
    order = Window.partitionBy(*columns).orderBy("_piece")
    apart = F.coalesce(F.col("_first") - F.lag("_last").over(order) > 2 * width, F.lit(True))
    numbered = seen.filter("_piece is not null").withColumn("_apart", apart.cast("long"))
    numbered = numbered.withColumn("_part", F.sum("_apart").over(order))
    return numbered.groupBy(*columns, "_part").agg((F.min("_first") - width).alias("_from"), (F.max("_last") + width).alias("_to")).drop("_part")


#: Into how many parts the alerts of a piece of time are dealt, and its values too, so that few busy pieces still make many
#: tasks: each part of the ones meets each part of the others. A power of two.
DEALT = 8

#: Most values in a row of ``_runs``.
RUN = 256


def _runs(present: DataFrame) -> DataFrame:
    """``(_piece, kind, _values, _run)``: the values of a kind in a piece and part, in order, up to ``RUN`` of them in a row."""
    part = F.hash("value").bitwiseAND(DEALT - 1).alias("_values")
    dealt = present.select("_piece", "kind", part, "value", "_from", "_to")
    place = F.row_number().over(Window.partitionBy("_piece", "kind", "_values").orderBy("value", "_from"))
    numbered = dealt.withColumn("_row", F.floor((place - 1) / RUN))
    return numbered.groupBy("_piece", "kind", "_values", "_row").agg(F.collect_list(F.struct("value", "_from", "_to")).alias("_run")).drop("_row")


def alert_entities(events: DataFrame, alerts: DataFrame, minutes: int = 5, alert_id: str = "event_id") -> DataFrame:
    """Distinct ``(alert_id, kind, value)`` of an alert and the events around it.

    The result has a row for every alert and value near it, so it is far larger than what it is made from, and nothing of
    its size is shuffled: an alert lies in one piece of time and in at most one interval of a value's presence, so no pair
    comes twice. Only alerts whose id stands for several moments need their pairs made distinct. A short run of values
    meets one alert after the other, so ids and values come again at once, and column files of all pairs stay small.
    """
    width = minutes * MINUTE_US
    seen = _seen(_long(events, ENTITY_COLUMNS, F.col("event_time")), minutes, [F.col("kind"), F.col("value")])
    covered = F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor(F.col("_to") / width)))
    present = _present(seen, minutes, ["kind", "value"]).withColumn("_piece", covered)
    same = Window.partitionBy("alert_id")
    timed = alerts.select(F.col(alert_id).alias("alert_id"), *dict.fromkeys(ENTITY_COLUMNS.values()), F.unix_micros("event_time").alias("_t"))
    timed = timed.withColumns({"_oldest": F.min("_t").over(same), "_newest": F.max("_t").over(same)})
    once = F.col("_oldest").eqNullSafe(F.col("_newest"))
    parts, block = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["_piece", "_values", "_alerts"]
    each = F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))
    runs = _runs(present).withColumn("_alerts", each).repartition(parts, *block)

    def near(chosen: DataFrame) -> DataFrame:
        moments = chosen.filter("_t is not null").select("alert_id", "_t").distinct()
        moments = moments.withColumns({"_piece": F.floor(F.col("_t") / width), "_alerts": F.hash("alert_id", "_t").bitwiseAND(DEALT - 1)})
        moments = moments.withColumn("_values", each).repartition(parts, *block)
        # Compiled, a join holds all rows that come of one run. Lambdas are not compiled, so this one goes from alert to alert.
        covers = F.exists("_run", lambda value: F.col("_t").between(value["_from"], value["_to"]))
        met = runs.alias("r").join(moments.alias("m"), reduce(Column.__and__, [F.col(f"r.{c}") == F.col(f"m.{c}") for c in block], covers))
        found = met.select("alert_id", "_t", "kind", F.inline("_run"))
        return found.filter(F.col("_t").between(F.col("_from"), F.col("_to"))).select("alert_id", "kind", "value")

    own = _long(timed.filter(once), ENTITY_COLUMNS, F.col("alert_id"), F.col("_oldest").alias("_t")).distinct()
    own = own.withColumn("_piece", F.floor(F.col("_t") / width)).alias("own")
    shown = (F.col("own.kind") == F.col("p.kind")) & (F.col("own.value") == F.col("p.value")) & (F.col("own._piece") == F.col("p._piece"))
    alone = own.join(present.alias("p"), shown & F.col("own._t").between(F.col("p._from"), F.col("p._to")), "left_anti")
    several = near(timed.filter(~once)).unionByName(_long(timed.filter(~once), ENTITY_COLUMNS, F.col("alert_id"))).distinct()
    return near(timed.filter(once)).unionByName(alone.select("alert_id", "kind", "value")).unionByName(several)


def iocs(alerts: DataFrame, alert_id: str = "event_id") -> DataFrame:
    """Distinct ``(alert_id, kind, value)`` for the host, the user and both addresses of each alert."""
    return _long(alerts, IOC_COLUMNS, F.col(alert_id).alias("alert_id")).distinct()


def context_messages(
    events: DataFrame, alerts: DataFrame, minutes: int = 5, lines: int = 20, chars: int = 200, alert_id: str = "event_id"
) -> DataFrame:
    """The first ``lines`` messages around each alert as one text per alert, each cut to ``chars`` characters."""
    near = alert_context(events, alerts, minutes, alert_id)
    first = Window.partitionBy("alert_id").orderBy("event_time", "event_id")
    stamp = F.date_format("event_time", "yyyy-MM-dd HH:mm:ss")
    origin = F.concat(F.coalesce("event_module", F.lit("")), F.lit("."), F.coalesce("event_dataset", F.lit("")))
    line = F.concat(F.lit("["), stamp, F.lit("]["), origin, F.lit("] "), truncate(F.col("message"), chars))
    kept = (
        near.withColumn("_place", F.row_number().over(first))
        .filter(F.col("_place") <= lines)
        .select("alert_id", "_place", line.alias("line"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("_place", "line")))
    return kept.groupBy("alert_id").agg(
        F.array_join(F.transform(ordered, lambda item: item["line"]), "\n").alias("context_text")
    )


def alert_digest(events: DataFrame, alerts: DataFrame, alert_id: str = "event_id") -> DataFrame:
    """A short text per alert: score, risk, mappings, up to five correlations, entities, up to three actions.

    ``alerts`` carry ``anom_score``; mappings and risk are added where they are missing.
    """
    named = annotate(alerts)
    words = keyword_techniques(alerts)
    risk = escalate_risk(F.col("risk_level"), F.col("event_severity"), words, F.col("event_action"))
    named = named.select(
        F.col(alert_id).alias("alert_id"),
        F.col("event_time").alias("alert_time"),
        "anom_score",
        risk.alias("risk"),
        F.array_distinct(F.concat(words, F.transform("technique_hits", lambda hit: hit["technique"]))).alias("_techniques"),
        F.array_distinct(
            F.transform(
                "control_hits", lambda hit: F.concat(hit["function"], F.lit(" ("), hit["category"], F.lit(")"))
            )
        ).alias("_controls"),
        F.slice(recommended_actions(alerts), 1, 3).alias("_actions"),
    )
    five = Window.partitionBy("alert_id").orderBy("module", "action")
    related = (
        correlated(events, alerts, alert_id=alert_id)
        .withColumn("_place", F.row_number().over(five))
        .filter(F.col("_place") <= 5)
        .groupBy("alert_id")
        .agg(F.array_sort(F.collect_list(F.concat("module", F.lit("::"), "action"))).alias("_related"))
    )
    entities = (
        alert_entities(events, alerts, alert_id=alert_id)
        .filter(F.col("kind").isin("src", "dst"))
        .groupBy("alert_id")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("kind") == "src", F.col("value")))).alias("_src"),
            F.array_sort(F.collect_list(F.when(F.col("kind") == "dst", F.col("value")))).alias("_dst"),
        )
    )

    def line(title: str, items: str) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"- {title}: "), F.array_join(items, ", ")))

    stamp = F.date_format("alert_time", "yyyy-MM-dd HH:mm:ss")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# Alert at "), stamp),
        F.concat(F.lit("- Score: "), F.format_string("%.3f", "anom_score")),
        F.concat(F.lit("- Risk: "), F.col("risk")),
        line("MITRE", "_techniques"),
        line("NIST CSF", "_controls"),
        line("Related", "_related"),
        line("Sources", "_src"),
        line("Destinations", "_dst"),
        line("Actions", "_actions"),
    )
    return (
        named.join(related, "alert_id", "left")
        .join(entities, "alert_id", "left")
        .select("alert_id", "alert_time", "anom_score", "risk", text.alias("digest"))
    )


#: Most rows of the table of group pieces that is broadcast; one is three numbers.
MOST_PIECES = 1_000_000


def _pieces_of(alerts: DataFrame, seconds: float) -> DataFrame:
    """``(_piece, group_us, first, last)``: pieces of time that hold alerts, with the group of alerts they belong to.

    A piece is as wide as an alert's context, so alerts of one piece always share a group, and only the first and the last
    alert of a piece decide whether it goes on. The pieces are swept in order by one task: there are as many as the time has,
    whatever the number of alerts.
    """
    reach = int(seconds * 1_000_000)
    us = F.unix_micros("event_time")
    pieces = alerts.where("event_time is not null").groupBy(F.floor(us / (2 * reach)).alias("_piece")).agg(F.min(us).alias("first"), F.max(us).alias("last"))
    order = Window.orderBy("_piece")
    apart = F.coalesce(F.col("first") - F.lag("last").over(order) > 2 * reach, F.lit(True))
    numbered = pieces.withColumn("_group", F.sum(apart.cast("int")).over(order))
    return numbered.withColumn("group_us", F.min("first").over(Window.partitionBy("_group")) - reach).select("_piece", "group_us", "first", "last")


def context_groups(alerts: DataFrame, seconds: float = 300) -> DataFrame:
    """Alerts with ``group_us``: where the group of alerts begins whose contexts, ``seconds`` before and after, overlap.

    For any number of alerts: events belong to a group (``group_events``), not to each alert. Alerts without a time have none.
    """
    reach = int(seconds * 1_000_000)
    pieces = _bounded(_pieces_of(alerts, seconds).select("_piece", "group_us"))
    return alerts.withColumn("_piece", F.floor(F.unix_micros("event_time") / (2 * reach))).join(pieces, "_piece", "left").drop("_piece")


def group_events(events: DataFrame, alerts: DataFrame, seconds: float = 300) -> DataFrame:
    """Events with the ``group_us`` of the group of alerts whose joint context holds them; other events are left out.

    Groups do not overlap, so an event has at most one. What is broadcast grows with the time the alerts span, not with
    their number, and is checked; the events are not shuffled.
    """
    reach = int(seconds * 1_000_000)
    groups = _pieces_of(alerts, seconds).groupBy("group_us").agg((F.max("last") + reach).alias("_until"))
    covered = F.sequence(F.floor(F.col("group_us") / (2 * reach)), F.floor(F.col("_until") / (2 * reach)))
    pieces = _bounded(groups.select("group_us", "_until", F.explode(covered).alias("_piece")))
    us = F.unix_micros("event_time")
    found = events.withColumn("_piece", F.floor(us / (2 * reach))).join(pieces, "_piece")
    return found.where(us.between(F.col("group_us"), F.col("_until"))).drop("_piece", "_until")


def _bounded(pieces: DataFrame) -> DataFrame:
    """Stored, and broadcast if that is small enough; else Spark chooses the join."""
    stored = materialize(pieces, "pieces")
    return F.broadcast(stored) if stored.count() <= MOST_PIECES else stored


def evidence_manifest(rows: DataFrame, id_col: str, content: str) -> DataFrame:
    """Id, SHA-256 and size in bytes of every row's content; null content has neither."""
    return rows.select(id_col, F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("bigint").alias("size"))


def _leaf(id_col: str, content: str) -> Column:
    """SHA-256 of a row's id and of its content's SHA-256; a null id or content is marked as such."""
    named = F.when(F.col(id_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(id_col).cast("string")))
    held = F.coalesce(F.sha2(F.col(content).cast("binary"), 256), F.lit("-"))
    return F.sha2(F.concat_ws("\n", named, held).cast("binary"), 256)


def custody_tree(rows: DataFrame, group: str, id_col: str, content: str, depth: int = 4) -> DataFrame:
    """Hash tree over the rows of each group: ``(group, level, prefix, digest, n, n_texts, size)``, level 0 being the root.

    A leaf is the SHA-256 of a row's id and the SHA-256 of its content; equal rows are one leaf with their number, so a row
    more or less changes every digest above it. Leaves with the same first ``depth`` hexadecimal digits are a bucket, whose
    digest is that of its sorted leaves with their numbers; a node above is the digest of its up to 16 children. Buckets are
    as even as hashes are, and one is a list in one task: with the 65,536 buckets of depth 4 it has some 15,000 leaves, a
    megabyte, where a group has a thousand million rows. ``depth`` should grow by one when a group grows sixteenfold. The
    tree depends on the rows alone, not on their order. Null ids and contents have leaves of their own.
    """
    leaves = rows.select(group, _leaf(id_col, content).alias("leaf"), F.col(content).alias("_held"))
    leaves = leaves.groupBy(group, "leaf").agg(F.count(F.lit(1)).alias("n"), F.count("_held").alias("n_texts"), F.coalesce(F.sum(F.octet_length("_held")), F.lit(0)).alias("size"))
    below = leaves.select(group, F.substring("leaf", 1, depth).alias("prefix"), F.concat_ws("=", "leaf", F.col("n").cast("string")).alias("line"), "n", "n_texts", "size")
    levels = []
    for level in range(depth, -1, -1):
        digest = F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("line"))).cast("binary"), 256)
        nodes = below.groupBy(group, "prefix").agg(digest.alias("digest"), *[F.sum(c).alias(c) for c in ("n", "n_texts", "size")])
        levels.append(nodes.select(group, F.lit(level).alias("level"), "prefix", "digest", "n", "n_texts", "size"))
        upper = F.substring("prefix", 1, level - 1) if level > 1 else F.lit("")
        below = nodes.select(group, upper.alias("prefix"), F.concat_ws("=", "prefix", "digest").alias("line"), "n", "n_texts", "size")
    return reduce(DataFrame.unionByName, levels)


def manifest_digests(rows: DataFrame, group: str, id_col: str, content: str, depth: int = 4) -> DataFrame:
    """``(group, n, n_texts, size, digest)``: the root of each group's hash tree, in whatever order the rows come."""
    return custody_tree(rows, group, id_col, content, depth).where("level = 0").select(group, "n", "n_texts", "size", "digest")


def inclusion_proof(rows: DataFrame, group: str, id_col: str, content: str, row_id, depth: int = 4) -> list[list[str]] | None:
    """What proves that the row with this id is in its group: the lines of its bucket, then of every node above it.

    At most a bucket and ``depth`` times 16 lines; none if no row has the id. ``proven_root`` turns it into the root.
    """
    one = rows.where(F.col(id_col) == row_id).select(group, _leaf(id_col, content)).first()
    if one is None:
        return None
    mine, leaf = rows.where(F.col(group).eqNullSafe(F.lit(one[0]))), one[1]
    bucket = mine.select(_leaf(id_col, content).alias("leaf")).where(F.col("leaf").startswith(leaf[:depth])).groupBy("leaf").count()
    proof = [sorted(f"{r['leaf']}={r['count']}" for r in bucket.collect())]
    nodes = custody_tree(mine, group, id_col, content, depth).where("level > 0")
    beside = nodes.where(F.lit(leaf).startswith(F.expr("left(prefix, level - 1)"))).select("level", "prefix", "digest").collect()
    return proof + [sorted(f"{r['prefix']}={r['digest']}" for r in beside if r["level"] == level) for level in range(depth, 0, -1)]


def proven_root(row_id: object, content: str | bytes | None, proof: list[list[str]]) -> str | None:
    """The root to which a proof leads for this row, or none if a step does not hold what the step before gives."""
    raw = content.encode() if isinstance(content, str) else content
    held = "-" if raw is None else hashlib.sha256(raw).hexdigest()
    leaf = hashlib.sha256(f"{'-' if row_id is None else f'+{row_id}'}\n{held}".encode()).hexdigest()
    if not any(line.split("=")[0] == leaf for line in proof[0]):
        return None
    for place, lines in enumerate(proof):
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        level = len(proof) - 1 - place
        if place + 1 < len(proof) and f"{leaf[:level]}={digest}" not in proof[place + 1]:
            return None
    return digest
