"""The registered queries: each operator run over the shared tables.

A query takes the session and the table folder. Events come from ``adapters.ecs``; where a score is needed and no model
is meant, ``plain_score`` gives one that plain SQL can compute too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.adapters import ecs, raw_events, security_events, table
from duskwatch.functions import text
from duskwatch.functions.flags import add_flags, entity_key
from duskwatch.operators import alerts, context, firstk, forest, model_store, quality, quantile, report, response, rules, windows
from duskwatch.operators.model_store import Detector
from duskwatch.operators.rolling import add_ratios, as_amount, rolling
from duskwatch.operators.sessions import session_stats, sessionize
from duskwatch.plans.features import build_features
from duskwatch.schema import FLAGS, WINDOWS_MIN, feature_columns
from duskwatch.session import materialize, scratch_path
from duskwatch.sources import firewall, flows, ingest, jsonl, lines, nested, store, syslog
from duskwatch.streaming import revising, stateful
from duskwatch.streaming import windows as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def micros(name: str = "event_time", alias: str = "t_us") -> Column:
    return F.unix_micros(name).alias(alias)


def r6(name: str, alias: str | None = None) -> Column:
    return F.round(F.col(name), 6).alias(alias or name)


def f6(name: str) -> Column:
    """``r6`` of a feature; nearly all are whole numbers, which need no rounding, the slow part of a wide row."""
    value = F.col(name)
    return F.when(value == F.rint(value), value + 0.0).otherwise(F.round(value, 6)).alias(name)


def flagged(spark: SparkSession, folder: str) -> DataFrame:
    return add_flags(ecs(spark, folder)).withColumn(
        "entity", entity_key(F.col("source_ip"), F.col("user_name"), F.col("host_name"))
    )


def plain_score(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged events with a score made of two flags and the traffic."""
    score = F.col("login_failed") * 0.5 + F.col("conn_suspicious") * 0.25 + F.col("network_bytes") / 1000
    return flagged(spark, folder).withColumn("anom_score", F.round(score, 6))


def detected(spark: SparkSession, folder: str) -> DataFrame:
    """Scored events with the rolling features that the technique rules read."""
    events = plain_score(spark, folder)
    names = ("login_failed", "action_allow", "action_deny")
    counted = rolling(events, F.col("entity"), {n: n + "_count_{w}m" for n in names}, windows=(5,))
    scanned = rolling(counted, F.col("source_ip"), {}, {"destination_port": "uniq_dport_per_src_{w}m"}, windows=(1,), of=events)
    return add_ratios(scanned, windows=(5,))


def top_alerts(spark: SparkSession, folder: str, n: int = 10) -> DataFrame:
    return alerts.select_alerts(materialize(plain_score(spark, folder), "plain-scores"), n)


def all_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Every event at or above the threshold, with the columns that tell what is near it."""
    scores = plain_score(spark, folder).select("event_id", "event_time", *context.ENTITY_COLUMNS.values(), "anom_score")
    return alerts.above_threshold(materialize(scores, "plain-scores"))


def mapped_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """All alerts above the threshold with mappings and risk."""
    return rules.annotate(alerts.above_threshold(stored_detected(spark, folder)))


def stored_detected(spark: SparkSession, folder: str) -> DataFrame:
    """The scores as a stored table, since thresholds, alerts and reports each read them again."""
    return materialize(detected(spark, folder), "scores")


# --- expressions ---------------------------------------------------------------------------------------------------


@query
def technique_alerts(spark, folder):
    """Events that meet each technique rule, the query to start with."""
    return report.technique_counts(rules.with_mappings(detected(spark, folder)))


@query
def security_flags(spark, folder):
    return flagged(spark, folder).select("event_id", "login_failed", "conn_suspicious", "ips_alert")


@query
def action_flags(spark, folder):
    return flagged(spark, folder).select("event_id", "action_allow", "action_deny")


@query
def cbs_flag(spark, folder):
    return flagged(spark, folder).select("event_id", "cbs_failed")


@query
def entity_keys(spark, folder):
    blank = ecs(spark, folder).withColumns(
        {
            "source_ip": F.when(F.col("destination_port") != 22, F.col("source_ip")),
            "user_name": F.when(F.col("destination_ip") != "192.168.0.2", F.col("user_name")),
            "host_name": F.when(F.col("network_transport") == "udp", F.col("host_name")),
        }
    )
    key = entity_key(F.col("source_ip"), F.col("user_name"), F.col("host_name"))
    return blank.groupBy(key.alias("entity")).agg(F.count(F.lit(1)).alias("n"))


@query
def entropy_documents(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", F.round(text.shannon_entropy(F.col("text")), 6).alias("entropy")
    )


@query
def entropy_sql_function(spark, folder):
    text.register_sql_functions(spark)
    documents = table(spark, folder, "documents")
    return spark.sql("select doc_id, round(shannon_entropy(text), 6) as entropy from {documents}", documents=documents)


@query
def token_entropy_conversations(spark, folder):
    tokens = F.split("text", " ")
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", F.round(text.mean_token_entropy(tokens), 6).alias("entropy")
    )


@query
def text_entropy_fallback(spark, folder):
    value = text.text_entropy(F.col("process_command_line"), F.col("message"))
    return ecs(spark, folder).select("event_id", F.round(value, 6).alias("text_entropy"))


@query
def risk_words(spark, folder):
    """Risk levels named in conversations; documents supply the words, as one in three gets a level appended."""
    said = table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" Risk: High.")))
        .when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" moderate, then low")))
        .otherwise(F.col("text"))
        .alias("said"),
    )
    return said.select("conv_id", "turn", text.risk_from_text(F.col("said")).alias("risk"))


@query
def truncate_text(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.truncate(F.col("html"), 200).alias("html"))


@query
def technique_url(spark, folder):
    hits = rules.with_mappings(detected(spark, folder)).select(F.explode("technique_hits").alias("hit"))
    ids = hits.select(F.explode(F.array("hit.technique", "hit.subtechnique")).alias("technique"))
    return ids.groupBy(text.technique_url(F.col("technique")).alias("url")).agg(F.count(F.lit(1)).alias("n"))


@query
def dedup_labels(spark, folder):
    items = F.split(F.concat_ws(",", "event_module", "event_dataset", "event_module", F.lit(""), "event_action"), ",")
    return ecs(spark, folder).select("event_id", F.array_join(text.dedup_in_order(items), "|").alias("labels"))


@query
def ioc_long(spark, folder):
    return context.iocs(all_alerts(spark, folder))


# --- windows -------------------------------------------------------------------------------------------------------


def _rolled(spark, folder, key: str, sums: dict, distincts: dict | None = None, **options) -> DataFrame:
    events = flagged(spark, folder).withColumns(
        {c: as_amount(F.col(c)) for c in ("network_bytes", "network_packets") if c in sums}
    )
    rolled = rolling(events, F.col(key), sums, distincts, **options)
    names = [t.format(w=w) for t in (*sums.values(), *(distincts or {}).values()) for w in (1, 5, 15)]
    return rolled.select("event_id", *[r6(n) for n in names])


@query
def rolling_login_failed_entity(spark, folder):
    return _rolled(spark, folder, "entity", {"login_failed": "login_failed_count_{w}m"})


@query
def rolling_login_failed_host(spark, folder):
    return _rolled(spark, folder, "host_name", {"login_failed": "login_failed_count_host_{w}m"})


@query
def rolling_login_failed_user(spark, folder):
    return _rolled(spark, folder, "user_name", {"login_failed": "login_failed_count_user_{w}m"})


@query
def rolling_login_failed_dst(spark, folder):
    return _rolled(spark, folder, "destination_ip", {"login_failed": "login_failed_count_dst_{w}m"}, slice_seconds=10)


@query
def rolling_cbs_host(spark, folder):
    return _rolled(spark, folder, "host_name", {"cbs_failed": "cbs_failed_count_host_{w}m"})


@query
def rolling_cbs_proc(spark, folder):
    return _rolled(spark, folder, "process_name", {"cbs_failed": "cbs_failed_count_proc_{w}m"})


@query
def rolling_uniq_dst_per_src(spark, folder):
    return _rolled(spark, folder, "source_ip", {}, {"destination_ip": "uniq_dst_per_src_{w}m"})


@query
def rolling_uniq_src_per_dst(spark, folder):
    return _rolled(spark, folder, "destination_ip", {}, {"source_ip": "uniq_src_per_dst_{w}m"})


@query
def rolling_uniq_dport_per_src(spark, folder):
    return _rolled(spark, folder, "source_ip", {}, {"destination_port": "uniq_dport_per_src_{w}m"})


@query
def rolling_traffic_dst(spark, folder):
    names = ("network_bytes", "network_packets")
    return _rolled(spark, folder, "destination_ip", {n: n + "_sum_{w}m" for n in names})


@query
def ratios(spark, folder):
    names = ("login_failed", "action_allow", "action_deny")
    found = add_ratios(rolling(flagged(spark, folder), F.col("entity"), {n: n + "_count_{w}m" for n in names}))
    return found.select("event_id", *[r6(f"{n}_{w}m") for n in ("deny_ratio", "login_failed_ratio") for w in WINDOWS_MIN])


@query
def sessions(spark, folder):
    return sessionize(ecs(spark, folder), timeout_seconds=5).select("event_id", "session_seq", "session_id")


@query
def session_summary(spark, folder):
    stats = session_stats(sessionize(ecs(spark, folder), timeout_seconds=120))
    return stats.select(
        "session_id", micros("session_start", "start_us"), micros("session_end", "end_us"), "n_events"
    )


@query
def feature_table(spark, folder):
    """The full feature table."""
    features = build_features(ecs(spark, folder))
    return features.select("event_id", micros(), "session_id", *[f6(n) for n in feature_columns()])


@query
def feature_slice(spark, folder):
    """Features of a ten-minute window with everything before it as warm-up."""
    start, end = F.timestamp_micros(F.lit(947_400_000_000)), F.timestamp_micros(F.lit(948_000_000_000))
    features = build_features(ecs(spark, folder), start, end)
    return features.select("event_id", micros(), *[f6(n) for n in feature_columns()])


# --- quantiles, alerts, labels -------------------------------------------------------------------------------------


@query
def threshold_quantile(spark, folder):
    found = quantile.compute_threshold(table(spark, folder, "lineitem"), "l_extendedprice")
    return found.select(r6("threshold"), "n_alerts")


@query
def threshold_meanstd(spark, folder):
    found = quantile.compute_threshold(table(spark, folder, "lineitem"), "l_extendedprice", method="meanstd")
    return found.select(F.round("threshold", 4).alias("threshold"), "n_alerts")


@query
def alerts_topn(spark, folder):
    return top_alerts(spark, folder).select("event_id", "anom_score", r6("threshold"))


def fitted_table(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """The stored feature table with a text column and a constant one besides, and the names that are fitted."""
    features = build_features(ecs(spark, folder)).withColumn("always", F.lit(7))
    names = feature_columns()
    rounded = features.select("event_id", "host_name", "always", *[f6(n) for n in names])
    return materialize(rounded, "features"), [*names, "host_name", "always"]


@query
def constant_columns(spark, folder):
    found = quantile.column_quantiles(*fitted_table(spark, folder))
    return found.select("feature", (F.col("low") == F.col("high")).alias("constant"))


@query
def scaler_fit(spark, folder):
    return forest.scaler_table(*fitted_table(spark, folder)).select("feature", r6("center"), r6("scale"))


@query
def robust_scaled(spark, folder):
    features, names = fitted_table(spark, folder)
    return forest.robust_scale(features, names).select("event_id", *[F.round(n, 4).alias(n) for n in names])


@query
def label_joined(spark, folder):
    joined = alerts.label_join(
        table(spark, folder, "documents"), table(spark, folder, "labels"), "quality", keys=["doc_id"]
    )
    return joined.select("doc_id", "n_chars", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query
def evaluate_labels(spark, folder):
    documents = table(spark, folder, "documents").withColumn("anom_score", F.col("n_chars").cast("double"))
    labelled = alerts.label_join(documents, table(spark, folder, "labels"), "toxic", keys=["doc_id"])
    found = alerts.evaluate(labelled, label_col="toxic")
    rates = ("threshold", "tpr", "fpr", "precision", "recall", "f1")
    return found.select("total", "positive", "negative", "tp", "fp", "fn", "tn", *[r6(n) for n in rates])


@query
def label_join_events(spark, folder):
    """Labels on the default keys, with null keys and double labels."""
    events = ecs(spark, folder).withColumn("host_name", F.when(F.col("network_transport") == "tcp", F.col("host_name")))
    marked = events.filter("destination_port = 4444").select(
        "event_time", "source_ip", "destination_ip", "host_name", F.col("event_severity").alias("label")
    )
    labelled = alerts.label_join(events, marked.unionByName(marked))
    return labelled.select("event_id", F.coalesce("label", F.lit(-1)).alias("label"))


# --- rules ---------------------------------------------------------------------------------------------------------


@query
def mitre_hits(spark, folder):
    hit = F.explode("technique_hits").alias("hit")
    return rules.with_mappings(detected(spark, folder)).select("event_id", hit).select("event_id", "hit.*").drop("description")


@query
def nist_hits(spark, folder):
    hit = F.explode("control_hits").alias("hit")
    return rules.with_mappings(detected(spark, folder)).select("event_id", hit).select("event_id", "hit.*").drop("description")


@query
def mitre_counts(spark, folder):
    return report.technique_counts(mapped_alerts(spark, folder))


@query
def nist_counts(spark, folder):
    found = mapped_alerts(spark, folder)
    functions = report.control_counts(found).select(F.lit("function").alias("kind"), F.col("function").alias("name"), "count")
    categories = report.control_counts(found, "category")
    return functions.unionAll(categories.select(F.lit("category"), "category", "count"))


@query
def rule_language(spark, folder):
    """Conditions of every kind, over whole tables."""
    events = flagged(spark, folder)
    wanted = {
        "greater": {"network.packets": "> 50"},
        "text_number": {"event.id": ">= 100"},
        "not_a_number": {"host.name": "> 1"},
        "list_text": {"event.action": ["ALLOW", "Deny"]},
        "list_number": {"destination.port": [22, 80.0, "443"]},
        "equal_text": {"event.outcome": "S0"},
        "equal_number": {"event.severity": 3},
        "text_for_number": {"event.severity": "3"},
        "absent": {"no.such.field": "x"},
        "none": {},
        "two": {"login_failed": "== 1", "network.transport": "TCP"},
    }
    return events.agg(*[F.count_if(rules.conditions(events, c)).alias(name) for name, c in wanted.items()])


@query
def alert_annotated(spark, folder):
    names = ("mitre_tactics", "mitre_techniques", "nist_functions", "nist_categories", "risk_level")
    return mapped_alerts(spark, folder).select("event_id", *names)


@query
def keyword_techniques(spark, folder):
    events = ecs(spark, folder).withColumn(
        "rule_name", F.when(F.col("event_severity") == 1, "Port Scan seen").when(F.col("event_severity") == 2, "PowerShell BEACON")
    )
    return events.select("event_id", F.array_join(rules.keyword_techniques(events), "|").alias("techniques"))


@query
def threat_first(spark, folder):
    first = rules.first_threat(rules.with_mappings(detected(spark, folder)))
    return first.filter("threat_technique_id is not null").select(
        "event_id", "threat_tactic_name", "threat_technique_name", "threat_technique_id", "threat_technique_subtechnique"
    )


@query
def policy_plan(spark, folder):
    plan = response.policy_plan(plain_score(spark, folder), keep=("event_id",))
    return plan.select("event_id", micros("row_time"), "rule", "score", "action_no", "action_type", "action_cmd", "dry_run")


@query
def risk_escalation(spark, folder):
    events = ecs(spark, folder)
    risk = response.escalate_risk(
        F.lit("LOW"), F.col("event_severity"), rules.keyword_techniques(events), F.col("event_action")
    )
    return events.groupBy(risk.alias("risk")).agg(F.count(F.lit(1)).alias("n"))


@query
def recommended_actions(spark, folder):
    events = ecs(spark, folder).withColumns(
        {
            "user_name": F.when(F.col("event_severity") == 0, "SYSTEM").otherwise(F.col("user_name")),
            "source_ip": F.when(F.col("event_severity") == 1, "N/A").otherwise(F.col("source_ip")),
            "process_name": F.when(F.col("event_severity") != 2, F.col("process_name")),
        }
    )
    return events.select("event_id", F.array_join(response.recommended_actions(events), "|").alias("actions"))


# --- investigation -------------------------------------------------------------------------------------------------


@query
def alert_context(spark, folder):
    near = context.alert_context(ecs(spark, folder), top_alerts(spark, folder))
    return near.select("alert_id", "event_id", micros())


@query
def alert_correlated(spark, folder):
    return context.correlated(ecs(spark, folder), all_alerts(spark, folder))


@query
def alert_entities(spark, folder):
    return context.alert_entities(ecs(spark, folder), all_alerts(spark, folder))


@query
def alert_messages(spark, folder):
    found = context.context_messages(ecs(spark, folder), top_alerts(spark, folder))
    return found.select("alert_id", "context_text")


@query
def alert_digest(spark, folder):
    chosen = alerts.above_threshold(stored_detected(spark, folder)).orderBy(F.desc("anom_score"), "event_id").limit(10)
    found = context.alert_digest(ecs(spark, folder), materialize(chosen, "alerts"))
    return found.select("alert_id", "risk", "digest")


@query
def evidence_manifest(spark, folder):
    """Digest and size of every document's text."""
    return context.evidence_manifest(table(spark, folder, "documents"), "doc_id", "text")


@query
def context_groups(spark, folder):
    """All alerts in groups of overlapping contexts of a second to each side, and the events of each group."""
    scores = materialize(plain_score(spark, folder), "plain-scores")
    found = materialize(alerts.above_threshold(scores).select("event_id", "event_time"), "alerts")
    of_alerts = context.context_groups(found, 1).groupBy("group_us").agg(F.count(F.lit(1)).alias("n_alerts"), F.max(F.unix_micros("event_time")).alias("last_us"))
    of_events = context.group_events(scores.select("event_id", "event_time", "source_ip"), found, 1)
    counted = of_events.groupBy("group_us").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("source_ip").alias("n_sources"))
    return of_alerts.join(counted, "group_us")


@query
def evidence_digests(spark, folder):
    """The root of each source's hash tree over its documents."""
    return context.manifest_digests(table(spark, folder, "documents"), "source", "doc_id", "text")


# --- reports -------------------------------------------------------------------------------------------------------


@query
def source_breakdown(spark, folder):
    return report.source_breakdown(ecs(spark, folder))


@query
def risk_distribution(spark, folder):
    return report.risk_distribution(mapped_alerts(spark, folder))


@query
def technique_list(spark, folder):
    return report.distinct_techniques(mapped_alerts(spark, folder))


@query
def score_histogram(spark, folder):
    return report.score_histogram(plain_score(spark, folder)).select("bin", r6("bin_start"), r6("bin_end"), "count")


@query
def alert_timeline(spark, folder):
    found = report.alert_timeline(alerts.above_threshold(plain_score(spark, folder), contamination=0.001))
    return found.select(micros("minute", "minute_us"), "count")


@query
def summary_long(spark, folder):
    return report.summary(plain_score(spark, folder), mapped_alerts(spark, folder)).select("section", "name", r6("value"))


@query
def alert_detail(spark, folder):
    chosen = report.alert_detail(mapped_alerts(spark, folder), ["MEDIUM"], ["T1021", "T1046"], ["RESPOND"])
    return chosen.select(micros(), *[c for c in report.DETAIL_COLUMNS if c != "event_time"])


@query
def quality_events(spark, folder):
    raw = table(spark, folder, "documents").select(
        F.when(F.col("doc_id") % 7 == 0, "no time").otherwise("2024-01-01T00:00:00Z").alias("event_time"),
        F.col("text").alias("message"),
        F.when(F.col("lang") != "en", F.col("source")).alias("host_name"),
        F.struct("lang").alias("event"),
    )
    return quality.quality_events(raw).select("metric", "name", r6("value"), "status")


@query
def quality_features(spark, folder):
    return quality.quality_features(detected(spark, folder)).select("metric", "name", r6("value"), "status")


@query
def quality_scores(spark, folder):
    return quality.quality_scores(stored_detected(spark, folder)).select("metric", "name", r6("value"), "status")


@query
def quality_verdict(spark, folder):
    found = stored_detected(spark, folder)
    return quality.verdict(quality.quality_features(found), quality.quality_scores(found))


# --- tumbling windows ----------------------------------------------------------------------------------------------


@query
def window_classes(spark, folder):
    found = windows.classify_windows(plain_score(spark, folder), F.lit(1.15), minutes=2)
    return found.select(micros("window_start", "start_us"), micros("window_end", "end_us"), "classification")


@query
def window_meta(spark, folder):
    found = windows.window_meta(plain_score(spark, folder), F.lit(1.15), minutes=2, warmup_minutes=5)
    return found.select(
        micros("window_start", "start_us"), "classification", "rows_scored", "alerts", "rows_with_warmup"
    )


@query
def window_technique_counts(spark, folder):
    found = windows.window_technique_counts(detected(spark, folder), F.lit(0.7))
    return found.select(micros("window_start", "start_us"), "kind", "name", "count")


@query
def window_boundary(spark, folder):
    end = windows.closing_boundary(F.col("event_time"))
    return ecs(spark, folder).select("event_id", F.unix_micros(end).alias("end_us"))


def _normal(spark, folder) -> DataFrame:
    scored = plain_score(spark, folder)
    classes = windows.classify_windows(scored, F.lit(1.15), minutes=2)
    return windows.normal_history(scored, classes, parts=3, minutes=2)


@query
def normal_history(spark, folder):
    return _normal(spark, folder).select("event_id", micros("window_start", "start_us"))


@query
def latest_window(spark, folder):
    found = windows.latest_window(windows.with_window(plain_score(spark, folder), 2))
    return found.select("event_id", micros("window_start", "start_us"))


@query
def retrain_set(spark, folder):
    events = plain_score(spark, folder)
    start = events.agg(F.min("event_time")).scalar()
    baseline = events.filter(F.col("event_time") < start + F.expr("interval 5 minutes"))
    return windows.retrain_set(baseline, _normal(spark, folder)).select("event_id", "anom_score")


# --- sources -------------------------------------------------------------------------------------------------------


def _numbered(spark, folder) -> DataFrame:
    """Events with ``k``, the number inside ``props``, to vary rendered lines by."""
    return ecs(spark, folder).withColumn("k", F.col("network_packets").cast("bigint"))


def _lines(events: DataFrame, line: Column) -> DataFrame:
    """Rendered lines, stored, as a log reader would find them."""
    return materialize(events.select(line.alias("value"), F.lit("x.log").alias("log_file_path")), "lines")


def _clock(pattern: str) -> Column:
    return F.date_format("event_time", pattern)


@query
def syslog_parse(spark, folder):
    k = F.col("k").cast("string")
    stamp = _clock("MMM dd HH:mm:ss")
    switch = F.concat(stamp, F.lit(" sw-"), k, F.lit(" 77: %LINK-3-UPDOWN: Interface Ethernet0/"), k, F.lit(", changed state to down"))
    config = F.concat(stamp, F.lit(" sw-"), k, F.lit(" sys: %SYS-5-CONFIG_I: Configured from console by vty"), k)
    login = F.concat(stamp, F.lit(" "), F.col("host_name"), F.lit(" sshd["), k, F.lit("]: "), F.col("message"))
    line = (
        F.when(F.col("k") % 19 == 0, F.concat(F.lit("-- mark "), k))
        .when(F.col("k") % 9 == 0, switch)
        .when(F.col("k") % 9 == 1, config)
        .otherwise(login)
    )
    found = syslog.log_events(_lines(_numbered(spark, folder), line), 1970)
    return found.select(
        micros(), "host_name", "process_name", "user_name", "source_ip", "event_dataset", "event_action", "event_outcome"
    )


@query
def cbs_parse(spark, folder):
    k = F.col("k").cast("string")
    part = F.when(F.col("k") % 3 == 0, "CBS").when(F.col("k") % 3 == 1, "CSI").otherwise("DPX")
    tail = F.when(F.col("k") % 4 == 0, F.concat(F.lit("Failed 0x"), k)).otherwise(F.concat(F.lit("done from "), F.col("source_ip")))
    line = F.concat(_clock("yyyy-MM-dd HH:mm:ss"), F.lit(", Info                  "), part, F.lit("    "), tail)
    found = syslog.log_events(_lines(_numbered(spark, folder), line), 1970)
    return found.select(micros(), "process_name", "event_action", "event_outcome", "source_ip", "message")


@query
def firewall_parse(spark, folder):
    line = F.concat(
        F.when(F.col("k") % 5 != 0, F.concat(F.lit("date="), _clock("yyyy-MM-dd"), F.lit(" time="), _clock("HH:mm:ss"))).otherwise(
            F.concat(F.lit("eventtime="), ((F.unix_micros("event_time") + 1_700_000_000_000_000) * 1000).cast("string"))
        ),
        F.lit(' devname="FW '),
        F.col("k").cast("string"),
        F.lit('" srcip=0.0.0.0 srcip='),
        F.col("source_ip"),
        F.lit(" dstip="),
        F.col("destination_ip"),
        F.lit(" dstport="),
        F.col("destination_port").cast("string"),
        F.lit(" action="),
        F.col("event_action"),
        F.lit(" sentbyte="),
        F.col("k").cast("string"),
        F.when(F.col("k") % 2 == 0, " rcvdbyte=7").otherwise(""),
    )
    found = firewall.firewall_events(_lines(_numbered(spark, folder), line))
    return found.select(
        micros(), "host_name", "source_ip", "destination_ip", "destination_port", "event_action", "network_bytes"
    )


@query
def ids_parse(spark, folder):
    line = F.concat(
        _clock("yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit(" [**] [1:"),
        (F.col("k") + 2000).cast("string"),
        F.lit(":3] ET SCAN k"),
        F.col("k").cast("string"),
        F.lit(" [**] [Classification: Kind "),
        F.col("event_type_"),
        F.lit("] [Priority: "),
        F.col("event_severity").cast("string"),
        F.lit("] {"),
        F.upper("network_transport"),
        F.lit("} "),
        F.col("source_ip"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit(":"), F.col("source_port").cast("string"))).otherwise(""),
        F.lit(" -> "),
        F.col("destination_ip"),
        F.lit(":"),
        F.col("destination_port").cast("string"),
    )
    events = _numbered(spark, folder).withColumn("event_type_", F.col("event_action"))
    found = firewall.ids_events(_lines(events, line))
    return found.select(
        micros(),
        "event_category",
        "event_severity",
        "network_transport",
        "source_ip",
        F.coalesce("source_port", F.lit(-1)).alias("source_port"),
        "destination_port",
        "rule_id",
        "rule_name",
    )


@query
def flow_parse(spark, folder):
    table_ = _numbered(spark, folder).select(
        F.when(F.col("k") % 11 == 0, "soon").otherwise(_clock("dd/MM/yyyy HH:mm:ss")).alias("Time Stamp"),
        F.when(F.col("k") % 11 == 0, "soon").otherwise(_clock("dd/MM/yyyy HH:mm:ss")).alias(" Timestamp "),
        F.col("source_ip").alias("Src IP"),
        F.col("destination_port").cast("string").alias("Dst Port"),
        F.upper("network_transport").alias("Protocol"),
        F.col("event_action").alias("Label"),
        F.col("k").cast("string").alias("Tot Fwd Bytes"),
        F.when(F.col("k") % 2 == 0, "5").alias("Tot Bwd Bytes"),
    )
    found = flows.flow_events(table_)
    return found.select(micros(), "source_ip", "destination_port", "network_transport", "event_action", "network_bytes")


def _write_raw(lines: DataFrame, path: str, extension: str = "csv", *by: str) -> None:
    """Write a column of lines as they are, as files with this extension."""
    as_is = {"sep": "\u0001", "quote": "", "escapeQuotes": "false", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    lines.write.options(**as_is, extension=extension).partitionBy(*by).csv(path)


@query
def flow_files(spark, folder):
    """Flow records in CSV files under 50 headers: five ways to name and choose the columns, none to nine more before them."""
    events = _numbered(spark, folder).withColumn("variant", F.col("event_id").cast("bigint") % 50)
    names = [["Timestamp", "Src IP", "Dst Port", "Label", "Tot Fwd Bytes", "Tot Bwd Bytes"], ["source_ip", " Flow Start", "dport", "attack cat", "total_fwd_bytes", "total bwd bytes"],
             ["DATE TIME", "ip_src", "Destination Port", "Attack_Category", "tot fwd bytes", "TOT BWD BYTES"], ["ts", "srcip", "sport", "dst_port", "tot_fwd_bytes", "tot_bwd_bytes"],
             ["Start Time", "SourceAddress", "DPort", "label", "Tot Fwd Bytes", "comment"]]
    stamp, port = _clock("dd/MM/yyyy HH:mm:ss"), F.col("destination_port").cast("string")
    forward, backward = F.col("k").cast("string"), F.when(F.col("k") % 2 == 0, "5").otherwise("")
    quoted = F.concat(F.lit('"'), F.col("event_action"), F.lit('"'))
    cells = [[stamp, "source_ip", port, "event_action", forward, backward], ["source_ip", stamp, port, quoted, forward, backward], [stamp, "source_ip", port, "event_action", forward, backward],
             [stamp, "source_ip", F.lit("1"), port, forward, backward], [stamp, "source_ip", port, "event_action", forward, F.lit('"one, two"')]]
    more = F.array_repeat(F.lit("x,"), (F.col("variant") / 5).cast("int"))
    style = F.get(F.array(*[F.concat_ws(",", *row) for row in cells]), (F.col("variant") % 5).cast("int"))
    lines = events.select("variant", F.lit(1).alias("place"), F.concat(F.concat_ws("", more), style).alias("value"))
    tops = F.get(F.array(*[F.lit(",".join(n)) for n in names]), (F.col("variant") % 5).cast("int"))
    first = spark.range(50).select(F.col("id").alias("variant"), F.lit(0).alias("place"), F.concat(F.concat_ws("", more), tops).alias("value"))
    path = scratch_path(spark, "flow-files")
    ordered = lines.unionByName(first).repartition("variant").sortWithinPartitions("variant", "place")
    _write_raw(ordered.drop("place"), path, "csv", "variant")
    return flows.read_flows(spark, path).select(micros(), "source_ip", "destination_port", "event_action", "network_bytes")


@query
def ingest_chain(spark, folder):
    """Four kinds of logs written as files and read together: rows, distinct ids and times of each source."""
    events, path = _numbered(spark, folder), scratch_path(spark, "logs")
    day = F.concat(F.lit("date="), _clock("yyyy-MM-dd"), F.lit(" time="), _clock("HH:mm:ss"))
    _write_raw(events.select(F.concat_ws(" ", day, F.concat(F.lit("action="), F.col("event_action"))).alias("value")), f"{path}/firewall", "txt")
    _write_raw(events.select(F.concat_ws(" ", _clock("MMM dd HH:mm:ss"), F.lit("web sshd[1]:"), "message").alias("value")), f"{path}/syslog", "log")
    zeek = F.to_json(F.struct((F.lit(1_700_000_000) + F.col("k")).alias("ts"), F.col("source_ip").alias("id.orig_h"), F.when(F.col("k") % 2 == 0, F.col("event_id")).alias("uid")))
    _write_raw(events.select(zeek.alias("value")), f"{path}/zeek", "txt")
    table_ = events.select(_clock("dd/MM/yyyy HH:mm:ss").alias("Timestamp"), F.col("source_ip").alias("Src IP"))
    table_.write.option("header", "true").csv(f"{path}/flows")
    found = ingest.ingest(spark, {name: f"{path}/{name}" for name in ("firewall", "syslog", "zeek", "flows")}, 1970)
    return found.groupBy("source", "event_dataset").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_ids"), F.min(F.unix_micros("event_time")).alias("first_us"), F.max(F.unix_micros("event_time")).alias("last_us")
    )


def _records(df: DataFrame) -> DataFrame:
    """Rows as parsed JSON lines, with a blank and a broken line among them for every hundredth row."""
    whole = F.to_json(F.struct("*"))
    texts = df.select(F.explode(F.when(F.col("`k`") % 100 == 0, F.array(whole, F.lit(""), F.lit("{oops"))).otherwise(F.array(whole))).alias("value"))
    return jsonl.parse_records(texts)


@query
def windows_parse(spark, folder):
    iso = _clock("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    system = F.struct(F.col("host_name").alias("Computer"), F.when(F.col("login_failed") == 1, 4625).otherwise(4624).alias("EventID"))
    data = F.struct(F.col("user_name").alias("TargetUserName"), F.col("source_ip").alias("IpAddress"))
    events = add_flags(_numbered(spark, folder))
    raw = events.select("k", iso.alias("@timestamp"), F.struct(system.alias("System"), data.alias("EventData")).alias("Event"))
    found = jsonl.windows_events(_records(raw))
    return found.select(micros(), "host_name", "event_code", "user_name", "source_ip", "event_module", "event_dataset")


@query
def sysmon_parse(spark, folder):
    raw = _numbered(spark, folder).select(
        "k",
        _clock("yyyy-MM-dd HH:mm:ss.SSSSSS").alias("UtcTime"),
        F.col("host_name").alias("Computer"),
        F.lit(3).alias("EventID"),
        F.col("process_name").alias("Image"),
        F.col("process_command_line").alias("CommandLine"),
        F.col("destination_port").cast("string").alias("DestinationPort"),
    )
    found = jsonl.sysmon_events(_records(raw))
    return found.select(micros(), "host_name", "event_code", "process_name", "process_command_line", "destination_port", "event_dataset")


@query
def zeek_parse(spark, folder):
    raw = _numbered(spark, folder).select(
        "k",
        (F.lit(1_700_000_000) + F.col("k")).alias("ts"),
        F.col("source_ip").alias("id.orig_h"),
        F.col("source_port").alias("id.orig_p"),
        F.col("destination_ip").alias("id.resp_h"),
        F.col("event_outcome").alias("conn_state"),
        F.col("event_id").alias("uid"),
    )
    found = jsonl.zeek_events(_records(raw))
    return found.select("event_id", micros(), "source_ip", "source_port", "destination_ip", "event_outcome", "event_dataset")


@query
def beats_parse(spark, folder):
    raw = _numbered(spark, folder).select(
        "k",
        _clock("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("@timestamp"),
        F.struct(F.col("source_ip").alias("ip"), F.col("source_port").alias("port")).alias("source"),
        F.col("destination_ip").alias("destination.ip"),
        F.struct(F.col("k").alias("bytes"), F.col("network_transport").alias("transport")).alias("network"),
        F.struct(F.when(F.col("k") % 2 == 0, "").otherwise(F.col("event_module")).alias("module")).alias("event"),
    )
    found = jsonl.beats_events(_records(raw))
    return found.select(
        micros(), "source_ip", "source_port", "destination_ip", "network_bytes", "network_transport", "event_module", "event_dataset"
    )


@query
def documents_normalise(spark, folder):
    k = F.col("k")
    host = F.struct(
        F.when(k % 4 == 0, F.col("host_name")).alias("name"),
        F.when(k % 4 == 1, F.col("host_name")).alias("hostname"),
        F.when(k % 3 != 0, F.array("source_ip", "destination_ip")).alias("ip"),
    )
    raw = _numbered(spark, folder).select(
        "k",
        _clock("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("@timestamp"),
        host.alias("host"),
        F.when(k % 4 == 2, F.col("host_name")).alias("hostname"),
        F.struct(F.when(k % 4 == 3, F.col("host_name")).alias("computer_name")).alias("winlog"),
        F.struct(F.col("event_action").alias("action"), F.col("event_severity").alias("severity")).alias("event"),
    )
    found = jsonl.document_events(_records(raw))
    return found.select(micros(), "host_name", "host_ip", "event_action", "event_severity")


@query
def field_map(spark, folder):
    """Two raw fields for one target, the later one winning, and a mapped time."""
    raw = _numbered(spark, folder).select(
        "k",
        F.struct(F.col("source_ip").alias("addr")).alias("a.b"),
        F.struct(F.struct(F.col("destination_ip").alias("addr")).alias("b")).alias("a"),
        F.when(F.col("k") % 2 == 0, F.col("user_name")).alias("first"),
        F.when(F.col("k") % 3 == 0, F.col("host_name")).alias("second"),
        _clock("yyyy-MM-dd HH:mm:ss.SSSSSS").alias("seen"),
    )
    mapping = [("a.b.addr", "source.ip"), ("first", "user.name"), ("second", "user.name"), ("seen", "@timestamp")]
    return jsonl.map_fields(_records(raw), mapping).select(micros(), "source_ip", "user_name")


@query
def flatten_nested(spark, folder):
    events = ecs(spark, folder)
    docs = events.select(
        F.col("event_id").alias("id"),
        F.struct(F.col("event_action").alias("action"), F.col("event_severity").alias("severity")).alias("event"),
        F.struct(F.col("source_ip").alias("ip"), F.col("source_port").cast("string").alias("port")).alias("source"),
        F.struct(F.concat(F.lit("p"), F.col("destination_port")).alias("port")).alias("destination"),
        F.when(F.col("network_transport") == "tcp", "1.1.1.1").alias("source.ip"),
    )
    port = F.coalesce("destination_port", F.lit(-1)).alias("destination_port")
    return nested.flatten(docs).select("id", "event_action", "event_severity", "source_ip", "source_port", port)


def _text_lines(spark, folder) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))


def _dated_lines(spark, folder) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 10 == 0, "undated").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, folder, "orders").select("o_orderkey", F.concat(day, F.lit(" "), "o_orderpriority").alias("value"))


@query
def lines_by_keyword(spark, folder):
    return lines.lines_by_keyword(_text_lines(spark, folder), "The ")


@query
def lines_by_date(spark, folder):
    return lines.lines_by_date(_dated_lines(spark, folder), "1998-10")


@query
def lines_by_range(spark, folder):
    return lines.lines_by_range(_dated_lines(spark, folder), "1998-01-15", "1999-02-01")


@query
def time_range_scan(spark, folder):
    start, end = F.timestamp_micros(F.lit(947_000_000_000)), F.timestamp_micros(F.lit(947_900_000_000))
    found = firstk.time_range(ecs(spark, folder), start, end, 500, F.col("destination_port") != 80)
    return found.select("event_id", micros())


@query
def day_sample(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("event_id"), F.year("o_orderdate").alias("dt"))
    return store.training_sample(orders, per_day=100)


@query
def score_sample(spark, folder):
    return firstk.hash_sample(table(spark, folder, "orders"), 1000, "o_orderkey")


@query
def label_files(spark, folder):
    """Labels written as CSV and read again with their schema."""
    path = f"{scratch_path(spark, 'labels')}.csv"
    table(spark, folder, "labels").write.option("header", "true").csv(path)
    return store.read_table(spark, path, "doc_id bigint, quality int, toxic int")


@query
def threshold_merged(spark, folder):
    """Thresholds of three spans of windows from stored sketches of the windows, held against the ranks of all scores."""
    scores = materialize(windows.with_window(plain_score(spark, folder), 2).select("window_start", "anom_score"), "scores")
    sketches = materialize(quantile.score_sketches(scores, ["window_start"]), "sketches")
    middle = F.timestamp_micros(F.lit(947_640_000_000))
    spans = F.explode(F.when(F.col("window_start") < middle, F.array(F.lit("first"), F.lit("whole"))).otherwise(F.array(F.lit("second"), F.lit("whole")))).alias("span")
    found = quantile.merged_threshold(sketches.select("*", spans), ["span"])
    ranks = scores.select("anom_score", spans).join(F.broadcast(found), "span").groupBy("span", "n_rows").agg(
        (F.count_if(F.col("anom_score") < F.col("threshold")) / F.count("anom_score")).alias("_below"),
        (F.count_if(F.col("anom_score") <= F.col("threshold")) / F.count("anom_score")).alias("_upto"),
    )
    error = quantile.sketch_error(1_024)
    return ranks.select("span", "n_rows", ((F.col("_below") <= 0.95 + error) & (F.col("_upto") >= 0.95 - error)).alias("within_error"))


@query
def store_days(spark, folder):
    """Write the events to a day-partitioned store, replace a day, append to a source, and read back."""
    path = scratch_path(spark, "store")
    events = ecs(spark, folder)
    store.write_events(events.withColumn("source", F.col("event_module")), path)
    store.write_events(events.filter("event_module = 'ips' and network_transport = 'tcp'"), path, "ips")
    store.append_events(events.filter("event_module = 'windows'"), path, "windows")
    found = store.read_events(spark, path)
    return found.groupBy("source", "dt").agg(F.count(F.lit(1)).alias("n")).select(
        "source", F.col("dt").cast("string").alias("dt"), "n"
    )


@query
def audit_log(spark, folder):
    path = scratch_path(spark, "audit")
    plan = response.policy_plan(plain_score(spark, folder))
    store.append_audit(plan, path)
    logged = spark.read.schema("dry_run boolean, rule string, score double, action struct<type:string,cmd:string>, output string").json(path)
    return logged.select("dry_run", "rule", "score", F.col("action.cmd").alias("cmd"), "output")


@query
def report_file(spark, folder):
    path = scratch_path(spark, "report")
    store.write_report(report.source_breakdown(ecs(spark, folder)), path)
    return spark.read.schema("event_module string, event_dataset string, count bigint").json(path)


# --- model ---------------------------------------------------------------------------------------------------------


def _vectors(spark, folder) -> tuple[DataFrame, list[str]]:
    names = [f"f{i:02d}" for i in range(64)]
    columns = [F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]
    return table(spark, folder, "embeddings").select("vec_id", "label", *columns), names


def _forest(spark, folder) -> tuple[DataFrame, forest.ForestModel]:
    vectors, names = _vectors(spark, folder)
    return vectors, forest.train(vectors, names, id_col="vec_id")


@query
def attribution_abs_top5(spark, folder):
    vectors, names = _vectors(spark, folder)
    ranked = F.transform(forest.top_raw_features(names), lambda item: item["feature"])
    return vectors.select("vec_id", F.array_join(ranked, ",").alias("top_features"))


@query
def iforest_nodes(spark, folder):
    vectors, names = _vectors(spark, folder)
    fitted = forest.train(vectors, names, id_col="vec_id")
    path = scratch_path(spark, "model")
    forest.save(fitted, spark, path)
    return spark.read.parquet(f"{path}/nodes").select("tree_id", "node_id", "feature", r6("split"), "left", "right", "depth", "n")


@query
def iforest_scores(spark, folder):
    vectors, fitted = _forest(spark, folder)
    return forest.score(vectors, fitted).select("vec_id", "label", r6("anom_score"))


@query
def iforest_alerts(spark, folder):
    vectors, fitted = _forest(spark, folder)
    return alerts.select_alerts(materialize(forest.score(vectors, fitted), "scores"), id_col="vec_id").select("vec_id", r6("anom_score"), r6("threshold"))


@query
def iforest_baseline(spark, folder):
    vectors, fitted = _forest(spark, folder)
    return quantile.compute_threshold(materialize(forest.score(vectors, fitted), "scores")).select(r6("threshold"), "n_alerts")


@query
def attribution_top5(spark, folder):
    vectors, fitted = _forest(spark, folder)
    chosen = alerts.select_alerts(materialize(forest.score(vectors, fitted), "scores"), id_col="vec_id")
    return forest.attribution(chosen, fitted).select("vec_id", F.explode("top_features").alias("item")).select(
        "vec_id", "item.feature", r6("item.value", "value")
    )


@query
def event_detection(spark, folder):
    """Events to alerts in one go: features, forest, scores, threshold, mappings."""
    features = materialize(build_features(ecs(spark, folder)), "features")
    fitted = forest.train(features, feature_columns())
    found = rules.annotate(alerts.select_alerts(materialize(forest.score(features, fitted), "scores")))
    return found.select("event_id", r6("anom_score"), "mitre_techniques", "nist_functions", "risk_level")


# --- streams -------------------------------------------------------------------------------------------------------


def _dealt(spark, folder, late_minutes: int = 10, pieces: int = 4) -> DataFrame:
    """The raw events with the ``piece`` they come in: steps of the table's time, but every seventh event of a step's last
    ``late_minutes`` comes with the next step."""
    whole = raw_events(spark, folder)
    first, last = whole.agg(F.min("t_us"), F.max("t_us")).first()
    step = (last - first) // pieces + 1
    place = F.floor((F.col("t_us") - first) / step)
    late = (F.pmod("event_id", F.lit(7)) == 0) & (F.pmod(F.col("t_us") - first, F.lit(step)) >= step - late_minutes * 60_000_000)
    return materialize(whole.withColumn("piece", F.least(place + late.cast("int"), F.lit(pieces - 1))), "stream-source")


def _stream(spark, folder, pieces: int = 4, closing: DataFrame | None = None) -> DataFrame:
    """The events as a file stream in several batches, through the same adapter as in batch, with some events late.

    ``closing`` are raw events that come after all others.
    """
    dealt = _dealt(spark, folder, pieces=pieces)
    stored, parts = scratch_path(spark, "stream-in"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    for piece in range(pieces):
        dealt.filter(F.col("piece") == piece).drop("piece").repartition(parts, "event_id").write.mode("append").parquet(stored)
    if closing is not None:
        closing.write.mode("append").parquet(stored)
    source = spark.readStream.schema(dealt.drop("piece").schema).option("maxFilesPerTrigger", parts).parquet(stored)
    return add_flags(security_events(source))


@query
def stream_windows(spark, folder):
    counted = streams.tumbling_counts(_stream(spark, folder), minutes=2, flags=["login_failed"])
    found = streams.run_to_latest(counted, ["window_start"])
    return found.select(micros("window_start", "start_us"), "n_events", "login_failed")


@query
def stream_sessions(spark, folder):
    """Each session once, when the watermark passes its end; an event an hour later closes the last ones."""
    raw = raw_events(spark, folder)
    newest = raw.orderBy(F.desc("t_us")).limit(1)
    closing = newest.withColumns({"t_us": F.col("t_us") + F.lit(3_600_000_000), "user_id": F.lit(-1).cast(raw.schema["user_id"].dataType)})
    found = streams.run_to_table(streams.stream_sessions(_stream(spark, folder, closing=closing), 5))
    return found.select(
        "source_ip", "destination_ip", "network_transport", micros("session_start", "start_us"), micros("session_end", "end_us"), "n_events"
    )


@query
def stream_rolling(spark, folder):
    found = stateful.rolling_counts(_stream(spark, folder), F.col("source_ip"), FLAGS)
    return stateful.latest(streams.run_to_latest(found, ["entity", "t_us", "version"]))


def _stream_features(events: DataFrame) -> DataFrame:
    """Flags and the rolling features that the stream's score reads; the flags are written out once, as both kinds of key read them."""
    key = entity_key(F.col("source_ip"), F.col("user_name"), F.col("host_name")).alias("entity")
    flags = add_flags(events).select("event_id", "event_time", key, "source_ip", "destination_port", "login_failed", "conn_suspicious")
    keyed = materialize(flags, "flagged")
    counted = rolling(keyed, F.col("entity"), {"login_failed": "login_failed_count_{w}m"}, windows=(5,))
    scanned = rolling(counted, F.col("source_ip"), {}, {"destination_port": "uniq_dport_per_src_{w}m"}, windows=(1,), of=keyed)
    return scanned.select("event_id", "event_time", "login_failed", "conn_suspicious", "login_failed_count_5m", "uniq_dport_per_src_1m")


def _stream_score(features: DataFrame) -> DataFrame:
    score = F.col("login_failed") * 0.5 + F.col("conn_suspicious") * 0.25 + F.col("login_failed_count_5m") / 100 + F.col("uniq_dport_per_src_1m") / 20
    return features.withColumn("anom_score", F.round(score, 6))


def _run_in_pieces(spark, folder, late_minutes: int) -> str:
    """Let the events come piece by piece, each a batch of a stream that starts again where it stopped; returns the folder."""
    dealt, out = _dealt(spark, folder), scratch_path(spark, "detection")
    sink = revising.RevisingSink(f"{out}/tables", lambda _: Detector(_stream_score, 1.0), minutes=2, late_minutes=late_minutes, featurize=_stream_features)
    for piece in range(4):
        dealt.filter(F.col("piece") == piece).drop("piece").write.mode("append").parquet(f"{out}/in")
        source = security_events(spark.readStream.schema(dealt.drop("piece").schema).parquet(f"{out}/in"))
        streams.start(source, sink, f"{out}/checkpoint").awaitTermination()
    return f"{out}/tables"


@query
def stream_detection(spark, folder):
    """Scores and classes of all windows after late events have revised them."""
    path = _run_in_pieces(spark, folder, late_minutes=20)
    classes = revising.current(spark, path, "meta").select("window_us", "classification", "rows_scored", "alerts")
    scores = revising.current(spark, path).select("event_id", "anom_score", "window_us")
    return scores.join(classes, "window_us").withColumnRenamed("window_us", "start_us")


@query
def stream_late(spark, folder):
    """Events taken and events behind the watermark of every batch, the latter counted from their table."""
    path = _run_in_pieces(spark, folder, late_minutes=2)
    counted = revising.late_events(spark, path).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_late"), F.min(F.unix_micros("event_time")).alias("oldest_late_us"))
    found = revising.progress(spark, path).select("batch_id", "n_events", "watermark_us").join(counted, "batch_id", "left")
    numbers = ["n_events", "n_late", "watermark_us", "oldest_late_us"]  # the first batch has no watermark, here 0
    return found.select("batch_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers])


@query
def retrain_job(spark, folder):
    """A day's training: baseline and newest NORMAL windows, scaler, forest and threshold stored, put in force, read again."""
    names = [*FLAGS, "cbs_failed", "network_bytes", "network_packets", "event_severity", "destination_port"]
    events = materialize(plain_score(spark, folder).select("event_id", "event_time", "anom_score", *names), "events")
    start = events.agg(F.min("event_time")).scalar()
    baseline = events.filter(F.col("event_time") < start + F.expr("interval 10 minutes"))
    classes = windows.classify_windows(events, F.lit(1.45), minutes=2)
    root = scratch_path(spark, "models")
    version = model_store.retrain(baseline, events.drop("anom_score"), classes, root, names, minutes=2)
    model, threshold, _ = model_store.load(spark, root)
    rows = windows.retrain_set(baseline, windows.normal_history(events, classes, minutes=2))
    scored = forest.score(rows, model).agg(
        F.count(F.lit(1)).alias("n_scored"), F.count_if(F.col("anom_score") >= threshold).alias("_from"), F.count_if(F.col("anom_score") > threshold).alias("_over")
    )
    entry = model_store.pointers(spark, root).where(F.col("version") == version)
    share = F.expr("n_scored - 1 - floor(0.95D * (n_scored - 1))")
    return entry.crossJoin(scored).select(
        "version", "n_rows", "n_baseline", "n_features", micros("trained_from", "from_us"), micros("trained_to", "to_us"), "n_scored",
        F.lit(",".join(model.features)).alias("features"), F.lit(int(model.nodes["tree_id"].nunique())).alias("trees"),
        share.alias("n_alerts_meant"), ((F.col("_from") >= share) & (F.col("_over") <= share)).alias("threshold_holds"),
    )
