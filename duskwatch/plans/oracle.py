"""The same results in plain SQL over the shared tables, to check the queries of ``catalog`` against."""

from __future__ import annotations

from duskwatch.schema import FLAGS, WINDOWS_MIN, feature_columns

ORACLES: dict[str, str] = {}

_RAW = """raw AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1800 AS t_us,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""
_ADDR = """addr AS (
  SELECT *, CASE WHEN event_type = 'error' THEN '10.0.0.' || (user_id % 3) ELSE '10.0.1.' || (user_id % 50) END AS source_ip,
    CASE k % 6 WHEN 0 THEN 22 WHEN 1 THEN 3389 WHEN 2 THEN 445 WHEN 3 THEN 4444 WHEN 4 THEN 80 ELSE 443 END AS port
  FROM raw)"""
_ECS = """ecs AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, t_us, k, event_type, value,
    CASE WHEN k % 13 = 0 THEN 'ips' WHEN k % 11 = 0 THEN 'windows' ELSE 'network' END AS event_module,
    CASE WHEN k % 13 = 0 THEN 'ips.alert' WHEN k % 11 = 0 THEN 'cbs' ELSE 'flow' END AS event_dataset,
    CASE event_type WHEN 'purchase' THEN 'allow' WHEN 'click' THEN 'accept' WHEN 'view' THEN 'http_request'
      WHEN 'signup' THEN CASE WHEN k % 3 = 0 THEN 'deny' ELSE 'user_login' END ELSE 'user_login' END AS event_action,
    CASE WHEN event_type = 'error' THEN 'failure' WHEN k % 17 = 0 THEN 'S0' ELSE 'success' END AS event_outcome,
    CAST(k % 5 AS INTEGER) AS event_severity, 'host-' || (user_id % 50) AS host_name, 'user-' || user_id AS user_name,
    source_ip, CAST(40000 + k AS INTEGER) AS source_port, '192.168.0.' || (k % 10) AS destination_ip,
    CAST(port AS INTEGER) AS destination_port, CASE WHEN k % 2 = 0 THEN 'tcp' ELSE 'udp' END AS network_transport,
    value AS network_bytes, CAST(k AS DOUBLE) AS network_packets, 'proc-' || (k % 7) AS process_name,
    CASE WHEN k % 4 <> 0 THEN event_type || ' --k=' || k END AS process_command_line,
    (CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Accepted' END) || ' password for user-' || user_id || ' from '
      || source_ip || ' port ' || port || ' ssh2' AS message
  FROM addr)"""
_FLAGGED = r"""flagged AS (
  SELECT *, source_ip AS entity,
    CAST(event_outcome = 'failure' OR regexp_matches(lower(message), 'failed password|authentication failure|invalid user')
      AS INTEGER) AS login_failed,
    CAST(destination_port = 4444 OR event_outcome = 'S0' AS INTEGER) AS conn_suspicious,
    CAST(event_action IN ('allow', 'allowed', 'permit', 'accept', 'close') AS INTEGER) AS action_allow,
    CAST(event_action IN ('deny', 'denied', 'drop', 'blocked', 'reset') AS INTEGER) AS action_deny,
    CAST(event_module = 'ips' AS INTEGER) AS ips_alert,
    CAST(event_module = 'windows' AND event_dataset = 'cbs' AND regexp_matches(message, '(?i)(fail|error|0x[0-9a-f]{2,})')
      AS INTEGER) AS cbs_failed
  FROM ecs)"""
_SCORED = """scored AS (
  SELECT *, round(login_failed * 0.5::DOUBLE + conn_suspicious * 0.25::DOUBLE + network_bytes / 1000, 6) AS anom_score
  FROM flagged)"""


def _frame(key: str, minutes: int) -> str:
    return f"(PARTITION BY {key} ORDER BY t_us RANGE BETWEEN {minutes * 60_000_000 - 1} PRECEDING AND CURRENT ROW)"


_DETECTED = f"""counted AS (
  SELECT *, CAST(sum(login_failed) OVER five AS DOUBLE) AS lf5, CAST(sum(action_allow) OVER five AS DOUBLE) AS al5,
    CAST(sum(action_deny) OVER five AS DOUBLE) AS de5,
    count(DISTINCT destination_port) OVER {_frame("source_ip", 1)} AS ports
  FROM scored WINDOW five AS {_frame("entity", 5)}),
detected AS (
  SELECT *, de5 / (de5 + al5 + 1e-6) AS deny_ratio_5m, lf5 / (lf5 + al5 + de5 + 1e-6) AS login_failed_ratio_5m,
    (lf5 > 10 AND lf5 / (lf5 + al5 + de5 + 1e-6) > 0.4) AS brute,
    (destination_port IN (22, 3389, 445) AND action_allow = 1) AS remote, (ports > 3 AND conn_suspicious = 1) AS scan
  FROM counted)"""
_TECHNIQUES = """techniques AS (
  SELECT event_id, 1 AS place, 'rule_bruteforce' AS rule_id, 'Credential Access' AS tactic, 'T1110' AS technique,
    'T1110.001' AS subtechnique, 'nist_detect_bruteforce' AS control_id, 'DETECT' AS function, 'DE.CM' AS category,
    'DE.CM-7' AS subcategory FROM {t} WHERE brute
  UNION ALL SELECT event_id, 2, 'rule_remote_service', 'Lateral Movement', 'T1021', NULL, 'nist_respond_lateral', 'RESPOND',
    'RS.MI', 'RS.MI-1' FROM {t} WHERE remote
  UNION ALL SELECT event_id, 3, 'rule_port_scan', 'Discovery', 'T1046', NULL, 'nist_detect_portscan', 'DETECT', 'DE.CM',
    'DE.CM-8' FROM {t} WHERE scan)"""
_ALERTS = """limits AS (SELECT quantile_cont(anom_score, 0.95) AS threshold FROM detected),
alerts AS (SELECT d.*, l.threshold FROM detected d, limits l WHERE d.anom_score >= l.threshold)"""
_TOP = """top AS (
  SELECT s.*, l.threshold FROM scored s, (SELECT quantile_cont(anom_score, 0.95) AS threshold FROM scored) l
  WHERE s.anom_score >= l.threshold ORDER BY s.anom_score DESC, s.event_id LIMIT 10)"""


_EVERY = _TOP.replace("top AS", "alerts AS").replace(" ORDER BY s.anom_score DESC, s.event_id LIMIT 10", "")


def _with(parts: list[str], body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body


def over_ecs(name: str, body: str, *more: str) -> None:
    ORACLES[name] = _with([_RAW, _ADDR, _ECS, *more], body)


def over_flagged(name: str, body: str, *more: str) -> None:
    over_ecs(name, body, _FLAGGED, *more)


def over_scored(name: str, body: str, *more: str) -> None:
    over_flagged(name, body, _SCORED, *more)


def over_detected(name: str, body: str, *more: str) -> None:
    over_scored(name, body, _DETECTED, _TECHNIQUES.format(t="detected"), *more)


def over_alerts(name: str, body: str, *more: str) -> None:
    over_scored(name, body, _DETECTED, _ALERTS, _TECHNIQUES.format(t="alerts"), *more)


def over_top(name: str, body: str, *more: str) -> None:
    over_scored(name, body, _TOP, *more)


def over_every(name: str, body: str, *more: str) -> None:
    """Over all events at or above the threshold of the plain score."""
    over_scored(name, body, _EVERY, *more)


def _entropy(text: str, key: str, source: str) -> str:
    """Entropy per key of a text column."""
    return f"""SELECT {key}, coalesce(-sum(c / n * log2(c / n)), 0) AS entropy FROM (
      SELECT {key}, ch, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY {key})::DOUBLE AS n FROM (
        SELECT {key}, unnest(string_split({text}, '')) AS ch FROM {source}) GROUP BY {key}, ch) GROUP BY {key}"""


# --- expressions ---------------------------------------------------------------------------------------------------

over_detected("technique_alerts", "SELECT technique, count(*) AS count FROM techniques GROUP BY technique")
over_flagged("security_flags", "SELECT event_id, login_failed, conn_suspicious, ips_alert FROM flagged")
over_flagged("action_flags", "SELECT event_id, action_allow, action_deny FROM flagged")
over_flagged("cbs_flag", "SELECT event_id, cbs_failed FROM flagged")
over_ecs(
    "entity_keys",
    """SELECT coalesce(CASE WHEN destination_port <> 22 THEN source_ip END,
      CASE WHEN destination_ip <> '192.168.0.2' THEN user_name END,
      CASE WHEN network_transport = 'udp' THEN host_name END, 'unknown') AS entity, count(*) AS n FROM ecs GROUP BY 1""",
)
ORACLES["entropy_documents"] = (
    "SELECT d.doc_id, round(coalesce(e.entropy, 0), 6) AS entropy FROM documents d LEFT JOIN ("
    + _entropy("text", "doc_id", "documents")
    + ") e USING (doc_id)"
)
ORACLES["entropy_sql_function"] = ORACLES["entropy_documents"]
ORACLES["token_entropy_conversations"] = f"""WITH tokens AS (
  SELECT conv_id, turn, unnest(string_split(text, ' ')) AS token FROM conversations),
numbered AS (SELECT *, row_number() OVER () AS token_no FROM tokens WHERE token <> ''),
each AS ({_entropy("token", "token_no", "numbered")})
SELECT c.conv_id, c.turn, round(coalesce(avg(e.entropy), 0), 6) AS entropy
FROM conversations c LEFT JOIN numbered n ON c.conv_id = n.conv_id AND c.turn = n.turn LEFT JOIN each e USING (token_no)
GROUP BY c.conv_id, c.turn"""
over_ecs(
    "text_entropy_fallback",
    f"""SELECT event_id, round(entropy, 6) AS text_entropy FROM ({_entropy("t", "event_id", "chosen")})""",
    "chosen AS (SELECT event_id, coalesce(process_command_line, message) AS t FROM ecs)",
)
ORACLES["risk_words"] = r"""WITH said AS (
  SELECT conv_id, turn, lower(CASE turn % 3 WHEN 0 THEN text || ' Risk: High.' WHEN 1 THEN text || ' moderate, then low'
    ELSE text END) AS t FROM conversations)
SELECT conv_id, turn, CASE
  WHEN regexp_matches(t, '(^|[^\p{L}\p{N}\p{M}_])(cao|nghiêm\s*trọng|critical|high)($|[^\p{L}\p{N}\p{M}_])') THEN 'HIGH'
  WHEN regexp_matches(t, '(^|[^\p{L}\p{N}\p{M}_])(trung\s*bình|vừa|medium|med|moderate)($|[^\p{L}\p{N}\p{M}_])') THEN 'MEDIUM'
  ELSE 'LOW' END AS risk FROM said"""
ORACLES["truncate_text"] = """SELECT page_id, CASE WHEN length(html) <= 200 THEN html
  ELSE substring(html, 1, 197) || '...' END AS html FROM pages"""
over_detected(
    "technique_url",
    """SELECT CASE WHEN t IS NULL THEN '' ELSE 'https://attack.mitre.org/techniques/' || replace(t, '.', '/') || '/' END AS url,
      count(*) AS n FROM (SELECT technique AS t FROM techniques UNION ALL SELECT subtechnique FROM techniques) GROUP BY 1""",
)
over_ecs("dedup_labels", "SELECT event_id, event_module || '|' || event_dataset || '|' || event_action AS labels FROM ecs")
over_every(
    "ioc_long",
    """SELECT event_id AS alert_id, 'host.name' AS kind, host_name AS value FROM alerts
      UNION SELECT event_id, 'user.name', user_name FROM alerts UNION SELECT event_id, 'source.ip', source_ip FROM alerts
      UNION SELECT event_id, 'destination.ip', destination_ip FROM alerts""",
)

# --- windows -------------------------------------------------------------------------------------------------------


def _rolled(name: str, key: str, columns: dict[str, str]) -> None:
    parts = [
        f"round(CAST({value} OVER {_frame(key, w)} AS DOUBLE), 6) AS {column.format(w=w)}"
        for column, value in columns.items()
        for w in WINDOWS_MIN
    ]
    over_flagged(name, "SELECT event_id, " + ",\n".join(parts) + " FROM flagged")


for _suffix, _key in (("", "entity"), ("_host", "host_name"), ("_user", "user_name"), ("_dst", "destination_ip")):
    _rolled(
        f"rolling_login_failed_{_suffix[1:] or 'entity'}", _key, {f"login_failed_count{_suffix}_{{w}}m": "sum(login_failed)"}
    )
_rolled("rolling_cbs_host", "host_name", {"cbs_failed_count_host_{w}m": "sum(cbs_failed)"})
_rolled("rolling_cbs_proc", "process_name", {"cbs_failed_count_proc_{w}m": "sum(cbs_failed)"})
_UNIQUE = {
    "uniq_dst_per_src": ("source_ip", "destination_ip"),
    "uniq_src_per_dst": ("destination_ip", "source_ip"),
    "uniq_dport_per_src": ("source_ip", "destination_port"),
}
for _name, (_key, _value) in _UNIQUE.items():
    _rolled(f"rolling_{_name}", _key, {f"{_name}_{{w}}m": f"count(DISTINCT {_value})"})
_rolled(
    "rolling_traffic_dst",
    "destination_ip",
    {"network_bytes_sum_{w}m": "sum(network_bytes)", "network_packets_sum_{w}m": "sum(network_packets)"},
)


def _sessions(seconds: int) -> str:
    return f"""starts AS (
  SELECT *, CASE WHEN lag(t_us) OVER w IS NULL OR lag(network_transport) OVER w <> network_transport
    OR t_us - lag(t_us) OVER w > {seconds * 1_000_000} THEN 1 ELSE 0 END AS s
  FROM ecs WINDOW w AS (PARTITION BY source_ip, destination_ip ORDER BY t_us, network_transport)),
sessions AS (
  SELECT *, CAST(sum(s) OVER (PARTITION BY source_ip, destination_ip ORDER BY t_us, network_transport
    RANGE UNBOUNDED PRECEDING) AS BIGINT) AS session_seq FROM starts),
named AS (SELECT *, source_ip || '>' || destination_ip || '#' || session_seq AS session_id FROM sessions)"""


over_ecs("sessions", "SELECT event_id, session_seq, session_id FROM named", _sessions(5))
over_ecs(
    "session_summary",
    "SELECT session_id, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n_events FROM named GROUP BY session_id",
    _sessions(120),
)


def _feature_sql() -> dict[str, str]:
    """SQL of every feature over the table ``named`` with the entropies joined."""
    sql = {n: f"CAST({n} AS DOUBLE)" for n in ("login_failed", "conn_suspicious", "action_allow", "action_deny", "ips_alert", "cbs_failed")}
    sql["process_command_line_entropy"] = "coalesce(ce.entropy, 0)"
    sql["message_entropy"] = "coalesce(me.entropy, 0)"
    sql["text_entropy"] = "CASE WHEN process_command_line IS NOT NULL THEN ce.entropy ELSE me.entropy END"
    for w in WINDOWS_MIN:
        for suffix, key in (("", "entity"), ("_host", "host_name"), ("_user", "user_name"), ("_dst", "destination_ip")):
            for flag in FLAGS:
                sql[f"{flag}_count{suffix}_{w}m"] = f"CAST(sum({flag}) OVER {_frame(key, w)} AS DOUBLE)"
        sql[f"cbs_failed_count_host_{w}m"] = f"CAST(sum(cbs_failed) OVER {_frame('host_name', w)} AS DOUBLE)"
        sql[f"cbs_failed_count_proc_{w}m"] = f"CAST(sum(cbs_failed) OVER {_frame('process_name', w)} AS DOUBLE)"
        for name, (key, value) in _UNIQUE.items():
            sql[f"{name}_{w}m"] = f"CAST(count(DISTINCT {value}) OVER {_frame(key, w)} AS DOUBLE)"
        for measure in ("network_bytes", "network_packets"):
            sql[f"{measure}_sum_{w}m"] = f"sum({measure}) OVER {_frame('destination_ip', w)}"
        failed, allow, deny = (sql[f"{f}_count_{w}m"] for f in ("login_failed", "action_allow", "action_deny"))
        sql[f"deny_ratio_{w}m"] = f"{deny} / ({deny} + {allow} + 1e-6)"
        sql[f"login_failed_ratio_{w}m"] = f"{failed} / ({failed} + {allow} + {deny} + 1e-6)"
    return sql


_FEATURES = _feature_sql()
over_ecs(
    "feature_table",
    "SELECT event_id, t_us, session_id, "
    + ",\n".join(f"round({_FEATURES[n]}, 6) AS {n}" for n in feature_columns())
    + " FROM flagged LEFT JOIN ce USING (event_id) LEFT JOIN me USING (event_id)",
    _sessions(120),
    _FLAGGED.replace("FROM ecs)", "FROM named)"),
    "ce AS (" + _entropy("process_command_line", "event_id", "ecs") + ")",
    "me AS (" + _entropy("message", "event_id", "ecs") + ")",
)
_SLICE = "t_us BETWEEN 947400000000 AND 948000000000"
ORACLES["feature_slice"] = (
    "SELECT * EXCLUDE (session_id) FROM (" + ORACLES["feature_table"] + f") WHERE {_SLICE}"
)
over_flagged(
    "ratios",
    "SELECT event_id, "
    + ", ".join(f"round({_FEATURES[n]}, 6) AS {n}" for w in WINDOWS_MIN for n in (f"deny_ratio_{w}m", f"login_failed_ratio_{w}m"))
    + " FROM flagged",
)

# --- quantiles, alerts, labels -------------------------------------------------------------------------------------

ORACLES["threshold_quantile"] = """SELECT round(t, 6) AS threshold,
  (SELECT count(*) FROM lineitem WHERE l_extendedprice >= t) AS n_alerts
  FROM (SELECT quantile_cont(l_extendedprice, 0.95) AS t FROM lineitem)"""
ORACLES["threshold_meanstd"] = """SELECT round(t, 4) AS threshold,
  (SELECT count(*) FROM lineitem WHERE l_extendedprice >= t) AS n_alerts
  FROM (SELECT avg(l_extendedprice) + stddev_samp(l_extendedprice) AS t FROM lineitem)"""
over_top("alerts_topn", "SELECT event_id, anom_score, round(threshold, 6) AS threshold FROM top")
_FITTED = [*feature_columns(), "host_name", "always"]
_TABLE = (
    "WITH f AS MATERIALIZED (SELECT *, 0 AS host_name, 7 AS always FROM (" + ORACLES["feature_table"] + "))\n"
)
ORACLES["constant_columns"] = _TABLE + "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, min(coalesce({c}, 0)) = max(coalesce({c}, 0)) AS constant FROM f" for c in _FITTED
)
ORACLES["scaler_fit"] = _TABLE + "\nUNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(q[2], 6) AS center, round(CASE WHEN q[3] - q[1] = 0 THEN 1 ELSE q[3] - q[1] END, 6) AS scale
  FROM (SELECT quantile_cont(coalesce({c}, 0)::DOUBLE, [0.25, 0.5, 0.75]) AS q FROM f)"""
    for c in _FITTED
)
ORACLES["robust_scaled"] = (
    _TABLE.rstrip()
    + ", q AS (SELECT "
    + ", ".join(f"quantile_cont(coalesce({c}, 0)::DOUBLE, [0.25, 0.5, 0.75]) AS q_{c}" for c in _FITTED)
    + " FROM f)\nSELECT event_id, "
    + ", ".join(
        f"round((coalesce({c}, 0) - q_{c}[2]) / CASE WHEN q_{c}[3] = q_{c}[1] THEN 1 ELSE q_{c}[3] - q_{c}[1] END, 4) AS {c}" for c in _FITTED
    )
    + " FROM f, q"
)
ORACLES["label_joined"] = """SELECT d.doc_id, d.n_chars, coalesce(l.quality, -1) AS quality FROM documents d
  LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)"""
ORACLES["evaluate_labels"] = """WITH j AS (
  SELECT d.n_chars::DOUBLE AS s, coalesce(l.toxic = 1, false) AS y FROM documents d
  LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
t AS (SELECT quantile_cont(s, 0.95) AS threshold FROM j),
c AS (SELECT threshold, count(*) AS total, count(*) FILTER (y) AS positive, count(*) FILTER (y AND s >= threshold) AS tp,
  count(*) FILTER (NOT y AND s >= threshold) AS fp, count(*) FILTER (y AND s < threshold) AS fn,
  count(*) FILTER (NOT y AND s < threshold) AS tn FROM j, t GROUP BY threshold)
SELECT total, positive, total - positive AS negative, tp, fp, fn, tn, round(threshold, 6) AS threshold,
  round(tp / (tp + fn + 1e-9), 6) AS tpr, round(fp / (fp + tn + 1e-9), 6) AS fpr,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c"""
over_ecs(
    "label_join_events",
    """SELECT e.event_id, coalesce(m.label, -1) AS label FROM e LEFT JOIN (SELECT t_us, source_ip, destination_ip, h, max(event_severity) AS label
      FROM e WHERE destination_port = 4444 GROUP BY ALL) m
      ON e.t_us = m.t_us AND e.source_ip = m.source_ip AND e.destination_ip = m.destination_ip
      AND e.h IS NOT DISTINCT FROM m.h""",
    "e AS (SELECT *, CASE WHEN network_transport = 'tcp' THEN host_name END AS h FROM ecs)",
)

# --- rules ---------------------------------------------------------------------------------------------------------

over_detected("mitre_hits", "SELECT event_id, rule_id, tactic, technique, subtechnique FROM techniques")
over_detected("nist_hits", "SELECT event_id, control_id AS rule_id, function, category, subcategory FROM techniques")
over_alerts("mitre_counts", "SELECT technique, count(*) AS count FROM techniques GROUP BY technique")
over_alerts(
    "nist_counts",
    """SELECT 'function' AS kind, function AS name, count(DISTINCT event_id) AS count FROM techniques GROUP BY function
      UNION ALL SELECT 'category', category, count(DISTINCT event_id) FROM techniques GROUP BY category""",
)
over_flagged(
    "rule_language",
    """SELECT count(*) FILTER (network_packets > 50) AS greater, count(*) FILTER (CAST(event_id AS DOUBLE) >= 100) AS text_number,
      0::BIGINT AS not_a_number, count(*) FILTER (lower(event_action) IN ('allow', 'deny')) AS list_text,
      count(*) FILTER (destination_port IN (22, 80)) AS list_number, count(*) FILTER (event_outcome = 'S0') AS equal_text,
      count(*) FILTER (event_severity = 3) AS equal_number, 0::BIGINT AS text_for_number, 0::BIGINT AS absent, count(*) AS none,
      count(*) FILTER (login_failed = 1 AND network_transport = 'tcp') AS two FROM flagged""",
)
_ANNOTATED = """annotated AS (
  SELECT a.event_id, a.t_us, a.host_name, a.user_name, a.source_ip, a.destination_ip, a.destination_port, a.anom_score,
    coalesce(string_agg(DISTINCT t.tactic, ', ' ORDER BY t.tactic), '') AS mitre_tactics,
    coalesce(string_agg(DISTINCT t.technique, ', ' ORDER BY t.technique), '') AS mitre_techniques,
    coalesce(string_agg(DISTINCT t.function, ', ' ORDER BY t.function), '') AS nist_functions,
    coalesce(string_agg(DISTINCT t.category, ', ' ORDER BY t.category), '') AS nist_categories,
    CASE WHEN count(t.technique) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
  FROM alerts a LEFT JOIN techniques t USING (event_id) GROUP BY ALL)"""
over_alerts(
    "alert_annotated",
    "SELECT event_id, mitre_tactics, mitre_techniques, nist_functions, nist_categories, risk_level FROM annotated",
    _ANNOTATED,
)
over_ecs(
    "keyword_techniques",
    """SELECT event_id, concat_ws('|', CASE WHEN event_severity = 1 THEN 'T1046 Network Service Discovery' END,
      CASE WHEN event_severity = 2 THEN 'T1059.001 PowerShell|TA0011 Command and Control' END,
      CASE WHEN destination_port IN (3389, 445) THEN 'T1021 Remote Services' END) AS techniques FROM ecs""",
)
over_detected(
    "threat_first",
    """SELECT event_id, tactic AS threat_tactic_name, technique AS threat_technique_name, technique AS threat_technique_id,
      subtechnique AS threat_technique_subtechnique FROM techniques
      QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY place) = 1""",
)
over_scored(
    "policy_plan",
    """SELECT event_id, t_us, 'High IF score fallback' AS rule, anom_score AS score, 1 AS action_no, 'powershell' AS action_type,
      'wevtutil qe System /c:50 /rd:true /f:text' AS action_cmd, true AS dry_run FROM scored WHERE anom_score >= 0.327""",
)
over_ecs(
    "risk_escalation",
    """SELECT CASE WHEN event_severity <= 2 THEN 'HIGH' WHEN destination_port IN (3389, 445) OR event_action = 'deny' THEN 'MEDIUM'
      ELSE 'LOW' END AS risk, count(*) AS n FROM ecs GROUP BY 1""",
)
over_ecs(
    "recommended_actions",
    """SELECT event_id, concat_ws('|', CASE WHEN event_severity <> 1 THEN 'block_source_ip:' || source_ip END,
      CASE WHEN event_severity <> 0 THEN 'disable_account:' || user_name || '|reset_password:' || user_name END,
      'isolate_host:' || host_name, 'run_antivirus_scan', 'collect_event_logs',
      CASE WHEN event_severity <> 2 THEN 'stop_process:' || process_name || '|hash_executable:' || process_name END,
      CASE WHEN event_severity <> 0 THEN 'revoke_admin_rights:' || user_name END, 'watch_related_logs') AS actions FROM ecs""",
)

# --- investigation -------------------------------------------------------------------------------------------------

over_top(
    "alert_context",
    """SELECT a.event_id AS alert_id, e.event_id, e.t_us FROM top a JOIN ecs e
      ON e.t_us BETWEEN a.t_us - 300000000 AND a.t_us + 300000000""",
)
over_every(
    "alert_correlated",
    """SELECT DISTINCT a.event_id AS alert_id, e.event_module AS module, e.event_action AS action FROM alerts a JOIN ecs e
      ON e.t_us BETWEEN a.t_us - 600000000 AND a.t_us + 600000000
      AND (e.source_ip = a.source_ip OR e.destination_ip = a.destination_ip OR e.user_name = a.user_name)""",
)
_NEAR = """near AS (
  SELECT a.event_id AS alert_id, e.* FROM {alerts} a JOIN ecs e ON e.t_us BETWEEN a.t_us - 300000000 AND a.t_us + 300000000)"""
over_every(
    "alert_entities",
    "\nUNION ".join(
        f"SELECT alert_id, '{kind}' AS kind, {column} AS value FROM near"
        for kind, column in (
            ("src", "source_ip"),
            ("dst", "destination_ip"),
            ("user", "user_name"),
            ("host", "host_name"),
            ("action", "event_action"),
            ("module", "event_module"),
        )
    ),
    _NEAR.format(alerts="alerts"),
)
over_top(
    "alert_messages",
    """SELECT alert_id, string_agg('[' || strftime(make_timestamp(t_us), '%Y-%m-%d %H:%M:%S') || '][' || event_module || '.'
      || event_dataset || '] ' || CASE WHEN length(message) <= 200 THEN message ELSE substring(message, 1, 197) || '...' END,
      chr(10) ORDER BY t_us, event_id) AS context_text FROM (
      SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY t_us, event_id) <= 20) GROUP BY alert_id""",
    _NEAR.format(alerts="top"),
)
over_alerts(
    "alert_digest",
    """SELECT c.event_id AS alert_id, c.risk, concat_ws(chr(10),
      '# Alert at ' || strftime(make_timestamp(c.t_us), '%Y-%m-%d %H:%M:%S'), '- Score: ' || printf('%.3f', c.anom_score),
      '- Risk: ' || c.risk,
      '- MITRE: ' || nullif(concat_ws(', ', CASE WHEN c.destination_port IN (3389, 445) THEN 'T1021 Remote Services' END,
        (SELECT string_agg(technique, ', ' ORDER BY place) FROM techniques t WHERE t.event_id = c.event_id)), ''),
      '- NIST CSF: ' || nullif(concat_ws(', ', CASE WHEN c.brute OR c.scan THEN 'DETECT (DE.CM)' END,
        CASE WHEN c.remote THEN 'RESPOND (RS.MI)' END), ''),
      '- Related: ' || (SELECT string_agg(name, ', ' ORDER BY name) FROM related r WHERE r.alert_id = c.event_id),
      '- Sources: ' || (SELECT string_agg(DISTINCT source_ip, ', ' ORDER BY source_ip) FROM near n WHERE n.alert_id = c.event_id),
      '- Destinations: ' || (SELECT string_agg(DISTINCT destination_ip, ', ' ORDER BY destination_ip) FROM near n
        WHERE n.alert_id = c.event_id),
      '- Actions: block_source_ip:' || c.source_ip || ', disable_account:' || c.user_name || ', reset_password:' || c.user_name)
      AS digest FROM chosen c""",
    """chosen AS (SELECT *, CASE WHEN event_severity <= 2 THEN 'HIGH' WHEN brute OR remote OR scan
      OR destination_port IN (3389, 445) OR event_action = 'deny' THEN 'MEDIUM' ELSE 'LOW' END AS risk
      FROM alerts ORDER BY anom_score DESC, event_id LIMIT 10)""",
    _NEAR.format(alerts="chosen"),
    """related AS (SELECT alert_id, name FROM (
      SELECT DISTINCT a.event_id AS alert_id, e.event_module AS m, e.event_action AS n, e.event_module || '::' || e.event_action AS name
      FROM chosen a JOIN ecs e ON e.t_us BETWEEN a.t_us - 600000000 AND a.t_us + 600000000
      AND (e.source_ip = a.source_ip OR e.destination_ip = a.destination_ip OR e.user_name = a.user_name))
      QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY m, n) <= 5)""",
)

# --- reports -------------------------------------------------------------------------------------------------------

over_ecs("source_breakdown", "SELECT event_module, event_dataset, count(*) AS count FROM ecs GROUP BY ALL")
over_alerts("risk_distribution", "SELECT risk_level, count(*) AS count FROM annotated GROUP BY risk_level", _ANNOTATED)
over_alerts("technique_list", "SELECT DISTINCT technique, '' AS name FROM techniques")
over_scored(
    "score_histogram",
    """SELECT b.bin, round(low + b.bin * width, 6) AS bin_start, round(low + (b.bin + 1) * width, 6) AS bin_end,
      coalesce(c.count, 0) AS count FROM (SELECT unnest(range(30)) AS bin) b CROSS JOIN e
      LEFT JOIN (SELECT least(CAST(floor((anom_score - low) / width) AS BIGINT), 29) AS bin, count(*) AS count
      FROM scored, e GROUP BY 1) c ON b.bin = c.bin""",
    "e AS (SELECT min(anom_score) AS low, (max(anom_score) - min(anom_score)) / 30 AS width FROM scored)",
)
over_scored(
    "alert_timeline",
    """SELECT m.minute_us, coalesce(count(a.t_us), 0) AS count FROM (
      SELECT unnest(range(min(t_us) // 60000000, max(t_us) // 60000000 + 1)) * 60000000 AS minute_us FROM a) m
      LEFT JOIN a ON a.t_us // 60000000 * 60000000 = m.minute_us GROUP BY 1""",
    """a AS (SELECT t_us FROM scored, (SELECT quantile_cont(anom_score, 0.999) AS t FROM scored) WHERE anom_score >= t)""",
)
over_alerts(
    "summary_long",
    """SELECT 'total' AS section, 'events' AS name, count(*)::DOUBLE AS value FROM ecs
      UNION ALL SELECT 'total', 'alerts', count(*) FROM alerts
      UNION ALL SELECT 'total', 'threshold', round(max(threshold), 6) FROM alerts
      UNION ALL SELECT 'risk', risk_level, count(*) FROM annotated GROUP BY risk_level
      UNION ALL SELECT 'technique', technique, count(*) FROM techniques GROUP BY technique
      UNION ALL SELECT 'functions', nist_functions, count(*) FROM annotated GROUP BY nist_functions""",
    _ANNOTATED,
)
over_alerts(
    "alert_detail",
    """SELECT t_us, host_name, user_name, source_ip, destination_ip, destination_port, anom_score, risk_level, mitre_techniques,
      nist_functions FROM annotated WHERE risk_level = 'MEDIUM' AND (contains(mitre_techniques, 'T1021')
      OR contains(mitre_techniques, 'T1046')) AND contains(nist_functions, 'RESPOND')""",
    _ANNOTATED,
)
ORACLES["quality_events"] = """WITH d AS (
  SELECT doc_id % 7 = 0 AS bad, text, CASE WHEN lang <> 'en' THEN source END AS host_name FROM documents)
SELECT 'non_null' AS metric, 'event_time' AS name, 1.0::DOUBLE AS value, 'info' AS status
UNION ALL SELECT 'non_null', 'message', round(avg((text IS NOT NULL)::INT), 6), 'info' FROM d
UNION ALL SELECT 'non_null', 'host_name', round(avg((host_name IS NOT NULL)::INT), 6), 'info' FROM d
UNION ALL SELECT 'time_parse_failures', 'event_time', round(avg(bad::INT), 6), CASE WHEN avg(bad::INT) > 0.2 THEN 'error' ELSE 'ok' END FROM d
UNION ALL SELECT 'nested_column', 'event', NULL, 'info'
UNION ALL SELECT 'missing_column', unnest(['event_original', 'host_ip', 'user_name', 'source_ip', 'source_port', 'destination_ip',
  'destination_port', 'network_transport', 'event_code', 'event_action', 'event_outcome', 'event_module', 'event_dataset',
  'network_bytes', 'network_packets', 'rule_id', 'rule_name']), NULL, 'warning'"""
_PRESENT = {
    "login_failed": "login_failed",
    "conn_suspicious": "conn_suspicious",
    "action_allow": "action_allow",
    "action_deny": "action_deny",
    "ips_alert": "ips_alert",
    "cbs_failed": "cbs_failed",
    "login_failed_count_5m": "lf5",
    "action_allow_count_5m": "al5",
    "action_deny_count_5m": "de5",
    "uniq_dport_per_src_1m": "ports",
    "deny_ratio_5m": "deny_ratio_5m",
    "login_failed_ratio_5m": "login_failed_ratio_5m",
}
_WANTED = (
    ["login_failed", "conn_suspicious", "action_allow", "action_deny", "ips_alert", "cbs_failed"]
    + [f"{flag}_count_{w}m" for flag in FLAGS for w in WINDOWS_MIN]
    + ["uniq_dst_per_src_1m", "uniq_dport_per_src_1m", "deny_ratio_5m", "login_failed_ratio_5m", "text_entropy", "session_id"]
)
_MISSING_SQL = ", ".join(f"'{n}'" for n in _WANTED if n not in _PRESENT)
over_detected(
    "quality_features",
    "\nUNION ALL ".join(
        f"SELECT 'coverage' AS metric, '{name}' AS name, round(avg(({column} > 0)::INT), 6) AS value, 'info' AS status FROM detected"
        for name, column in _PRESENT.items()
    )
    + """\nUNION ALL SELECT 'critical_features', 'any_positive', max((lf5 > 0 OR ports > 0)::INT)::DOUBLE,
      CASE WHEN bool_or(lf5 > 0 OR ports > 0) THEN 'ok' ELSE 'error' END FROM detected
      UNION ALL SELECT 'missing_feature', unnest(["""
    + _MISSING_SQL
    + "]), NULL, 'warning'",
)
_SCORE_ROWS = """SELECT 'rows' AS metric, 'scores' AS name, count(*)::DOUBLE AS value, 'info' AS status FROM detected
  UNION ALL SELECT 'threshold', 'anom_score', round(threshold, 6), 'info' FROM limits
  UNION ALL SELECT 'alerts', 'at_or_above_threshold', count(*), CASE WHEN count(*) > 0 THEN 'ok' ELSE 'error' END FROM alerts
  UNION ALL SELECT 'technique', technique, count(*), 'info' FROM techniques GROUP BY technique
  UNION ALL SELECT 'techniques', 'matched', count(DISTINCT technique),
    CASE WHEN count(*) > 0 THEN 'ok' ELSE 'error' END FROM techniques
  UNION ALL SELECT 'function', function, count(DISTINCT event_id), 'info' FROM techniques GROUP BY function
  UNION ALL SELECT 'functions', 'matched', count(DISTINCT function),
    CASE WHEN count(*) > 0 THEN 'ok' ELSE 'error' END FROM techniques
  UNION ALL SELECT 'expected_missing', e, NULL, 'warning' FROM (SELECT unnest(['T1110', 'T1046', 'T1021']) AS e)
    WHERE e NOT IN (SELECT technique FROM techniques)"""
over_alerts("quality_scores", _SCORE_ROWS)
over_alerts(
    "quality_verdict",
    f"""SELECT count(*) FILTER (status = 'error') = 0 AS passed, count(*) FILTER (status = 'error') AS errors,
      count(*) FILTER (status = 'warning') + {len([n for n in _WANTED if n not in _PRESENT])} AS warnings FROM ({_SCORE_ROWS})""",
)

# --- tumbling windows ----------------------------------------------------------------------------------------------

_CLASSES = """classes AS (
  SELECT t_us // 120000000 * 120000000 AS start_us, CASE WHEN bool_or(anom_score >= 1.15) THEN 'ANOMALY' ELSE 'NORMAL' END
    AS classification, count(*) AS rows_scored, count(*) FILTER (anom_score >= 1.15) AS alerts FROM scored GROUP BY 1)"""
over_scored("window_classes", "SELECT start_us, start_us + 120000000 AS end_us, classification FROM classes", _CLASSES)
over_scored(
    "window_meta",
    """SELECT c.*, (SELECT count(*) FROM scored s WHERE s.t_us >= c.start_us - 300000000 AND s.t_us < c.start_us + 120000000)
      AS rows_with_warmup FROM classes c""",
    _CLASSES,
)
over_detected(
    "window_technique_counts",
    """SELECT t_us // 600000000 * 600000000 AS start_us, kind, name, count(*) AS count FROM (
      SELECT DISTINCT event_id, 'technique' AS kind, technique AS name FROM techniques
      UNION SELECT event_id, 'function', function FROM techniques) JOIN detected USING (event_id)
      WHERE anom_score >= 0.7 GROUP BY ALL""",
)
over_ecs(
    "window_boundary",
    """SELECT event_id, CASE WHEN t_us // 60000000 % 10 = 0 THEN t_us // 600000000 * 600000000
      ELSE t_us // 600000000 * 600000000 + 600000000 END AS end_us FROM ecs""",
)
_NORMAL = """normal AS (
  SELECT s.*, c.start_us FROM scored s JOIN (SELECT start_us FROM classes WHERE classification = 'NORMAL'
    ORDER BY start_us DESC LIMIT 3) c ON s.t_us // 120000000 * 120000000 = c.start_us)"""
over_scored("normal_history", "SELECT event_id, start_us FROM normal", _CLASSES, _NORMAL)
over_scored(
    "latest_window",
    """SELECT event_id, t_us // 120000000 * 120000000 AS start_us FROM scored
      WHERE t_us // 120000000 = (SELECT max(t_us) // 120000000 FROM scored)""",
)
over_scored(
    "retrain_set",
    """SELECT event_id, anom_score FROM scored WHERE t_us < (SELECT min(t_us) FROM scored) + 300000000
      UNION ALL SELECT event_id, anom_score FROM normal""",
    _CLASSES,
    _NORMAL,
)

# --- sources -------------------------------------------------------------------------------------------------------

_SECOND = "t_us // 1000000 * 1000000"
over_ecs(
    "syslog_parse",
    rf"""SELECT {_SECOND} AS t_us, CASE WHEN k % 9 < 2 THEN 'sw-' || k ELSE host_name END AS host_name,
      CASE WHEN k % 9 = 0 THEN '77' WHEN k % 9 = 1 THEN 'sys' ELSE 'sshd[' || k || ']' END AS process_name,
      CASE WHEN k % 9 > 1 THEN regexp_extract(message, 'password for (\S+)', 1) END AS user_name,
      CASE WHEN k % 9 > 1 THEN regexp_extract(message, '(\d+\.\d+\.\d+\.\d+)', 1) END AS source_ip,
      CASE WHEN k % 9 > 1 THEN 'auth' ELSE 'switch.syslog' END AS event_dataset,
      CASE WHEN k % 9 > 1 THEN 'user_login' WHEN k % 9 = 1 THEN 'config_change' ELSE 'interface_state' END AS event_action,
      CASE WHEN k % 9 < 2 THEN 'info' WHEN message LIKE 'Failed%' THEN 'Failure' ELSE 'Success' END AS event_outcome
      FROM ecs WHERE k % 19 <> 0""",
)
over_ecs(
    "cbs_parse",
    f"""SELECT {_SECOND} AS t_us, CASE k % 3 WHEN 0 THEN 'CBS' WHEN 1 THEN 'CSI' ELSE 'DPX' END AS process_name,
      CASE WHEN k % 3 < 2 THEN 'system_update' ELSE 'log_event' END AS event_action,
      CASE WHEN k % 4 = 0 THEN 'Failure' ELSE 'Info' END AS event_outcome,
      CASE WHEN k % 4 <> 0 THEN source_ip END AS source_ip,
      CASE WHEN k % 4 = 0 THEN 'Failed 0x' || k ELSE 'done from ' || source_ip END AS message FROM ecs""",
)
over_ecs(
    "firewall_parse",
    f"""SELECT CASE WHEN k % 5 <> 0 THEN {_SECOND} ELSE t_us + 1700000000000000 END AS t_us, 'FW ' || k AS host_name, source_ip,
      destination_ip, destination_port, event_action, (k + CASE WHEN k % 2 = 0 THEN 7 ELSE 0 END)::DOUBLE AS network_bytes
      FROM ecs""",
)
over_ecs(
    "ids_parse",
    f"""SELECT {_SECOND} AS t_us, 'Kind ' || event_action AS event_category, event_severity,
      upper(network_transport) AS network_transport, source_ip, CASE WHEN k % 2 = 0 THEN source_port ELSE -1 END AS source_port,
      destination_port, CAST(k + 2000 AS VARCHAR) AS rule_id, 'ET SCAN k' || k AS rule_name FROM ecs""",
)
over_ecs(
    "flow_parse",
    f"""SELECT {_SECOND} AS t_us, source_ip, destination_port, network_transport, event_action,
      (k + CASE WHEN k % 2 = 0 THEN 5 ELSE 0 END)::DOUBLE AS network_bytes FROM ecs WHERE k % 11 <> 0""",
)
over_ecs(
    "flow_files",
    f"""SELECT {_SECOND} AS t_us, source_ip, destination_port, CASE WHEN v % 5 = 3 THEN 'flow' ELSE event_action END AS event_action,
      CASE WHEN v % 5 <> 4 THEN (k + CASE WHEN k % 2 = 0 THEN 5 ELSE 0 END)::DOUBLE END AS network_bytes
      FROM (SELECT *, event_id::BIGINT % 50 AS v FROM ecs)""",
)
over_ecs(
    "ingest_chain",
    f"""SELECT source, event_dataset, count(*) AS n, count(*) AS n_ids, min(us) AS first_us, max(us) AS last_us FROM (
      SELECT {_SECOND} AS us, unnest(['firewall', 'syslog', 'flows']) AS source, unnest(['fortigate.traffic', 'auth', 'custom_csv']) AS event_dataset FROM ecs
      UNION ALL SELECT (1700000000 + k) * 1000000, 'zeek', 'zeek.conn' FROM ecs) GROUP BY source, event_dataset""",
)
over_flagged(
    "windows_parse",
    """SELECT t_us, host_name, CASE WHEN login_failed = 1 THEN '4625' ELSE '4624' END AS event_code, user_name, source_ip,
      'windows' AS event_module, 'security' AS event_dataset FROM flagged""",
)
over_ecs(
    "sysmon_parse",
    """SELECT t_us, host_name, '3' AS event_code, process_name, process_command_line, destination_port, 'sysmon' AS event_dataset
      FROM ecs""",
)
over_ecs(
    "zeek_parse",
    """SELECT event_id, (1700000000 + k) * 1000000 AS t_us, source_ip, source_port, destination_ip, event_outcome,
      'zeek.conn' AS event_dataset FROM ecs""",
)
over_ecs(
    "beats_parse",
    """SELECT t_us, source_ip, source_port, destination_ip, k::DOUBLE AS network_bytes, network_transport,
      CASE WHEN k % 2 = 0 THEN 'packetbeat' ELSE event_module END AS event_module, 'packetbeat.flow' AS event_dataset FROM ecs""",
)
over_ecs(
    "documents_normalise",
    """SELECT t_us, host_name, CASE WHEN k % 3 <> 0 THEN source_ip END AS host_ip, event_action, event_severity FROM ecs""",
)
over_ecs(
    "field_map",
    """SELECT t_us, destination_ip AS source_ip, CASE WHEN k % 3 = 0 THEN host_name WHEN k % 2 = 0 THEN user_name END AS user_name
      FROM ecs""",
)
over_ecs(
    "flatten_nested",
    """SELECT event_id AS id, event_action, event_severity, CASE WHEN network_transport = 'tcp' THEN '1.1.1.1' ELSE source_ip END
      AS source_ip, source_port, CAST(-1 AS INTEGER) AS destination_port FROM ecs""",
)
_TEXT_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents)"
ORACLES["lines_by_keyword"] = f"SELECT doc_id, value FROM {_TEXT_LINES} WHERE contains(lower(value), 'the ')"
_DATED = """(SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'undated' ELSE strftime(o_orderdate, '%Y-%m-%d') END
  || ' ' || o_orderpriority AS value FROM orders)"""
ORACLES["lines_by_date"] = f"SELECT o_orderkey, value FROM {_DATED} WHERE starts_with(value, '1998-10')"
ORACLES["lines_by_range"] = (
    f"SELECT o_orderkey, value FROM {_DATED} WHERE TRY_CAST(string_split(value, ' ')[1] AS DATE) BETWEEN DATE '1998-01-15' AND DATE '1999-02-01'"
)
over_ecs(
    "time_range_scan",
    """SELECT event_id, t_us FROM ecs WHERE t_us BETWEEN 947000000000 AND 947900000000 AND destination_port <> 80
      ORDER BY t_us, event_id LIMIT 500""",
)
over_ecs(
    "store_days",
    """SELECT event_module AS source, strftime(make_timestamp(t_us), '%Y-%m-%d') AS dt,
      sum(CASE event_module WHEN 'ips' THEN (network_transport = 'tcp')::INT WHEN 'windows' THEN 2 ELSE 1 END)::BIGINT AS n
      FROM ecs GROUP BY ALL""",
)
over_scored(
    "audit_log",
    """SELECT true AS dry_run, 'High IF score fallback' AS rule, anom_score AS score,
      'wevtutil qe System /c:50 /rd:true /f:text' AS cmd, 'DRY-RUN powershell: wevtutil qe System /c:50 /rd:true /f:text' AS output
      FROM scored WHERE anom_score >= 0.327""",
)
over_ecs("report_file", "SELECT event_module, event_dataset, count(*) AS count FROM ecs GROUP BY ALL")

# --- model and streams ---------------------------------------------------------------------------------------------

ORACLES["attribution_abs_top5"] = """WITH v AS (
  SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT vec_id, string_agg(printf('f%02d', i), ',' ORDER BY abs(x) DESC, i) AS top_features FROM (
  SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, i) <= 5) GROUP BY vec_id"""
over_flagged(
    "stream_windows",
    """SELECT t_us // 120000000 * 120000000 AS start_us, count(*) AS n_events, sum(login_failed)::BIGINT AS login_failed
      FROM flagged GROUP BY 1""",
)
over_ecs(
    "stream_sessions",
    """SELECT source_ip, destination_ip, network_transport, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n_events
      FROM (SELECT *, sum(s) OVER (PARTITION BY source_ip, destination_ip, network_transport ORDER BY t_us
        RANGE UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY source_ip,
        destination_ip, network_transport ORDER BY t_us) <= 5000000 THEN 0 ELSE 1 END AS s FROM ecs))
      GROUP BY source_ip, destination_ip, network_transport, g""",
)
over_flagged(
    "stream_rolling",
    "SELECT DISTINCT source_ip AS entity, t_us, "
    + ", ".join(
        f"CAST(sum({flag}) OVER {_frame('source_ip', w)} AS BIGINT) AS {flag}_count_{w}m" for flag in FLAGS for w in WINDOWS_MIN
    )
    + " FROM flagged",
)

over_detected(
    "stream_detection",
    """SELECT event_id, anom_score, start_us, classification, rows_scored, alerts FROM revised JOIN (
      SELECT start_us, CASE WHEN bool_or(anom_score >= 1.0) THEN 'ANOMALY' ELSE 'NORMAL' END AS classification,
        count(*) AS rows_scored, count(*) FILTER (anom_score >= 1.0) AS alerts FROM revised GROUP BY 1) USING (start_us)""",
    """revised AS (SELECT event_id, t_us // 120000000 * 120000000 AS start_us,
      round(login_failed * 0.5::DOUBLE + conn_suspicious * 0.25::DOUBLE + lf5 / 100 + ports / 20, 6) AS anom_score FROM detected)""",
)
over_ecs(
    "stream_late",
    """SELECT batch_id, count(*) FILTER (NOT late) AS n_events, count(*) FILTER (late) AS n_late,
      coalesce(watermark_us, 0) AS watermark_us, coalesce(min(t_us) FILTER (late), 0) AS oldest_late_us
      FROM (SELECT *, coalesce(t_us < watermark_us, false) AS late FROM dealt JOIN marks USING (batch_id)) GROUP BY batch_id, watermark_us""",
    """span AS (SELECT min(t_us) AS first, (max(t_us) - min(t_us)) // 4 + 1 AS step FROM raw)""",
    """dealt AS (SELECT raw.t_us, least((t_us - first) // step
      + (event_id % 7 = 0 AND (t_us - first) % step >= step - 600000000)::INT, 3)::BIGINT AS batch_id FROM raw, span)""",
    """marks AS (SELECT batch_id, max(max(t_us)) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      - 120000000 AS watermark_us FROM dealt GROUP BY batch_id)""",
)
over_every(
    "context_groups",
    """SELECT g.group_us, g.n_alerts, g.last_us, count(*) AS n_events, count(DISTINCT e.source_ip) AS n_sources
      FROM groups g JOIN scored e ON e.t_us BETWEEN g.group_us AND g.last_us + 1000000 GROUP BY g.group_us, g.n_alerts, g.last_us""",
    """steps AS (SELECT t_us, CASE WHEN t_us - lag(t_us) OVER (ORDER BY t_us) <= 2000000 THEN 0 ELSE 1 END AS apart FROM alerts)""",
    """groups AS (SELECT min(t_us) - 1000000 AS group_us, count(*) AS n_alerts, max(t_us) AS last_us FROM (
      SELECT t_us, sum(apart) OVER (ORDER BY t_us RANGE UNBOUNDED PRECEDING) AS g FROM steps) GROUP BY g)""",
)


def _draw(key: str) -> str:
    return f"('0x' || substring(md5('42:' || {key}), 1, 15))::BIGINT, {key}"


ORACLES["day_sample"] = f"""SELECT event_id, dt FROM (SELECT o_orderkey AS event_id, year(o_orderdate)::INT AS dt FROM orders)
  QUALIFY row_number() OVER (PARTITION BY dt ORDER BY {_draw("event_id")}) <= 100"""
ORACLES["score_sample"] = f"SELECT * FROM orders ORDER BY {_draw('o_orderkey')} LIMIT 1000"
ORACLES["label_files"] = "SELECT doc_id, quality::INT AS quality, toxic::INT AS toxic FROM labels"
over_scored(
    "threshold_merged",
    """SELECT span, count(anom_score) AS n_rows, true AS within_error FROM (SELECT anom_score, unnest(
      [CASE WHEN t_us // 120000000 * 120000000 < 947640000000 THEN 'first' ELSE 'second' END, 'whole']) AS span FROM scored) GROUP BY span""",
)
_TRAINED = [*FLAGS, "cbs_failed", "network_bytes", "network_packets", "event_severity", "destination_port"]
_VARYING = ", ".join(f"CASE WHEN count(DISTINCT {c}) > 1 THEN '{c}' END" for c in _TRAINED)
over_scored(
    "retrain_job",
    f"""SELECT 1::BIGINT AS version, n AS n_rows, (SELECT count(*) FROM base) AS n_baseline, len(string_split(features, ','))::INT AS n_features,
      from_us, to_us, n AS n_scored, features, 150::INT AS trees, (n - 1 - floor(0.95 * (n - 1)))::BIGINT AS n_alerts_meant, true AS threshold_holds
      FROM (SELECT count(*) AS n, min(t_us) AS from_us, max(t_us) AS to_us, concat_ws(',', {_VARYING}) AS features
        FROM (SELECT * FROM base UNION ALL SELECT * FROM recent))""",
    """classes AS (SELECT t_us // 120000000 AS w FROM scored GROUP BY 1 HAVING NOT bool_or(anom_score >= 1.45) ORDER BY w DESC LIMIT 500)""",
    "base AS (SELECT * FROM scored WHERE t_us < (SELECT min(t_us) FROM scored) + 600000000)",
    "recent AS (SELECT * FROM scored WHERE t_us // 120000000 IN (SELECT w FROM classes))",
)

ORACLES["evidence_manifest"] = "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size FROM documents"
_NODE = "sha256(string_agg({line}, chr(10) ORDER BY {line})) AS d, sum(n)::BIGINT AS n, sum(n_texts)::BIGINT AS n_texts, sum(size)::BIGINT AS size"
ORACLES["evidence_digests"] = f"""WITH leaf AS (
  SELECT source, text, sha256(coalesce('+' || doc_id, '-') || chr(10) || coalesce(sha256(text), '-')) AS leaf FROM documents),
counted AS (SELECT source, leaf, count(*) AS n, count(text) AS n_texts, coalesce(sum(strlen(text)), 0) AS size FROM leaf GROUP BY source, leaf),
four AS (SELECT source, substring(leaf, 1, 4) AS p, {_NODE.format(line="leaf || '=' || n")} FROM counted GROUP BY 1, 2),
three AS (SELECT source, substring(p, 1, 3) AS p, {_NODE.format(line="p || '=' || d")} FROM four GROUP BY 1, 2),
two AS (SELECT source, substring(p, 1, 2) AS p, {_NODE.format(line="p || '=' || d")} FROM three GROUP BY 1, 2),
one AS (SELECT source, substring(p, 1, 1) AS p, {_NODE.format(line="p || '=' || d")} FROM two GROUP BY 1, 2),
root AS (SELECT source, {_NODE.format(line="p || '=' || d")} FROM one GROUP BY 1)
SELECT source, n, n_texts, size, d AS digest FROM root"""


def _uniform(*parts: str) -> str:
    """A number in [0, 1) from the MD5 of seed, tree and place."""
    return f"('0x' || substring(md5(concat_ws(':', {', '.join(parts)})), 1, 13))::BIGINT * 2.0::DOUBLE ** -52"


def _mean_path(n: str) -> str:
    return f"CASE WHEN {n} > 2 THEN 2 * (ln({n}::DOUBLE - 1) + 0.5772156649::DOUBLE) - 2 * ({n}::DOUBLE - 1) / {n} WHEN {n} = 2 THEN 1 ELSE 0 END"


# The forest level by level: members of every place, ends of every feature there, one drawn feature and cut.
_LEVELS = 8  # log2 of 256 rows a tree
_FOREST = f"""WITH v AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS f, unnest(embedding)::DOUBLE AS v FROM embeddings),
size AS MATERIALIZED (SELECT *, least(1, (s + 8 * sqrt(s) + 8) / n::DOUBLE) AS chance, ceil(log2(greatest(s, 2))) AS deepest
  FROM (SELECT count(*) AS n, least(count(*), 256) AS s FROM embeddings)),
fit AS (SELECT f, q[2] AS center, CASE WHEN q[3] = q[1] THEN 1 ELSE q[3] - q[1] END AS scale
  FROM (SELECT f, quantile_cont(v, [0.25, 0.5, 0.75]) AS q FROM v GROUP BY f HAVING min(v) < max(v))),
numbered AS (SELECT f AS old, row_number() OVER (ORDER BY f) - 1 AS f, center, scale FROM fit),
x AS MATERIALIZED (SELECT vec_id, numbered.f, (v - center) / scale AS x FROM v JOIN numbered ON v.f = old),
drawn AS (SELECT vec_id, tree, s FROM (SELECT vec_id, s, chance, CASE WHEN chance < 1
    THEN floor(ln(1 - {_uniform("42", "vec_id")}) / ln(1 - chance)) ELSE 0 END AS first FROM embeddings, size), range(150) AS r(tree)
  WHERE tree = first OR (tree > first AND {_uniform("43", "vec_id", "tree")} < chance)),
m0 AS MATERIALIZED (SELECT tree, 1::BIGINT AS p, vec_id FROM drawn
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY {_uniform("44", "vec_id", "tree")}, vec_id) <= s),
""" + "".join(
    f"""c{k} AS MATERIALIZED (SELECT tree, p, f, low + (high - low) * ({_uniform("42", "tree", "p", "'cut'")}) AS cut
  FROM (SELECT tree, p, f, min(x) AS low, max(x) AS high FROM m{k} JOIN x USING (vec_id) GROUP BY tree, p, f HAVING max(x) > min(x)), size
  WHERE {k} < deepest QUALIFY row_number() OVER (PARTITION BY tree, p ORDER BY f) - 1
    = floor({_uniform("42", "tree", "p", "'feature'")} * count(*) OVER (PARTITION BY tree, p))),
m{k + 1} AS MATERIALIZED (SELECT m.tree, 2 * m.p + (x > cut)::BIGINT AS p, m.vec_id
  FROM m{k} m JOIN c{k} c ON m.tree = c.tree AND m.p = c.p JOIN x ON x.vec_id = m.vec_id AND x.f = c.f),
"""
    for k in range(_LEVELS)
) + "cuts AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(_LEVELS)) + """),
counts AS (""" + " UNION ALL ".join(f"SELECT tree, p, {k} AS depth, count(*) AS n FROM m{k} GROUP BY tree, p" for k in range(_LEVELS + 1)) + f"""),
nodes AS MATERIALIZED (SELECT counts.*, f, cut, row_number() OVER (PARTITION BY counts.tree ORDER BY counts.p) - 1 AS node,
    depth + {_mean_path("n")} AS length FROM counts LEFT JOIN cuts ON counts.tree = cuts.tree AND counts.p = cuts.p),
w0 AS (SELECT vec_id, tree, 1::BIGINT AS p, true AS goes FROM embeddings, range(150) AS r(tree)),
""" + "".join(
    f"""w{k + 1} AS MATERIALIZED (SELECT w.vec_id, w.tree, CASE WHEN c.f IS NULL THEN w.p ELSE 2 * w.p + (x > cut)::BIGINT END AS p, c.f IS NOT NULL AS goes
  FROM w{k} w LEFT JOIN cuts c ON w.tree = c.tree AND w.p = c.p LEFT JOIN x ON x.vec_id = w.vec_id AND x.f = c.f),
"""
    for k in range(_LEVELS)
) + f"""raw AS (SELECT vec_id, 2::DOUBLE ** (-avg(length) / any_value({_mean_path("s")})) AS score
  FROM w{_LEVELS} w JOIN nodes ON w.tree = nodes.tree AND w.p = nodes.p, size GROUP BY vec_id),
scored AS MATERIALIZED (SELECT vec_id, score - quantile_cont(score, 0.95) OVER () AS s FROM raw),
edge AS (SELECT quantile_cont(s, 0.95) AS threshold FROM scored),
alerts AS MATERIALIZED (SELECT vec_id, s, threshold FROM scored, edge WHERE s >= threshold ORDER BY s DESC, vec_id LIMIT 10)
"""
ORACLES["iforest_nodes"] = _FOREST + """SELECT a.tree::INT AS tree_id, a.node::INT AS node_id, coalesce(a.f, -1)::INT AS feature, round(coalesce(a.cut, 0), 6) AS split,
  coalesce(l.node, -1)::INT AS "left", coalesce(r.node, -1)::INT AS "right", a.depth::INT AS depth, a.n
  FROM nodes a LEFT JOIN nodes l ON l.tree = a.tree AND l.p = 2 * a.p LEFT JOIN nodes r ON r.tree = a.tree AND r.p = 2 * a.p + 1"""
ORACLES["iforest_scores"] = _FOREST + "SELECT vec_id, label, round(s, 6) AS anom_score FROM scored JOIN embeddings USING (vec_id)"
ORACLES["iforest_alerts"] = _FOREST + "SELECT vec_id, round(s, 6) AS anom_score, round(threshold, 6) AS threshold FROM alerts"
ORACLES["iforest_baseline"] = _FOREST + """SELECT round(threshold, 6) AS threshold, count(*) AS n_alerts
  FROM scored, edge WHERE s >= threshold GROUP BY threshold"""
# What a step saves: the mean length below a node less that below its child; leaves lie below all places that lead to them.
ORACLES["attribution_top5"] = _FOREST + f""", below AS MATERIALIZED (SELECT tree, p >> k AS p, sum(length * n) / sum(n) AS expected FROM nodes, range({_LEVELS + 1}) AS r(k)
    WHERE f IS NULL AND k <= depth GROUP BY tree, p >> k),
steps AS (""" + " UNION ALL ".join(f"SELECT vec_id, tree, p FROM w{k + 1} WHERE goes" for k in range(_LEVELS)) + """),
gained AS (SELECT s.vec_id, c.f, sum(a.expected - b.expected) / 150 AS value FROM steps s JOIN alerts USING (vec_id) JOIN cuts c ON c.tree = s.tree AND c.p = s.p // 2
  JOIN below a ON a.tree = s.tree AND a.p = s.p // 2 JOIN below b ON b.tree = s.tree AND b.p = s.p GROUP BY s.vec_id, c.f)
SELECT vec_id, 'f' || lpad(old::VARCHAR, 2, '0') AS feature, round(value, 6) AS value FROM gained JOIN numbered USING (f)
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(value) DESC, feature) <= 5"""
