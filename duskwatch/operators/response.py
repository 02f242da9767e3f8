"""Risk escalation, recommended actions and the response plan. Nothing here runs a command."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.schema import column_name

# The response policy.
POLICY = [
    {
        "name": "Pause Windows Update on high ensemble score",
        "condition": {"score_col": "ensemble.score", "gte": 0.327},
        "actions": [
            {"type": "powershell", "cmd": "net stop wuauserv"},
            {"type": "powershell", "cmd": "dism /online /cleanup-image /scanhealth"},
            {"type": "powershell", "cmd": "sfc /scannow"},
        ],
    },
    {
        "name": "High IF score fallback",
        "condition": {"score_col": "anom.score", "gte": 0.327},
        "actions": [{"type": "powershell", "cmd": "wevtutil qe System /c:50 /rd:true /f:text"}],
    },
]

# Actions that count as blocked when risk is raised, and accounts nobody should lock.
BLOCKED_ACTIONS = ["deny", "drop", "blocked", "reset"]
SYSTEM_ACCOUNTS = ["SYSTEM", "LOCAL SERVICE", "NETWORK SERVICE"]
_BLANK = ["", "N/A", "None"]


def escalate_risk(risk: Column, severity: Column, techniques: Column, action: Column) -> Column:
    """Severity 1 or 2 is HIGH; a known technique or a blocked action lifts LOW to MEDIUM."""
    notable = (F.size(techniques) > 0) | F.coalesce(F.lower(action).isin(BLOCKED_ACTIONS), F.lit(False))
    return (
        F.when(severity.try_cast("int") <= 2, "HIGH").when(notable & (risk == "LOW"), "MEDIUM").otherwise(risk)
    )


def recommended_actions(df: DataFrame) -> Column:
    """Ordered action codes, ``code`` or ``code:target``, by what is known about the alert."""

    def value(*names: str) -> Column:
        known = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
        return F.coalesce(*known, F.lit(""))

    def act(code: str, target: Column, known: Column) -> Column:
        return F.when(known, F.concat(F.lit(f"{code}:"), target))

    address, user, host = value("source_ip"), value("user_name"), value("host_name")
    process = value("process_name", "process_executable")
    has_address = ~address.isin(_BLANK) & (address.contains(".") | address.contains(":"))
    has_user = ~user.isin(_BLANK + SYSTEM_ACCOUNTS)
    has_process = ~process.isin(_BLANK)
    steps = [
        act("block_source_ip", address, has_address),
        act("disable_account", user, has_user),
        act("reset_password", user, has_user),
        act("isolate_host", host, ~host.isin(_BLANK)),
        F.lit("run_antivirus_scan"),
        F.lit("collect_event_logs"),
        act("stop_process", process, has_process),
        act("hash_executable", process, has_process),
        act("revoke_admin_rights", user, has_user),
        F.lit("watch_related_logs"),
    ]
    return F.array_distinct(F.array_compact(F.array(*steps)))


def policy_plan(df: DataFrame, policy: list[dict] = POLICY, dry_run: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per alert, matching policy rule and action. A score column that is absent or null counts as 0."""
    matches = []
    for rule in policy:
        wanted = rule.get("condition", {})
        name = wanted.get("score_col", "anom.score")
        column = next((c for c in (name, column_name(name)) if c in df.columns), None)
        score = F.lit(0.0) if column is None else F.coalesce(F.col(f"`{column}`").cast("double"), F.lit(0.0))
        inside = F.lit(True)
        if wanted.get("gte") is not None:
            inside = inside & (score >= float(wanted["gte"]))
        if wanted.get("lte") is not None:
            inside = inside & (score <= float(wanted["lte"]))
        for place, action in enumerate(rule.get("actions", []), start=1):
            matches.append(
                F.when(
                    inside,
                    F.struct(
                        F.lit(str(rule.get("name"))).alias("rule"),
                        score.alias("score"),
                        F.lit(place).alias("action_no"),
                        F.lit(str(action.get("type"))).alias("action_type"),
                        F.lit(str(action.get("cmd", ""))).alias("action_cmd"),
                    ),
                )
            )
    moment = [F.col("event_time").alias("row_time")] if "event_time" in df.columns else []
    if not matches:
        matches = [F.lit(None).cast("struct<rule:string,score:double,action_no:int,action_type:string,action_cmd:string>")]
    return df.select(*keep, *moment, F.inline(F.array_compact(F.array(*matches)))).withColumn("dry_run", F.lit(dry_run))
