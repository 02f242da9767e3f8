"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from duskwatch.plans.catalog import QUERIES  # noqa: E402
from duskwatch.session import build_session  # noqa: E402

HEADLINE = [
    "technique_alerts",
    "security_flags",
    "entropy_documents",
    "rolling_login_failed_entity",
    "rolling_uniq_dst_per_src",
    "sessions",
    "feature_table",
    "threshold_quantile",
    "alert_annotated",
    "alert_context",
    "alert_entities",
    "syslog_parse",
    "firewall_parse",
    "iforest_scores",
    "window_meta",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "duskwatch-bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["source_breakdown"](spark, folder).count()  # start the JVM's compilers before timing
    seconds = {}
    for name in HEADLINE:
        started = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
