"""Registered queries on small tables made here."""

import datetime

import pytest
from pyspark.sql import functions as F

from duskwatch.plans.catalog import QUERIES

ROLLED = {
    "rolling_login_failed_entity": "login_failed_count_{w}m",
    "rolling_login_failed_host": "login_failed_count_host_{w}m",
    "rolling_login_failed_user": "login_failed_count_user_{w}m",
    "rolling_login_failed_dst": "login_failed_count_dst_{w}m",
    "rolling_cbs_host": "cbs_failed_count_host_{w}m",
    "rolling_cbs_proc": "cbs_failed_count_proc_{w}m",
    "rolling_uniq_dst_per_src": "uniq_dst_per_src_{w}m",
    "rolling_uniq_src_per_dst": "uniq_src_per_dst_{w}m",
    "rolling_uniq_dport_per_src": "uniq_dport_per_src_{w}m",
    "rolling_traffic_dst": "network_bytes_sum_{w}m",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Failed logins of one user at 0, 30, 120 and 1,200 seconds of compressed time."""
    path = str(tmp_path_factory.mktemp("tables"))
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=1800 * s), 7, "error", 2.5, f'{{"k": {11 * (1 + i % 2)}}}') for i, s in enumerate((0, 30, 120, 1200))]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    frame.write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ROLLED)
def test_rolling_queries_run_and_count(spark, folder, name):
    got = QUERIES[name](spark, folder).orderBy(F.col("event_id").cast("long")).collect()
    found = [[r[ROLLED[name].format(w=w)] for w in (1, 5, 15)] for r in got]
    if name == "rolling_login_failed_entity":
        assert found == [[1, 1, 1], [2, 2, 2], [1, 3, 3], [1, 1, 1]]
    if name == "rolling_uniq_dst_per_src":
        assert found == [[1, 1, 1], [2, 2, 2], [1, 2, 2], [1, 1, 1]]
    if name == "rolling_traffic_dst":
        assert found == [[2.5, 2.5, 2.5], [2.5, 2.5, 2.5], [2.5, 5.0, 5.0], [2.5, 2.5, 2.5]]
    assert len(found) == 4


@pytest.fixture(scope="module")
def busy_folder(spark, tmp_path_factory):
    """Events of few users around each other's window ends; ids, instants and whole rows repeat."""
    import random

    draw = random.Random(11)
    path, start = str(tmp_path_factory.mktemp("busy")), datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(300):
        second = draw.choice([0, 59, 60, 61, 299, 300, 301, 900, 901, draw.randrange(1800)])
        kind = draw.choice(["error", "error", "signup", "click", "view"])
        rows.append((i - i % 3, start + datetime.timedelta(seconds=1800 * second), draw.randrange(4), kind, draw.randrange(999) / 4, f'{{"k": {draw.choice([11, 22, 33, 40, 4, 13])}}}'))
    frame = spark.createDataFrame(rows + rows[:40], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    frame.coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ROLLED)
def test_rolling_queries_equal_their_sql(spark, busy_folder, name):
    import duckdb

    from duskwatch.plans.oracle import ORACLES

    with duckdb.connect() as con:
        con.execute(f"create view events as select * from '{busy_folder}/events.parquet/*.parquet'")
        expected = con.execute(ORACLES[name])
        columns = [c[0] for c in expected.description]
        wanted = sorted(map(str, expected.fetchall()))
    got = QUERIES[name](spark, busy_folder)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == wanted


@pytest.fixture(scope="module")
def copied_folder(spark, busy_folder, tmp_path_factory):
    """The events of ``busy_folder`` three times at their own instants, the ids of a copy shifted, in several files."""
    path = str(tmp_path_factory.mktemp("copied"))
    copies = spark.read.parquet(f"{busy_folder}/events.parquet").crossJoin(spark.range(3).withColumnRenamed("id", "copy"))
    copies.withColumn("event_id", F.expr("event_id + 1000 * copy")).drop("copy").repartition(5).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ROLLED)
def test_rolling_queries_over_copies(spark, busy_folder, copied_folder, name):
    """Larger tables are copies with shifted ids: sums grow with them, distinct counts do not."""
    times = 1 if "_uniq_" in name else 3
    once = QUERIES[name](spark, busy_folder).collect()
    wanted = [(int(r[0]) + 1000 * copy, *(times * v for v in r[1:])) for r in once for copy in range(3)]
    got = QUERIES[name](spark, copied_folder).collect()
    assert sorted((int(r[0]), *r[1:]) for r in got) == sorted(wanted)


def test_rolling_queries_find_the_flags_once_for_the_sums_and_once_for_the_totals(spark, folder):
    """Rows that leave a window searched the messages again, twice each."""
    for name in ("rolling_login_failed_dst", "rolling_cbs_host"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RLIKE") == 2


def test_no_function_of_a_module_takes_the_name_of_another():
    """A second helper of the same name ended all rolling queries with a TypeError."""
    import ast
    from collections import Counter
    from pathlib import Path

    import duskwatch

    for path in Path(duskwatch.__file__).parent.rglob("*.py"):
        names = Counter(n.name for n in ast.parse(path.read_text()).body if isinstance(n, ast.FunctionDef | ast.ClassDef))
        assert not [n for n, times in names.items() if times > 1], path


def test_features_are_rolled_by_kind_and_no_row_meets_the_kinds_in_an_aggregate(spark, folder):
    """Wide aggregates by row took most of the time and the shuffle."""
    plan = QUERIES["feature_table"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN (kind" not in plan and "max(CASE" not in plan


def test_feature_slice_is_the_slice_of_the_whole_table(spark, folder, tmp_path):
    """The slice has 15 minutes of warm-up for windows and all of it for sessions."""
    start = datetime.datetime(2024, 1, 1)
    first = 947_400 - 946_704.96
    seconds = [first - 1000, first - 990, first - 880, first - 200, first - 0.5, first, first + 60, first + 599, first + 600, first + 601]
    rows = [(i, start + datetime.timedelta(seconds=1800 * (s + 0.96)), 7 + i % 2, "error", 2.5, f'{{"k": {11 * (1 + i % 3)}}}') for i, s in enumerate(seconds)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    part = QUERIES["feature_slice"](spark, str(tmp_path))
    whole = QUERIES["feature_table"](spark, str(tmp_path)).filter("t_us between 947400000000 and 948000000000").select(*part.columns)
    assert 2 <= part.count() < 10
    assert sorted(map(str, part.collect())) == sorted(map(str, whole.collect()))


def test_alert_entities_come_once_without_a_shuffle_of_all_pairs(spark):
    """Brute force over values that break off and come back, ids that repeat or are null, alerts without a time."""
    import random

    from duskwatch.operators import context

    draw = random.Random(5)
    names = list(context.ENTITY_COLUMNS.values())

    def rows(n, first_id, span):
        made = []
        for i in range(n):
            second = None if draw.random() < 0.05 else draw.choice([0, 299, 300, 600, 601, draw.randrange(span)])
            made.append((draw.choice([None, str(first_id + i), str(first_id + i // 3)]), second, *[draw.choice([None, "", "a", f"{c[0]}{draw.randrange(6)}"]) for c in names]))
        return made

    around, found = rows(80, 0, 4000), rows(40, 1000, 4500)
    kind = "event_id string, s int, " + ", ".join(f"{c} string" for c in names)

    def frame(data):
        return spark.createDataFrame(data, kind).withColumn("event_time", F.timestamp_micros(F.col("s").cast("long") * 1_000_000))

    expected = set()
    for a in found:
        near = [a] + [e for e in around if None not in (a[1], e[1]) and abs(a[1] - e[1]) <= 300]
        expected |= {(a[0], k, e[2 + i]) for e in near for i, k in enumerate(context.ENTITY_COLUMNS) if e[2 + i]}
    got = [tuple(r) for r in context.alert_entities(frame(around), frame(found)).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    once = frame([(str(i), i, *["a"] * 6) for i in range(900)])
    pairs = context.alert_entities(once, once)
    assert pairs.count() == 900 * 6
    last = pairs._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
    assert last.startswith("Union")


def test_alert_entities_of_many_values_take_little_disk(spark, tmp_path):
    """All of an alert's values came before those of the next, and column files spelled each value's number out again."""
    from duskwatch.operators import context

    names = list(context.ENTITY_COLUMNS.values())
    at = F.timestamp_micros(F.col("id") % 240 * 1_000_000).alias("event_time")
    user = F.concat(F.lit("u"), "id").alias("user_name")
    around = spark.range(25_000).select(F.lit("e").alias("event_id"), at, *[user if c == "user_name" else F.lit("a").alias(c) for c in names])
    found = spark.range(400).select(F.concat(F.lit("a"), "id").alias("event_id"), at, *[F.lit("a").alias(c) for c in names])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to broadcast
    try:
        context.alert_entities(around, found).write.parquet(f"{tmp_path}/pairs")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = 400 * (25_000 + 5 + 1)
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == rows
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < rows / 2


def test_alert_entities_make_no_list_of_all_pairs_of_a_run(spark):
    """A compiled join holds what comes of one of its rows, here values times alerts, before it passes any of it on."""
    import re

    from duskwatch.operators import context

    once = spark.range(900).select(F.col("id").cast("string").alias("event_id"), F.timestamp_micros("id").alias("event_time"), *[F.lit("a").alias(c) for c in context.ENTITY_COLUMNS.values()])
    pairs = context.alert_entities(once, once)
    assert len(pairs.collect()) == 900 * 6
    joins = [line for line in pairs._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in line and "_alerts" in line]
    assert joins and not [line for line in joins if re.search(r"\*\s*\(\d+\)", line)]


def test_column_quantiles_are_exact_and_make_no_row_for_every_value(spark, monkeypatch):
    import numpy as np
    import pandas as pd
    from pyspark.sql import DataFrame

    from duskwatch.operators import quantile

    def no_unpivot(*args, **kwargs):
        raise AssertionError("a row for every value of every column")

    monkeypatch.setattr(DataFrame, "unpivot", no_unpivot)
    draw = np.random.default_rng(3)
    n = 4001
    columns = {
        "near": 1.0 + draw.integers(0, 1000, n) * 2.0**-52,
        "wide": draw.normal(size=n) * 10.0 ** draw.integers(-300, 300, n),
        "few": draw.integers(-2, 3, n) * 1.0,
        "zeros": np.where(draw.random(n) < 0.5, -0.0, 0.0),
        "one": np.full(n, 7.0),
        "ends": draw.choice([-np.inf, -1.0, 0.0, np.inf], n, p=[0.1, 0.2, 0.6, 0.1]),
        "holes": np.where(draw.random(n) < 0.3, np.nan, draw.random(n)),
    }
    frame = spark.createDataFrame(pd.DataFrame(columns)).repartition(5)
    got = {r["feature"]: r for r in quantile.column_quantiles(frame, list(columns)).collect()}
    for name, values in columns.items():
        filled, r = np.sort(np.nan_to_num(values, nan=0.0, posinf=np.inf, neginf=-np.inf)), got[name]
        assert (r["n_rows"], r["low"], r["high"]) == (n, filled[0], filled[-1])
        assert [r["q25"], r["q50"], r["q75"]] == [filled[1000], filled[2000], filled[3000]]
    assert quantile.column_quantiles(frame.limit(0), ["few"]).count() == 0
    two = quantile.column_quantiles(spark.createDataFrame([(1.0, "x"), (4.0, None)], "a double, b string"), ["a", "b"]).collect()
    assert {r["feature"]: tuple(r)[1:] for r in two} == {"a": (2, 1.0, 1.75, 2.5, 3.25, 4.0), "b": (2, 0.0, 0.0, 0.0, 0.0, 0.0)}


def test_event_detection_scores_once(spark, folder):
    """The forest runs when the scores are stored, not again for each look at them."""
    found = QUERIES["event_detection"](spark, folder)
    assert "ArrowEvalPython" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() >= 1


def test_stream_features_broadcast_nothing_and_roll_each_key_once(spark, folder):
    """Rolled tables were joined back, broadcast where their files were small, and made again for the second key."""
    import re

    from duskwatch.adapters import ecs
    from duskwatch.plans.catalog import _stream_features

    plan = _stream_features(ecs(spark, folder))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and len(re.findall("RepartitionByExpression", plan)) == 2


def test_stream_features_find_the_flags_once(spark, folder):
    """Each look at the events searched the messages again."""
    from duskwatch.adapters import ecs
    from duskwatch.plans.catalog import _stream_features

    found = _stream_features(ecs(spark, folder))
    assert "RLIKE" not in found._jdf.queryExecution().optimizedPlan().toString().upper()
    assert found.count() == ecs(spark, folder).count()
