"""Streams give what the batch code gives."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from duskwatch.functions.flags import add_flags
from duskwatch.operators import forest
from duskwatch.operators.rolling import rolling
from duskwatch.operators.windows import normal_history
from duskwatch.plans.features import build_features
from duskwatch.schema import EVENT_COLUMNS, feature_columns
from duskwatch.streaming import sources, stateful, windows


@pytest.fixture(scope="module")
def files(spark, events, tmp_path_factory):
    """The events in time order, as three files."""
    path = str(tmp_path_factory.mktemp("in"))
    third = F.floor(F.percent_rank().over(Window.orderBy("event_time")) * 2.999)
    numbered = events.withColumn("part", third).cache()
    for part in range(3):
        chosen = numbered.filter(F.col("part") == part).select(*EVENT_COLUMNS)
        chosen.coalesce(1).write.mode("append").parquet(f"{path}/p={part}")
    return path


def stream(spark, files):
    return spark.readStream.schema(spark.read.parquet(f"{files}/p=0").schema).option("maxFilesPerTrigger", 1).parquet(f"{files}/p=*")


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_tumbling_counts_and_sessions(spark, files, events):
    got = windows.run_to_table(windows.tumbling_counts(stream(spark, files)), "complete")
    expected = events.groupBy(F.window("event_time", "10 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    assert {(r.window_start, r.n_events) for r in got.collect()} == {(r.w.start, r.n) for r in expected.collect()}
    sessions = windows.run_to_table(windows.stream_sessions(stream(spark, files), 30), "complete")
    assert sessions.agg(F.sum("n_events")).first()[0] == events.count()
    batch = windows.stream_sessions(events, 30)
    assert same(sessions, batch)


def test_stateful_counts_equal_batch(spark, files, events):
    flagged = add_flags(stream(spark, files))
    got = stateful.latest(windows.run_to_table(stateful.rolling_counts(flagged, F.col("source_ip"), ["login_failed"]), "update"))
    batch = rolling(add_flags(events), F.col("source_ip"), {"login_failed": "login_failed_count_{w}m"})
    names = [f"login_failed_count_{w}m" for w in (1, 5, 15)]
    expected = batch.select(
        F.col("source_ip").alias("entity"), F.unix_micros("event_time").alias("t_us"), *[F.col(n).cast("bigint") for n in names]
    ).distinct()
    assert same(got, expected)


def test_window_sink_equals_batch_and_survives_a_replay(spark, files, events, features, tmp_path):
    model = forest.train(features, feature_columns(), trees=10, max_samples=64)
    sink = windows.WindowSink(str(tmp_path / "out"), model, 0.0)
    query = windows.start(stream(spark, files), sink, str(tmp_path / "check"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "scores"))
    names = ["event_id", *[n for n in feature_columns()]]
    rounded = [F.round(n, 6).alias(n) if n != "event_id" else F.col(n) for n in names]
    assert same(got.select(*rounded), features.select(*rounded))
    last = spark.read.parquet(f"{files}/p=2")
    sink(last, 2)
    again = spark.read.parquet(str(tmp_path / "out" / "scores"))
    assert same(again.select(*rounded), features.select(*rounded))
    table = windows.window_table(spark.read.parquet(str(tmp_path / "out" / "meta")))
    assert table.agg(F.sum("rows_scored")).first()[0] == events.count()
    assert windows.progress(table).agg(F.sum("windows_processed")).first()[0] == table.count()
    normal = normal_history(features, table.withColumn("classification", F.lit("NORMAL")), parts=1)
    assert 0 < normal.count() < events.count()


def test_file_drop_stream_parses_like_batch(spark, tmp_path):
    (tmp_path / "a.txt").write_text("date=2024-05-01 time=12:00:00 srcip=10.0.0.1 action=deny\n")
    got = windows.run_to_table(sources.stream_firewall(spark, str(tmp_path), pattern="*.txt"))
    assert [(r.source_ip, r.event_action) for r in got.collect()] == [("10.0.0.1", "deny")]


def test_stateful_counts_are_corrected_by_later_and_late_events(spark, tmp_path):
    """Events at 6000 | 6000, 5970 | 5950 seconds in three files: the instant 6000 counts one, then three, then four."""
    source = spark.range(0).selectExpr("cast(id as timestamp) as event_time", "'e' as entity", "1 as login_failed")
    for seconds in ([6000], [6000, 5970], [5950]):
        rows = spark.createDataFrame([(s,) for s in seconds], "s long").selectExpr("timestamp_seconds(s) as event_time", "'e' as entity", "1 as login_failed")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream_in = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counted = stateful.rolling_counts(stream_in, F.col("entity"), ["login_failed"])
    every = windows.run_to_table(counted, "update")
    last = {r["t_us"] // 1_000_000: r["login_failed_count_1m"] for r in stateful.latest(every).collect()}
    assert last == {5950: 1, 5970: 2, 6000: 4}
    assert every.where("t_us = 6000000000").count() == 3
