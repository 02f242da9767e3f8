"""The stream that revises its windows, late events, sessions that close, and the store of models."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from duskwatch.operators import alerts, context, firstk, forest, model_store, quantile, windows
from duskwatch.operators.model_store import Detector
from duskwatch.schema import EVENT_SCHEMA, conform
from duskwatch.session import scratch_root
from duskwatch.streaming import revising
from duskwatch.streaming import windows as streams

MINUTE = 60_000_000


def batch(spark, *rows):
    """Events from (id, minute)."""
    frame = spark.createDataFrame([(i, None if m is None else float(m)) for i, m in rows], "event_id string, minute double")
    return conform(frame.withColumn("event_time", F.timestamp_micros((F.col("minute") * MINUTE).cast("long"))))


def counted(events):
    """How many events lie in the five minutes up to an event."""
    other = events.select(F.col("event_time").alias("_t"))
    near = (F.col("_t") <= F.col("event_time")) & (F.col("_t") > F.col("event_time") - F.expr("interval 5 minutes"))
    return events.join(other, near).groupBy("event_id", "event_time").agg(F.count(F.lit(1)).alias("n"))


def sink_at(path, **options):
    detector = Detector(lambda f: f.withColumn("anom_score", F.col("n").cast("double")), 3.0, 7)
    return revising.RevisingSink(str(path), lambda _: detector, reach_minutes=5, late_minutes=20, featurize=counted, **options)


def scores(spark, path):
    return {r["event_id"]: r["anom_score"] for r in revising.current(spark, str(path)).collect()}


def test_late_events_revise_earlier_windows(spark, tmp_path):
    before = set(os.listdir(scratch_root(spark)))
    sink = sink_at(tmp_path)
    sink(batch(spark, ("a", 8), ("b", 11), ("c", 29)), 0)
    assert scores(spark, tmp_path) == {"a": 1, "b": 2, "c": 1}
    sink(batch(spark, ("late", 9), ("d", 39)), 1)  # 9 is the watermark itself, and counts in b across the window's start
    assert scores(spark, tmp_path) == {"a": 1, "late": 2, "b": 3, "c": 1, "d": 1}
    sink(batch(spark, ("too late", 18.5), ("e", 40)), 2)
    assert scores(spark, tmp_path) == {"a": 1, "late": 2, "b": 3, "c": 1, "d": 1, "e": 2}
    assert {r["event_id"] for r in revising.current(spark, str(tmp_path), "alerts").collect()} == {"b"}
    meta = {r["window_us"] // MINUTE: (r["version"], r["classification"], r["rows_scored"], r["model_version"]) for r in revising.current(spark, str(tmp_path), "meta").collect()}
    assert meta == {0: (1, "NORMAL", 2, 7), 10: (1, "ANOMALY", 1, 7), 20: (0, "NORMAL", 1, 7), 30: (1, "NORMAL", 1, 7), 40: (2, "NORMAL", 1, 7)}
    assert revising.window_versions(spark, str(tmp_path)).where("window_us = 0").count() == 2
    done = {r["batch_id"]: (r["n_events"], r["n_late"], r["watermark_us"] and r["watermark_us"] // MINUTE) for r in revising.progress(spark, str(tmp_path)).collect()}
    assert done == {0: (3, 0, None), 1: (2, 0, 9), 2: (1, 1, 19)}
    assert [(r["event_id"], r["batch_id"]) for r in revising.late_events(spark, str(tmp_path)).collect()] == [("too late", 2)]
    assert set(os.listdir(scratch_root(spark))) == before


def test_a_batch_again_and_a_batch_that_fails(spark, tmp_path):
    sink = sink_at(tmp_path)
    sink(batch(spark, ("a", 8), ("b", 11)), 0)
    first = scores(spark, tmp_path)
    failing = sink_at(tmp_path)
    written = failing._write

    def stop(df, table, *parts):
        written(df, table, *parts)
        if table == "scores":
            raise RuntimeError("lost")

    failing._write = stop
    with pytest.raises(RuntimeError):
        failing(batch(spark, ("x", 9)), 1)
    assert scores(spark, tmp_path) == first
    for _ in range(2):
        sink(batch(spark, ("x", 9)), 1)
        assert scores(spark, tmp_path) == {"a": 1, "x": 2, "b": 3}


def test_empty_batches_and_events_without_time(spark, tmp_path):
    sink = sink_at(tmp_path)
    sink(spark.createDataFrame([], EVENT_SCHEMA), 0)
    sink(batch(spark, (None, None), ("a", None)), 1)
    assert [(r["n_events"], r["n_late"], r["newest_us"]) for r in revising.progress(spark, str(tmp_path)).collect()] == [(0, 0, None)] * 2
    sink(batch(spark, (None, 3)), 2)
    assert scores(spark, tmp_path) == {None: 1}
    assert revising.late_events(spark, str(tmp_path)).count() == 0


def test_model_in_force(spark, features, tmp_path):
    root, names = str(tmp_path / "models"), ["login_failed", "conn_suspicious", "login_failed_count_5m", "network_bytes_sum_5m"]
    with pytest.raises(ValueError):
        model_store.load(spark, root)
    start = features.agg(F.min("event_time")).first()[0]
    baseline = features.where(F.col("event_time") < F.lit(start) + F.expr("interval 6 minutes"))
    classes = windows.classify_windows(features.withColumn("anom_score", F.col("login_failed").cast("double")), F.lit(2.0))
    first = model_store.retrain(baseline, features, classes, root, names, parts=1, trees=10, max_samples=64)
    model, threshold, version = model_store.load(spark, root)
    newest = windows.normal_history(features, classes, 1)
    pointer = model_store.in_force(spark, root)
    assert version == first == 1 and pointer["n_rows"] == baseline.count() + newest.count() and pointer["n_baseline"] == baseline.count()
    second = model_store.publish(spark, root, model, threshold + 1, 5)
    assert model_store.load(spark, root)[1:] == (threshold + 1, second)
    detector = model_store.detector(root)
    assert detector(spark).version == second
    model_store.restore(spark, root, first)
    assert detector(spark).version == first and detector(spark).threshold == threshold
    assert model_store.pointers(spark, root).count() == 3
    with pytest.raises(ValueError):
        model_store.restore(spark, root, 99)
    scored = detector(spark).score(features)
    assert scored.exceptAll(forest.score(features, model)).isEmpty()


def test_sessions_close_once_and_leave_the_state(spark, tmp_path):
    """Sessions at 0-60 s and 7200 s; the second closes the first, an event a day later closes both."""
    rows = [[(s, "a", "b", "tcp") for s in (0, 30, 60)], [(7_200, "a", "b", "tcp"), (7_200, "c", "d", "udp")], [(90_000, "z", "z", "tcp")]]
    schema = "s long, source_ip string, destination_ip string, network_transport string"
    for part in rows:
        spark.createDataFrame(part, schema).withColumn("event_time", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = []
    query = streams.stream_sessions(source, 120).writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend(tuple(r)[:5] for r in df.selectExpr("source_ip", "unix_seconds(session_start)", "unix_seconds(session_end)", "n_events", "network_transport").collect()))
    query = query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(out) == [("a", 0, 60, 3, "tcp"), ("a", 7_200, 7_200, 1, "tcp"), ("c", 7_200, 7_200, 1, "udp")]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert held[-1] == 1 < max(held)


def test_custody_tree(spark):
    def root(rows, **options):
        frame = spark.createDataFrame(rows, "g string, id long, text string").repartition(3)
        return [tuple(r) for r in context.manifest_digests(frame, "g", "id", "text", **options).collect()]

    a = [("g", k, f"text {k}") for k in range(700)]
    doubled, other = a[:1] + [("g", 9, "b")] * 2, a[:1] + [("g", 9, "z")] * 2
    assert root(a) == root(a[::-1]) and root(a)[0][:4] == ("g", 700, 700, sum(len(t) for _, _, t in a))
    assert len({root(r)[0][4] for r in (doubled, other, a[:1], a[:1] + [("g", 9, "b")], a[:1] + [("g", 9, "b")] * 3)}) == 5
    assert len({root(r)[0][4] for r in ([("g", 1, "")], [("g", 1, None)], [("g", None, "")], [("g", None, None)])}) == 4
    assert root([]) == [] and root([(None, 1, "x")])[0][:4] == (None, 1, 1, 1)
    frame = spark.createDataFrame(a + [("h", 1, "x")] + [("g", 9_999, "twice")] * 2, "g string, id long, text string")
    for depth in (0, 1, 2):
        digest = {r["g"]: r["digest"] for r in context.manifest_digests(frame, "g", "id", "text", depth).collect()}["g"]
        for row_id, text in ((3, "text 3"), (9_999, "twice")):
            proof = context.inclusion_proof(frame, "g", "id", "text", row_id, depth)
            assert context.proven_root(row_id, text, proof) == digest and len(proof) == depth + 1
            assert context.proven_root(row_id, "forged", proof) is None
            assert context.proven_root(row_id, text, [*proof[:-1], proof[-1][1:] + ["f" * 66]]) != digest
    assert context.inclusion_proof(frame, "g", "id", "text", -5) is None


@pytest.mark.parametrize("kind", ["long", "string", "double"])
def test_null_ids_of_every_type_are_errors(spark, kind):
    rows = spark.range(50).selectExpr(f"cast(if(id = 7, null, id) as {kind}) as event_id", "cast(id as double) as anom_score", "id as x")
    for run in (lambda: firstk.hash_sample(rows, 5, "event_id"), lambda: alerts.select_alerts(rows, 50, contamination=1.0)):
        with pytest.raises(Exception, match="a row has no event_id"):
            run().collect()
    with pytest.raises(Exception, match="a row has no event_id"):
        forest.train(rows, ["x"], trees=2)


def test_core_queries_without_the_text_libraries(tmp_path):
    """The other queries register where a library that only the text operators need cannot be imported."""
    code = "import sys; sys.modules['tokenizers'] = None; sys.modules['xxhash'] = None; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; assert 'sessions' in e.queries() and 'pipeline' not in e.queries(); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_context_groups_without_a_shuffle_of_events(spark):
    """Alerts at 0, 9 and 30 minutes with five minutes to each side: the first two share a group."""
    found = batch(spark, ("a", 100), ("b", 109), ("c", 130), ("no time", None))
    events = batch(spark, ("before", 94.9), ("edge", 95), ("between", 104.6), ("end", 114), ("after", 114.1), ("c", 130), (None, 135))
    groups = {r["event_id"]: r["group_us"] and r["group_us"] // MINUTE for r in context.context_groups(found).collect()}
    assert groups == {"a": 95, "b": 95, "c": 125, "no time": None}
    held = context.group_events(events, found)
    assert {(r["event_id"], r["group_us"] // MINUTE) for r in held.collect()} == {("edge", 95), ("between", 95), ("end", 95), ("c", 125), (None, 125)}
    assert "hashpartitioning" not in held._jdf.queryExecution().executedPlan().toString()
    assert context.group_events(events, found.limit(0)).count() == 0


def test_merged_sketches_keep_their_error(spark):
    rows = spark.range(200_000).selectExpr("id % 50 as day", "cast(if(id % 1000 = 3, null, pow(id % 9973, 1.5)) as double) as anom_score")
    sketches = quantile.score_sketches(rows, ["day"], k=400)
    assert sketches.count() == 50
    for contamination in (0.05, 0.5):
        row = quantile.merged_threshold(sketches, contamination=contamination).first()
        below, upto, n = rows.where("anom_score is not null").agg(F.count_if(F.col("anom_score") < row["threshold"]), F.count_if(F.col("anom_score") <= row["threshold"]), F.count(F.lit(1))).first()
        assert n == row["n_rows"] == 199_800
        assert below / n <= 1 - contamination + quantile.sketch_error(400) and upto / n >= 1 - contamination - quantile.sketch_error(400)
    assert quantile.merged_threshold(quantile.score_sketches(rows.limit(0), ["day"]), ["day"]).count() == 0
