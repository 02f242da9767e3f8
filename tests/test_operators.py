"""Operators on small frames, against hand-made or brute-force results."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duskwatch.functions import flags, text
from duskwatch.operators import alerts, context, firstk, forest, quantile, rules, windows
from duskwatch.operators import rolling as rolling_module
from duskwatch.operators.rolling import rolling
from duskwatch.operators.sessions import sessionize
from duskwatch.plans.features import build_features
from duskwatch.schema import EVENT_SCHEMA, feature_columns

START = 1_704_067_200


def events(spark, rows):
    """Events from ``(second, dict)`` pairs."""
    names = EVENT_SCHEMA.fieldNames()
    data = [[{"event_id": str(i), **r}.get(n) for n in names] for i, (_, r) in enumerate(rows)]
    frame = spark.createDataFrame(data, EVENT_SCHEMA)
    seconds = F.create_map(*[x for i, (s, _) in enumerate(rows) for x in (F.lit(str(i)), F.lit(float(START + s)))])
    return frame.withColumn("event_time", F.timestamp_micros((seconds[F.col("event_id")] * 1_000_000).cast("bigint")))


def test_login_failed_by_text_by_code_and_by_float_code(spark):
    frame = spark.createDataFrame(
        [(None, None, "Failed password for invalid user admin"), ("4625", "Failure", ""), ("4625.0", None, None), (None, None, None)],
        "code string, outcome string, message string",
    )
    got = frame.select(flags.login_failed(F.col("code"), F.col("outcome"), F.col("message"))).collect()
    assert [r[0] for r in got] == [1, 1, 1, 0]


@pytest.mark.parametrize("value", [None, "", "a", "aaaa", "abcd", "héé€😀😀", "x" * 5000 + "y"])
def test_entropy(spark, value):
    frame = spark.createDataFrame([(value,)], "t string")
    got = frame.select(text.shannon_entropy(F.col("t"))).first()[0]
    counts = Counter(value or "")
    total = sum(counts.values())
    expected = -sum(c / total * math.log2(c / total) for c in counts.values()) if total else 0.0
    assert got == pytest.approx(expected, abs=1e-9)


def test_text_helpers(spark):
    frame = spark.createDataFrame([("Critical, not low",), ("moderately low",), ("medium or low",), ("",), (None,)], "t string")
    risks = [r[0] for r in frame.select(text.risk_from_text(F.col("t"))).collect()]
    assert risks == ["HIGH", "LOW", "MEDIUM", "LOW", "LOW"]
    cut = spark.createDataFrame([("abcdef",), ("abc",), (None,)], "t string").select(text.truncate(F.col("t"), 5))
    assert [r[0] for r in cut.collect()] == ["ab...", "abc", ""]
    link = spark.createDataFrame([("T1059.001",), (" ",)], "t string").select(text.technique_url(F.col("t")))
    assert [r[0] for r in link.collect()] == ["https://attack.mitre.org/techniques/T1059/001/", ""]


def test_rolling_keeps_rows_with_null_keys(spark):
    frame = events(spark, [(0, {"source_ip": "A"}), (30, {}), (60, {"source_ip": "A"})])
    frame = frame.withColumn("flag", F.when(F.col("event_id") == "2", 0).otherwise(1))
    got = rolling(frame, F.col("source_ip"), {"flag": "flag_count_{w}m"}).orderBy("event_id")
    assert [r.flag_count_1m for r in got.collect()] == [1.0, 1.0, 0.0]


@pytest.mark.parametrize("slice_seconds", [1, 45, 3600])
def test_rolling_equals_brute_force(spark, slice_seconds):
    chance = random.Random(slice_seconds)
    rows = []
    for _ in range(400):
        second = chance.choice([chance.randrange(0, 4000), 60 * chance.randrange(0, 60)])
        key = chance.choice(["hot", "hot", "hot", "a", None])
        rows.append((second, {"source_ip": key, "destination_ip": chance.choice(["x", "y", "z", None]), "event_severity": chance.randrange(3)}))
    frame = events(spark, rows)
    got = rolling(
        frame, F.col("source_ip"), {"event_severity": "sum_{w}m"}, {"destination_ip": "uniq_{w}m"}, slice_seconds=slice_seconds
    )
    for row in got.collect():
        second, own = rows[int(row.event_id)]
        for w in (1, 5, 15):
            seen = [r for s, r in rows if r["source_ip"] == own["source_ip"] and second - 60 * w < s <= second]
            assert row[f"sum_{w}m"] == sum(r["event_severity"] for r in seen)
            assert row[f"uniq_{w}m"] == len({r["destination_ip"] for r in seen} - {None})


def test_rolling_and_sessions_join_nothing_back_to_the_events(spark):
    """Results that were joined back to the events by key and instant shuffled both sides again, or were broadcast whole."""
    frame = events(spark, [(0, {"source_ip": "a"}), (30, {})])
    rolled = rolling(frame, F.col("source_ip"), {"event_severity": "s_{w}m"}, {"destination_ip": "u_{w}m"})
    for found in (rolled, sessionize(frame)):
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_rolling_and_sessions_of_repeated_rows_and_rows_without_time(spark):
    chance = random.Random(4)
    rows = [(chance.choice([None, 0, 60, chance.randrange(900)]), chance.choice(["a", "b", None]), chance.choice(["x", "y", None]), chance.choice([None, 0, 2])) for _ in range(60)]
    frame = spark.createDataFrame([(i % 60, *rows[i % 60]) for i in range(90)], "id long, second long, source_ip string, destination_ip string, n int")
    frame = frame.withColumn("network_transport", F.lit("tcp")).withColumn("event_time", F.timestamp_seconds("second"))
    every = [r[1:5] for r in frame.collect()]
    got = rolling(frame, F.col("source_ip"), {"n": "s_{w}m"}, {"destination_ip": "u_{w}m"}, slice_seconds=20)
    assert got.columns[: len(frame.columns)] == frame.columns and got.count() == 90
    for row in got.collect():
        for w in (1, 5, 15):
            seen = [r for r in every if None not in (r[0], row.second) and r[1] == row.source_ip and row.second - 60 * w < r[0] <= row.second]
            expected = (None, None) if row.second is None else (sum(r[3] or 0 for r in seen), len({r[2] for r in seen} - {None}))
            assert (row[f"s_{w}m"], row[f"u_{w}m"]) == expected
    for row in sessionize(frame).collect():
        times = sorted({r[0] for r in every if r[1:3] == (row.source_ip, row.destination_ip) and r[0] is not None})
        starts = [t for before, t in zip([None, *times], times) if before is None or t - before > 120]
        assert row.session_seq == (None if row.second is None else sum(t <= row.second for t in starts))
        assert (row.session_id is None) == (row.second is None)


def test_sessions_break_on_gap_and_transport(spark):
    def flow(proto, src="a"):
        return {"source_ip": src, "destination_ip": "d", "network_transport": proto}

    rows = [(0, flow("tcp")), (120, flow("tcp")), (241, flow("tcp")), (250, flow("udp")), (251, flow("tcp")), (9000, flow("tcp")), (0, flow(None, None))]
    got = sessionize(events(spark, rows)).orderBy("event_id").collect()
    assert [r.session_seq for r in got] == [1, 1, 2, 3, 4, 5, 1]
    assert got[5].session_id == "a>d#5" and got[6].session_id == "?>d#1"


def test_feature_properties(spark, features, events):
    assert len(feature_columns()) == 96 and features.count() == events.count()
    f = F.col
    ordered = (f("login_failed_count_1m") <= f("login_failed_count_5m")) & (f("login_failed_count_5m") <= f("login_failed_count_15m"))
    sane = ordered & (f("login_failed_count_1m") >= f("login_failed")) & f("deny_ratio_5m").between(0, 1)
    assert features.filter(~sane).isEmpty()


def test_features_of_one_sparse_event(spark):
    got = build_features(events(spark, [(0, {})])).first()
    assert got.login_failed_count_1m == 0.0 and got.uniq_dst_per_src_1m == 0.0 and got.text_entropy == 0.0


@pytest.mark.parametrize("n, accuracy", [(1, 100), (2, 100), (1000, 100), (20000, 1000)])
def test_exact_quantile(spark, n, accuracy):
    values = np.random.default_rng(n).choice([1.0, 2.5, *np.random.default_rng(1).normal(size=300)], n)
    frame = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(7)
    for p in (0.0, 0.5, 0.95, 1.0):
        got = quantile.exact_quantile(frame, "v", p, accuracy).first()
        assert got.threshold == pytest.approx(float(np.quantile(values, p))) and got.n_rows == n


def test_threshold_without_rows(spark):
    empty = spark.createDataFrame([], "event_id string, anom_score double")
    assert alerts.select_alerts(empty).count() == 0


def test_first_k_and_hash_sample(spark):
    frame = spark.range(5000).withColumn("g", F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 2 + 1))
    got = firstk.first_k(frame, 10, F.floor(F.col("id") / 100), [F.col("id")], by=["g"])
    assert {(r.g, r.n, r.low) for r in got.groupBy("g").agg(F.count("id").alias("n"), F.min("id").alias("low")).collect()} == {
        (0, 10, 0), (1, 10, 4000), (2, 10, 4001)
    }
    sample = firstk.hash_sample(frame, 100, "id")
    assert sample.count() == 100 and sample.exceptAll(firstk.hash_sample(frame.repartition(9), 100, "id")).isEmpty()


def rule_hits(spark, schema, *row):
    frame = spark.createDataFrame([row], schema)
    return [h.technique for h in frame.select(rules.technique_hits(frame).alias("h")).first().h]


def test_shipped_rules(spark):
    assert rule_hits(spark, "login_failed_count_5m double, login_failed_ratio_5m double, event_action string", 20.0, 0.9, "deny") == ["T1110"]
    assert rule_hits(spark, "destination_port int, event_action string", 22, "Accept") == ["T1021"]
    assert rule_hits(spark, "`destination.port` int, `event.action` string", 22, "allow") == ["T1021"]
    assert rule_hits(spark, "uniq_dport_per_src_1m double, conn_suspicious int", 5.0, 1) == ["T1046"]
    assert rule_hits(spark, "destination_port int, event_action string", 80, "allow") == []
    assert rule_hits(spark, "event_dataset string, event_action string", "switch.syslog", "interface_state") == ["T1499"]
    assert rule_hits(spark, "labels struct<attack_type:string>", (("port_scan",))) == ["T1046"]


def test_evaluate_counts_add_up_and_labels_never_repeat_rows(spark):
    scores = spark.createDataFrame([(i, i / 100) for i in range(100)], "row_id int, anom_score double")
    labels = spark.createDataFrame([(99, 1), (99, 0), (3, 1), (4, 0)], "row_id int, label int")
    labelled = alerts.label_join(scores, labels, keys=["row_id"])
    assert labelled.count() == 100
    got = alerts.evaluate(labelled).first()
    assert (got.tp, got.fp, got.fn, got.tn, got.total) == (1, 4, 1, 94, 100)
    with pytest.raises(ValueError):
        alerts.label_join(scores, labels)


def test_context_bounds_are_inclusive(spark):
    around = events(spark, [(s, {"source_ip": "a", "event_module": f"m{s}", "event_action": "x"}) for s in (0, 299, 300, 600, 900, 901)])
    alert = around.filter("event_id = '3'")
    near = context.alert_context(around, alert).select("event_id")
    assert {r.event_id for r in near.collect()} == {"2", "3", "4"}
    modules = context.alert_entities(around, alert).filter("kind = 'module'")
    assert {r.value for r in modules.collect()} == {"m300", "m600", "m900"}
    related = context.correlated(around, alert, minutes=5)
    assert {r.module for r in related.collect()} == {"m300", "m600", "m900"}


def test_window_boundaries(spark):
    frame = events(spark, [(0, {}), (599, {}), (600, {}), (630, {})])
    got = frame.select((F.unix_seconds(windows.closing_boundary(F.col("event_time"))) - START).alias("e"), "event_id").orderBy("event_id")
    assert [r.e for r in got.collect()] == [0, 600, 600, 600]
    starts = windows.with_window(frame).select((F.unix_seconds("window_start") - START).alias("s"), "event_id").orderBy("event_id")
    assert [r.s for r in starts.collect()] == [0, 0, 600, 600]


@pytest.fixture(scope="module")
def trained(spark):
    chance = np.random.default_rng(3)
    points = [(str(i), *map(float, chance.normal(size=3)), 1.0) for i in range(500)] + [("far", 9.0, -9.0, 9.0, 1.0)]
    table = spark.createDataFrame(points, "event_id string, a double, b double, c double, same double").repartition(4)
    return table, forest.train(table, ["a", "b", "c", "same"], trees=60, max_samples=64)


def test_forest_is_repeatable_and_finds_the_outlier(spark, trained, tmp_path):
    table, model = trained
    assert model.features == ["a", "b", "c"]
    again = forest.train(table.repartition(9), ["a", "b", "c", "same"], trees=60, max_samples=64)
    by = ["tree_id", "node_id"]
    assert model.nodes.sort_values(by).reset_index(drop=True).equals(again.nodes.sort_values(by).reset_index(drop=True))
    best = alerts.select_alerts(forest.score(table, model), top_n=1).first()
    assert best.event_id == "far"
    forest.save(model, spark, str(tmp_path / "m"))
    loaded = forest.load(spark, str(tmp_path / "m"))
    one = forest.score(table.filter("event_id = 'far'"), loaded).first()
    assert one.anom_score == pytest.approx(best.anom_score)


def test_forest_scores_equal_a_plain_walk(trained):
    table, model = trained
    trees = {t: g.set_index("node_id") for t, g in model.nodes.groupby("tree_id")}
    rows = forest.score(table.limit(20), model).collect()
    for row in rows:
        x = [(row[f] - c) / s for f, c, s in zip(model.features, model.center, model.scale)]
        total = 0.0
        for nodes in trees.values():
            at = nodes.loc[0]
            while at.feature >= 0:
                at = nodes.loc[int(at.left if x[int(at.feature)] <= at.split else at.right)]
            total += at.depth + float(forest.mean_path(at.n))
        expected = 2 ** (-total / len(trees) / float(forest.mean_path(64))) - model.offset
        assert row.anom_score == pytest.approx(expected)


def test_attribution_adds_up(trained):
    table, model = trained
    got = forest.attribution(table.filter("event_id = 'far'"), model, k=3).first()
    assert len(got.top_features) == 3 and all(i.value > 0 for i in got.top_features)


def test_column_quantiles_of_heavy_tails(spark):
    """Nearly all values in a sliver of the range, nulls and texts among them; brackets narrow in several rounds."""
    random = np.random.default_rng(0)
    x = np.exp(random.normal(size=20_000) * 6)
    frame = spark.createDataFrame(
        pd.DataFrame({"tail": x, "flat": np.arange(20_000) % 3, "text": ["7" if k % 2 else "seven" for k in range(20_000)], "one": 4.0, "gap": [None if k % 4 else float(k) for k in range(20_000)]})
    )
    want = {"tail": x, "flat": np.arange(20_000) % 3, "text": np.arange(20_000) % 2 * 7.0, "one": np.full(20_000, 4.0), "gap": np.where(np.arange(20_000) % 4, 0, np.arange(20_000))}
    for most in (100_000, 50):
        got = {r["feature"]: r for r in quantile.column_quantiles(frame, list(want), most_rows=most).collect()}
        for name, values in want.items():
            r = got[name]
            assert r["n_rows"] == 20_000 and np.allclose([r["low"], r["q25"], r["q50"], r["q75"], r["high"]], np.quantile(values, [0, 0.25, 0.5, 0.75, 1]))
    for p in (0.0, 0.01, 0.5, 0.95, 1.0):
        for accuracy, most in ((100_000, 50_000), (100, 20)):
            assert np.isclose(quantile.exact_quantile(frame, "tail", p, accuracy, most).first()["threshold"], np.quantile(x, p))


def test_draws_do_not_depend_on_size_or_partitions(spark):
    rows = spark.range(200_000).selectExpr("string(id) as event_id", "array(double(id % 97), double(id % 89)) as x")
    draws = []
    for parts in (1, 5):
        drawn = forest.tree_samples(rows.repartition(parts), "event_id", 200_000, 20, 256, 1)
        draws.append({(r["tree_id"], r["_order"]) for r in drawn.collect()})
    assert draws[0] == draws[1]
    sizes = {}
    for tree, _ in draws[0]:
        sizes[tree] = sizes.get(tree, 0) + 1
    assert sizes == {tree: 256 for tree in range(20)}


def test_missing_ids_are_errors(spark):
    rows = spark.range(100).selectExpr("cast(null as string) as event_id", "double(id) as a", "double(id % 7) as b")
    with pytest.raises(Exception, match="no event_id"):
        forest.train(rows, ["a", "b"], trees=3)
    with pytest.raises(Exception, match="no event_id"):
        firstk.hash_sample(rows, 5, "event_id").collect()
    same = spark.range(300).selectExpr("'x' as event_id", "double(id) as a")
    with pytest.raises(ValueError, match="trees"):
        forest.train(same, ["a"], trees=50, max_samples=8)


def test_large_amounts_are_summed(spark):
    rows = spark.createDataFrame([("k", 0, "2e16"), ("k", 1, "0.000001"), ("k", 2, "no"), ("k", 3, None)], "key string, t long, amount string")
    got = rolling(rows.withColumn("a", rolling_module.as_amount(F.col("amount"))), F.col("key"), {"a": "s_{w}m"}, time_us=F.col("t"), windows=(1,))
    assert {r["t"]: r["s_1m"] for r in got.collect()} == {0: 2e16, 1: 2e16, 2: 2e16, 3: 2e16}
