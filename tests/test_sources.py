"""Readers: written files in, events out."""

import json

import pytest
from pyspark.sql import functions as F

from duskwatch.schema import EVENT_COLUMNS
from duskwatch.sources import firewall, flows, ingest, jsonl, lines, nested, store, syslog


def rows(df, *names):
    picked = df.select(*[F.date_format(n, "yyyy-MM-dd HH:mm:ss.SSS").alias(n) if n == "event_time" else n for n in names])
    return [tuple(r) for r in picked.collect()]


def write(folder, name, *texts):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(t if isinstance(t, str) else json.dumps(t) for t in texts) + "\n")
    return str(folder)


def test_windows_events_mapped_and_ready(spark, tmp_path):
    path = write(
        tmp_path / "w",
        "a.jsonl",
        {
            "@timestamp": "2024-05-01T10:00:00Z",
            "Event": {
                "System": {"Computer": "pc1", "EventID": 4625},
                "EventData": {"TargetUserName": "bob", "IpAddress": "10.0.0.9", "Status": "0xC000006D"},
            },
        },
        "",
        "{broken",
        {"@timestamp": "2024-05-01T10:00:01.250Z", "event.code": "4624", "host.name": "pc2", "event.module": ""},
        {"@timestamp": "yesterday", "Event": {"System": {"Computer": "pc3"}}},
    )
    got = jsonl.windows_events(jsonl.read_jsonl(spark, path))
    assert got.columns == EVENT_COLUMNS
    assert sorted(rows(got, "event_time", "host_name", "event_code", "user_name", "event_module", "event_dataset")) == [
        ("2024-05-01 10:00:00.000", "pc1", "4625", "bob", "windows", "security"),
        ("2024-05-01 10:00:01.250", "pc2", "4624", None, "windows", "windows.security"),
    ]


def test_sysmon_and_zeek(spark, tmp_path):
    path = write(
        tmp_path / "s",
        "a.jsonl",
        {"UtcTime": "2024-05-01 10:00:00.123", "Computer": "pc1", "EventID": 3, "SourceIp": "10.0.0.1", "DestinationPort": "443"},
    )
    got = jsonl.sysmon_events(jsonl.read_jsonl(spark, path))
    assert rows(got, "event_time", "event_code", "source_ip", "destination_port", "event_dataset") == [
        ("2024-05-01 10:00:00.123", "3", "10.0.0.1", 443, "sysmon")
    ]
    path = write(
        tmp_path / "z",
        "conn.jsonl",
        {"ts": 1714557600.5, "id.orig_h": "10.0.0.1", "id.orig_p": 5000, "conn_state": "S0", "uid": "C1", "local_orig": True},
        {"ts": "bad", "id.orig_h": "10.0.0.2"},
    )
    got = jsonl.zeek_events(jsonl.read_jsonl(spark, path))
    assert rows(got, "event_time", "source_ip", "source_port", "event_outcome", "event_id", "network_direction", "event_dataset") == [
        ("2024-05-01 10:00:00.500", "10.0.0.1", 5000, "S0", "C1", "true", "zeek.conn")
    ]


def test_beats_flat_and_nested(spark, tmp_path):
    path = write(
        tmp_path / "b",
        "packetbeat.jsonl",
        {"@timestamp": "2024-05-01T10:00:00Z", "source": {"ip": "1.1.1.1", "port": 5}, "network": {"bytes": 10.5}},
        {"@timestamp": "2024-05-01T10:00:01+02:00", "source.ip": "2.2.2.2", "event.module": "winlogbeat", "event.severity": "x"},
    )
    got = jsonl.beats_events(jsonl.read_jsonl(spark, path))
    assert sorted(rows(got, "event_time", "source_ip", "source_port", "network_bytes", "event_module", "event_dataset", "event_severity")) == [
        ("2024-05-01 08:00:01.000", "2.2.2.2", None, None, "winlogbeat", "packetbeat.flow", None),
        ("2024-05-01 10:00:00.000", "1.1.1.1", 5, 10.5, "packetbeat", "packetbeat.flow", None),
    ]


def test_documents_with_host_shapes(spark, tmp_path):
    path = write(
        tmp_path / "d",
        "docs.json",
        {"@timestamp": "2024-05-01T10:00:00Z", "host": {"name": "a", "ip": ["10.0.0.1", "fe80::1"]}},
        {"@timestamp": "2024-05-01T10:00:01Z", "host": {"hostname": "b", "ip": "10.0.0.2"}},
        {"@timestamp": "2024-05-01T10:00:02Z", "hostname": "c", "host": "plain"},
        {"@timestamp": "2024-05-01T10:00:03Z", "winlog": {"computer_name": "d"}, "event": {"code": 4625, "outcome": "failure"}},
    )
    got = jsonl.document_events(jsonl.read_jsonl(spark, path)).orderBy("event_time")
    assert rows(got, "host_name", "host_ip", "event_code", "event_outcome") == [
        ("a", "10.0.0.1", None, None),
        ("b", "10.0.0.2", None, None),
        ("c", None, None, None),
        ("d", None, "4625", "failure"),
    ]


def test_field_map_later_entry_wins_and_duplicate_keys(spark):
    records = jsonl.parse_records(
        spark.createDataFrame([('{"a": "1", "b": "2", "t": "2024-01-01"}',), ('{"a": "1", "b": null, "a": "3"}',)], "value string")
    )
    got = jsonl.map_fields(records, [("a", "rule.id"), ("b", "rule.id"), ("t", "@timestamp")])
    assert sorted(rows(got, "rule_id", "event_time"), key=str) == [("2", "2024-01-01 00:00:00.000"), ("3", None)]


def test_syslog_switch_and_servicing(spark, tmp_path):
    folder = tmp_path / "l"
    (folder).mkdir()
    path = write(
        folder / "deep",
        "auth.log",
        "Oct 01 10:02:00 web1 sshd[123]: Failed password for invalid user bob from 10.0.0.9 port 5000 ssh2",
        "Oct  1 10:02:01 web1 sshd[123]: Accepted publickey for root from 10.0.0.8 port 5000 ssh2",
        "Oct 01 10:02:02 sw1 77: %LINK-3-UPDOWN: Interface Ethernet0/3, changed state to down",
        "Oct 01 10:02:04 sw1 %LINK-3-UPDOWN: Interface Ethernet0/3, changed state to down",
        "Oct 01 10:02:03 sw1 sys: %SYS-5-CONFIG_I: Configured from console",
        "Feb 30 10:02:03 sw1 sys: no such day",
        "2016-09-28 04:30:31, Info                  CBS    Failed to get next element 10.1.1.1",
        "2016-09-28 04:30:32, Warning CSI fine",
        "nothing to see",
    )
    write(folder, "other.txt", "Oct 01 10:02:00 web1 sshd[123]: Accepted password for x")
    got = syslog.read_logs(spark, str(folder), 2024, "Asia/Ho_Chi_Minh").orderBy("event_time")
    assert rows(got, "event_time", "host_name", "user_name", "source_ip", "event_dataset", "event_action", "event_outcome") == [
        ("2016-09-28 04:30:31.000", None, None, "10.1.1.1", "cbs", "system_update", "Failure"),
        ("2016-09-28 04:30:32.000", None, None, None, "cbs", "system_update", "Warning"),
        ("2024-10-01 03:02:00.000", "web1", "bob", "10.0.0.9", "auth", "user_login", "Failure"),
        ("2024-10-01 03:02:01.000", "web1", "root", "10.0.0.8", "auth", "user_login", "Success"),
        ("2024-10-01 03:02:02.000", "sw1", None, None, "switch.syslog", "interface_state", "info"),
        ("2024-10-01 03:02:03.000", "sw1", None, None, "switch.syslog", "config_change", "info"),
        ("2024-10-01 03:02:04.000", "sw1", None, None, "switch.syslog", "syslog_event", "info"),
    ]
    assert all(p.endswith("auth.log") for (p,) in rows(got, "log_file_path"))


def test_firewall_pairs(spark, tmp_path):
    path = write(
        tmp_path / "f",
        "fw.txt",
        'date=2024-05-01 time=12:00:00 devname="FW 1" srcip=10.0.0.1 srcport=1 dstip=10.0.0.2 dstport=22 action=accept sentbyte=10 rcvdbyte=20 srcip=10.0.0.7',
        "",
        'eventtime=1714564800000000000 msg="odd srcip=9.9.9.9 inside" rcvdbyte=5 dstport=none',
    )
    got = firewall.read_firewall(spark, path).orderBy("event_time", "network_bytes")
    assert rows(got, "event_time", "host_name", "source_ip", "destination_port", "network_bytes", "message", "event_clock") == [
        ("2024-05-01 12:00:00.000", None, None, None, 5.0, "odd srcip=9.9.9.9 inside", None),
        ("2024-05-01 12:00:00.000", "FW 1", "10.0.0.7", 22, 30.0, None, "12:00:00"),
    ]


def test_ids_alerts(spark, tmp_path):
    path = write(
        tmp_path / "i",
        "alert.txt",
        "2024-05-01T12:00:00.5Z [**] [1:2001219:20] ET SCAN SSH [**] [Classification: Attempted Leak] [Priority: 2] {TCP} 10.0.0.1:1234 -> 10.0.0.2:22",
        "2024-05-01T12:00:01Z [Classification: X] [Priority: 1] {ICMP} 10.0.0.1 -> 10.0.0.2",
        "free text",
    )
    got = firewall.read_ids(spark, path).orderBy("message")
    assert rows(got, "event_time", "event_severity", "event_category", "source_port", "destination_port", "rule_id", "rule_name") == [
        ("2024-05-01 12:00:00.500", 2, "Attempted Leak", 1234, 22, "2001219", "ET SCAN SSH"),
        ("2024-05-01 12:00:01.000", 1, "X", None, None, None, None),
        (None, None, None, None, None, None, None),
    ]


def test_csv_flows_with_different_headers(spark, tmp_path):
    folder = tmp_path / "c"
    write(folder, "a.csv", "Timestamp,Src IP,Dst IP,Dst Port,Protocol,Label,Tot Fwd Bytes,Tot Bwd Bytes",
          "25/12/2023 10:00:00,10.0.0.1,10.0.0.2,80,TCP,Benign,5,", "not a date,1,2,3,4,5,6,7")
    write(folder / "sub", "b.csv", "start_time,source_ip,host", "2023-12-25T10:00:01Z,10.0.0.3,h1")
    write(folder, "c.csv", "x,y", "1,2")
    got = flows.read_flows(spark, str(folder)).orderBy("event_time")
    assert rows(got, "event_time", "source_ip", "destination_port", "network_transport", "event_action", "network_bytes", "host_name") == [
        ("2023-12-25 10:00:00.000", "10.0.0.1", 80, "tcp", "Benign", 5.0, None),
        ("2023-12-25 10:00:01.000", "10.0.0.3", None, None, "flow", None, "h1"),
    ]
    assert flows.normal_name(" Src  IP/(v4) ") == "src_ipv4"


def test_line_filters(spark, tmp_path):
    path = write(tmp_path / "t", "x.log", "2024-01-01 Start", "2024-01-05 ERROR x", " 2024-01-03 y", "bad", "2024-13-01 z")
    text = lines.read_lines(spark, path)
    assert {r.value for r in lines.lines_by_date(text, "2024-01-0").collect()} == {"2024-01-01 Start", "2024-01-05 ERROR x"}
    assert [r.value for r in lines.lines_by_keyword(text, "error").collect()] == ["2024-01-05 ERROR x"]
    assert {r.value for r in lines.lines_by_range(text, "2024-01-01", "2024-01-03").collect()} == {"2024-01-01 Start", " 2024-01-03 y"}
    lines.write_lines(lines.lines_by_keyword(text, "error"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1


def test_flatten_nested_struct(spark):
    doc = {
        "@timestamp": "2024-01-01T00:00:00Z",
        "event": {"action": "accept", "outcome": "failure", "dataset": "d", "module": "m"},
        "source": {"ip": "10.10.10.50", "port": "52000"},
        "destination": {"ip": "10.0.0.2", "port": 22},
        "network": {"transport": "tcp", "bytes": 7},
        "message": "m",
    }
    schema = (
        "`@timestamp` string, event struct<action:string,outcome:string,dataset:string,module:string>, "
        "source struct<ip:string,port:string>, destination struct<ip:string,port:int>, "
        "network struct<transport:string,bytes:int>, message string, `source.ip` string"
    )
    got = nested.flatten(spark.createDataFrame([doc], schema)).first()
    assert (got.event_action, got.event_outcome, got.source_ip) == ("accept", "failure", "10.10.10.50")
    assert (got.source_port, got.destination_port, got.network_bytes) == (52000, 22, 7)


def test_store_replaces_days_and_appends(spark, tmp_path, events):
    path = str(tmp_path / "store")
    day = events.withColumn("event_time", F.col("event_time") + F.expr("interval 1 day"))
    store.write_events(events, path, "a")
    n = events.count()
    store.write_events(day.filter("destination_port = 22"), path, "a")
    store.write_events(events.limit(10), path, "b")
    assert store.read_events(spark, path, ["a"]).count() == n + events.filter("destination_port = 22").count()
    store.write_events(events.limit(5), path, "a")
    assert store.read_events(spark, path, ["a"], ("1970-01-11", "1970-01-11")).count() == 5
    store.append_events(events.limit(5), path, "a")
    assert store.read_events(spark, path, ["a"], ("1970-01-11", "1970-01-11")).count() == 10
    assert store.partitions(spark, path).count() == 3
    pruned = store.read_events(spark, path, ["b"], ("1970-01-11", "1970-01-11"))
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "source" in filters and "dt" in filters


def test_ingest_several_sources_with_one_missing(spark, tmp_path):
    paths = {
        "ids": write(tmp_path / "i", "a.txt", "2024-05-01T12:00:01Z [Classification: X] [Priority: 1] {ICMP} 10.0.0.1 -> 10.0.0.2"),
        "zeek": str(tmp_path / "nothing"),
        "flows": str(tmp_path / "nothing"),
        "syslog": write(tmp_path / "s", "a.log", "Oct 01 10:02:00 web1 sshd[1]: Accepted password for al from 10.0.0.9"),
    }
    got = ingest.ingest(spark, paths, 2024)
    assert sorted(rows(got, "source", "event_module")) == [("ids", "ips"), ("syslog", "syslog")]
    ingest.ingest_to_store(spark, paths, str(tmp_path / "st"), 2024)
    assert store.read_events(spark, str(tmp_path / "st")).count() == 2


def test_tables_by_extension_reports_and_audit(spark, tmp_path):
    from duskwatch.operators.response import policy_plan

    write(tmp_path / "x", "labels.csv", "id,label", "1,0", "2,1")
    assert {tuple(r) for r in store.read_table(spark, str(tmp_path / "x" / "labels.csv")).collect()} == {(1, 0), (2, 1)}
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.1)], "event_id string, anom_score double").withColumn(
        "event_time", F.lit("2024-01-01").cast("timestamp")
    )
    plan = policy_plan(scores)
    assert [(r.rule, r.score, r.action_no) for r in plan.collect()] == [("High IF score fallback", 0.5, 1)]
    store.append_audit(plan, str(tmp_path / "audit"))
    store.append_audit(plan, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 2
    store.write_report(scores, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_training_sample_and_scores_are_bounded_and_repeatable(spark, tmp_path, events):
    two = events.unionByName(events.withColumns({"event_time": F.col("event_time") + F.expr("interval 1 day"), "event_id": F.concat("event_id", F.lit("x"))}))
    sample = store.training_sample(two, 100)
    assert {(r.dt.isoformat(), r["count"]) for r in sample.groupBy("dt").count().collect()} == {
        ("1970-01-11", 100),
        ("1970-01-12", 100),
    }
    again = store.training_sample(two.repartition(5), 100)
    assert sample.select("event_id").exceptAll(again.select("event_id")).isEmpty()
    store.write_scores(two.withColumn("anom_score", F.rand(1)), str(tmp_path / "scores"))
    assert store.read_scores(spark, str(tmp_path / "scores")).count() == two.count()
    assert store.read_scores(spark, str(tmp_path / "scores"), max_rows=50).count() == 50


def test_every_line_has_its_own_lasting_id(spark, tmp_path):
    """Equal lines differ, and ids do not depend on how files are split or read."""
    pair = 'date=2024-05-01 time=12:00:00 devname="FW 1" srcip=10.0.0.1 dstip=10.0.0.2 action=accept'
    write(tmp_path / "fw", "a.log", *[pair] * 40, *[f"{pair} policyid={k}" for k in range(200)], "", pair)
    write(tmp_path / "fw", "b.log", pair)
    write(tmp_path / "z", "z.json", '{"ts": "2024-05-01T00:00:00Z", "uid": "own"}', '{"ts": "2024-05-01T00:00:00Z"}', '{"ts": "2024-05-01T00:00:00Z"}', "broken")
    write(tmp_path / "csv", "f.csv", "timestamp,src_ip", "01/02/2024 10:00,1.1.1.1", "01/02/2024 10:00,1.1.1.1", "01/02/2024 10:00,")
    read = ingest.readers(2024)
    whole = {r["event_id"] for r in read["firewall"](spark, str(tmp_path / "fw")).collect()}
    assert len(whole) == 242 and None not in whole
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    try:
        assert {r["event_id"] for r in read["firewall"](spark, str(tmp_path / "fw")).collect()} == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    zeek = [r["event_id"] for r in read["zeek"](spark, str(tmp_path / "z")).collect()]
    assert "own" in zeek and len(set(zeek)) == 3 and None not in zeek
    flow = [r["event_id"] for r in read["flows"](spark, str(tmp_path / "csv")).collect()]
    assert len(set(flow)) == 3 and None not in flow


def test_each_source_is_scanned_once(spark, tmp_path):
    write(tmp_path / "x", "x.log", "Oct 01 10:02:00 web1 sshd[1]: Failed password for bob from 10.0.0.9 port 1 ssh2", "2016-09-28 04:30:31, Info CBS Failed to go")
    write(tmp_path / "x", "x.json", '{"@timestamp": "2024-01-01T00:00:00Z", "event.code": "1"}')
    for frame in (syslog.read_logs(spark, str(tmp_path / "x"), 2024), jsonl.windows_events(jsonl.read_jsonl(spark, str(tmp_path / "x"), "*.json"))):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("Relation [value") == 1
        assert frame.count() >= 1


def test_lines_are_not_shuffled_for_their_ids(spark, tmp_path):
    write(tmp_path / "fw", "a.log", *[f"date=2024-05-01 time=12:00:00 srcip=10.0.0.{k}" for k in range(300)])
    plan = firewall.read_firewall(spark, str(tmp_path / "fw"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    numbered = lines.read_numbered(spark, str(tmp_path / "fw")).collect()
    assert sorted(r["line_no"] for r in numbered) == list(range(300))
    assert all(r["value"].endswith(f".{r['line_no']}") for r in numbered)
    assert lines.read_numbered(spark, str(tmp_path / "none"), header=True).columns == ["value", "log_file_path", "line_no", "header", "line_id"]


def test_files_split_anew_between_the_readings_are_an_error(spark, tmp_path):
    write(tmp_path / "fw", "a.log", *[f"line number {k}" for k in range(2_000)])
    numbered = lines.read_numbered(spark, str(tmp_path / "fw"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    try:
        with pytest.raises(Exception, match="split otherwise"):
            numbered.select("line_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r["line_id"] for r in numbered.collect()}) == 2_000


def test_headers_of_any_kind(spark, tmp_path):
    write(tmp_path / "c", "a.csv", '﻿"Time Stamp", Timestamp ,"Src IP",Label', '01/02/2024 10:00,02/02/2024 10:00,1.1.1.1,"a, b"', "", "02/02/2024 11:00")
    write(tmp_path / "c", "b.csv", "src_ip,label,when", "2.2.2.2,x,2024-02-03T00:00:00Z")
    write(tmp_path / "c", "empty.csv")
    got = flows.read_flows(spark, str(tmp_path / "c"))
    assert rows(got, "event_time", "source_ip", "event_action") == [("2024-02-02 10:00:00.000", "1.1.1.1", "a, b")]
    got = flows.read_flows(spark, str(tmp_path / "c"), "When").orderBy("event_time")
    assert rows(got, "event_time", "source_ip", "event_action")[1:] == [("2024-02-03 00:00:00.000", "2.2.2.2", "x")]
    assert flows.read_flows(spark, str(tmp_path / "none")).count() == 0


def test_patterns_of_text_logs_run_once(spark, tmp_path):
    write(tmp_path / "x", "x.log", "Oct 01 10:02:00 web1 sshd[1]: Failed password for bob from 10.0.0.9 port 1 ssh2", "2016-09-28 04:30:31, Info CBS Failed to go", "\x01Oct 01 10:02:00 web1 p: m", "Oct 01 10:02:00 web1 p: a\x01b")
    frame = syslog.read_logs(spark, str(tmp_path / "x"), 2024)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for pattern in (syslog.SYSLOG_LINE, syslog.SERVICING_LINE, syslog.FAILED_USER, syslog.ACCEPTED_USER):
        assert 1 <= plan.count(pattern) <= 2, pattern
    assert sorted(r["message"] for r in frame.collect()) == ["Failed password for bob from 10.0.0.9 port 1 ssh2", "Failed to go", "a\x01b"]
