"""Fixed cases of scoring, cleaning and texts."""

import json

import pytest
from pyspark.sql import functions as F

from idsignal.functions import checks, ip, numeric, risk, scores, text, times
from idsignal.operators import events, reports
from idsignal.plans.analysis import analyze_payloads, line_alerts
from idsignal.sources import payloads

SAMPLE = [
    {"eventTime": "2026-05-26T10:20:00Z", "eventName": "CreateAccessKey", "sourceIPAddress": "45.67.89.10",
     "awsRegion": "us-east-1", "userIdentity": {"userName": "admin"}},
    {"eventTime": "2026-05-26T10:25:00Z", "eventName": "DeleteTrail", "sourceIPAddress": "185.220.101.45",
     "awsRegion": "ap-south-1", "userIdentity": {"userName": "cloud-admin"}},
    {"eventTime": "2026-05-26T10:30:00Z", "eventName": "ListUsers", "sourceIPAddress": "192.168.1.20",
     "awsRegion": "ap-south-1", "userIdentity": {"userName": "auditor"}},
]


def requests(spark, *documents):
    rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, "request_id bigint, payload string")


def applied(spark, column, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").orderBy("i").select(column(F.col("v")).alias("out"))
    return [r.out for r in df.collect()]


def test_sample_request(spark):
    rows = analyze_payloads(requests(spark, SAMPLE)).orderBy("pos").collect()
    assert [(r.risk_score, r.priority) for r in rows] == [(65, "HIGH"), (95, "CRITICAL"), (0, "LOW")]
    assert rows[0].reasons == ["Sensitive IAM action detected: CreateAccessKey", "External source IP detected: 45.67.89.10"]
    assert len(rows[1].reasons) == 3 and rows[2].reasons == []
    assert [len(r.explanation.recommendations) for r in rows] == [3, 4, 1]
    assert rows[0].explanation.summary == (
        "HIGH alert detected for user admin. Action: CreateAccessKey. Source IP: 45.67.89.10.")
    assert rows[2].explanation.recommendations == ["Continue monitoring"]
    assert json.loads(rows[0].raw_event) == SAMPLE[0]
    assert rows[0].timestamp == "2026-05-26T10:20:00Z"


def test_sample_envelope_and_order(spark):
    alerts = analyze_payloads(requests(spark, SAMPLE))
    top = reports.request_summary(alerts).first()
    assert (top.total_logs, top.total_alerts, top.top_action, top.top_risk_score) == (3, 3, "DeleteTrail", 95)
    ranked = reports.ranked_alerts(alerts).orderBy("t").collect()
    assert [r.risk_score for r in ranked] == [95, 65, 0]


@pytest.mark.parametrize("action, result, address, score, level", [
    ("DeleteTrail", "FAILED", "8.8.8.8", 100, "CRITICAL"),
    ("ListUsers", "FAILED", "8.8.8.8", 35, "MEDIUM"),
    ("AssumeRole", "FAILED", "8.8.8.8", 60, "HIGH"),
    ("StopLogging", "SUCCESS", "10.0.0.1", 80, "CRITICAL"),
    ("createuser", "SUCCESS", "unknown", 0, "LOW"),
    ("ListUsers", "SUCCESS", "172.200.1.1", 0, "LOW"),
])
def test_risk_edges(spark, action, result, address, score, level):
    df = spark.createDataFrame([(action, result, address)], "action string, result string, src_ip string")
    row = risk.with_risk(df).first()
    assert (row.risk_score, row.priority) == (score, level)


def test_private_range_option(spark):
    df = spark.createDataFrame([("172.200.1.1",), ("172.20.1.1",), ("10.1.1.1",)], "src_ip string").select(
        F.lit("x").alias("action"), F.lit("x").alias("result"), "src_ip")
    assert [r.risk_score for r in risk.with_risk(df, rfc1918=True).collect()] == [15, 0, 0]


def test_quarantine_keeps_good_elements(spark):
    elements = payloads.scan_elements(requests(
        spark, [SAMPLE[0], 5, "x", None, SAMPLE[1]], "[{", "7", "[]", SAMPLE[2], "[] []", "{} x", "{'eventName':'A'}", "", "[[{}]]", "{},{}", "[{}],[{}]"))
    bad = payloads.quarantined(elements).orderBy("request_id", "pos").collect()
    assert [(r.request_id, r.pos, r.rejected) for r in bad] == [
        (0, 1, payloads.NOT_AN_EVENT), (0, 2, payloads.NOT_AN_EVENT), (0, 3, payloads.NOT_AN_EVENT),
        (1, 0, payloads.MALFORMED), (2, 0, payloads.NOT_AN_EVENT), (5, 0, payloads.MALFORMED), (6, 0, payloads.MALFORMED),
        (7, 0, payloads.MALFORMED), (8, 0, payloads.MALFORMED), (9, 0, payloads.NOT_AN_EVENT),
        (10, 0, payloads.MALFORMED), (11, 0, payloads.MALFORMED)]
    assert [r.raw_event for r in bad[:6]] == ["5", '"x"', "null", "[{", "7", "[] []"]
    good = payloads.event_fields(elements).orderBy("request_id", "pos").collect()
    assert [(r.request_id, r.pos) for r in good] == [(0, 0), (0, 4), (4, 0)]


def test_null_payload_is_malformed(spark):
    rows = spark.createDataFrame([(1, None)], "request_id bigint, payload string")
    for keep_raw in (True, False):
        assert [r.rejected for r in payloads.scan_elements(rows, keep_raw).collect()] == [payloads.MALFORMED]


def test_payload_may_start_with_whitespace(spark):
    rows = requests(spark, "\n\t [" + json.dumps(SAMPLE[0]) + "]", "\r\n" + json.dumps(SAMPLE[1]))
    assert payloads.event_fields(payloads.scan_elements(rows)).count() == 2


def test_records_wrapper_is_optional(spark):
    wrapped = requests(spark, {"Records": SAMPLE})
    assert payloads.event_fields(payloads.scan_elements(wrapped)).first().event_name is None
    rows = payloads.event_fields(payloads.scan_elements(wrapped, unwrap_records=True)).orderBy("pos").collect()
    assert [json.loads(r.raw_event) for r in rows] == SAMPLE
    assert payloads.event_fields(payloads.scan_elements(requests(spark, SAMPLE[0]), unwrap_records=True)).count() == 1


def test_error_code_truth_and_missing_keys(spark):
    codes = ["AccessDenied", "", None, 0, 1, False, True, {}, [], ["x"], "0", "false"]
    events_in = [{"eventName": "A", "errorCode": c} for c in codes] + [{"userIdentity": {"arn": "arn:x"}, "eventName": None}]
    rows = events.parse_events(payloads.event_fields(payloads.scan_elements(requests(spark, events_in)))).orderBy("pos").collect()
    assert [r.result == "FAILED" for r in rows] == [bool(c) for c in codes] + [False]
    assert rows[2].error_code is None and rows[2].timestamp == "unknown"
    assert (rows[-1].user, rows[-1].action, rows[-1].src_ip, rows[-1].region) == ("arn:x", "unknown", "unknown", "unknown")


def test_log_types(spark):
    documents = [
        {"eventSource": "iam.amazonaws.com", "eventName": "A"}, {"eventSource": "s3", "eventName": "A"},
        {"userIdentity": {}, "eventName": "A"}, {"eventName": "A"}, {"eventSource": "iam.amazonaws.com"},
    ]
    rows = events.parse_events(payloads.event_fields(payloads.scan_elements(requests(spark, documents)))).orderBy("pos").collect()
    assert [r.log_type for r in rows] == ["aws_iam", "aws_cloudtrail", "aws_cloudtrail", "unknown", "unknown"]


def test_ip_extract(spark):
    values = ["x 999.1.1.1 10.0.0.1", "010.0.0.1", "1.2.3.4.5", "ec2.amazonaws.com", None, "", "0.0.0.0", "a1.2.3.4", "fe80::1",
              "from 8.8.8.8 port", "é1.2.3.4"]
    assert applied(spark, ip.extract_ip, values) == [
        "unknown", "unknown", "1.2.3.4", "unknown", "unknown", "unknown", "0.0.0.0", "unknown", "unknown", "8.8.8.8", "unknown"]


def test_ip_repair(spark):
    values = ["5.205", "abc", "300.1.1.1", "1.2.3.4.5", "-", " unknown ", None, "007.08.0.000", "99999999999999999999.1"]
    assert applied(spark, ip.repair_ip, values) == [
        "5.205.0.0", "0.0.0.0", "255.1.1.1", "1.2.3.4", None, None, None, "7.8.0.0", "255.1.0.0"]


def test_score_maps(spark):
    assert applied(spark, scores.reputation_score, [9, 10, 29, 30, 59, 60, 79, 80, None], "int") == [1, 3, 3, 6, 6, 8, 8, 10, 1]
    assert applied(spark, scores.fusion_bucket, [0.85, 0.851, 0.6, 0.3, 0.31], "double") == [
        "HIGH", "CRITICAL", "MEDIUM", "LOW", "MEDIUM"]
    assert applied(spark, scores.priority_code, ["LOW", "MEDIUM", "HIGH", "CRITICAL", "high", None]) == [0, 1, 2, 3, 0, 0]


def test_names(spark):
    assert applied(spark, text.feed_name, ["admin", "ADMIN", "unknown", None, "", "jOHN doe", "securityMonkey", " backup "]) == [
        "Admin Account", "Admin Account", "Unidentified User", "Unidentified User", "Unidentified User", "John doe",
        "Security Monitor Bot", "Backup Service Account"]
    assert applied(spark, text.insight_name, ["admin", "ADMIN", "Level6", None]) == [
        "Admin Account", "Admin", "Production IAM Role", "Unknown"]
    assert applied(spark, text.clean_value, [None, "\tNaN\n", "none ", "", " x y ", "\u3000x\xa0"]) == [
        "Unknown", "Unknown", "Unknown", "Unknown", "x y", "x"]


def test_times(spark):
    fallback = F.lit("2000-01-01 00:00:00").cast("timestamp")
    shown = applied(spark, lambda c: times.iso_text(times.parse_time(c, fallback)),
                    ["2024-03-01 10:20:30", "2024-03-01", "01/03/2024", None, "2024-3-1 1:2:3"])
    assert shown == ["2024-03-01 10:20:30", "2024-03-01 00:00:00", "2000-01-01 00:00:00", "2000-01-01 00:00:00", "2024-03-01 01:02:03"]


def test_means_skip_nan_and_null(spark):
    df = spark.createDataFrame([("u", 1.0), ("u", 0.5), ("u", float("nan")), ("u", None), ("v", None)], "user string, alert_score double")
    assert df.agg(numeric.known_mean(F.col("alert_score"))).first()[0] == 0.75
    assert [(r.entity, r.risk_score) for r in reports.entity_insights(df).collect()] == [("U", 0.75)]


def test_numbers(spark):
    assert applied(spark, numeric.number_or_zero, ["1.5", "x", None, "NaN"]) == [1.5, 0.0, 0.0, 0.0]
    assert applied(spark, numeric.two_decimals, [0.5, 0.126, 12.0], "double") == ["0.50", "0.13", "12.00"]


ENTRY = dict(user_id="1", action_id="2", ip_id="3", result="SUCCESS", alert_score="5", prelim_priority="high", ip=None)


@pytest.mark.parametrize("change, message", [
    ({}, "Valid"),
    ({"user_id": None, "result": None}, "Missing required field: user_id"),
    ({"prelim_priority": None}, "Missing required field: prelim_priority"),
    ({"alert_score": "abc"}, "could not convert string to float: 'abc'"),
    ({"alert_score": "7d"}, "could not convert string to float: '7d'"),
    ({"alert_score": "nan"}, "Alert score must be between 0 and 10"),
    ({"alert_score": "inf"}, "Alert score must be between 0 and 10"),
    ({"alert_score": "10.01", "prelim_priority": "bad"}, "Alert score must be between 0 and 10"),
    ({"prelim_priority": "CRITICAL"}, "Invalid prelim_priority value"),
    ({"ip": "999.999.999.999"}, "Valid"),
    ({"ip": "1.2.3"}, "Invalid IP format: 1.2.3"),
    ({"ip": ""}, "Valid"),
])
def test_validation(spark, change, message):
    row = {**ENTRY, **change}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    out = checks.with_validation(df).first()
    assert (out.message, out.is_valid) == (message, message == "Valid")


def test_validation_without_a_required_column(spark):
    df = spark.createDataFrame([("1",)], "user_id string")
    assert checks.with_validation(df).first().message == "Missing required field: action_id"


def test_line_alerts(spark):
    lines = spark.createDataFrame([(1, "Failed password for root from 45.67.89.1"), (2, "sshd: from 10.0.0.1"), (3, "hello")],
                                  "event_id bigint, raw_log string")
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    plain = line_alerts(lines, F.col("event_id"), stamp).orderBy("id").collect()
    assert [(r.event_type, r.risk_score, r.severity, r.status, r.user) for r in plain] == [
        ("UNKNOWN", 15, "LOW", "OPEN", None), ("UNKNOWN", 0, "LOW", "OPEN", None), ("UNKNOWN", 0, "LOW", "OPEN", None)]
    marked = line_alerts(lines, F.col("event_id"), stamp, auth_rule=True).orderBy("id").collect()
    assert [(r.event_type, r.user) for r in marked] == [("FAILED_LOGIN", "root"), ("FAILED_LOGIN", None), ("UNKNOWN", None)]


def test_findings_placeholder(spark):
    empty = spark.createDataFrame([], "user string, prelim_priority string, alert_score double, src_ip string")
    rows = reports.top_findings(empty).collect()
    assert [(r.user, r.message) for r in rows] == [(None, "No log data available")]
    assert reports.finding_recommendations(reports.top_findings(empty)).count() == 0
