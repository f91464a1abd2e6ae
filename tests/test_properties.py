"""Random requests against a plain restatement of the rules, and a partitioned trend."""

import ipaddress
import json
import random
import re

from pyspark.sql import functions as F

from idsignal import fixed_values as fv
from idsignal.operators import reports
from idsignal.plans import catalog
from idsignal.plans.analysis import analyze_payloads

ACTIONS = fv.SENSITIVE_ACTIONS + fv.ELEVATED_ACTIONS + ["ListUsers", "createuser", "", "Ünïcode \"quoted\""]
ADDRESSES = ["8.8.8.8", "10.1.1.1", "172.99.0.1", "192.168.0.1", "256.1.1.1 9.9.9.9", "host", "", "a 1.2.3.4 b", "01.2.3.4"]
ERRORS = ["", "Denied", 0, 3, True, False, {}, {"k": 1}, [], None]


def random_event(rng):
    event = {}
    choices = {"eventName": ACTIONS, "sourceIPAddress": ADDRESSES, "errorCode": ERRORS,
               "awsRegion": ["us-east-1"], "eventSource": ["iam.amazonaws.com", "s3"], "eventTime": ["2024-01-01"]}
    for key, values in choices.items():
        if rng.random() < 0.8:
            event[key] = rng.choice(values)
    if rng.random() < 0.8:
        event["userIdentity"] = {k: v for k, v in {"userName": "u", "arn": "arn:u"}.items() if rng.random() < 0.6}
    return event


def expected(event):
    """(user, action, address, result, score) by one sum over the fired rules."""
    identity = event.get("userIdentity", {})
    action = event.get("eventName", "unknown")
    found = re.search(fv.IPV4_TOKEN, event.get("sourceIPAddress", ""))
    try:
        address = str(ipaddress.ip_address(found[0])) if found else "unknown"
    except ValueError:
        address = "unknown"
    outside = address != "unknown" and not any(address.startswith(p) for p in fv.INTERNAL_PREFIXES)
    fired = {50: action in fv.SENSITIVE_ACTIONS, 25: action in fv.ELEVATED_ACTIONS, 20: bool(event.get("errorCode")),
             15: outside, 30: action in fv.TAMPERING_ACTIONS}
    score = min(100, sum(points for points, hit in fired.items() if hit))
    user = identity.get("userName") or identity.get("arn") or "unknown"
    return user, action, address, "FAILED" if fired[20] else "SUCCESS", score, sum(fired.values())


def test_random_requests(spark):
    rng = random.Random(7)
    documents = []
    for number in range(200):
        events = [random_event(rng) for _ in range(rng.randrange(0, 8))]
        documents.append(events if number % 5 else (events or [{}])[0])
    requests = spark.createDataFrame(
        [(i, json.dumps(d, ensure_ascii=bool(i % 2))) for i, d in enumerate(documents)], "request_id bigint, payload string")
    alerts = analyze_payloads(requests).cache()
    got = {(r.request_id, r.pos): r for r in alerts.collect()}
    wanted = {(i, p): e for i, d in enumerate(documents) for p, e in enumerate(d if isinstance(d, list) else [d])}
    assert got.keys() == wanted.keys()
    for place, event in wanted.items():
        row = got[place]
        assert (row.user, row.action, row.src_ip, row.result, row.risk_score, len(row.reasons)) == expected(event), event
        assert json.loads(row.raw_event) == event
        assert 0 <= row.risk_score <= 100
    order = {}
    for r in reports.ranked_alerts(alerts).orderBy("request_id", "t").collect():
        order.setdefault(r.request_id, []).append(r.pos)
    for request, positions in order.items():
        scores = [got[request, p].risk_score for p in range(len(positions))]
        assert positions == sorted(range(len(scores)), key=lambda p: -scores[p])
    tops = {r.request_id: r.top_pos for r in reports.request_summary(alerts).collect()}
    assert tops == {request: positions[0] for request, positions in order.items()}


def test_trend_reads_only_the_days_of_the_span(spark, sf, tmp_path):
    fact, path = catalog.wh_fact(spark, sf), str(tmp_path / "fact")
    fact.withColumn("dt", F.to_date("event_ts")).write.partitionBy("dt").parquet(path)
    as_of = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    stored = reports.trend_since(spark.read.parquet(path), "7d", as_of)
    assert sorted(map(str, stored.collect())) == sorted(map(str, reports.trend_since(fact, "7d", as_of).collect()))
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*dt", plan)


def test_valid_and_quarantined_add_up(spark, sf):
    report = catalog.QUERIES["validation_report"](spark, sf)
    counts = {r.is_valid: r["count"] for r in report.groupBy("is_valid").count().collect()}
    assert sum(counts.values()) == spark.read.parquet(f"{sf}/events.parquet").count() and len(counts) == 2
