"""Chains of operators for the two ways events come in."""

from pyspark.sql import Column, DataFrame, functions as F

from idsignal import schemas
from idsignal.functions.explain import with_explanation
from idsignal.functions.risk import priority, risk_score, with_risk
from idsignal.operators.events import parse_events
from idsignal.sources.lines import normalize_lines
from idsignal.sources.payloads import event_fields, scan_elements


def analyze_events(events: DataFrame) -> DataFrame:
    """Audit columns to scored, explained alerts."""
    return with_explanation(with_risk(parse_events(events)))


def analyze_payloads(requests: DataFrame, keep_raw: bool = True) -> DataFrame:
    """(request_id, payload) rows to scored, explained alerts in payload order."""
    return analyze_events(event_fields(scan_elements(requests, keep_raw)))


def line_alerts(lines: DataFrame, id_column: Column, timestamp: Column, auth_rule: bool = False) -> DataFrame:
    """Raw lines to alert-store rows. Lines carry no action or result, so only the address scores."""
    seen = normalize_lines(lines, auth_rule)
    score = risk_score(F.lit(""), F.lit(""), F.col("src_ip"))
    return alert_rows(seen.withColumn("risk_score", score), id_column, timestamp, F.col("event_type"))


def alert_rows(scored: DataFrame, id_column: Column, timestamp: Column, event_type: Column) -> DataFrame:
    """Alert-store rows: severity is the priority, status starts OPEN."""
    values = {
        "id": id_column, "timestamp": timestamp, "src_ip": F.col("src_ip"), "user": F.col("user"),
        "event_type": event_type, "severity": priority(F.col("risk_score")), "risk_score": F.col("risk_score"),
        "ai_reasoning": F.lit(None), "status": F.lit("OPEN"),
    }
    return scored.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in schemas.ALERTS.fields])


def raw_landing(lines: DataFrame, created_at: Column, id_column: Column) -> DataFrame:
    """Landing rows: the line, its normalised form as JSON, not yet processed."""
    seen = normalize_lines(lines)
    normalized = F.to_json(F.struct("event_type", "src_ip", F.col("raw_log").alias("raw")))
    return seen.select(
        id_column.alias("id"), "raw_log", normalized.alias("normalized"),
        F.lit(False).alias("processed"), created_at.alias("created_at"),
    )
