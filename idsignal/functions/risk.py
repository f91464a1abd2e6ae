"""Rule score, priority and reasons of one event, all in plain columns."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from idsignal import fixed_values as fv
from idsignal.functions import rules
from idsignal.functions.rules import BUILT_IN, Rule


def _facts(action: Column, result: Column, src_ip: Column):
    return {"action": action, "result": result, "src_ip": src_ip}.__getitem__


def risk_score(action: Column, result: Column, src_ip: Column, rfc1918: bool = False) -> Column:
    return rules.score(BUILT_IN, _facts(action, result, src_ip), rfc1918)


def risk_reasons(action: Column, result: Column, src_ip: Column, rfc1918: bool = False) -> Column:
    return rules.reasons(BUILT_IN, _facts(action, result, src_ip), rfc1918)


def priority(score: Column) -> Column:
    name, floor = fv.PRIORITY_FLOORS[0]
    level = F.when(score >= floor, name)
    for name, floor in fv.PRIORITY_FLOORS[1:]:
        level = level.when(score >= floor, name)
    return level.otherwise(fv.LOWEST_PRIORITY)


def with_risk(events: DataFrame, rfc1918: bool = False, by: Sequence[Rule] = BUILT_IN) -> DataFrame:
    """Add risk_score, priority and reasons to rows that have the columns the rules test (action, result and src_ip)."""
    known = rules.checked(by, events.columns)
    return (
        events
        .withColumn("risk_score", rules.score(known, F.col, rfc1918))
        .withColumn("priority", priority(F.col("risk_score")))
        .withColumn("reasons", rules.reasons(known, F.col, rfc1918))
    )
