"""Scoring rules as data: a small, checked, versioned table that becomes plain columns.

A rule names a field, how it is tested, the values it is tested against, what it is worth and the
reason it gives; reasons are listed in the order of the rules. The built-in rules are one such list
(`BUILT_IN`), so a changed table needs no change of code.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from idsignal import fixed_values as fv
from idsignal.functions.ip import is_internal

MAX_RULES = 500  # a rule becomes a piece of every row's expression
SCHEMA = "version int, place int, name string, field string, operator string, values array<string>, points int, reason string, append string"


@dataclass(frozen=True)
class Rule:
    """`append` names a column whose value follows the reason; `values` is empty for an operator that takes none."""

    name: str
    field: str
    operator: str
    points: int
    reason: str
    values: tuple[str, ...] = ()
    append: str | None = None


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


OPERATORS: dict[str, Callable[[Column, tuple[str, ...], bool], Column]] = {
    "in": lambda c, values, _: c.isin(list(values)),
    "not in": lambda c, values, _: ~c.isin(list(values)),
    "starts with": lambda c, values, _: _any([c.startswith(v) for v in values]),
    "contains": lambda c, values, _: _any([c.contains(v) for v in values]),
    "outside": lambda c, _, rfc1918: (c != fv.UNKNOWN) & ~is_internal(c, rfc1918),
}
WITHOUT_VALUES = {"outside"}

BUILT_IN = [
    Rule("sensitive action", "action", "in", fv.SENSITIVE_POINTS, fv.SENSITIVE_REASON, tuple(fv.SENSITIVE_ACTIONS), "action"),
    Rule("elevated action", "action", "in", fv.ELEVATED_POINTS, fv.ELEVATED_REASON, tuple(fv.ELEVATED_ACTIONS), "action"),
    Rule("failure", "result", "in", fv.FAILURE_POINTS, fv.FAILURE_REASON, ("FAILED",)),
    Rule("external address", "src_ip", "outside", fv.EXTERNAL_POINTS, fv.EXTERNAL_REASON, (), "src_ip"),
    Rule("tampering", "action", "in", fv.TAMPERING_POINTS, fv.TAMPERING_REASON, tuple(fv.TAMPERING_ACTIONS)),
]


def problems(rules: Sequence[Rule], columns: Sequence[str] | None = None) -> list[str]:
    """What is wrong with a list of rules, `columns` being those of the rows they are for."""
    found = [f"more than {MAX_RULES} rules"] if len(rules) > MAX_RULES else []
    names = [r.name for r in rules]
    for rule in rules:
        wrong = []
        if not rule.name or names.count(rule.name) > 1:
            wrong.append("its name is empty or used twice")
        if rule.operator not in OPERATORS:
            wrong.append(f"unknown operator {rule.operator!r}")
        elif bool(rule.values) == (rule.operator in WITHOUT_VALUES) or None in rule.values:
            wrong.append("its values do not fit the operator")
        if rule.points is None or rule.points < 0:
            wrong.append("its points are missing or negative")
        if rule.reason is None:
            wrong.append("it has no reason")
        if columns is not None:
            wrong += [f"no column {c!r}" for c in dict.fromkeys([rule.field, rule.append]) if c is not None and c not in columns]
        found += [f"rule {rule.name!r}: {text}" for text in wrong]
    return found


def checked(rules: Sequence[Rule], columns: Sequence[str] | None = None) -> list[Rule]:
    wrong = problems(rules, columns)
    if wrong:
        raise ValueError("; ".join(wrong))
    return list(rules)


def score(rules: Sequence[Rule], facts: Callable[[str], Column] = F.col, rfc1918: bool = False) -> Column:
    """Points of the rules that fire, at most `RISK_CAP`; a null field fires none."""
    total = reduce(lambda a, b: a + b, [F.when(fires(r, facts, rfc1918), r.points).otherwise(0) for r in rules], F.lit(0))
    return F.least(total, F.lit(fv.RISK_CAP))


def reasons(rules: Sequence[Rule], facts: Callable[[str], Column] = F.col, rfc1918: bool = False) -> Column:
    said = [F.lit(r.reason) if r.append is None else F.concat(F.lit(r.reason), facts(r.append)) for r in rules]
    return F.array_compact(F.array(*[F.when(fires(r, facts, rfc1918), text) for r, text in zip(rules, said)]).cast("array<string>"))


def fires(rule: Rule, facts: Callable[[str], Column] = F.col, rfc1918: bool = False) -> Column:
    return OPERATORS[rule.operator](facts(rule.field), rule.values, rfc1918)


def as_table(spark: SparkSession, rules: Sequence[Rule], version: int) -> DataFrame:
    rows = [Row(version, i, r.name, r.field, r.operator, list(r.values), r.points, r.reason, r.append) for i, r in enumerate(checked(rules))]
    return spark.createDataFrame(rows, SCHEMA)


def from_table(table: DataFrame, version: int | None = None, columns: Sequence[str] | None = None) -> list[Rule]:
    """The checked rules of one version of a rule table, by default its newest one."""
    known = table if version is None else table.where(F.col("version") == version)
    newest = known.agg(F.max("version")).scalar()
    rows = known.where(F.col("version") == newest).orderBy("place", "name").limit(MAX_RULES + 1).collect()
    if not rows:
        raise ValueError("the rule table has no such version")
    return checked([Rule(r["name"], r["field"], r["operator"], r["points"], r["reason"], tuple(r["values"] or ()), r["append"]) for r in rows], columns)
