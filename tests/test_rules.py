"""Rule tables: same as built in, checked, versioned, in order."""

import pytest
from pyspark.sql import functions as F

from idsignal.functions import rules
from idsignal.functions.risk import with_risk
from idsignal.functions.rules import BUILT_IN, Rule

ROWS = [("DeleteTrail", "FAILED", "8.8.8.8"), ("ListUsers", "SUCCESS", "10.0.0.1"), (None, None, None), ("ConsoleLogin", "FAILED", "unknown")]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, "action string, result string, src_ip string")


def test_a_written_table_gives_the_rules_again(spark, events, tmp_path):
    path = str(tmp_path / "rules")
    rules.as_table(spark, BUILT_IN, 1).unionByName(rules.as_table(spark, BUILT_IN[:2], 2)).write.parquet(path)
    table = spark.read.parquet(path)
    assert rules.from_table(table) == BUILT_IN[:2] and rules.from_table(table, 1, events.columns) == BUILT_IN
    assert with_risk(events, by=rules.from_table(table, 1)).collect() == with_risk(events).collect()
    with pytest.raises(ValueError, match="no such version"):
        rules.from_table(table, 3)


def test_reasons_follow_the_order_of_the_rules(events):
    turned = with_risk(events, by=BUILT_IN[::-1]).collect()
    plain = with_risk(events).collect()
    assert [r.reasons for r in turned] == [r.reasons[::-1] for r in plain]
    assert [r.risk_score for r in turned] == [r.risk_score for r in plain]
    assert plain[2].risk_score == 0 and plain[2].reasons == []


def test_no_rules_at_all(events):
    assert {(r.risk_score, tuple(r.reasons)) for r in with_risk(events, by=[]).collect()} == {(0, ())}


@pytest.mark.parametrize("rule, message", [
    (Rule("a", "action", "like", 1, "x", ("y",)), "operator"), (Rule("a", "action", "in", 1, "x"), "values"),
    (Rule("a", "src_ip", "outside", 1, "x", ("y",)), "values"), (Rule("a", "action", "in", -1, "x", ("y",)), "points"),
    (Rule("a", "none", "in", 1, "x", ("y",)), "no column 'none'"), (Rule("a", "action", "in", 1, "x", ("y",), "gone"), "no column 'gone'"),
    (Rule("", "action", "in", 1, "x", ("y",)), "name"), (Rule("a", "action", "in", 1, None, ("y",)), "reason")])
def test_bad_rules_are_refused(events, rule, message):
    with pytest.raises(ValueError, match=message):
        with_risk(events, by=[rule])


def test_two_rules_of_one_name_and_too_many(events):
    with pytest.raises(ValueError, match="used twice"):
        rules.checked([BUILT_IN[0], BUILT_IN[0]])
    with pytest.raises(ValueError, match="more than"):
        rules.checked([Rule(f"r{i}", "action", "in", 1, "x", ("y",)) for i in range(rules.MAX_RULES + 1)])


def test_operators(spark):
    df = spark.createDataFrame([("abc",), ("xbc",), (None,)], "f string")
    fired = {op: [bool(r[0]) for r in df.select(F.coalesce(rules.fires(Rule("r", "f", op, 1, "", values)), F.lit(False))).collect()]
             for op, values in [("in", ("abc",)), ("not in", ("abc",)), ("starts with", ("ab", "zz")), ("contains", ("xb", "q"))]}
    assert fired == {"in": [True, False, False], "not in": [False, True, False], "starts with": [True, False, False], "contains": [False, True, False]}
