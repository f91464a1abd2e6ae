"""Every registered query against its SQL, plus what SQL cannot say about the rest."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from idsignal.operators import lookup
from idsignal.plans import catalog

QUERIES, ORACLES = dict(catalog.QUERIES), dict(catalog.ORACLES)


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", ["star_fact", "star_fact_strict", "ti_enrich", "anomaly_features", "risk_trend", "star_load"])
def test_query_without_any_broadcast(spark, sf, con, name, monkeypatch):
    """The plans for dimensions too large to broadcast give the same rows."""
    monkeypatch.setattr(lookup, "fits_broadcast", lambda table: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert difference(QUERIES[name](spark, sf), con, ORACLES[name]) is None
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_entry_gives_the_hundred_riskiest(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 100
    assert [r.risk_score for r in rows] == sorted((r.risk_score for r in rows), reverse=True)


def test_only_models_have_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"fusion_ml_final", "fusion_held_out", "fusion_model_preview"}
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_every_query():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_severity_counts_add_up(spark, sf):
    counts = QUERIES["severity_breakdown"](spark, sf).collect()
    assert sum(r.v for r in counts) == spark.read.parquet(f"{sf}/events.parquet").count()
    assert {r.name for r in counts} == {"CRITICAL", "HIGH", "MEDIUM", "LOW"}
