"""Skew-safe joins, numbering, upserts, metrics, scaling against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from idsignal.operators import anomaly, enrich, lookup, metrics, numbering, reports, scaling, warehouse
from idsignal.sources import files, sinks
from idsignal import schemas


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 rows: one key holds a third, one tenth have none, the rest is spread."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 500))
    return spark.range(3000).withColumn("key", key)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_plain_join(spark, skewed, how):
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 400)], "key string, value int")
    salted = lookup.salted_join(skewed, table, "key", "id", how, share=0.05, salts=16)
    plain = skewed.join(table, "key", how)
    assert sorted(map(str, salted.select("id", "key", "value").collect())) == sorted(map(str, plain.select("id", "key", "value").collect()))


def test_hot_keys_are_few_and_right(skewed):
    assert [r.key for r in lookup.hot_keys(skewed, "key", 0.05).collect()] == ["hot"]


def test_salting_spreads_hot_and_null_keys(spark, skewed, monkeypatch):
    """With AQE off the join runs in as many tasks as there are partitions; no task holds the hot key alone."""
    monkeypatch.setattr(lookup, "measured_bytes", lambda table: lookup.BROADCAST_BYTES + 1)
    table = spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, value int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup.lookup(skewed, table, "key", "id").withColumn("task", F.spark_partition_id())
        for key in (F.col("key") == "hot", F.col("key").isNull()):
            parts = joined.where(key).groupBy("task").count().collect()
            assert len(parts) == 8
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_size_check(spark):
    table = spark.createDataFrame([("a" * 100,)] * 10, "key string")
    assert lookup.measured_bytes(table) == 10 * 116
    assert lookup.fits_broadcast(table, 1160) and not lookup.fits_broadcast(table, 1159)


def test_lookup_beyond_the_limit_gives_the_same_rows(spark, skewed, monkeypatch):
    table = spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, value int")
    small = lookup.lookup(skewed, table, "key", "id").agg(F.count("value"), F.count("*")).first()
    monkeypatch.setattr(lookup, "fits_broadcast", lambda table: False)
    assert lookup.lookup(skewed, table, "key", "id").agg(F.count("value"), F.count("*")).first() == small


def test_dense_ids_are_unique_and_consecutive(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    ids = sorted(r.n for r in numbering.dense_ids(keys, "key", "n", 10).collect())
    assert ids == list(range(11, 5011))


def test_group_ordinals_in_small_chunks(spark):
    rng = random.Random(1)
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else "cold", rng.choice([0, 15, 95]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, level int, pos bigint")
    got = {r.pos: r.t for r in numbering.group_ordinals(df, "g", "level", "pos", "t", chunk=40).collect()}
    assert len(got) == 500
    for group in (None, "hot", "cold"):
        members = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in members] == list(range(1, len(members) + 1))


def ip_table(spark, rows):
    return spark.createDataFrame(rows, "ip_id bigint, src_ip string, country string, ti_score int")


def test_upserts(spark):
    existing = ip_table(spark, [(1, "1.1.1.1", "US", 3), (2, "2.2.2.2", "IN", 6)])
    incoming = spark.createDataFrame([("2.2.2.2", None, 8), ("3.3.3.3", "DE", None)], "src_ip string, country string, ti_score int")
    kept = warehouse.insert_if_absent(existing, incoming, "src_ip", "ip_id").orderBy("ip_id").collect()
    assert [tuple(r) for r in kept] == [(1, "1.1.1.1", "US", 3), (2, "2.2.2.2", "IN", 6), (3, "3.3.3.3", "DE", None)]
    updated = warehouse.upsert(existing, incoming, "src_ip", "ip_id").orderBy("ip_id").collect()
    assert [tuple(r) for r in updated] == [(1, "1.1.1.1", "US", 3), (2, "2.2.2.2", None, 8), (3, "3.3.3.3", "DE", None)]


def star_logs(spark, ids):
    rows = [(i, f"2024-01-{i % 5 + 1:02d} 00:00:00" if i % 7 else None, f"u{i % 3}", f"a{i % 2}", f"10.0.0.{i % 4}", "US", i, "OK", False, 0.5, "LOW")
            for i in ids]
    return spark.createDataFrame(rows, "id bigint, t string, user string, action string, src_ip string, country string, ti_score int, "
                                 "result string, result_flag boolean, alert_score double, prelim_priority string").withColumn(
        "event_ts", F.col("t").cast("timestamp_ntz")).drop("t")


def test_star_load_is_idempotent(spark, tmp_path):
    base = str(tmp_path / "star")
    sinks.load_star(star_logs(spark, range(20)), base)
    sinks.load_star(star_logs(spark, range(20)), base)
    sinks.load_star(star_logs(spark, range(10, 40)), base)
    fact = spark.read.parquet(f"{base}/enriched_logs")
    assert sorted(r.id for r in fact.select("id").collect()) == list(range(40))
    users = spark.read.parquet(f"{base}/users").collect()
    assert sorted(r.username for r in users) == ["u0", "u1", "u2"] and len({r.user_id for r in users}) == 3
    ips = sinks.read_ip_details(spark, base).collect()
    assert len(ips) == 4 and {r.version for r in ips} == {2}
    assert {r.src_ip: r.ti_score for r in ips}["10.0.0.2"] == 10
    report = warehouse.constraint_report(fact, spark.read.parquet(f"{base}/users"), spark.read.parquet(f"{base}/actions"),
                                         sinks.read_ip_details(spark, base))
    assert report.agg(F.sum("violations")).first()[0] == 0


def test_csv_by_header_name(spark, tmp_path):
    path = str(tmp_path / "extract.csv")
    with open(path, "w") as f:
        f.write('eventName,eventTime,extra,userIdentityuserName\nX,2024-01-01 00:00:00,q,"a,b"\nY,short\nZ,t,q,u,too,many\n')
    rows = {r.eventName: r for r in files.read_csv(spark, path, schemas.CSV_EXTRACT).cache().collect()}
    assert [f.name for f in schemas.CSV_EXTRACT.fields] + ["_corrupt_record"] == list(rows["X"].asDict())
    assert (rows["X"].eventTime, rows["X"].userIdentityuserName, rows["X"].sourceIPAddress) == ("2024-01-01 00:00:00", "a,b", None)
    assert (rows["Y"].eventTime, rows["Y"].userIdentityuserName, rows["Y"]._corrupt_record) == ("short", None, None)
    assert rows["Z"]._corrupt_record == "Z,t,q,u,too,many"
    out = str(tmp_path / "out")
    good = files.read_csv(spark, path, schemas.CSV_EXTRACT).drop("_corrupt_record")
    sinks.write_csv(good, out)
    assert files.read_csv(spark, out, schemas.CSV_EXTRACT).count() == 3
    with pytest.raises(Exception):
        sinks.write_csv(good, out)


def test_star_load_stores_each_id_once(spark, tmp_path):
    base = str(tmp_path / "star")
    logs = star_logs(spark, range(1, 37))
    sinks.load_star(logs.unionByName(logs), base)
    sinks.load_star(logs.withColumn("event_ts", F.col("event_ts") + F.expr("interval 60 days")), base)
    fact = spark.read.parquet(f"{base}/enriched_logs")
    assert sorted(r.id for r in fact.select("id").collect()) == list(range(1, 37))
    assert {r.version for r in sinks.read_ip_details(spark, base).collect()} == {1}  # nothing changed, nothing rewritten


def test_means_keep_small_and_large_scores(spark):
    rows = spark.createDataFrame([("a", 1e-7), ("a", 3e-7), ("b", 1e13), ("c", 0.125), ("d", float("nan")), ("e", 0.375)],
                                 "src_ip string, alert_score double").withColumn("user", F.col("src_ip")).withColumn("prelim_priority", F.lit("LOW"))
    means = {r.src_ip: r.mean_score for r in reports.top_risky_ips(rows).collect()}
    assert means["a"] == 2e-7 and means["b"] == 1e13
    texts = {r.ip: r.finding for r in reports.top_findings(rows).where("ip is not null").collect()}
    assert texts["c"].endswith(" 0.12") and texts["e"].endswith(" 0.38")


def test_empty_fact_counts_zero(spark):
    fact = spark.createDataFrame([], "id bigint, user_id bigint, alert_score double, prelim_priority string")
    users = spark.createDataFrame([], "user_id bigint, username string")
    row = reports.stats_by_username(fact, users).first()
    assert (row.total_alerts, row.critical_alerts, row.unique_users, row.avg_risk_score) == (0, 0, 0, None)


def test_repeated_reputation_counts_once(spark):
    logs = spark.createDataFrame([(1, "9.9.9.9")], "id bigint, src_ip string")
    table = spark.createDataFrame([("9.9.9.9", 5, "US", "A"), ("9.9.9.9", 95, "DE", "B"), (None, 1, "X", "C")],
                                  "ip string, abuse_confidence int, country string, asn string")
    rows = enrich.enrich(logs, table, "id").collect()
    assert [(r.ti_score, r.ti_country) for r in rows] == [(10, "DE")]


def test_latest_rows_shuffle_no_dimension(spark):
    fact = spark.range(1000).selectExpr("id", "id % 50 as user_id", "id / 1000 as alert_score", "'LOW' as prelim_priority", "'US' as ti_country")
    users = spark.range(500).selectExpr("id as user_id", "concat('u', id) as username")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = reports.agentic_insights(fact, users)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan


def test_missing_table_raises(spark, tmp_path):
    with pytest.raises(Exception):
        files.read_table(spark, str(tmp_path / "none")).count()


def test_lower_names(spark):
    assert files.lower_names(spark.range(1).select(F.col("id").alias("ID"), F.lit(1).alias("Xy"))).columns == ["id", "xy"]


def test_metrics(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 0)] + [(2, 0)] * 2
    df = spark.createDataFrame(pairs, "y int, p int")
    rows = {r["class"]: r for r in metrics.classification_report(df, "y", "p").collect()}
    assert rows["0"].precision == pytest.approx(5 / 8) and rows["0"].recall == pytest.approx(5 / 7)
    assert (rows["2"].precision, rows["2"].recall, rows["2"].f1, rows["2"].support) == (0.0, 0.0, 0.0, 2)
    assert rows["accuracy"].f1 == pytest.approx(8 / 13) and rows["accuracy"].support == 13
    assert rows["macro avg"].recall == pytest.approx((5 / 7 + 3 / 4 + 0) / 3)
    assert rows["weighted avg"].recall == pytest.approx(8 / 13)


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (2.0, 5.0)], "a double, b double")
    rows = scaling.scale_columns(df, ["a", "b"]).collect()
    assert [r.a_scaled for r in rows] == [0.0, 1.0, 0.5] and {r.b_scaled for r in rows} == {0.0}
    norm = [r.n for r in scaling.normalize(df, "a", "n").collect()]
    assert norm[0] == 0.0 and norm[1] == pytest.approx(1.0) and math.isclose(norm[2], 0.5, abs_tol=1e-6)


def test_one_hot_of_unseen_action_has_no_flag(spark):
    train = spark.createDataFrame([("A",), ("OTHER",)], "action_top string")
    rows = spark.createDataFrame([(1, "A"), (2, "B"), (3, "OTHER")], "id bigint, action_top string")
    out = anomaly.one_hot(rows, anomaly.action_vocabulary(train), "id").orderBy("id").collect()
    assert [r.hot_feature for r in out] == ["action_A", None, "action_OTHER"]


def test_vocabulary_is_kept_once_saved(spark, tmp_path):
    path = str(tmp_path / "vocabulary")
    first = spark.createDataFrame([("A",), ("A",)], "action_top string")
    later = spark.createDataFrame([("B",)], "action_top string")
    assert [r.action_top for r in anomaly.load_or_fit_vocabulary(path, first).collect()] == ["A"]
    assert [r.action_top for r in anomaly.load_or_fit_vocabulary(path, later).collect()] == ["A"]


def test_reputation_and_alert_tables(spark, tmp_path):
    ips, alerts = str(tmp_path / "ips"), str(tmp_path / "alerts")
    sinks.write_parquet(spark.createDataFrame([("1.1.1.1", 90, "US", "AS1")], schemas.REPUTATION), ips)
    rows = spark.createDataFrame([(1, "1.1.1.1"), (2, None), (3, "9.9")], "id bigint, src_ip string")
    out = enrich.enrich(rows, files.read_reputation(spark, ips), "id").orderBy("id").collect()
    assert [(r.src_ip, r.ti_score, r.ti_country, r.ti_asn) for r in out] == [
        ("1.1.1.1", 10, "US", "AS1"), (None, 1, "NA", "NA"), ("9.9.0.0", 1, "NA", "NA")]
    alert = (7, None, "1.1.1.1", "u", "UNKNOWN", "LOW", 15, None, "OPEN")
    for _ in range(2):
        sinks.append_parquet(spark.createDataFrame([alert], schemas.ALERTS), alerts)
    assert [tuple(r) for r in files.alert_store(spark, alerts).collect()] == [alert, alert]


def test_rows_without_an_id_are_stored_once_each(spark, tmp_path):
    base = str(tmp_path / "star")
    given = star_logs(spark, [0, 0, 1, 2, 0]).withColumn("user", F.lit("u")).unionByName(star_logs(spark, [0]).withColumn("user", F.lit("v")))
    logs = given.withColumn("id", F.when(F.col("id") > 0, F.col("id")))
    for _ in range(2):
        sinks.load_star(logs, base)
    fact = spark.read.parquet(f"{base}/enriched_logs")
    ids = [r.id for r in fact.collect()]
    assert len(ids) == len(set(ids)) == 6 and sorted(i for i in ids if i > 0) == [1, 2]
    assert fact.join(spark.read.parquet(f"{base}/users"), "user_id").groupBy("username").count().orderBy("username").collect() == [("u", 5), ("v", 1)]


def test_ids_without_an_id_tell_equal_rows_apart(spark):
    rows = spark.createDataFrame([(None, "a", None), (None, None, "a"), (None, "a", None), (7, "a", None)], "id bigint, x string, y string")
    made = warehouse.with_ids(rows).collect()
    assert len({r.id for r in made}) == 4 and sum(r.id < 0 for r in made) == 3
    assert sorted(map(str, made)) == sorted(map(str, warehouse.with_ids(rows.repartition(3)).collect()))


def test_versions_of_addresses(spark, tmp_path):
    base = str(tmp_path / "star")
    for n in range(20):  # each load changes one address more
        sinks.ip_details(spark, base).append(
            spark.createDataFrame([(1, "1.1.1.1", "US", n, n + 1), (n + 2, f"2.2.2.{n}", "IN", 0, n + 1)], sinks.VERSIONED_IPS), n + 1)
        sinks.StreamTable(spark, f"{base}/ip_history", sinks.VERSIONED_IPS).append(
            spark.createDataFrame([(1, "1.1.1.1", "US", n, n + 1), (n + 2, f"2.2.2.{n}", "IN", 0, n + 1)], sinks.VERSIONED_IPS), n + 1)
    assert sinks.ip_details(spark, base).compact() == 1 and len(sinks.ip_details(spark, base).live()[1]) == 5
    now = {r.ip_id: r for r in sinks.read_ip_details(spark, base).collect()}
    assert len(now) == 21 and (now[1].ti_score, now[1].version) == (19, 20)
    then = {r.ip_id: r.ti_score for r in sinks.ip_details_at(spark, base, 5).collect()}
    assert then == {1: 4, **{n: 0 for n in range(2, 7)}}
