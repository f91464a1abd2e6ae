"""The warehouse run from flat logs to reports."""

from pyspark.sql import functions as F

from idsignal.operators import reports
from idsignal.plans import batch, catalog, fixtures as fx
from idsignal.sources import sinks


def test_two_runs_and_reports(spark, sf, tmp_path):
    base = str(tmp_path / "warehouse")
    logs = catalog.flat_logs(spark, sf)
    reputation = fx.derive(spark, sf, fx.IP_REPUTATION)
    split = F.lit("2024-01-20").cast("timestamp_ntz")
    late = F.coalesce(F.col("event_ts") >= split, F.lit(False))
    first = batch.run(logs.where(~late), reputation, base, "r1")
    second = batch.run(logs.where(late), reputation, base, "r2")
    assert first.count() + second.count() == logs.count()
    assert {"ml_score", "ti_asn", "final_score", "final_priority"} <= set(second.columns)
    assert second.where("ti_score is null or final_score not between 0 and 100").isEmpty()

    fact, users = (spark.read.parquet(f"{base}/star/{name}") for name in ("enriched_logs", "users"))
    actions, ips = spark.read.parquet(f"{base}/star/actions"), sinks.read_ip_details(spark, f"{base}/star")
    whole = logs.dropna(subset=["user", "action", "src_ip"])
    assert fact.count() == whole.count()
    named = fact.join(users, "user_id").join(actions, "action_id").join(ips, "ip_id")
    got = named.select("id", F.col("username").alias("user"), F.col("action_name").alias("action"), "src_ip")
    assert got.exceptAll(whole.select("id", "user", "action", "src_ip")).isEmpty()

    feed = reports.alerts_feed(fact, users, actions, ips).collect()
    assert len(feed) == 100 and all(r.src_ip != "—" for r in feed)
    stats = reports.warehouse_stats(fact).first()
    assert stats.total_alerts == fact.count() and stats.unique_users == users.count()
