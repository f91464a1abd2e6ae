"""Anomaly forest and fusion classifier: repeatable, bounded, and useful."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from idsignal.operators import anomaly, fusion
from idsignal.plans import catalog
from idsignal.workspace import stage


@pytest.fixture(scope="module")
def logs(spark):
    """2000 ordinary rows and five far outliers."""
    odd = F.col("id") >= 2000
    return spark.range(2005).select(
        "id",
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 40 * 600).alias("event_ts"),
        F.when(odd, "StopLogging").when(F.col("id") % 2 == 0, "ListUsers").otherwise("GetObject").alias("action"),
        F.when(odd, 9000.0).otherwise((F.col("id") % 17).cast("double")).alias("final_risk_score"),
        F.when(odd, 10).otherwise(F.col("id") % 3).alias("ti_score"),
    )


def test_outliers_score_highest_and_runs_repeat(spark, logs):
    featured = anomaly.features(logs)
    runs = []
    for _ in range(2):
        forest = stage(anomaly.train_forest(featured, "id", trees=40), "forest")
        scored = anomaly.anomaly_scores(featured, forest, keep=["id"])
        runs.append({r.id: r.ml_score for r in scored.collect()})
    assert runs[0] == runs[1]
    top = sorted(runs[0], key=runs[0].get, reverse=True)[:5]
    assert set(top) == set(range(2000, 2005))
    assert min(runs[0].values()) == 0.0 and 0.99 < max(runs[0].values()) <= 1.0


def test_samples_have_the_asked_size(spark, logs):
    samples = anomaly.tree_samples(anomaly.features(logs), "id", trees=30, sample=64)
    sizes = samples.groupBy("tree_id").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d")).collect()
    assert len(sizes) == 30 and all(r.n == r.d == 64 for r in sizes)


def test_pool_is_bounded_on_larger_tables(spark):
    rows = anomaly.features(spark.range(200000).select(
        "id", F.lit(None).cast("timestamp").alias("event_ts"), F.lit("a").alias("action"),
        (F.col("id") % 100).alias("final_risk_score"), F.lit(0).alias("ti_score")))
    samples = anomaly.tree_samples(rows, "id", trees=10, sample=32).groupBy("tree_id").count().collect()
    assert len(samples) == 10 and {r["count"] for r in samples} == {32}


def test_scoring_equals_a_row_by_row_walk(spark, logs):
    featured = anomaly.features(logs)
    forest = stage(anomaly.train_forest(featured, "id", trees=5, sample=32), "forest")
    nodes = {(r.tree_id, r.node_id): r for r in forest.collect()}
    got = anomaly.raw_scores(featured, forest).orderBy("id").limit(50).collect()
    for row in got:
        total = 0.0
        for tree in range(1, 6):
            node = nodes[tree, 0]
            while node.feature >= 0:
                right = row.action_top == node.category if node.feature == anomaly.ACTION_SPLIT else (
                    row[anomaly.NUMERIC[node.feature]] > node.threshold)
                node = nodes[tree, node.right_id if right else node.left_id]
            total += node.path_length
        assert row.raw_score == pytest.approx(2 ** (-total / 5 / float(anomaly.mean_path(32))))


def test_mean_path():
    assert list(anomaly.mean_path([0, 1, 2])) == [0.0, 0.0, 1.0]
    assert anomaly.mean_path(256) == pytest.approx(2 * (np.log(255) + np.euler_gamma) - 2 * 255 / 256)


def test_forest_is_loaded_once_saved(spark, logs, tmp_path):
    path, featured = str(tmp_path / "forest"), anomaly.features(logs)
    first = anomaly.load_or_train(path, featured, "id", trees=3, sample=16).collect()
    again = anomaly.load_or_train(path, featured, "id", trees=9, sample=16).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_fusion(spark, sf, tmp_path):
    featured = fusion.fusion_features(catalog.flat_logs(spark, sf))
    path = str(tmp_path / "fusion")
    model = fusion.load_or_train(path, featured, "id", trees=10)
    rows = fusion.final_scores(featured, model).collect()
    assert len(rows) == featured.count()
    assert all(0 <= r.final_score <= 100 and 0 <= r.p_high <= 1 for r in rows)
    assert {r.final_priority for r in rows} <= {"LOW", "MEDIUM", "HIGH", "CRITICAL"}
    shown = fusion.preview(fusion.final_scores(featured.withColumn("timestamp", F.col("event_ts")), model), "id").collect()
    assert len(shown) == 10 and shown[0].asDict().keys() == {"timestamp", "user", "src_ip", "final_priority"}
    loaded = fusion.load_or_train(path, featured, "id", trees=10)
    assert {r.id: r.final_score for r in fusion.final_scores(featured, loaded).collect()} == {r.id: r.final_score for r in rows}


def test_fusion_repeats_and_reports_the_largest_probability(spark, sf):
    featured = stage(fusion.fusion_features(catalog.flat_logs(spark, sf)), "features")
    runs = []
    for _ in range(2):
        model = fusion.train(featured, "id", trees=5)
        runs.append({r.id: r.final_score for r in fusion.final_scores(featured, model).collect()})
    assert runs[0] == runs[1]
    for row in model.transform(featured).select("id", "probability").collect():
        assert abs(runs[0][row.id] - 100 * max(row.probability)) <= 0.005001


def test_report_covers_the_held_out_part(spark, sf):
    featured = fusion.fusion_features(catalog.flat_logs(spark, sf))
    model = fusion.train(featured, "id", trees=5)
    rows = {r["class"]: r for r in fusion.held_out_report(featured, model, "id").collect()}
    assert rows["accuracy"].support == featured.where(fusion.is_held_out("id")).count()
    assert 0 < rows["accuracy"].f1 <= 1 and set("0123") <= set(rows)


def test_split_is_four_to_one(spark):
    held = spark.range(20000).where(fusion.is_held_out("id")).count()
    assert 3700 < held < 4300


def test_fusion_does_not_depend_on_partitions(spark):
    import random

    from idsignal.operators import fusion
    draw = random.Random(4)
    rows = [(i, draw.random(), float(draw.randint(0, 9)), draw.random(), draw.random() < 0.3, draw.choice(["LOW", "MEDIUM", "HIGH", "CRITICAL"]))
            for i in range(600)]
    logs = spark.createDataFrame(rows, "id long, alert_score double, ti_score double, ip_score double, result_flag boolean, prelim_priority string")
    scores = []
    for parts in (3, 7):
        featured = fusion.fusion_features(logs.repartition(parts))
        model = fusion.train(featured, "id", trees=5)
        scores.append({r.id: r.final_score for r in fusion.final_scores(featured, model).collect()})
    assert scores[0] == scores[1]


def test_fusion_ranges_are_kept_with_the_model(spark, tmp_path):
    from idsignal.operators import fusion
    logs = spark.range(100).selectExpr("id", "id / 100 as alert_score", "5.0 as ti_score", "id / 50 as ip_score", "id % 2 = 0 as result_flag", "'LOW' as prelim_priority")
    path = str(tmp_path / "ranges")
    whole = fusion.fusion_features(logs, fusion.load_or_measure(path, logs)).where("id = 5").first()
    half = logs.where("id < 50")
    later = fusion.fusion_features(half, fusion.load_or_measure(path, half)).where("id = 5").first()
    assert whole.alert_score_scaled == later.alert_score_scaled
