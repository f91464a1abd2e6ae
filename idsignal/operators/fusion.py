"""Score fusion: a random forest over the four scaled scores of an alert.

The forest of `forest.py` (`grow_forest`, `forest_scores`) repeats in SQL; Spark ML's (`train`, `final_scores`) does not.
"""

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from idsignal.functions.numeric import number_or_zero, round_half_even
from idsignal.functions.scores import fusion_bucket, priority_code
from idsignal.operators import forest
from idsignal.operators.metrics import classification_report
from idsignal.operators.scaling import range_table, scale_columns
from idsignal.workspace import load_or_write

# -- fixed values: model settings -----------------------------------------------
INPUTS = ["alert_score", "ti_score", "ip_score", "result_flag"]
TREES = 100
SEED = 42
TEST_PARTS = 5  # one part in five is held out
DEPTH = 10  # the original has no limit; deeper trees cost much and gain little (README)
TRAIN_ROWS = 200_000  # labelled rows fitted on at most, chosen by hash of their id
TRAIN_PARTS = 16  # bagging is seeded per partition, so their number must not follow the cluster

SCALED = [f"{name}_scaled" for name in INPUTS]


def filled_inputs(alerts: DataFrame) -> DataFrame:
    return alerts.withColumns({name: number_or_zero(F.col(name).cast("double")) for name in INPUTS})


def fusion_features(alerts: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Null-filled inputs, their 0-1 scaled form and the label from prelim_priority.

    `bounds` is the one-row table of `scaling.range_table`, by default that of these alerts.
    """
    scaled = scale_columns(filled_inputs(alerts), INPUTS, bounds=bounds)
    return scaled.withColumn("label", priority_code(F.col("prelim_priority")))


def load_or_measure(path: str, alerts: DataFrame) -> DataFrame:
    """The input ranges saved at `path` beside a model, measured and saved first if there are none."""
    rows = filled_inputs(alerts)
    table = range_table(rows, INPUTS)
    return load_or_write(alerts.sparkSession, path, table.schema, lambda: table)


def is_held_out(row_id: str) -> Column:
    """Whether a row belongs to the test part; the same row always does or does not."""
    return F.pmod(F.xxhash64(F.col(row_id), F.lit(SEED)), F.lit(TEST_PARTS)) == 0


def training_rows(featured: DataFrame, row_id: str, limit: int = TRAIN_ROWS) -> DataFrame:
    """About `limit` rows of the training part at most, laid out the same on every cluster."""
    part = featured.where(~is_held_out(row_id)).select(row_id, *SCALED, F.col("label").cast("double").alias("label"))
    share = min(1.0, limit / max(part.count(), 1))
    chosen = F.pmod(F.xxhash64(F.col(row_id), F.lit(SEED + 1)), F.lit(1 << 20)) < int(share * (1 << 20))
    return part.where(chosen).repartition(TRAIN_PARTS, row_id).sortWithinPartitions(row_id, *SCALED, "label")


def train(featured: DataFrame, row_id: str, trees: int = TREES, depth: int = DEPTH, limit: int = TRAIN_ROWS) -> PipelineModel:
    """Fit on the training part (runs Spark jobs)."""
    stages = [
        VectorAssembler(inputCols=SCALED, outputCol="features"),
        RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, maxMemoryInMB=1024),
    ]
    return Pipeline(stages=stages).fit(training_rows(featured, row_id, limit))


def load_or_train(path: str, featured: DataFrame, row_id: str, **settings) -> PipelineModel:
    """The model saved at `path`, trained and saved first if there is none."""
    spark = featured.sparkSession
    try:
        spark.read.text(f"{path}/metadata")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        train(featured, row_id, **settings).save(path)
    return PipelineModel.load(path)


def final_scores(featured: DataFrame, model: PipelineModel) -> DataFrame:
    """Add final_score (100 x largest class probability), final_priority, predicted and p_high."""
    scored = model.transform(featured).withColumn("_p", vector_to_array("probability"))
    return (
        scored
        .withColumn("final_score", round_half_even(F.array_max("_p") * F.lit(100.0), 2))
        .withColumn("final_priority", fusion_bucket(F.col("final_score") / F.lit(100.0)))
        .withColumn("p_high", F.aggregate(F.slice("_p", 3, 4), F.lit(0.0), lambda a, b: a + b))
        .withColumn("predicted", F.col("prediction").cast("int"))
        .drop("features", "rawPrediction", "probability", "prediction", "_p")
    )


def in_test_part(row_id: str) -> Column:
    """Whether `grow_forest` leaves a row out."""
    return forest.draw(row_id, SEED, F.lit("test")) < 1 / TEST_PARTS


def grow_forest(path: str, featured: DataFrame, row_id: str, limit: int = TRAIN_ROWS, **settings) -> DataFrame:
    """The node table saved at `path`, else grown on about `limit` rows of the training part at most and saved."""
    part = featured.where(~in_test_part(row_id))
    total = part.agg(F.count(F.lit(1))).scalar()
    chosen = part.where(forest.draw(row_id, SEED, F.lit("fit")) * total < limit)
    return forest.load_or_grow(path, chosen, row_id, SCALED, "label", **settings)


def forest_scores(featured: DataFrame, nodes: DataFrame, row_id: str, trees: int = forest.TREES, depth: int = forest.DEPTH) -> DataFrame:
    """Add final_score (100 x largest class share), final_priority, predicted and p_high."""
    scored = forest.class_shares(featured, nodes, row_id, SCALED, trees, depth)
    best, whole = F.array_max("shares"), float(trees * forest.SHARE_UNITS)
    return (
        scored
        .withColumn("final_score", round_half_even(best.cast("double") * F.lit(100.0) / F.lit(whole), 2))
        .withColumn("final_priority", fusion_bucket(F.col("final_score") / F.lit(100.0)))
        .withColumn("p_high", (F.get("shares", F.lit(2)) + F.get("shares", F.lit(3))).cast("double") / F.lit(whole))
        .withColumn("predicted", (F.array_position("shares", best) - 1).cast("int"))
        .drop("shares")
    )


def held_out_report(featured: DataFrame, model: PipelineModel, row_id: str) -> DataFrame:
    """Precision, recall and F1 of the model on the part it was not fitted on."""
    tested = final_scores(featured.where(is_held_out(row_id)), model)
    return classification_report(tested, "label", "predicted")


def preview(final: DataFrame, row_id: str, limit: int = 10) -> DataFrame:
    """The short list shown after a run."""
    return final.orderBy(row_id).limit(limit).select("timestamp", "user", "src_ip", "final_priority")
