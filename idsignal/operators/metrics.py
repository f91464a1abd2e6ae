"""Per-class precision, recall and F1 from counts of (label, prediction) pairs."""

from pyspark.sql import Column, DataFrame, functions as F


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def class_counts(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    """hits, predicted and support per class; the input is grouped once."""
    pairs = predictions.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("l").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).cast("bigint").alias("hits")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits")),
    )).alias("s")).select("s.*")
    return sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("hits", "predicted", "support")])


def classification_report(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows for each class, then accuracy, macro avg and weighted avg."""
    per_class = class_counts(predictions, label, prediction).select(
        F.col("class").cast("string").alias("class"),
        _share(F.col("hits"), F.col("predicted")).alias("precision"),
        _share(F.col("hits"), F.col("support")).alias("recall"),
        _share(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
        "support", "hits",
    )
    measures = ["precision", "recall", "f1"]
    total = F.sum("support")
    accuracy = per_class.agg((F.sum("hits") / total).alias("f1"), total.alias("support")).select(
        F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"), "f1", "support")
    macro = per_class.agg(*[F.avg(m).alias(m) for m in measures], total.alias("support")).select(
        F.lit("macro avg").alias("class"), *measures, "support")
    weighted = per_class.agg(
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(m) for m in measures], total.alias("support")
    ).select(F.lit("weighted avg").alias("class"), *measures, "support")
    return per_class.drop("hits").unionByName(accuracy).unionByName(macro).unionByName(weighted)
