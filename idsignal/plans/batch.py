"""The warehouse run: score, enrich, fuse and load one set of flat logs.

Each step writes its result below `base`, once; models are trained on the first
run, with the ranges their inputs are scaled by, and loaded afterwards.
"""

from pyspark.sql import DataFrame

from idsignal.operators import anomaly, enrich, fusion
from idsignal.sources.sinks import load_star, write_parquet


def _written(df: DataFrame, path: str) -> DataFrame:
    write_parquet(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def enrich_logs(logs: DataFrame, reputation: DataFrame, base: str, run: str, row_id: str = "id") -> DataFrame:
    """Anomaly score and address reputation for scored logs."""
    featured = anomaly.features(logs)
    forest = anomaly.load_or_train(f"{base}/models/forest", featured, row_id)
    scored = anomaly.anomaly_scores(featured, forest, keep=logs.columns)
    return _written(enrich.enrich(scored, reputation, row_id), f"{base}/enriched/{run}")


def fuse_alerts(enriched: DataFrame, base: str, run: str, row_id: str = "id") -> DataFrame:
    """Final score and priority for enriched logs."""
    bounds = fusion.load_or_measure(f"{base}/models/fusion_ranges", enriched)
    featured = fusion.fusion_features(enriched, bounds)
    model = fusion.load_or_train(f"{base}/models/fusion", featured, row_id)
    final = fusion.final_scores(featured, model).drop(*fusion.SCALED, "label")
    return _written(final, f"{base}/final_alerts/{run}")


def run(logs: DataFrame, reputation: DataFrame, base: str, run_id: str) -> DataFrame:
    """All steps; gives the final alerts and leaves the star schema in `base`/star."""
    enriched = enrich_logs(logs, reputation, base, run_id)
    load_star(enriched, f"{base}/star")
    return fuse_alerts(enriched, base, run_id)
