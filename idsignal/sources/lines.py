"""Raw log lines, one event each."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from idsignal.functions.ip import extract_ip

# Our own rule for login failures in text logs; off unless asked for.
AUTH_MARKERS = ["sshd", "Failed password"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("raw_log"))


def stream_lines(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
        .text(path).select(F.col("value").alias("raw_log"))
    )


def is_auth_line(raw_log: Column) -> Column:
    found = F.lit(False)
    for marker in AUTH_MARKERS:
        found = found | raw_log.contains(marker)
    return found


def normalize_lines(lines: DataFrame, auth_rule: bool = False) -> DataFrame:
    """Add event_type, src_ip and user to rows with raw_log."""
    raw = F.col("raw_log")
    failed = is_auth_line(raw) if auth_rule else F.lit(False)
    return (
        lines.withColumn("event_type", F.when(failed, "FAILED_LOGIN").otherwise("UNKNOWN"))
        .withColumn("src_ip", extract_ip(raw))
        .withColumn("user", F.when(failed & raw.contains("root"), "root"))
    )
