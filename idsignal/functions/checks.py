"""Row validation: the message of the first rule a row breaks."""

from pyspark.sql import Column, DataFrame, functions as F

from idsignal import fixed_values as fv

_NUMBER = r"(?i)^\s*[+-]?(([0-9]+([.][0-9]*)?|[.][0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"


def entry_error(columns: list[str]) -> Column:
    """Null for a good row, else its first error; `columns` are those the frame has."""
    missing = F.lit(None).cast("string")
    for field in reversed(fv.REQUIRED_FIELDS):
        absent = F.col(field).isNull() if field in columns else F.lit(True)
        missing = F.when(absent, fv.MISSING_FIELD + field).otherwise(missing)
    if not set(fv.REQUIRED_FIELDS) <= set(columns):
        return missing

    text = F.col("alert_score").cast("string")
    score = text.try_cast("double")
    low, high = fv.SCORE_RANGE
    ip = F.col("ip") if "ip" in columns else F.lit(None).cast("string")
    return (
        F.when(missing.isNotNull(), missing)
        .when(~text.rlike(_NUMBER), F.concat(F.lit(fv.BAD_NUMBER + "'"), text, F.lit("'")))
        .when(~score.between(low, high), fv.BAD_SCORE)
        .when(~F.upper("prelim_priority").isin(fv.VALID_PRIORITIES), fv.BAD_PRIORITY)
        .when((F.length(ip) > 0) & ~ip.rlike(fv.IPV4_SHAPE), F.concat(F.lit(fv.BAD_IP), ip))
    )


def with_validation(entries: DataFrame) -> DataFrame:
    """Add is_valid and message; split on is_valid to quarantine the bad rows."""
    error = entry_error(entries.columns)
    return (
        entries.withColumn("message", F.coalesce(error, F.lit(fv.VALID)))
        .withColumn("is_valid", F.col("message") == fv.VALID)
    )
