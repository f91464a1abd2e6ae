"""Event rows: parsing, cleaning, classes, contracts."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from idsignal import fixed_values as fv
from idsignal import schemas
from idsignal.functions.ip import extract_ip
from idsignal.functions.text import clean_value
from idsignal.functions.times import coerce_time, parse_time
from idsignal.sources.payloads import log_type


def parse_events(events: DataFrame) -> DataFrame:
    """Flat event from audit columns, with defaults; other columns are kept.

    `has_error` and `has_identity` may come from the JSON scan; a column source
    without them falls back on the text of error_code and the identity fields.
    """
    columns = events.columns
    failed = F.col("has_error") if "has_error" in columns else F.coalesce(F.length("error_code") > 0, F.lit(False))
    identity = (
        F.col("has_identity") if "has_identity" in columns
        else F.col("user_name").isNotNull() | F.col("arn").isNotNull()
    )
    unknown = F.lit(fv.UNKNOWN)
    if "event_time" in columns:
        events = events.withColumn("timestamp", F.coalesce("event_time", unknown)).drop("event_time")
    return (
        events
        .withColumn("user", F.coalesce("user_name", "arn", unknown))
        .withColumn("action", F.coalesce("event_name", unknown))
        .withColumn("src_ip", extract_ip(F.col("source_ip_address")))
        .withColumn("region", F.coalesce("aws_region", unknown))
        .withColumn("result", F.when(failed, "FAILED").otherwise("SUCCESS"))
        .withColumn("log_type", log_type(F.col("event_source"), F.col("event_name"), identity))
        .drop("user_name", "arn", "event_name", "source_ip_address", "aws_region", "event_source",
              "has_error", "has_identity")
    )


def preprocess(extract: DataFrame) -> DataFrame:
    """CSV extract to the ten warehouse columns; absent optional ones become null."""
    renamed = extract.withColumnsRenamed({
        "eventTime": "timestamp", "userIdentityuserName": "user",
        "eventName": "action", "sourceIPAddress": "src_ip",
    })
    optional = [
        F.col(name).try_cast(kind).alias(name) if name in renamed.columns
        else F.lit(None).cast(kind).alias(name)
        for name, kind in schemas.OPTIONAL_COLUMNS
    ]
    timestamp = F.col("timestamp")
    if isinstance(renamed.schema["timestamp"].dataType, T.StringType):
        timestamp = coerce_time(timestamp)
    return renamed.select(timestamp.alias("timestamp"), "user", "action", "src_ip", *optional)


FLAGS = ["is_failure", "is_login", "is_iam", "is_ec2", "is_s3"]


def adapt_events(rows: DataFrame, ingest_time: Column, keep: list[str] | None = None) -> DataFrame:
    """Legacy flagged extract to the twelve-field event; a flag that is absent or null is 0."""
    user = clean_value(F.col("useridentityusername"))
    flags = [
        F.coalesce(F.col(flag).cast("int"), F.lit(0)).alias(flag) if flag in rows.columns
        else F.lit(0).alias(flag)
        for flag in FLAGS
    ]
    time = F.col("eventtime")
    is_text = isinstance(rows.schema["eventtime"].dataType, T.StringType)
    return rows.select(
        *(keep or []),
        (parse_time(time, ingest_time) if is_text else F.coalesce(time, ingest_time)).alias("event_time"),
        F.lower(clean_value(F.col("eventname"))).alias("event_name"),
        user.alias("user"),
        user.alias("user_identity"),
        clean_value(F.col("sourceipaddress")).alias("source_ip"),
        clean_value(F.col("awsregion")).alias("aws_region"),
        clean_value(F.col("eventsource")).alias("event_source"),
        *flags,
    )


def event_class() -> Column:
    return (
        F.when(F.col("is_login") != 0, "authentication")
        .when(F.col("is_iam") != 0, "authorization")
        .when(F.col("is_s3") != 0, "data_access")
        .otherwise("infrastructure")
    )


CONTRACT_REQUIRED = ["timestamp", "event_type", "raw_log"]


def apply_contract(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Normalised event contract; contract_error names the first required field that is null."""
    kinds = [
        ("timestamp", "timestamp"), ("src_ip", "string"), ("user", "string"), ("action", "string"),
        ("result", "string"), ("event_type", "string"), ("raw_log", "string"),
    ]
    typed = rows.select(*(keep or []), *[F.col(name).try_cast(kind).alias(name) for name, kind in kinds])
    error = F.lit(None).cast("string")
    for name in reversed(CONTRACT_REQUIRED):
        error = F.when(F.col(name).isNull(), name).otherwise(error)
    return typed.withColumn("contract_error", error)
