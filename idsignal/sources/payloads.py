"""Analysis requests: JSON text holding one event object or an array of them."""

from pyspark.sql import Column, DataFrame, functions as F

from idsignal import fixed_values as fv

MALFORMED = "malformed payload"
NOT_AN_EVENT = "not an event object"

# errorCode stays a variant because its truth depends on its JSON type.
EVENT = (
    "struct<eventTime: string, eventName: string, sourceIPAddress: string, awsRegion: string, "
    "eventSource: string, errorCode: variant, userIdentity: struct<userName: string, arn: string>>"
)
STRICT = {"allowSingleQuotes": "false"}


def _read(text: Column, kind: str) -> Column:
    return F.from_json(text, kind, STRICT)


def _with_events(requests: DataFrame, keep_raw: bool, unwrap_records: bool) -> DataFrame:
    """Add `events`, the array of a payload's elements, null for malformed text.

    A payload of objects only is read in one typed pass. The rest is read as
    variant, its non-objects are blanked, and what remains is read again. The text
    is put in brackets, so that a second document after the first is noticed.
    """
    bracketed = F.concat(F.lit("["), F.col("payload"), F.lit("]"))
    many, one = F.col("_many"), F.col("_one")
    rows = (
        requests.select("request_id", "payload")
        .withColumn("_array", F.ltrim(F.col("payload"), F.lit(fv.JSON_WHITESPACE)).startswith("["))
        .withColumn("_many", F.when(F.col("_array"), _read(bracketed, f"array<array<{EVENT}>>")))
        .withColumn("_one", F.when(~F.col("_array"), _read(bracketed, f"array<{EVENT}>")))
    )
    typed = F.when(F.size(many) == 1, F.get(many, F.lit(0))).when(
        (F.size(one) == 1) & F.get(one, F.lit(0)).isNotNull(), one)
    if unwrap_records:
        rows = rows.withColumn("_wrapper", F.when(
            ~F.col("_array"), _read(bracketed, f"array<struct<Records: array<{EVENT}>>>")))
        inside = F.when(F.size("_wrapper") == 1, F.get("_wrapper", F.lit(0))["Records"])
        typed = F.coalesce(inside, typed)

    needed = F.lit(True) if keep_raw else F.col("_typed").isNull()
    document = F.get("_documents", F.lit(0))
    parts = F.when(F.col("_array"), document.cast("array<variant>")).otherwise(F.col("_documents"))
    if unwrap_records:
        parts = F.coalesce(F.try_variant_get(document, "$.Records", "array<variant>"), parts)

    def object_or_null(part):
        return F.when(F.try_variant_get(part, "$", "struct<eventName: variant>").isNotNull(), part)

    return (
        rows.withColumn("_typed", typed)
        .withColumn("_documents", F.when(needed, F.try_parse_json(bracketed)).cast("array<variant>"))
        .withColumn("_parts", F.when(F.size("_documents") == 1, parts))
        .withColumn("events", F.coalesce(
            "_typed", _read(F.to_json(F.transform("_parts", object_or_null)), f"array<{EVENT}>")))
    )


def scan_elements(requests: DataFrame, keep_raw: bool = True, keep_empty: bool = False,
                  unwrap_records: bool = False) -> DataFrame:
    """One row per array element of (request_id, payload), in payload order.

    Gives request_id, pos, event (struct), rejected (null for an event object) and,
    with `keep_raw`, raw_event (JSON text, at the price of a second parse). A
    payload that is not JSON gives one rejected row. `keep_empty` keeps requests
    with an empty array as a row with null pos; `unwrap_records` accepts the
    {"Records": [...]} wrapper.
    """
    rows = _with_events(requests, keep_raw, unwrap_records)
    malformed = F.col("events").isNull().alias("_malformed")
    if keep_raw:
        element = F.arrays_zip(F.col("events").alias("event"), F.coalesce("_parts", F.array()).alias("raw"))
        element = F.when(F.col("events").isNotNull(), element)
    else:
        element = F.transform("events", lambda event: F.struct(event.alias("event")))
    rows = rows.select("request_id", "payload", malformed, F.posexplode_outer(element).alias("pos", "element"))
    if not keep_empty:
        rows = rows.where(F.col("pos").isNotNull() | F.col("_malformed"))
    rejected = (
        F.when(F.col("_malformed"), MALFORMED)
        .when(F.col("pos").isNotNull() & F.col("element.event").isNull(), NOT_AN_EVENT)
    )
    raw = F.when(F.col("_malformed"), F.col("payload")).otherwise(F.to_json("element.raw")) if keep_raw else None
    return rows.select(
        "request_id", F.when(F.col("_malformed"), 0).otherwise(F.col("pos")).alias("pos"),
        F.col("element.event").alias("event"), rejected.alias("rejected"),
        *([raw.alias("raw_event")] if keep_raw else []),
    )


def quarantined(elements: DataFrame) -> DataFrame:
    raw = [c for c in elements.columns if c == "raw_event"]
    return elements.where(F.col("rejected").isNotNull()).select("request_id", "pos", "rejected", *raw)


def _has_error(error: Column) -> Column:
    """Whether an error code is a non-empty string, a non-zero number, true, or a filled container."""
    empty = error.isin('""', "false", "{}", "[]") | F.coalesce(error.try_cast("double") == 0, F.lit(False))
    return F.coalesce(~empty, F.lit(False))


def event_fields(elements: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Event columns of the good elements; a JSON null counts as a missing key.

    `keep_empty` also keeps rejected and empty rows, with null pos, so that every
    request stays visible.
    """
    good = F.col("rejected").isNull() & F.col("pos").isNotNull()
    rows = elements.withColumn("pos", F.when(good, F.col("pos"))) if keep_empty else elements.where(good)
    error = F.nullif(F.to_json("event.errorCode"), F.lit("null"))
    return (
        rows.withColumn("_error", error)
        .select(
            "request_id", "pos",
            F.col("event.eventTime").alias("event_time"),
            F.col("event.eventName").alias("event_name"),
            F.col("event.userIdentity.userName").alias("user_name"),
            F.col("event.userIdentity.arn").alias("arn"),
            F.col("event.userIdentity").isNotNull().alias("has_identity"),
            F.col("event.sourceIPAddress").alias("source_ip_address"),
            F.col("event.awsRegion").alias("aws_region"),
            F.col("event.eventSource").alias("event_source"),
            F.coalesce(F.try_variant_get("event.errorCode", "$", "string"), F.col("_error")).alias("error_code"),
            _has_error(F.col("_error")).alias("has_error"),
            *[c for c in elements.columns if c == "raw_event"],
        )
    )


def log_type(event_source: Column, event_name: Column, has_identity: Column) -> Column:
    return (
        F.when(event_source.isNotNull() & event_name.isNotNull(),
               F.when(event_source == fv.IAM_SOURCE, "aws_iam").otherwise("aws_cloudtrail"))
        .when(has_identity & event_name.isNotNull(), "aws_cloudtrail")
        .otherwise(fv.UNKNOWN)
    )
