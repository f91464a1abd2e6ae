"""Table contracts as Spark schemas."""

from pyspark.sql import types as T


def _table(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


# Columns of the CSV event extract; optional ones may be missing from a file.
CSV_EXTRACT = _table(
    ("eventTime", T.StringType(), True),
    ("userIdentityuserName", T.StringType(), True),
    ("eventName", T.StringType(), True),
    ("sourceIPAddress", T.StringType(), True),
)

ENRICHED_FLAT = _table(
    ("id", T.LongType(), False),
    ("timestamp", T.TimestampType(), True),
    ("user", T.StringType(), True),
    ("action", T.StringType(), True),
    ("src_ip", T.StringType(), True),
    ("result", T.StringType(), True),
    ("ti_score", T.IntegerType(), True),
    ("country", T.StringType(), True),
    ("ip_score", T.DoubleType(), True),
    ("result_flag", T.BooleanType(), True),
    ("alert_score", T.DoubleType(), True),
    ("prelim_priority", T.StringType(), True),
    ("ti_country", T.StringType(), True),
    ("ti_asn", T.StringType(), True),
)

USERS = _table(("user_id", T.LongType(), False), ("username", T.StringType(), False))
ACTIONS = _table(("action_id", T.LongType(), False), ("action_name", T.StringType(), False))
IP_DETAILS = _table(
    ("ip_id", T.LongType(), False),
    ("src_ip", T.StringType(), False),
    ("country", T.StringType(), True),
    ("ti_score", T.IntegerType(), True),
)
FACT = _table(
    ("id", T.LongType(), False),
    ("event_ts", T.TimestampNTZType(), True),
    ("user_id", T.LongType(), True),
    ("action_id", T.LongType(), True),
    ("ip_id", T.LongType(), True),
    ("result", T.StringType(), True),
    ("result_flag", T.BooleanType(), True),
    ("alert_score", T.DoubleType(), True),
    ("prelim_priority", T.StringType(), True),
    ("ti_country", T.StringType(), True),
)

# What the cleaning step adds when an extract lacks it, in output order.
OPTIONAL_COLUMNS = [
    ("result", T.StringType()),
    ("result_flag", T.BooleanType()),
    ("alert_score", T.DoubleType()),
    ("prelim_priority", T.StringType()),
    ("ti_country", T.StringType()),
    ("ti_asn", T.StringType()),
]

REPUTATION = _table(
    ("ip", T.StringType(), False),
    ("abuse_confidence", T.IntegerType(), True),
    ("country", T.StringType(), True),
    ("asn", T.StringType(), True),
)

ALERTS = _table(
    ("id", T.LongType(), False),
    ("timestamp", T.TimestampNTZType(), True),
    ("src_ip", T.StringType(), True),
    ("user", T.StringType(), True),
    ("event_type", T.StringType(), True),
    ("severity", T.StringType(), True),
    ("risk_score", T.IntegerType(), True),
    ("ai_reasoning", T.StringType(), True),
    ("status", T.StringType(), True),
)
