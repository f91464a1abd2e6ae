"""Timestamp columns."""

from pyspark.sql import Column, functions as F

from idsignal import fixed_values as fv


def coerce_time(text: Column) -> Column:
    """Any ISO form to a timestamp; what does not parse becomes null."""
    return F.try_to_timestamp(text)


def parse_time(text: Column, fallback: Column) -> Column:
    """The two accepted formats in order, else `fallback` (the ingest time).

    The shape is tested first because a failed parse costs an exception.
    """
    attempts = [
        F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern))) for shape, pattern in fv.TIME_FORMATS
    ]
    return F.coalesce(*attempts, fallback)


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def printed_time(ts: Column) -> Column:
    """As iso_text, with six decimals when there is a fraction of a second."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), "[.]000000$", "")
