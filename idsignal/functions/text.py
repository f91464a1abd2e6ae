"""Text columns: trimming, defaults, display names."""

from pyspark.sql import Column, functions as F

from idsignal import fixed_values as fv


def strip(text: Column) -> Column:
    """Remove all leading and trailing whitespace, not only spaces."""
    return F.btrim(text, F.lit(fv.WHITESPACE))


def clean_value(text: Column, default: str = "Unknown") -> Column:
    trimmed = strip(text)
    blank = text.isNull() | F.lower(trimmed).isin(fv.BLANK_WORDS)
    return F.when(blank, F.lit(default)).otherwise(trimmed)


def or_default(text: Column, default: str) -> Column:
    """`default` where the text is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def capitalize(text: Column) -> Column:
    """First letter upper, all others lower (words after the first stay lower)."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2147483647)))


def mapped(key: Column, names: dict[str, str], otherwise: Column) -> Column:
    result = None
    for raw, shown in names.items():
        result = F.when(key == raw, shown) if result is None else result.when(key == raw, shown)
    return result.otherwise(otherwise)


def feed_name(username: Column) -> Column:
    """Display name of the alert feed: the lookup ignores case."""
    raw = strip(or_default(username, "Unknown"))
    return mapped(F.lower(raw), fv.FEED_NAMES, capitalize(raw))


def insight_name(username: Column) -> Column:
    """Display name of the insight list: the lookup keeps case."""
    raw = or_default(username, "Unknown")
    return mapped(strip(raw), fv.INSIGHT_NAMES, capitalize(raw))
