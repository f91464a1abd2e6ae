"""Numeric columns whose value must not depend on how rows are partitioned."""

from pyspark.sql import Column, functions as F


def number_or_zero(value: Column) -> Column:
    """Text or number as double; null, NaN and non-numbers become 0."""
    number = value.try_cast("double")
    return F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))


def known(value: Column) -> Column:
    """The number, null where it is NaN."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def known_sum(value: Column) -> Column:
    """Sum of the numbers; a last bit may depend on their order, so means are shown rounded."""
    return F.sum(known(value))


def ratio(total: Column, count: Column) -> Column:
    """`total / count` as double, null when there is nothing to count."""
    return F.when(count > 0, total.cast("double") / count)


def known_mean(value: Column) -> Column:
    return F.avg(known(value))


def round_half_up(value: Column, places: int) -> Column:
    """Round by plain double arithmetic."""
    scale = float(10**places)
    return F.floor(value * scale + F.lit(0.5)) / F.lit(scale)


def round_half_even(value: Column, places: int) -> Column:
    """Round with ties to the even neighbour, as in 0.125 to 0.12."""
    scale = float(10**places)
    return F.rint(value * scale) / F.lit(scale)


def two_decimals(value: Column) -> Column:
    """Text with two decimals, as in "0.50"."""
    return round_half_even(value, 2).cast("decimal(18,2)").cast("string")
