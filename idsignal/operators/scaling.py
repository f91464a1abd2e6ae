"""Whole-table minimum and maximum as scalar subqueries (no join, no one-task window)."""

from pyspark.sql import Column, DataFrame, functions as F


def value_range(rows: DataFrame, column: str) -> Column:
    """One struct{lo, hi} for the whole table."""
    return rows.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()


def range_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: struct `ranges` with lo_<column> and hi_<column> of several columns, in one pass."""
    bounds = []
    for column in columns:
        bounds += [F.min(column).alias(f"lo_{column}"), F.max(column).alias(f"hi_{column}")]
    return rows.agg(F.struct(*bounds).alias("ranges"))


def normalize(rows: DataFrame, column: str, name: str) -> DataFrame:
    """(x - min) / (max - min + 1e-9)."""
    return (
        rows.withColumn("_range", value_range(rows, column))
        .withColumn(name, (F.col(column) - F.col("_range.lo")) / (F.col("_range.hi") - F.col("_range.lo") + F.lit(1e-9)))
        .drop("_range")
    )


def scale_columns(rows: DataFrame, columns: list[str], suffix: str = "_scaled", bounds: DataFrame | None = None) -> DataFrame:
    """Min-max scale to 0-1; a constant column becomes 0. With `bounds` of other rows, values beyond them leave 0-1."""
    measured = range_table(rows, columns) if bounds is None else bounds
    scaled = rows.withColumn("_ranges", measured.scalar())
    for column in columns:
        lo, hi = F.col(f"_ranges.lo_{column}"), F.col(f"_ranges.hi_{column}")
        width = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
        scaled = scaled.withColumn(column + suffix, (F.col(column) - lo) / width)
    return scaled.drop("_ranges")
