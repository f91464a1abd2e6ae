"""Consecutive numbers without one global sort task."""

from pyspark.sql import Column, DataFrame, Window, functions as F

HASH_DIGITS = 3  # 16^3 buckets


def bucket_of(key: str) -> Column:
    return F.substring(F.md5(F.col(key)), 1, HASH_DIGITS)


def dense_ids(keys: DataFrame, key: str, id_name: str, start: Column | int = 0) -> DataFrame:
    """Add ids start+1, start+2, ... to rows with a unique text `key`.

    Keys are numbered inside 4096 hash buckets in parallel; only the 4096 bucket
    sizes meet in one task to give each bucket its offset. The join with offsets is
    a left one so that both uses of `keys` stay the same plan and share its shuffle.
    """
    bucketed = keys.withColumn("_bucket", bucket_of(key))
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    base = start if isinstance(start, Column) else F.lit(start)
    return (
        bucketed.join(F.broadcast(offsets), "_bucket", "left")
        .withColumn(id_name, (base + F.col("_offset") + within).cast("bigint"))
        .select(id_name, *keys.columns)
    )


def group_ordinals(rows: DataFrame, group: str, level: str, order_id: str, name: str,
                   chunk: int = 1_000_000) -> DataFrame:
    """Position 1..n in each group by (`level` descending, `order_id` ascending).

    `level` has few values and `order_id` is a unique whole number, so a group of
    any size splits into (level, id range) chunks of at most `chunk` rows that
    are numbered in parallel; a running total over chunk sizes joins them up.
    """
    # A struct keeps rows of a null group joinable by plain equality.
    chunked = rows.withColumn("_group", F.struct(group)).withColumn("_chunk", F.floor(F.col(order_id) / chunk))
    parts = ["_group", level, "_chunk"]
    before = Window.partitionBy("_group").orderBy(F.desc(level), "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
        .select(*parts, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    within = F.row_number().over(Window.partitionBy(*parts).orderBy(order_id))
    return (
        chunked.join(offsets, parts)
        .withColumn(name, F.col("_before") + within)
        .select(*rows.columns, name)
    )
