"""Joins of large tables with keyed tables that hold one row per key.

A table is broadcast only after its size has been measured. Beyond the limit the
join shuffles, and keys that hold a large share of the rows are spread over many
tasks: their table rows are copied once per salt, everything else is not.
"""

from pyspark.sql import DataFrame, functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_SHARE = 0.001  # a key above this share of rows is hot, so there are at most 1000
SALTS = 256


def measured_bytes(table: DataFrame) -> int:
    """Bytes of text and fixed-width values in the table (runs one aggregate job)."""
    widths = [F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) + 16 for name in table.columns]
    total = F.lit(0).cast("bigint")
    for width in widths:
        total = total + width
    return table.agg(F.sum(total)).first()[0] or 0


def fits_broadcast(table: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return measured_bytes(table) <= limit


def hot_keys(fact: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys holding more than `share` of all rows: at most 1/share of them."""
    total = fact.agg(F.count(F.lit(1))).scalar()
    counts = fact.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > total * F.lit(share)).select(key, F.lit(True).alias("_hot"))


def salted_join(fact: DataFrame, table: DataFrame, key: str, row_id: str, how: str = "left",
                share: float = HOT_SHARE, salts: int = SALTS, count_on: DataFrame | None = None) -> DataFrame:
    """Equi-join on `key` with hot and null keys spread over `salts` tasks.

    `count_on` is a cheaper frame with the same keys to look for hot ones in.
    """
    hot = F.broadcast(hot_keys(fact if count_on is None else count_on, key, share))
    spread = F.col("_hot") | F.col(key).isNull()
    left = (
        fact.join(hot, key, "left")
        .withColumn("_salt", F.when(spread, F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int")).otherwise(0))
        .drop("_hot")
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = (
        table.join(hot, key, "left")
        .withColumn("_salt", F.explode(copies))
        .drop("_hot")
    )
    return left.join(right, [key, "_salt"], how).drop("_salt")


def lookup(fact: DataFrame, table: DataFrame, key: str, row_id: str, how: str = "left",
           count_on: DataFrame | None = None) -> DataFrame:
    """Join each fact row with at most one table row (measures the table first)."""
    if fits_broadcast(table):
        return fact.join(F.broadcast(table), key, how)
    return salted_join(fact, table, key, row_id, how, count_on=count_on)
