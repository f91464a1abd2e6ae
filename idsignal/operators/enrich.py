"""Address reputation."""

from pyspark.sql import DataFrame, functions as F

from idsignal import fixed_values as fv
from idsignal.functions.ip import is_blank_ip, repair_ip
from idsignal.functions.scores import reputation_score
from idsignal.operators.lookup import lookup


def valid_ips(rows: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Distinct repaired addresses.

    Raw values are made distinct first, so each is repaired once. A repaired
    address always has four octets; blank ones are dropped before.
    """
    raw = rows.where(~is_blank_ip(F.col(ip))).select(F.col(ip).alias("src_ip")).distinct()
    return raw.select(repair_ip(F.col("src_ip")).alias("src_ip")).distinct()


def enrich(rows: DataFrame, reputation: DataFrame, row_id: str) -> DataFrame:
    """Repair src_ip and add ti_score, ti_country and ti_asn; unknown addresses get 1, NA, NA."""
    # an address listed twice counts once, by its highest confidence, then country and number
    best = F.max(F.struct("abuse_confidence", "country", "asn")).alias("_best")
    records = reputation.where(F.col("ip").isNotNull()).groupBy(F.col("ip").alias("src_ip")).agg(best).select(
        "src_ip", "_best.abuse_confidence", F.col("_best.country").alias("_country"), F.col("_best.asn").alias("_asn"))
    repaired = rows.withColumn("src_ip", repair_ip(F.col("src_ip")))
    matched = lookup(repaired, records, "src_ip", row_id)
    return (
        matched
        .withColumn("ti_score", reputation_score(F.col("abuse_confidence")))
        .withColumn("ti_country", F.coalesce("_country", F.lit(fv.NO_REPUTATION)))
        .withColumn("ti_asn", F.coalesce("_asn", F.lit(fv.NO_REPUTATION)))
        .drop("abuse_confidence", "_country", "_asn")
    )
