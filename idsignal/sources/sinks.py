"""Result files and the star-schema load."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from idsignal import schemas
from idsignal.operators import warehouse
from idsignal.operators.lookup import fits_broadcast
from idsignal.sources.id_index import IdIndex
from idsignal.streaming.tables import StreamTable
from idsignal.workspace import read_existing, stage, together


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True)


def append_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, page: int = 1000, **options) -> None:
    """Append to a database table in pages of 1000 rows per statement."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=page, **options).mode("append").save()


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    saved = read_existing(spark, path, schema)
    return spark.createDataFrame([], schema) if saved is None else saved


VERSIONED_IPS = T.StructType([*schemas.IP_DETAILS.fields, T.StructField("version", T.LongType(), False)])


def ip_details(spark: SparkSession, base: str) -> StreamTable:
    """The address dimension: each load adds the rows it changed, merges keep the newest of an address."""
    return StreamTable(spark, f"{base}/ip_details", VERSIONED_IPS, ["ip_id"], newest_by="version")


def read_ip_details(spark: SparkSession, base: str) -> DataFrame:
    """Address dimension: of each address the row of the newest version written."""
    return ip_details(spark, base).read()


def ip_history(spark: SparkSession, base: str) -> DataFrame:
    """Every version of every address, with the version that replaced it (null: none has)."""
    rows = StreamTable(spark, f"{base}/ip_history", VERSIONED_IPS).read()
    after = F.lead("version").over(Window.partitionBy("ip_id").orderBy("version"))
    return rows.withColumn("replaced_by", after)


def ip_details_at(spark: SparkSession, base: str, version: int) -> DataFrame:
    """The address dimension as it was after that version."""
    return ip_history(spark, base).where((F.col("version") <= version) & (F.col("replaced_by").isNull() | (F.col("replaced_by") > version))).drop("replaced_by")


def id_index(spark: SparkSession, base: str) -> IdIndex:
    """The index of the fact's ids, made from the fact if there is a fact without one."""
    index = IdIndex(spark, f"{base}/fact_ids")
    if not index.ids.live()[0]:
        loaded = read_existing(spark, f"{base}/enriched_logs", schemas.FACT)
        if loaded is not None:
            index.rebuild(loaded)
    return index


def load_star(logs: DataFrame, base: str, ti_country: str = "country") -> None:
    """Add flat logs to the star schema below `base`; an id is stored once, by its first load.

    Ids stored before are found by the id index and dropped first, by ids only; of an id repeated
    within the load the earliest loadable row counts (`one_per_id`). Rows without an id get one
    (`with_ids`), so that none is lost. Users and actions only grow. Addresses are overwritten on
    conflict: a load writes those it changes as a new version and keeps the old one in a history.
    The fact is partitioned by day and rebalanced so that a day of any size becomes files of even
    size. Ids follow the highest one stored, so a star has one writer at a time; if a load fails after
    it wrote facts, `id_index(...).rebuild(facts)` comes before the next.
    """
    spark = logs.sparkSession
    columns = dict.fromkeys(["id", "event_ts", "user", "action", "src_ip", "result", "result_flag", "alert_score", "prelim_priority", "country", "ti_score",
                             ti_country])
    logs = logs.select(*columns)
    if not logs.where("id is null").isEmpty():  # numbered once and written, as the rows are used several times
        numbered = stage(warehouse.with_ids(logs.where("id is null")), "numbered")
        logs = logs.where("id is not null").unionByName(numbered)

    def grow(name: str, schema: T.StructType, column: str, key: str, id_name: str) -> None:
        existing = _read_or_empty(spark, f"{base}/{name}", schema)
        incoming = warehouse.distinct_keys(logs, column, key)
        append_parquet(warehouse.fresh_rows(existing, incoming, key, id_name), f"{base}/{name}")

    def replace_ips() -> None:
        table, history = ip_details(spark, base), StreamTable(spark, f"{base}/ip_history", VERSIONED_IPS)
        version = table.next_batch()
        # rows that came without an id (below zero) are the last to say what an address is
        first = warehouse.first_per_ip(logs, F.struct(F.col("id") < 0, F.col("id")))
        changed = stage(warehouse.changed_rows(table.read().drop("version"), first, "src_ip", "ip_id"), "changed_ips")
        if changed.isEmpty():
            return
        versioned = changed.withColumn("version", F.lit(version).cast("bigint"))
        history.append(versioned, version)
        table.append(versioned, version)
        history.compact()
        table.compact()

    together(
        lambda: grow("users", schemas.USERS, "user", "username", "user_id"),
        lambda: grow("actions", schemas.ACTIONS, "action", "action_name", "action_id"),
        replace_ips,
    )

    index = id_index(spark, base)
    rows = warehouse.loadable(logs)
    known = stage(index.known(rows.select("id").distinct()), "known_ids")
    # written, so its size is known: few ids in a load of new rows, all of them when a load is run again
    unseen = rows.join(F.broadcast(known) if fits_broadcast(known) else known, "id", "left_anti")
    fresh = stage(warehouse.one_per_id(unseen), "fresh")
    fact = warehouse.star_fact(
        fresh,
        spark.read.schema(schemas.USERS).parquet(f"{base}/users"),
        spark.read.schema(schemas.ACTIONS).parquet(f"{base}/actions"),
        read_ip_details(spark, base).drop("version"),
        ti_country,
    )
    (
        fact.withColumn("dt", F.to_date("event_ts")).hint("rebalance", "dt")
        .write.mode("append").partitionBy("dt").parquet(f"{base}/enriched_logs")
    )
    index.add(fresh.select("id"))
