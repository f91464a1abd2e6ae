"""Star schema: dimensions, upserts, facts, contract checks."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from idsignal.operators.lookup import lookup
from idsignal.operators.numbering import dense_ids
from idsignal.workspace import stage


def _next_id(existing: DataFrame, id_name: str):
    return F.coalesce(existing.agg(F.max(id_name)).scalar(), F.lit(0))


def distinct_keys(rows: DataFrame, column: str, name: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).select(F.col(column).alias(name)).distinct()


def new_dimension(rows: DataFrame, column: str, name: str, id_name: str) -> DataFrame:
    """Dimension of the distinct non-null values of `column`, numbered from 1."""
    return dense_ids(distinct_keys(rows, column, name), name, id_name)


def first_per_ip(rows: DataFrame, order: str) -> DataFrame:
    """src_ip with the country and ti_score of its first row by `order`."""
    return (
        rows.where(F.col("src_ip").isNotNull())
        .groupBy("src_ip")
        .agg(F.min_by(F.struct("country", "ti_score"), order).alias("_first"))
        .select("src_ip", "_first.country", "_first.ti_score")
    )


def new_ip_dimension(rows: DataFrame, order: str) -> DataFrame:
    return dense_ids(first_per_ip(rows, order), "src_ip", "ip_id")


def fresh_rows(existing: DataFrame, incoming: DataFrame, key: str, id_name: str) -> DataFrame:
    """Incoming rows whose key is new, with ids after the highest existing one."""
    columns = [c for c in existing.columns if c != id_name]
    unseen = incoming.select(*columns).join(existing.select(key), key, "left_anti")
    return dense_ids(unseen, key, id_name, _next_id(existing, id_name)).select(*existing.columns)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str, id_name: str) -> DataFrame:
    """Existing rows plus the incoming keys they lack; on conflict nothing changes."""
    return existing.unionByName(fresh_rows(existing, incoming, key, id_name))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, id_name: str) -> DataFrame:
    """As insert_if_absent, but on conflict every other column takes the incoming value, nulls too."""
    values = [c for c in existing.columns if c not in (key, id_name)]
    new_side = incoming.select(
        key, *[F.col(c).alias(f"_new_{c}") for c in values], F.lit(True).alias("_matched")
    )
    updated = existing.join(new_side, key, "left").select(
        id_name, key,
        *[F.when(F.col("_matched"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in values],
    )
    return updated.unionByName(fresh_rows(existing, incoming, key, id_name))


def changed_rows(existing: DataFrame, incoming: DataFrame, key: str, id_name: str) -> DataFrame:
    """What an upsert changes: known keys with another value, and new keys."""
    values = [c for c in existing.columns if c not in (key, id_name)]
    new_side = incoming.select(key, F.struct(*values).alias("_new"))
    met = existing.withColumn("_old", F.struct(*values)).drop(*values).join(new_side, key)
    other = met.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(id_name, key, *[F.col(f"_new.{c}").alias(c) for c in values])
    return other.select(*existing.columns).unionByName(fresh_rows(existing, incoming, key, id_name))


def one_per_id(logs: DataFrame, id_name: str = "id", order: str = "event_ts") -> DataFrame:
    """One row per id: the earliest by `order` (undated last), then by the other columns in turn."""
    rest = [c for c in logs.columns if c not in (id_name, order)]
    first = F.min(F.struct(F.col(order).isNull().alias("_undated"), order, *rest)).alias("_first")
    return logs.groupBy(id_name).agg(first).select(id_name, "_first.*").select(*logs.columns)


def with_ids(logs: DataFrame, id_name: str = "id") -> DataFrame:
    """`logs` with an id for every row: one that has none gets a negative id of its own.

    It follows from what the row holds and how many rows like it came before, so equal rows get
    different ids and a second load of the same rows gives the same ids again. It has 63 bits: two of
    n such rows share one with a chance of n * n / 2^64 (one in 18 for a thousand million).
    Equal rows are counted, not shuffled.
    """
    values = [c for c in logs.columns if c != id_name]
    alike = logs.where(F.col(id_name).isNull()).groupBy(*values).agg(F.count(F.lit(1)).alias("_n"))
    counted = alike.withColumn("_place", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))))
    named = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in values]  # names keep nulls of different columns apart
    made = F.lit(-1) - F.shiftrightunsigned(F.xxhash64(*named, "_place"), 1)
    given = logs.where(F.col(id_name).isNotNull())
    return given.unionByName(counted.withColumn(id_name, made.cast(logs.schema[id_name].dataType)).select(*logs.columns))


def loadable(logs: DataFrame) -> DataFrame:
    """Rows that have all three keys."""
    return logs.where(F.col("user").isNotNull() & F.col("action").isNotNull() & F.col("src_ip").isNotNull())


def star_fact(logs: DataFrame, users: DataFrame, actions: DataFrame, ips: DataFrame,
              ti_country: str = "country") -> DataFrame:
    """Fact rows whose user, action and address are all in the dimensions.

    Dimensions should be written tables: each is measured and then joined. Addresses,
    the largest, come last, after the joins most likely to need no shuffle.
    """
    keyed = loadable(logs)
    fact = keyed.select("id", "event_ts", "user", "action", "src_ip", "result", "result_flag",
                        "alert_score", "prelim_priority", F.col(ti_country).alias("ti_country"))
    for dim, key in [
        (actions.select("action_id", F.col("action_name").alias("action")), "action"),
        (users.select("user_id", F.col("username").alias("user")), "user"),
        (ips.select("ip_id", "src_ip"), "src_ip"),
    ]:
        fact = lookup(fact, dim, key, "id", "inner", count_on=keyed).drop(key)
    return fact.select("id", "event_ts", "user_id", "action_id", "ip_id", "result", "result_flag",
                       "alert_score", "prelim_priority", "ti_country")


def missing_keys(logs: DataFrame, users: DataFrame, actions: DataFrame, ips: DataFrame, samples: int = 10) -> DataFrame:
    """Per dimension: rows that found no key, distinct missing keys and the first few of them."""
    dims = [("user", users, "username"), ("action", actions, "action_name"), ("src_ip", ips, "src_ip")]
    reports = []
    for column, dim, name in dims:
        known = dim.select(F.col(name).alias("_key"), F.lit(True).alias("_known"))
        per_key = logs.groupBy(F.col(column).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
        checked = per_key.join(known, "_key", "left")
        unknown = F.col("_known").isNull() & F.col("_key").isNotNull()
        sample = (
            checked.where(unknown).orderBy("_key").limit(samples)
            .agg(F.array_join(F.sort_array(F.collect_list("_key")), ",")).scalar()
        )
        reports.append(checked.agg(
            F.lit(column).alias("dimension"),
            F.coalesce(F.sum("_n"), F.lit(0)).alias("incoming_rows"),
            F.coalesce(F.sum(F.when(F.col("_known"), F.col("_n"))), F.lit(0)).alias("matched_rows"),
            F.coalesce(F.sum(F.when(F.col("_key").isNull(), F.col("_n"))), F.lit(0)).alias("null_rows"),
            F.count_if(unknown).alias("missing_keys"),
        ).withColumn("sample_keys", sample))
    return reduce(DataFrame.unionByName, reports)


def flat_projection(logs: DataFrame) -> DataFrame:
    return logs.select("src_ip", "ti_score", "ti_country", "ti_asn", "alert_score", "prelim_priority")


def _key_rules(counts: DataFrame, name: str, column: str) -> DataFrame:
    """Repeated keys and null rows of a key column, from its row count `_n` per key."""
    null = F.col(column).isNull()
    found = counts.agg(
        F.count_if((F.col("_n") > 1) & ~null).alias("unique"),
        F.coalesce(F.sum(F.when(null, F.col("_n"))), F.lit(0)).alias("not null"),
    )
    return found.unpivot([], ["unique", "not null"], "rule", "violations").select(
        F.lit(f"{name}.{column}").alias("target"), "rule", "violations")


def _per_key(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))


def _orphans(counts: DataFrame, column: str, dim: DataFrame) -> DataFrame:
    """Fact rows with a key the dimension lacks, from the row count `_n` per key."""
    return counts.where(F.col(column).isNotNull()).join(dim.select(column), column, "left_anti").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("violations")
    ).select(F.lit(f"enriched_logs.{column}").alias("target"), F.lit("foreign key").alias("rule"), "violations")


def constraint_report(fact: DataFrame, users: DataFrame, actions: DataFrame, ips: DataFrame) -> DataFrame:
    """Violations of the UNIQUE, NOT NULL and foreign-key rules, one row per rule."""
    dims = [
        ("users", users, "user_id", "username"),
        ("actions", actions, "action_id", "action_name"),
        ("ip_details", ips, "ip_id", "src_ip"),
    ]
    # one pass over the fact: a row per (column, key) with its count, written once
    columns = ["id", *[id_name for _, _, id_name, _ in dims]]
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("bigint").alias("key")) for c in columns])).alias("side")
    counted = stage(fact.select(sides).groupBy("side.column", "side.key").agg(F.count(F.lit(1)).alias("_n")), "key_counts")

    def of(column: str) -> DataFrame:
        return counted.where(F.col("column") == column).select(F.col("key").alias(column), "_n")

    checks = [_key_rules(of("id"), "enriched_logs", "id")]
    for name, dim, id_name, key in dims:
        checks += [_key_rules(_per_key(dim, id_name), name, id_name), _key_rules(_per_key(dim, key), name, key), _orphans(of(id_name), id_name, dim)]
    return reduce(DataFrame.unionByName, checks)
