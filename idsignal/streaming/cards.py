"""Every dashboard card as running state: what the batch reports say, refreshed with each micro-batch.

A fact row adds to one mergeable total per card it belongs to: all rows, its user, its day, its
priority, its action. Structured Streaming keeps these totals as state (rows, HIGH rows, sum, count
and maximum of the scores) and hands out the ones a batch has changed; they are stored as the newest
version of their key. Distinct users are the keys there are, so they merge without being counted
again. Reports read the totals, never the facts. The lists of highest and newest rows are kept
beside them: the best of the lists so far and the batch take their place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from idsignal.functions.numeric import known, ratio, round_half_even, round_half_up
from idsignal.operators.reports import _trend_output
from idsignal.streaming.alerts import REFRESH, _start
from idsignal.streaming.tables import StreamTable

TOTALS = T.StructType([
    T.StructField("card", T.StringType()), T.StructField("key", T.StringType()), T.StructField("rows", T.LongType()),
    T.StructField("high", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("scored", T.LongType()),
    T.StructField("nonzero", T.LongType()), T.StructField("top", T.DoubleType()), T.StructField("batch_id", T.LongType())])
KEYS = ["card", "key"]
CARDS = ["all", "user", "day", "priority", "action"]
LIST_ROWS = 100


def card_rows(facts: DataFrame) -> DataFrame:
    """A row per fact and card: facts have user_id, action_id, event_ts, prelim_priority and alert_score."""
    keys = [F.lit(""), F.col("user_id").cast("string"), F.date_format("event_ts", "yyyy-MM-dd"), F.col("prelim_priority"), F.col("action_id").cast("string")]
    sides = F.array(*[F.struct(F.lit(card).alias("card"), key.alias("key")) for card, key in zip(CARDS, keys)])
    return facts.select("prelim_priority", "alert_score", F.explode(sides).alias("side")).select("side.*", "prelim_priority", "alert_score")


def totals(rows: DataFrame) -> DataFrame:
    """Totals per card and key; on a stream these are its state. A null key is a key of its own."""
    score = known(F.col("alert_score"))
    return rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.upper("prelim_priority") == "HIGH").alias("high"), F.sum(score).alias("total"),
        F.count(score).alias("scored"), F.count_if(score != 0).alias("nonzero"), F.max(score).alias("top"))


def totals_table(spark: SparkSession, path: str) -> StreamTable:
    return StreamTable(spark, path, TOTALS, KEYS)


def start_cards(facts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the totals of a stream of facts in the table at `path`, changed ones only, every 30 seconds."""

    def process(batch: DataFrame, batch_id: int) -> None:
        table = totals_table(batch.sparkSession, path)
        table.append(batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")), batch_id)
        table.compact()

    return _start(totals(card_rows(facts)), process, checkpoint, trigger or REFRESH, "update")


def best_rows(rows: DataFrame, limit: int) -> DataFrame:
    """(list, place) with the `limit` highest scores and the `limit` newest rows; ties by smaller id."""
    scored = rows.where(known(F.col("alert_score")).isNotNull()).orderBy(F.desc("alert_score"), "id").limit(limit).withColumn("list", F.lit("highest"))
    newest = rows.where("event_ts is not null").orderBy(F.desc("event_ts"), "id").limit(limit).withColumn("list", F.lit("newest"))
    return scored.unionByName(newest)


def start_lists(facts: DataFrame, path: str, checkpoint: str, schema: T.StructType, trigger: dict | None = None, limit: int = LIST_ROWS) -> StreamingQuery:
    """Keep the highest and the newest rows of a stream: each batch replaces the lists by the best of them and itself."""
    stored = T.StructType([*schema.fields, T.StructField("list", T.StringType()), T.StructField("batch_id", T.LongType())])

    def process(batch: DataFrame, batch_id: int) -> None:
        table = StreamTable(batch.sparkSession, path, stored)
        if table.has(batch_id):
            return
        before = table.read().drop("batch_id")
        rows = batch.select(*schema.fieldNames())
        merged = None
        for name in ("highest", "newest"):
            both = before.where(F.col("list") == name).drop("list").unionByName(best_rows(rows, limit).where(F.col("list") == name).drop("list"))
            best = best_rows(both, limit).where(F.col("list") == name)
            merged = best if merged is None else merged.unionByName(best)
        table.append(merged.withColumn("batch_id", F.lit(batch_id).cast("bigint")), batch_id, instead=True)

    return _start(facts, process, checkpoint, trigger or REFRESH, "append")


def latest_lists(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The lists as of the newest batch."""
    stored = T.StructType([*schema.fields, T.StructField("list", T.StringType()), T.StructField("batch_id", T.LongType())])
    return StreamTable(spark, path, stored).read().drop("batch_id")


# -- reports from the totals ------------------------------------------------------


def of(kept: DataFrame, card: str) -> DataFrame:
    return kept.where(F.col("card") == card)


def stats(kept: DataFrame) -> DataFrame:
    """`reports.warehouse_stats` from the totals: one row, zeros before the first batch."""
    def one(name: str):
        return F.max(F.when(F.col("card") == "all", F.col(name)))

    mean = ratio(one("total"), one("scored"))
    shown = round_half_even(F.coalesce(round_half_up(F.col("_mean"), 6), F.lit(0.0)) * F.lit(10000.0), 2)
    return kept.agg(
        F.coalesce(one("rows"), F.lit(0)).alias("total_alerts"), F.coalesce(one("high"), F.lit(0)).alias("critical_alerts"),
        F.count_if((F.col("card") == "user") & F.col("key").isNotNull()).alias("unique_users"), mean.alias("_mean"),
    ).withColumn("avg_risk_score", shown).drop("_mean")


def trend(kept: DataFrame) -> DataFrame:
    """`reports.daily_trend` from the totals."""
    days = of(kept, "day").where(F.col("key").isNotNull())
    per_day = days.select(F.col("key").alias("day"), F.col("rows").alias("_n"), F.when(F.col("nonzero") > 0, F.col("total")).alias("_sum"),
                          F.col("nonzero").alias("_scored"))
    return _trend_output(per_day, []).orderBy("day")


def breakdown(kept: DataFrame, card: str) -> DataFrame:
    return of(kept, card).select(F.col("key").alias("name"), F.col("rows").alias("v"))


def top_keys(kept: DataFrame, card: str, limit: int = 5) -> DataFrame:
    """The keys with most HIGH rows."""
    return of(kept, card).where("key is not null and high > 0").orderBy(F.desc("high"), "key").limit(limit).select(F.col("key").alias("name"), "high")


def all_cards(kept: DataFrame) -> DataFrame:
    """Every card in one table: card, name, rows, value (the mean or highest score the card shows)."""
    total = stats(kept).select(F.lit("stats").alias("card"), F.explode(F.create_map(
        F.lit("total_alerts"), F.col("total_alerts").cast("double"), F.lit("critical_alerts"), F.col("critical_alerts").cast("double"),
        F.lit("unique_users"), F.col("unique_users").cast("double"), F.lit("avg_risk_score"), F.col("avg_risk_score"))).alias("name", "value"))
    rows = [
        total.select("card", "name", F.lit(None).cast("bigint").alias("v"), "value"),
        trend(kept).select(F.lit("trend").alias("card"), F.col("day").alias("name"), F.col("alert_count").alias("v"), F.col("avg_risk").alias("value")),
        of(kept, "priority").select("card", F.col("key").alias("name"), F.col("rows").alias("v"), F.col("top").alias("value")),
        of(kept, "action").select("card", F.col("key").alias("name"), F.col("rows").alias("v"), F.col("top").alias("value")),
        top_keys(kept, "user").select(F.lit("top_users").alias("card"), "name", F.col("high").alias("v"), F.lit(None).cast("double").alias("value")),
    ]
    found = rows[0]
    for more in rows[1:]:
        found = found.unionByName(more)
    return found
