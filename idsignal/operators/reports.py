"""Report queries over scored events, alerts and the warehouse."""

from pyspark.sql import Column, DataFrame, functions as F

from idsignal import fixed_values as fv
from idsignal.functions.explain import entity_message, insight_advice
from idsignal.functions.numeric import known, known_mean, known_sum, ratio, round_half_even, round_half_up, two_decimals
from idsignal.functions.text import capitalize, feed_name, insight_name, or_default
from idsignal.functions.times import printed_time
from idsignal.operators.numbering import group_ordinals
from idsignal.workspace import stage

# -- request analysis -----------------------------------------------------------


def _top(field: Column) -> Column:
    """`field` of the highest risk; the earliest position wins a tie."""
    return F.max_by(field, F.struct(F.col("risk_score"), -F.col("pos")))


def request_summary(alerts: DataFrame) -> DataFrame:
    """Envelope per request; every event is an alert, so both totals agree."""
    return (
        alerts.groupBy("request_id")
        .agg(F.count(F.lit(1)).alias("total_logs"),
             _top(F.struct("pos", "action", "risk_score", "priority")).alias("top"))
        .select(
            "request_id", "total_logs", F.col("total_logs").alias("total_alerts"),
            F.col("top.pos").alias("top_pos"), F.col("top.action").alias("top_action"),
            F.col("top.risk_score").alias("top_risk_score"), F.col("top.priority").alias("top_priority"),
        )
    )


def kpi_cards(alerts: DataFrame) -> DataFrame:
    """Cards per request; rows with null pos stand for a request without events."""
    found = F.col("pos").isNotNull()
    return alerts.groupBy("request_id").agg(
        F.count_if(found).alias("total_logs"),
        F.count_if(found).alias("total_alerts"),
        F.coalesce(F.max(F.when(found, F.col("risk_score"))), F.lit(0)).alias("highest_risk"),
        F.coalesce(F.max_by("priority", F.when(found, F.col("risk_score"))), F.lit(fv.SAFE)).alias("top_priority"),
    )


def ranked_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts with their place `t` in the risk order of their request."""
    return group_ordinals(alerts, "request_id", "risk_score", "pos", "t")


def severity_breakdown(alerts: DataFrame, column: str = "priority") -> DataFrame:
    """Count per level; a level without alerts shows 0."""
    counts = alerts.agg(*[F.count_if(F.col(column) == level).alias(level) for level in fv.PRIORITIES])
    return counts.unpivot([], fv.PRIORITIES, "name", "v")


def action_breakdown(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.col("action").alias("name")).agg(F.count(F.lit(1)).alias("v"))


def breakdown_share(breakdown: DataFrame) -> DataFrame:
    """Add each bar's width in percent of the longest bar."""
    longest = breakdown.agg(F.greatest(F.max("v"), F.lit(1))).scalar()
    return breakdown.withColumn("share", F.col("v") / longest * F.lit(100.0))


# -- alert store ----------------------------------------------------------------


def dashboard_metrics(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_alerts"),
        F.count_if(F.col("severity") == "HIGH").alias("high_alerts"),
    )


def newest_first(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.desc("id"))


def live_feed(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.desc("timestamp"), F.desc("id")).select(
        "id", "timestamp", "src_ip", "event_type", "severity", "risk_score")


# -- warehouse ------------------------------------------------------------------


def warehouse_stats(fact: DataFrame) -> DataFrame:
    """Totals with the mean score at six decimals, shown times 10000."""
    totals = fact.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.upper("prelim_priority") == "HIGH").alias("critical_alerts"),
        F.countDistinct("user_id").alias("unique_users"),
        known_mean(F.col("alert_score")).alias("_mean"),
    )
    shown = round_half_even(F.coalesce(round_half_up(F.col("_mean"), 6), F.lit(0.0)) * F.lit(10000.0), 2)
    return totals.withColumn("avg_risk_score", shown).drop("_mean")


def stats_by_username(fact: DataFrame, users: DataFrame) -> DataFrame:
    """Totals with distinct usernames; rows are summed per user before the join."""
    per_user = fact.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.upper("prelim_priority") == "HIGH").alias("_high"),
        known_sum(F.col("alert_score")).alias("_sum"),
        F.count(known(F.col("alert_score"))).alias("_scored"),
    )
    return (
        per_user.join(users.select("user_id", "username"), "user_id", "left")
        .agg(
            F.coalesce(F.sum("_rows"), F.lit(0)).alias("total_alerts"),
            F.coalesce(F.sum("_high"), F.lit(0)).alias("critical_alerts"),
            F.countDistinct("username").alias("unique_users"),
            round_half_even(ratio(F.sum("_sum"), F.sum("_scored")), 2).alias("avg_risk_score"),
        )
    )


def record_count(fact: DataFrame) -> DataFrame:
    return fact.agg(F.count(F.lit(1)).alias("records_loaded"))


def named(rows: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """A few written rows with their row of a dimension of any size, which is not shuffled:
    the rows' keys are sent to it, what is left of it is sent back."""
    wanted = dim.join(F.broadcast(rows.select(key).distinct()), key, "left_semi")
    return rows.join(F.broadcast(wanted), key, "left")


def _with_names(rows: DataFrame, users: DataFrame, actions: DataFrame, ips: DataFrame) -> DataFrame:
    rows = stage(rows, "latest")
    rows = named(rows, users.select("user_id", "username"), "user_id")
    rows = named(rows, actions.select("action_id", F.col("action_name").alias("action")), "action_id")
    return named(rows, ips.select("ip_id", "src_ip"), "ip_id")


def alerts_feed(fact: DataFrame, users: DataFrame, actions: DataFrame, ips: DataFrame, limit: int = 100) -> DataFrame:
    """Latest alerts by time, undated first. The few kept rows are joined, not the fact."""
    order = [F.desc_nulls_first("event_ts"), F.desc("id")]
    latest = fact.select("id", "event_ts", "user_id", "action_id", "ip_id", "prelim_priority", "alert_score")
    latest = latest.orderBy(*order).limit(limit)
    return _with_names(latest, users, actions, ips).orderBy(*order).select(
        "id",
        F.coalesce(printed_time(F.col("event_ts")), F.lit(fv.DASH)).alias("timestamp"),
        feed_name(F.col("username")).alias("user"),
        or_default(F.col("action"), fv.DASH).alias("action"),
        or_default(F.col("prelim_priority"), "LOW").alias("prelim_priority"),
        F.coalesce("alert_score", F.lit(0.0)).alias("alert_score"),
        or_default(F.col("src_ip"), fv.DASH).alias("src_ip"),
    )


def alerts_latest(fact: DataFrame, users: DataFrame, actions: DataFrame, ips: DataFrame, limit: int = 100) -> DataFrame:
    latest = fact.select(
        "id", "user_id", "action_id", "ip_id", "result", "alert_score", "prelim_priority", "ti_country", "ti_asn"
    ).orderBy(F.desc("id")).limit(limit)
    return _with_names(latest, users, actions, ips).orderBy(F.desc("id")).select(
        "id", F.col("username").alias("user"), "action", "src_ip", "result",
        "alert_score", "prelim_priority", "ti_country", "ti_asn",
    )


def logs_latest(logs: DataFrame, limit: int = 50) -> DataFrame:
    return logs.orderBy(F.desc_nulls_first("event_ts"), F.desc("id")).limit(limit)


def daily_trend(logs: DataFrame) -> DataFrame:
    """Per day: alerts and the mean of non-zero scores (0 when there is none)."""
    days = _day_totals(logs.where(F.col("event_ts").isNotNull()), [])
    return _trend_output(days, []).orderBy("day")


def _day_totals(logs: DataFrame, extra: list[str]) -> DataFrame:
    score = known(F.col("alert_score"))
    scored = F.when(score != 0, score)
    return logs.groupBy(*extra, F.date_format("event_ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("_n"), known_sum(scored).alias("_sum"), F.count(scored).alias("_scored"))


def _trend_output(totals: DataFrame, extra: list[str]) -> DataFrame:
    mean = round_half_up(ratio(F.col("_sum"), F.col("_scored")), 2)
    return totals.select(*extra, "day", F.col("_n").alias("alert_count"), F.coalesce(mean, F.lit(0.0)).alias("avg_risk"))


RANGES = {"24h": "1 day", "7d": "7 days", "30d": "30 days", "365d": "12 months"}


def trend_since(logs: DataFrame, span: str = "30d", as_of: Column | None = None) -> DataFrame:
    """The daily trend over one span before `as_of` (default: the newest event).

    Logs partitioned by a `dt` column are read only for the days of the span.
    """
    now = as_of if as_of is not None else logs.agg(F.max("event_ts")).scalar()
    since = now - F.expr(f"interval {RANGES[span]}")
    recent = logs.where(F.col("event_ts") >= since)
    if "dt" in logs.columns:
        recent = recent.where(F.col("dt") >= F.to_date(since))
    return daily_trend(recent)


def trend_window(logs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The daily trend over all spans at once.

    The spans nest, so each row is counted once under the shortest span that
    holds it and the small day table is then added up per span.
    """
    now = as_of if as_of is not None else logs.agg(F.max("event_ts")).scalar()
    names = list(RANGES)
    recent = logs.select("event_ts", "alert_score").where(
        F.col("event_ts") >= now - F.expr(f"interval {RANGES[names[-1]]}"))
    step = F.lit(len(names) - 1)
    for place in reversed(range(len(names) - 1)):
        inside = F.col("event_ts") >= F.col("_now") - F.expr(f"interval {RANGES[names[place]]}")
        step = F.when(inside, place).otherwise(step)
    totals = _day_totals(recent.withColumn("_now", now).withColumn("_step", step), ["_step"])
    labels = F.array(*[F.lit(name) for name in names])
    widened = totals.select(
        F.explode(F.slice(labels, F.col("_step") + 1, F.lit(len(names)))).alias("range"),
        "day", "_n", "_sum", "_scored")
    summed = widened.groupBy("range", "day").agg(*[F.sum(c).alias(c) for c in ("_n", "_sum", "_scored")])
    return _trend_output(summed, ["range"]).orderBy("range", "day")


# -- findings -------------------------------------------------------------------


def top_high_users(logs: DataFrame, limit: int = 5) -> DataFrame:
    """Users with most HIGH alerts (rows without a score do not count)."""
    return (
        logs.where((F.upper("prelim_priority") == "HIGH") & F.col("user").isNotNull())
        .groupBy("user").agg(F.count(known(F.col("alert_score"))).alias("high_alerts"))
        .orderBy(F.desc("high_alerts"), "user").limit(limit)
    )


def top_risky_ips(logs: DataFrame, limit: int = 5) -> DataFrame:
    """Addresses of the highest mean score, to twelve decimals so that its last bit ranks nothing."""
    return (
        logs.where(F.col("src_ip").isNotNull())
        .groupBy("src_ip").agg(F.round(known_mean(F.col("alert_score")), 12).alias("mean_score"))
        .orderBy(F.desc_nulls_last("mean_score"), "src_ip").limit(limit)
    )


def top_findings(logs: DataFrame) -> DataFrame:
    """User findings, then address findings; one message row when there are no logs."""
    users = top_high_users(logs).select(
        "user",
        F.concat(F.col("high_alerts").cast("string"), F.lit(" high-priority alerts detected for "), "user").alias("finding"),
    )
    ips = top_risky_ips(logs).select(
        F.col("src_ip").alias("ip"),
        F.concat(F.lit("IP "), "src_ip", F.lit(" shows avg alert score "),
                 F.coalesce(two_decimals(F.col("mean_score")), F.lit("nan"))).alias("finding"),
    )
    found = users.unionByName(ips, allowMissingColumns=True).withColumn("message", F.lit(None).cast("string"))
    return or_placeholder(found, logs, {"message": fv.NO_FINDINGS})


def or_placeholder(result: DataFrame, source: DataFrame, values: dict[str, str]) -> DataFrame:
    """`result`, or one row of `values` when `source` has no rows."""
    empty = source.limit(1).agg(F.count(F.lit(1))).scalar() == 0
    row = result.sparkSession.range(1).select(
        *[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in result.schema.fields])
    return result.unionByName(row.where(empty))


def finding_recommendations(findings: DataFrame) -> DataFrame:
    is_user = F.col("user").isNotNull()
    target = F.coalesce("user", "ip")
    return findings.where(target.isNotNull()).select(
        F.when(is_user, "user").otherwise("ip").alias("type"),
        target.alias("target"),
        F.when(is_user, F.concat(F.lit("Review login activity for "), target))
        .otherwise(F.concat(F.lit("Investigate IP "), target, F.lit(" for repeated alerts"))).alias("recommendation"),
    )


def entity_insights(logs: DataFrame) -> DataFrame:
    """Mean score per user with a message, riskiest first."""
    return (
        logs.where(F.col("user").isNotNull())
        .groupBy("user").agg(known_mean(F.col("alert_score")).alias("_mean"))
        .where(F.col("_mean").isNotNull())
        .select(
            capitalize(F.col("user")).alias("entity"),
            round_half_even(F.col("_mean"), 2).alias("risk_score"),
            entity_message(F.col("_mean")).alias("summary"),
        )
        .orderBy(F.desc("risk_score"), "entity")
    )


def agentic_insights(fact: DataFrame, users: DataFrame, limit: int = 100) -> DataFrame:
    """Advice for the highest scores, or one placeholder row; only the kept rows are joined."""
    top = (
        fact.where(F.col("alert_score").isNotNull())
        .select("id", "user_id", "alert_score", "prelim_priority", "ti_country")
        .orderBy(F.desc("alert_score"), "id").limit(limit)
    )
    found = named(stage(top, "highest"), users.select("user_id", "username"), "user_id")
    user = insight_name(F.col("username"))
    advice = found.orderBy(F.desc("alert_score"), "id").select(
        "id",
        user.alias("user"),
        insight_advice(
            user, F.col("alert_score"), or_default(F.col("prelim_priority"), "LOW"),
            or_default(F.col("ti_country"), "Unknown"),
        ).alias("recommendation"),
    )
    scored = fact.where(F.col("alert_score").isNotNull()).select("id")
    return or_placeholder(advice, scored, {"user": fv.NO_INSIGHTS[0], "recommendation": fv.NO_INSIGHTS[1]})
