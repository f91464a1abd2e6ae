"""Sentences and recommendations derived from scores."""

from pyspark.sql import Column, DataFrame, functions as F

from idsignal import fixed_values as fv


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(value) for value in values])


def recommendations(priority: Column) -> Column:
    chosen = _texts(fv.DEFAULT_RECOMMENDATIONS)
    for level, advice in fv.RECOMMENDATIONS.items():
        chosen = F.when(priority == level, _texts(advice)).otherwise(chosen)
    return chosen


def summary(priority: Column, user: Column, action: Column, src_ip: Column) -> Column:
    return F.concat(
        priority, F.lit(" alert detected for user "), user,
        F.lit(". Action: "), action, F.lit(". Source IP: "), src_ip, F.lit("."),
    )


def with_explanation(alerts: DataFrame) -> DataFrame:
    """Add explanation{summary, recommendations} to scored events."""
    return alerts.withColumn(
        "explanation",
        F.struct(
            summary(F.col("priority"), F.col("user"), F.col("action"), F.col("src_ip")).alias("summary"),
            recommendations(F.col("priority")).alias("recommendations"),
        ),
    )


def entity_message(score: Column) -> Column:
    (high, high_text), (raised, raised_text) = fv.ENTITY_STEPS
    return F.when(score > high, high_text).when(score > raised, raised_text).otherwise(fv.ENTITY_NORMAL)


def insight_advice(user: Column, score: Column, priority: Column, country: Column) -> Column:
    def wrapped(pattern, *values):
        parts = [F.lit(pattern[0])]
        for value, tail in zip(values, pattern[1:]):
            parts += [value, F.lit(tail)]
        return F.concat(*parts)

    return (
        F.when(score > 0.8, wrapped(fv.LOCKDOWN_ADVICE, user))
        .when(F.upper(priority) == "HIGH", wrapped(fv.REVIEW_ADVICE, user, country))
        .otherwise(wrapped(fv.NORMAL_ADVICE, user))
    )
