"""Maps between score scales."""

from pyspark.sql import Column, functions as F

from idsignal import fixed_values as fv


def reputation_score(confidence: Column) -> Column:
    """Abuse confidence 0-100 to 1, 3, 6, 8 or 10; no record counts as confidence 0."""
    known = F.coalesce(confidence, F.lit(0))
    (below, score), *steps = fv.REPUTATION_STEPS
    mapped = F.when(known < below, score)
    for below, score in steps:
        mapped = mapped.when(known < below, score)
    return mapped.otherwise(fv.REPUTATION_TOP)


def fusion_bucket(probability: Column) -> Column:
    (name, above), *steps = fv.FUSION_STEPS
    bucket = F.when(probability > above, name)
    for name, above in steps:
        bucket = bucket.when(probability > above, name)
    return bucket.otherwise(fv.LOWEST_PRIORITY)


def priority_code(name: Column) -> Column:
    """0-3 for the four exact upper-case names, 0 for anything else."""
    code = F.when(name.isNull(), 0)
    for level, number in fv.PRIORITY_CODES:
        code = code.when(name == level, number)
    return code.otherwise(0)
