"""Decision and evaluation formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quintavote.config import BORDERLINE_VOTES, DENY_FROM_VOTES, NEIGHBOURS

# Fixed values of the evaluation formulas.
SCORE_UNIT = 1_000.0
P99_FULL_MARKS_MS = 1.0
P99_REFERENCE_MS = 1_000.0
P99_CUT_MS = 2_000.0
P99_CUT_SCORE = -3_000.0
ERROR_RATE_FLOOR = 0.001
PENALTY_WEIGHT = 300.0
FAILURE_RATE_CUT = 0.15
DETECTION_CUT_SCORE = -3_000.0
FALSE_POSITIVE_WEIGHT = 1
FALSE_NEGATIVE_WEIGHT = 3
ERROR_WEIGHT = 5


def fraud_score(votes: Column) -> Column:
    return votes / F.lit(float(NEIGHBOURS))


def approved(votes: Column) -> Column:
    """Compared on the count: 3 / 5 is not a safe float comparison."""
    return votes < F.lit(DENY_FROM_VOTES)


def is_borderline(votes: Column) -> Column:
    return votes.isin(*BORDERLINE_VOTES)


def latency_score(p99: Column) -> Column:
    floor = F.greatest(p99, F.lit(P99_FULL_MARKS_MS))
    return (
        # Nothing measured scores nothing.
        F.when(p99.isNull() | (p99 <= 0), F.lit(0.0))
        .when(p99 > P99_CUT_MS, F.lit(P99_CUT_SCORE))
        .otherwise(F.lit(SCORE_UNIT) * F.log10(F.lit(P99_REFERENCE_MS) / floor))
    )


def detection_cut(failure_rate: Column) -> Column:
    return failure_rate > F.lit(FAILURE_RATE_CUT)


def rate_component(error_rate: Column) -> Column:
    floor = F.greatest(error_rate, F.lit(ERROR_RATE_FLOOR))
    return F.lit(SCORE_UNIT) * F.log10(F.lit(1.0) / floor)


def absolute_penalty(weighted_errors: Column) -> Column:
    return F.lit(-PENALTY_WEIGHT) * F.log10(F.lit(1.0) + weighted_errors)


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.try_divide(part, whole)).otherwise(F.lit(0.0))
