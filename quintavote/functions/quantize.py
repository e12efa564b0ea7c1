"""Fixed-point codes: integer distances are the same on every engine and retry.

Whole vectors go through ``transform``.  Unrolled, fourteen or more roundings
make one generated method too long for the JVM to compile, and it then runs
interpreted, several times slower.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quintavote.config import SCALE

# Largest magnitude whose code still fits sixteen bits.
MAX_REFERENCE_MAGNITUDE = 3.2767
# The number below a half: added and cut off it rounds halves up, as ``round`` does, which goes by
# way of a decimal number where it is interpreted.
_HALF = "0.49999999999999994D"


def _query_code(value: str) -> str:
    clamped = f"least(1D, greatest(0D, {value}))"
    return (
        f"CAST(CASE WHEN {value} <= -0.999D THEN -{SCALE} "
        f"ELSE {clamped} * {SCALE}D + {_HALF} END AS SMALLINT)"
    )


def _reference_code(value: str) -> str:
    return (
        f"CAST(CASE WHEN abs({value}) <= {MAX_REFERENCE_MAGNITUDE}D "
        f"THEN {value} * {SCALE}D + CASE WHEN {value} < 0D THEN -{_HALF} ELSE {_HALF} END END AS SMALLINT)"
    )


def query_code(column: str) -> Column:
    """Absent (<= -0.999) keeps its own code; everything else is clamped first."""
    return F.expr(_query_code(column))


def reference_code(column: str) -> Column:
    """Rounded half away from zero, not clamped; null when it would not fit."""
    return F.expr(_reference_code(column))


def query_codes(vector: str) -> Column:
    return F.expr(f"transform({vector}, v -> {_query_code('v')})")


def reference_codes(vector: str) -> Column:
    return F.expr(f"transform({vector}, v -> {_reference_code('v')})")
