"""Vector-similarity fraud scoring as Spark DataFrame operators.

Transactions become 14-dimensional vectors, each vector's five nearest
labelled neighbours vote, and the vote becomes an approval decision.  Every
public function takes and returns DataFrames and composes through
``df.transform(...)``.
"""

from quintavote.config import (
    DIM,
    MCC_DEFAULT_RISK,
    NEIGHBOURS,
    SCALE,
    BuildParams,
    Normalization,
    ProbeParams,
)

__all__ = [
    "DIM",
    "MCC_DEFAULT_RISK",
    "NEIGHBOURS",
    "SCALE",
    "BuildParams",
    "Normalization",
    "ProbeParams",
]
