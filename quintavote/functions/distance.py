"""Distances between array columns, unrolled so that they stay in generated code.

Columns are given by name; the expressions are written as SQL text because a
64-wide vector unrolls to several hundred operators.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_of_squares(terms: list[str]) -> str:
    return " + ".join(f"({term}) * ({term})" for term in terms)


def dist_int(left: str, right: str, dim: int) -> Column:
    """Squared distance of two code arrays as BIGINT."""
    return F.expr(
        sum_of_squares(
            [f"CAST({left}[{i}] AS BIGINT) - CAST({right}[{i}] AS BIGINT)" for i in range(dim)]
        )
    )


def dist_f64(left: str, right: str, dim: int) -> Column:
    """Squared distance of two double arrays."""
    return F.expr(sum_of_squares([f"{left}[{i}] - {right}[{i}]" for i in range(dim)]))


def norm_sq(vector: str, dim: int) -> Column:
    return F.expr(sum_of_squares([f"{vector}[{i}]" for i in range(dim)]))


def centroid_score(query: str, centroid: str, norm: str, dim: int) -> Column:
    """Ranks centroids like the distance does: the query's own norm is left out."""
    dot = " + ".join(f"{centroid}[{i}] * {query}[{i}]" for i in range(dim))
    return F.expr(f"{norm} - 2D * ({dot})")
