"""Ranking clusters for each query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quintavote.functions.kernels import in_some_box, rank_centroids, score_range, to_matrix
from quintavote.operators.clustering import CentroidTable


def with_probes(queries: DataFrame, centroids: CentroidTable, n: int) -> DataFrame:
    """Add ``probes``: the ids of the ``n`` best clusters, best first.

    Map-only, from the unquantised vector.  One row per query goes in and comes
    out, whatever the number of clusters.
    """
    table, dim = centroids.broadcast(), centroids.dim
    n = min(n, centroids.size)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def rank(vectors: pa.Array) -> pa.Array:
        ids, matrix, norms = table.value
        ranked = ids[rank_centroids(to_matrix(vectors, dim), matrix, norms, n)]
        offsets = np.arange(0, ranked.size + 1, n, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ranked.ravel()))

    return queries.withColumn("probes", rank("vector"))


def probe_rows(ranked: DataFrame, first: int, last: int, *more: str) -> DataFrame:
    """One row per query and probe, for probe ranks ``first``..``last``; ``more`` columns are kept."""
    kept = [name for name in ("query_id", "codes", "bound", *more) if name in ranked.columns]
    wanted = F.slice("probes", first, last - first + 1)
    # A null is a probe that was found to be out of reach.
    return ranked.select(*kept, F.posexplode(wanted)).where("col IS NOT NULL").select(
        *kept,
        (F.col("pos") + first).alias("probe_rank"),
        F.col("col").alias("cluster_id"),
    )


def within_reach(ranked: DataFrame, boxes: Broadcast, dim: int) -> DataFrame:
    """Null those of ``probes`` whose cluster holds nothing within ``bound``.

    ``boxes`` holds ids in order, where the boxes of each begin and end, and the boxes' least and
    largest codes; a cluster that it does not name has no members.  Map-only; ranks stay as they are.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def reach(probes: pa.Array, codes: pa.Array, bound: pa.Array) -> pa.Array:
        ids, starts, least, largest = boxes.value
        wanted = probes.flatten().to_numpy()
        lengths = np.diff(probes.offsets.to_numpy())
        rows = np.repeat(np.arange(len(probes)), lengths)
        at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
        bounds = bound.to_numpy(zero_copy_only=False).astype(np.float64)
        named = np.flatnonzero(ids[at] == wanted)
        gone = np.ones(len(wanted), dtype=bool)
        gone[named] = ~in_some_box(to_matrix(codes, dim), bounds, rows[named], at[named], starts, least, largest)
        offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(wanted, mask=gone))

    return ranked.withColumn("probes", reach("probes", "codes", "bound"))


def centroid_coverage(queries: DataFrame, centroids: CentroidTable) -> DataFrame:
    """Score every query against every centroid and summarise per query.

    Returns query_id, centroids_scored, best_score and worst_score.  The scores
    live in the Arrow batch only; the pairs are never rows.
    """
    table, dim = centroids.broadcast(), centroids.dim
    result = T.StructType(
        [
            T.StructField("centroids_scored", T.IntegerType()),
            T.StructField("best_score", T.DoubleType()),
            T.StructField("worst_score", T.DoubleType()),
        ]
    )

    @F.arrow_udf(result)
    def summarise(vectors: pa.Array) -> pa.Array:
        _, matrix, norms = table.value
        scored, best, worst = score_range(to_matrix(vectors, dim), matrix, norms)
        return pa.StructArray.from_arrays(
            [pa.array(scored), pa.array(best), pa.array(worst)], names=result.names
        )

    summary = queries.withColumn("_s", summarise("vector"))
    return summary.select(
        "query_id", *[F.col(f"_s.{name}").alias(name) for name in result.names]
    )
