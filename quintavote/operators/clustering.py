"""Training sample, cluster assignment and centroid maintenance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quintavote.config import DIM, MAX_CLUSTERS
from quintavote.functions.distance import dist_f64, norm_sq
from quintavote.functions.kernels import nearest_centroid as nearest_kernel
from quintavote.functions.kernels import squared_norms, to_matrix
from quintavote.staging import materialize, ship_package

CENTROID_SCHEMA = T.StructType(
    [
        T.StructField("cluster_id", T.IntegerType()),
        T.StructField("centroid", T.ArrayType(T.DoubleType())),
        T.StructField("norm_sq", T.DoubleType()),
    ]
)

# Sums run over this fixed-point unit: integer addition gives the same centroid
# in whatever order, and on whatever retry, the rows arrive.
_FIXED_POINT = 100_000_000
_HASH_DIGITS = 5
_MOVED = 1e-10


def sample_hash(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")))


def train_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Uniform sample of exactly ``min(n, rows)`` rows, fixed by ``seed``.

    The rows with the n smallest hashes, found without one global sort: a
    histogram over hash prefixes locates the prefix where the sample ends, and
    only rows of that one prefix (a millionth of the table) are ordered.
    """
    hashed = df.withColumn("_hash", sample_hash(seed, F.col(key))).withColumn(
        "_prefix", F.conv(F.substring("_hash", 1, _HASH_DIGITS), 16, 10).cast("int")
    )
    histogram = hashed.groupBy("_prefix").agg(F.count("*").alias("_rows"))
    running = F.sum("_rows").over(
        Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    )
    room = histogram.select(
        "_prefix", (F.lit(n) - F.coalesce(running, F.lit(0))).alias("_room")
    ).filter(F.col("_room") > 0)
    # At most 16^5 prefixes of two small numbers each.
    candidates = hashed.join(F.broadcast(room), "_prefix")
    within = Window.partitionBy("_prefix").orderBy("_hash", key)
    ranked = candidates.withColumn("_rank", F.row_number().over(within))
    return ranked.filter(F.col("_rank") <= F.col("_room")).select(*df.columns)


def sampled_seeds(df: DataFrame, key: str, k: int, seed: int, dim: int = DIM) -> DataFrame:
    """A hash-ordered sample of ``k`` vectors as initial centroids 0..k-1."""
    sample = train_sample(df.select(key, "vector"), key, k, seed)
    order = Window.orderBy(sample_hash(seed, F.col(key)), key)
    # k rows, and k is bounded by MAX_CLUSTERS.
    return sample.select(
        (F.row_number().over(order) - 1).cast("int").alias("cluster_id"),
        F.col("vector").alias("centroid"),
        norm_sq("vector", dim).alias("norm_sq"),
    )


class CentroidTable:
    """The centroids as one matrix, small enough to broadcast (see MAX_CLUSTERS)."""

    def __init__(self, spark: SparkSession, ids: np.ndarray, matrix: np.ndarray, norms: np.ndarray):
        if not 1 <= len(ids) <= MAX_CLUSTERS:
            raise ValueError(f"expected 1..{MAX_CLUSTERS} centroids, found {len(ids)}")
        self.ids, self.matrix, self.norms = ids, matrix, norms
        self.size, self.dim = matrix.shape
        self._spark = spark
        self._broadcast: Broadcast | None = None

    @classmethod
    def load(cls, centroids: DataFrame, dim: int = DIM) -> CentroidTable:
        """Fetch a centroid table of at most MAX_CLUSTERS rows."""
        rows = (
            centroids.select("cluster_id", "centroid", "norm_sq")
            .limit(MAX_CLUSTERS + 1)
            .toArrow()
            .sort_by("cluster_id")
        )
        return cls(
            centroids.sparkSession,
            rows["cluster_id"].to_numpy().astype(np.int32),
            to_matrix(rows["centroid"], dim),
            rows["norm_sq"].to_numpy().astype(np.float64),
        )

    def with_means(self, means: DataFrame) -> CentroidTable:
        """The same clusters at new means; one without a mean becomes the zero vector."""
        rows = means.toArrow()
        matrix = np.zeros_like(self.matrix)
        position = np.searchsorted(self.ids, rows["cluster_id"].to_numpy())
        matrix[position] = to_matrix(rows["centroid"], self.dim)
        return CentroidTable(self._spark, self.ids, matrix, squared_norms(matrix))

    def moved_share(self, other: CentroidTable) -> float:
        """Share of clusters whose centroid differs noticeably from ``other``'s."""
        gaps = squared_norms(self.matrix - other.matrix)
        return float((gaps > _MOVED).mean())

    def to_frame(self) -> DataFrame:
        rows = pa.table(
            {
                "cluster_id": pa.array(self.ids),
                "centroid": pa.array(list(self.matrix)),
                "norm_sq": pa.array(self.norms),
            }
        )
        return self._spark.createDataFrame(rows, CENTROID_SCHEMA)

    def broadcast(self) -> Broadcast:
        if self._broadcast is None:
            ship_package(self._spark)
            held = (self.ids, self.matrix, self.norms)
            self._broadcast = self._spark.sparkContext.broadcast(held)
        return self._broadcast


def nearest_centroid(df: DataFrame, centroids: CentroidTable) -> DataFrame:
    """Add ``cluster_id`` and ``centroid_dist`` of the nearest centroid.

    Map-only: each Arrow batch of vectors meets the broadcast centroid matrix,
    so no (vector, centroid) pair ever becomes a row.
    """
    table, dim = centroids.broadcast(), centroids.dim
    result = T.StructType(
        [
            T.StructField("cluster_id", T.IntegerType()),
            T.StructField("centroid_dist", T.DoubleType()),
        ]
    )

    @F.arrow_udf(result)
    def assign(vectors: pa.Array) -> pa.Array:
        ids, matrix, _ = table.value
        position, distance = nearest_kernel(to_matrix(vectors, dim), matrix)
        return pa.StructArray.from_arrays(
            [pa.array(ids[position]), pa.array(distance)],
            names=["cluster_id", "centroid_dist"],
        )

    assigned = df.withColumn("_nearest", assign("vector"))
    return assigned.select(*df.columns, "_nearest.cluster_id", "_nearest.centroid_dist")


def with_fixed_point(df: DataFrame) -> DataFrame:
    """Add ``fixed``: the vector in the integer unit that means are summed in."""
    return df.withColumn(
        "fixed", F.expr(f"transform(vector, v -> CAST(round(v * {_FIXED_POINT}D) AS BIGINT))")
    )


def cluster_means(assigned: DataFrame, dim: int = DIM) -> DataFrame:
    """Mean vector of each cluster that has members."""
    if "fixed" not in assigned.columns:
        assigned = with_fixed_point(assigned)
    total = [F.expr(f"sum(fixed[{i}]) AS _s{i}") for i in range(dim)]
    sums = assigned.groupBy("cluster_id").agg(F.count("*").alias("_n"), *total)
    means = ", ".join(f"CAST(_s{i} AS DOUBLE) / (_n * {_FIXED_POINT}D)" for i in range(dim))
    return sums.select("cluster_id", F.expr(f"array({means})").alias("centroid"))


def centroid_update(
    assigned: DataFrame, cluster_ids: DataFrame, dim: int = DIM
) -> DataFrame:
    """New centroid per cluster; a cluster without members becomes the zero vector."""
    zero = F.array_repeat(F.lit(0.0), dim)
    return (
        cluster_ids.select("cluster_id")
        .join(cluster_means(assigned, dim), "cluster_id", "left")
        .select("cluster_id", F.coalesce("centroid", zero).alias("centroid"))
        .withColumn("norm_sq", norm_sq("centroid", dim))
    )


def cluster_profile(assigned: DataFrame, cluster_ids: DataFrame) -> DataFrame:
    """Members per cluster and running offset, with a row for empty clusters."""
    counts = assigned.groupBy("cluster_id").agg(F.count("*").alias("_n"))
    full = cluster_ids.select("cluster_id").join(counts, "cluster_id", "left")
    profile = full.select("cluster_id", F.coalesce("_n", F.lit(0)).alias("members"))
    # One row per cluster, so a single ordered window is bounded.
    before = Window.orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("members").over(before), F.lit(0))
    return profile.select("cluster_id", "members", offset.alias("start_offset"))


def centroid_movement(old: DataFrame, new: DataFrame, dim: int = DIM) -> DataFrame:
    """One row: clusters, how many of them moved, and that share."""
    before = old.select("cluster_id", F.col("centroid").alias("_old"))
    pairs = before.join(new.select("cluster_id", "centroid"), "cluster_id")
    moved = dist_f64("_old", "centroid", dim) > F.lit(_MOVED)
    return pairs.agg(
        F.count("*").alias("clusters"), F.count_if(moved).alias("moved")
    ).withColumn("moved_share", F.try_divide(F.col("moved"), F.col("clusters")))


def lloyd_step(sample: DataFrame, centroids: DataFrame, dim: int = DIM) -> DataFrame:
    """One assignment plus one mean."""
    table = CentroidTable.load(centroids, dim)
    return centroid_update(nearest_centroid(sample.select("vector"), table), centroids, dim)


def _race(seed: int, turn: int, key: str) -> Column:
    """An exponential variable per row, fixed by a hash, at the rate of ``centroid_dist``.

    The rows that come in first are a sample without replacement in proportion to their
    squared distances; of equal vectors the first counts, as their rates add up.
    """
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}-{turn}-"), F.col(key).cast("string"))), 1, 12)
    even = (F.conv(digits, 16, 10).cast("long") + 1) / F.lit(float(1 << 48))
    return -F.ln(even) / F.col("centroid_dist")


def kmeans_seed(sample: DataFrame, k: int, seed: int, dim: int = DIM, key: str = "ref_id") -> DataFrame:
    """Initial centroids by rounds of distance-weighted sampling.

    The first is the row of least hash.  Each round then adds as many rows as there are
    centroids (up to ``k``), drawn in proportion to their squared distance from the nearest
    one, so ``k`` takes log2(k) rounds.  Every draw is a hash of seed, round and key: the same
    rows give the same centroids in whatever order and on whatever retry.

    There are fewer than ``k`` where there are fewer distinct points.
    """
    rows = sample.select(key, "vector")
    # The sample is a few megabytes and the work per row is large: spread it.
    points = materialize(rows.repartition(rows.sparkSession.sparkContext.defaultParallelism), "points")
    first = points.orderBy(sample_hash(seed, F.col(key)), key).limit(1)
    # At most k rows, and k is bounded by MAX_CLUSTERS.
    chosen = [r["vector"] for r in first.collect()]

    def table() -> DataFrame:
        held = list(enumerate([float(x) for x in v] for v in chosen))
        centers = rows.sparkSession.createDataFrame(held, "cluster_id int, centroid array<double>")
        return centers.withColumn("norm_sq", norm_sq("centroid", dim))

    turn = 0
    while chosen and len(chosen) < k:
        turn += 1
        near = nearest_centroid(points, CentroidTable.load(table(), dim)).where("centroid_dist > 0")
        drawn = near.groupBy("vector").agg(F.min(F.struct(_race(seed, turn, key).alias("race"), key)).alias("first"))
        added = drawn.orderBy("first").limit(min(len(chosen), k - len(chosen))).collect()
        if not added:
            break
        chosen += [r["vector"] for r in added]
    return table()


def lloyd_fit(
    sample: DataFrame, seeds: DataFrame, max_iter: int, early_stop: float, dim: int = DIM
) -> DataFrame:
    """Repeat assignment and mean until fewer than ``early_stop`` centroids move.

    Each round is one job over the sample; only the K means reach the driver.
    """
    parallelism = sample.sparkSession.sparkContext.defaultParallelism
    spread = with_fixed_point(sample.select("vector")).repartition(parallelism)
    points = materialize(spread, "points")
    table = CentroidTable.load(seeds, dim)
    for _ in range(max_iter):
        updated = table.with_means(cluster_means(nearest_centroid(points, table), dim))
        share = updated.moved_share(table)
        table = updated
        if share < early_stop:
            break
    return table.to_frame()


def kmeans_fit(
    sample: DataFrame,
    k: int,
    max_iter: int,
    seed: int,
    early_stop: float = 0.001,
    dim: int = DIM,
    seeds: DataFrame | None = None,
) -> DataFrame:
    """Seeding (or the given ``seeds``) followed by Lloyd rounds."""
    seeds = kmeans_seed(sample, k, seed, dim) if seeds is None else seeds
    return lloyd_fit(sample, seeds, max_iter, early_stop, dim)
