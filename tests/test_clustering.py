import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quintavote.operators import clustering as c
from quintavote.staging import materialize


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    blobs = rng.random((4, 14))[rng.integers(0, 4, 300)]
    values = np.round(np.clip(blobs + rng.normal(0, 0.05, (300, 14)), 0, 1), 4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values)]
    return materialize(spark.createDataFrame(rows, "ref_id bigint, vector array<double>"), "points")


@pytest.mark.parametrize("n", [1, 37, 299, 300, 1_000])
def test_sample_is_the_n_smallest_hashes(points, n):
    found = sorted(r["ref_id"] for r in c.train_sample(points, "ref_id", n, 7).collect())
    by_hash = sorted(range(300), key=lambda i: hashlib.md5(f"7-{i}".encode()).hexdigest())
    assert found == sorted(by_hash[:n])


def test_sample_changes_with_the_seed(points):
    one = {r["ref_id"] for r in c.train_sample(points, "ref_id", 50, 1).collect()}
    two = {r["ref_id"] for r in c.train_sample(points, "ref_id", 50, 2).collect()}
    assert one != two


def test_empty_cluster_becomes_the_zero_vector(spark):
    assigned = spark.createDataFrame(
        [(0, [0.25] * 14), (0, [0.75] * 14)], "cluster_id int, vector array<double>"
    )
    ids = spark.range(2).select(F.col("id").cast("int").alias("cluster_id"))
    rows = {r["cluster_id"]: r for r in c.centroid_update(assigned, ids).collect()}
    assert rows[0]["centroid"] == [0.5] * 14 and rows[0]["norm_sq"] == pytest.approx(3.5)
    assert rows[1]["centroid"] == [0.0] * 14 and rows[1]["norm_sq"] == 0.0


def test_profile_keeps_empty_clusters(spark):
    assigned = spark.createDataFrame([(0,), (2,), (2,)], "cluster_id int")
    ids = spark.range(4).select(F.col("id").cast("int").alias("cluster_id"))
    rows = [tuple(r) for r in c.cluster_profile(assigned, ids).orderBy("cluster_id").collect()]
    assert rows == [(0, 1, 0), (1, 0, 1), (2, 2, 1), (3, 0, 3)]


def test_movement_counts_moved_centroids(spark):
    schema = "cluster_id int, centroid array<double>"
    old = spark.createDataFrame([(0, [0.0] * 14), (1, [0.5] * 14)], schema)
    new = spark.createDataFrame([(0, [1e-6] * 14), (1, [0.6] * 14)], schema)
    assert tuple(c.centroid_movement(old, new).first()) == (2, 1, 0.5)


def test_lloyd_rounds_equal_a_plain_loop(points):
    seeds = materialize(c.sampled_seeds(points, "ref_id", 6, 3), "seeds")
    fitted = c.lloyd_fit(points, seeds, max_iter=25, early_stop=0.001)
    found = np.array([r["centroid"] for r in fitted.orderBy("cluster_id").collect()])

    values = np.array([r["vector"] for r in points.orderBy("ref_id").collect()])
    centers = np.array([r["centroid"] for r in seeds.orderBy("cluster_id").collect()])
    for _ in range(25):
        owner = ((values[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        updated = np.array(
            [values[owner == k].mean(axis=0) if (owner == k).any() else np.zeros(14) for k in range(6)]
        )
        moved = (((updated - centers) ** 2).sum(axis=1) > 1e-10).mean()
        centers = updated
        if moved < 0.001:
            break
    assert np.allclose(found, centers, atol=1e-8)


def test_a_round_is_the_step_operator(points):
    seeds = materialize(c.sampled_seeds(points, "ref_id", 5, 3), "seeds")
    one = c.lloyd_fit(points, seeds, max_iter=1, early_stop=0.0)
    step = c.lloyd_step(points, seeds)
    assert one.exceptAll(step).count() == 0 and one.count() == 5


def test_seeding_copes_with_few_distinct_points(spark):
    rows = [(i, [float(i % 2)] * 14) for i in range(20)]
    df = spark.createDataFrame(rows, "ref_id bigint, vector array<double>")
    assert c.kmeans_seed(df, 5, 1).count() == 2
    assert c.kmeans_fit(df, 5, 5, 1).count() == 2


def test_fit_finds_the_blobs(points):
    fitted = c.kmeans_fit(points, 4, 25, 1)
    cost = c.nearest_centroid(points, c.CentroidTable.load(fitted)).agg(F.avg("centroid_dist"))
    assert fitted.count() == 4 and cost.first()[0] < 0.3


def test_centroid_count_is_checked(spark):
    empty = spark.createDataFrame([], c.CENTROID_SCHEMA)
    with pytest.raises(ValueError, match="expected"):
        c.CentroidTable.load(empty)
