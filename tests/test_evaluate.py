import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quintavote.config import Normalization, ProbeParams, BuildParams
from quintavote.operators import evaluate


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, expected_approved boolean, approved boolean")


def test_confusion_and_weights(spark):
    rows = (
        [(i, False, False) for i in range(4)]
        + [(i, True, True) for i in range(10, 15)]
        + [(20, True, False), (21, False, True), (22, False, True), (23, True, None)]
    )
    row = evaluate.weighted_error(evaluate.confusion_matrix(outcomes(spark, rows))).first()
    assert (row["tp"], row["tn"], row["fp"], row["fn"], row["errors"]) == (4, 5, 1, 2, 1)
    assert row["n"] == 13 and row["weighted_errors"] == 1 + 6 + 5
    assert row["error_rate"] == pytest.approx(12 / 13)
    assert row["failure_rate"] == pytest.approx(4 / 13)


def test_nothing_evaluated(spark):
    row = evaluate.detection_score(
        evaluate.weighted_error(evaluate.confusion_matrix(outcomes(spark, [])))
    ).first()
    assert (row["n"], row["error_rate"], row["failure_rate"]) == (0, 0.0, 0.0)
    assert row["detection_score"] == pytest.approx(3_000.0)


@pytest.mark.parametrize(
    "p99, score, cut",
    [(0.0, 0.0, False), (0.5, 3_000.0, False), (1.0, 3_000.0, False), (10.0, 2_000.0, False),
     (2_000.0, 1_000 * math.log10(0.5), False), (2_000.1, -3_000.0, True)],
)
def test_latency_score(spark, p99, score, cut):
    row = evaluate.latency_score(spark.createDataFrame([(p99,)], "p99 double")).first()
    assert row["p99_score"] == pytest.approx(score) and row["p99_cut"] is cut


@pytest.mark.parametrize(
    "fp, fn, tp, cut, score",
    [(0, 0, 100, False, 3_000.0), (15, 0, 85, False, 1_000 * math.log10(1 / 0.15) - 300 * math.log10(16)),
     (16, 0, 84, True, -3_000.0)],
)
def test_detection_score(spark, fp, fn, tp, cut, score):
    matrix = spark.createDataFrame([(tp, 0, fp, fn, 0)], "tp long, tn long, fp long, fn long, errors long")
    row = evaluate.detection_score(evaluate.weighted_error(matrix)).first()
    assert row["detection_cut"] is cut and row["detection_score"] == pytest.approx(score)
    assert (row["rate_component"] is None) is cut and (row["absolute_penalty"] is None) is cut


CASES = {
    "plain": np.random.default_rng(0).exponential(50, 1_000),
    "one": np.array([7.0]),
    "two": np.array([1.0, 3.0]),
    "all alike": np.full(500, 4.25),
    "hot value": np.r_[np.full(400, 3.0), np.random.default_rng(1).random(200) * 100],
    "far outlier": np.r_[np.random.default_rng(2).random(300), 1e12],
    "zero and up": np.arange(101.0),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("p", [0.0, 0.5, 0.99, 1.0])
def test_percentile_is_exact(spark, name, p):
    values = CASES[name]
    df = spark.createDataFrame([(float(v),) for v in values], "latency_ms double")
    found = evaluate.latency_percentile(df, "latency_ms", p).first()["percentile"]
    assert found == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def test_percentile_of_nothing_is_null(spark):
    df = spark.createDataFrame([], "latency_ms double")
    assert evaluate.latency_p99(df).first()["p99"] is None


def test_output_checks(spark):
    bodies = [
        '{"approved":true,"fraud_score":0.2}', '{"approved":"true","fraud_score":1}',
        '{"approved":false}', "oops", None,
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "query_id bigint, value string")
    rates = evaluate.output_checks(df)
    row = rates.first()
    assert row["responses"] == 5 and row["answered"] == 0.8 and row["body_is_json"] == 0.6
    assert row["approved_is_boolean"] == 0.4 and row["fraud_score_is_number"] == 0.4
    assert evaluate.checks_passed(rates).first()["passed"] is False
    assert evaluate.checks_passed(evaluate.output_checks(df.limit(1))).first()["passed"] is True


def test_report_is_nested(spark):
    expected = spark.range(20).select(
        F.col("id").alias("query_id"), (F.col("id") > 4).alias("expected_approved")
    )
    predictions = expected.withColumnRenamed("expected_approved", "approved")
    latencies = spark.range(1, 101).select(F.col("id").cast("double").alias("latency_ms"))
    scored = evaluate.evaluation_scores(expected, predictions, latencies)
    fast = expected.select("query_id", F.when(F.col("query_id") < 5, 2).otherwise(0).alias("votes"))
    row = evaluate.evaluation_report(scored, evaluate.dataset_profile(expected, fast)).first()
    assert row["p99"] == "99.01ms"
    assert row["expected"]["total"] == 20 and row["expected"]["edge_case_rate"] == 25.0
    assert row["scoring"]["breakdown"]["true_positive_detections"] == 5
    assert row["scoring"]["failure_rate"] == "0%"
    assert row["scoring"]["detection_score"]["value"] == 3_000.0
    assert row["scoring"]["final_score"] == round(3_000 + 1_000 * math.log10(1_000 / 99.01), 2)


@pytest.mark.parametrize(
    "given, clusters, wanted",
    [((0, 0), 4, (1, 1)), ((50, 10), 4, (4, 4)), ((8, 28), 4, (4, 4)), ((8, 28), 4_096, (8, 28)),
     ((50, 60), 4_096, (28, 28)), ((-3, 5), 100, (1, 5))],
)
def test_probe_clamping(given, clusters, wanted):
    effective = ProbeParams(*given).clamped(clusters)
    assert (effective.fast, effective.full) == wanted


def test_probe_settings_from_environment():
    assert ProbeParams.from_env({}) == ProbeParams(8, 28)
    assert ProbeParams.from_env({"N_PROBE_FAST": "3", "N_PROBE_FULL": "x"}) == ProbeParams(3, 28)


@pytest.mark.parametrize("value", [0, -1, float("nan"), float("inf"), None, "5", True])
def test_normalization_is_validated(value):
    with pytest.raises(ValueError):
        Normalization(max_km=value)


def test_build_params_are_validated():
    for bad in (dict(clusters=0), dict(clusters=70_000), dict(train_rows=0), dict(max_iter=0)):
        with pytest.raises(ValueError):
            BuildParams(**bad)


def test_a_run_without_latencies_scores_nothing(spark):
    none = spark.createDataFrame([], "latency_ms double")
    row = evaluate.latency_score(evaluate.latency_p99(none)).first()
    assert row["p99_score"] == 0.0 and row["p99_cut"] is False


def percentile_by_force(values, p):
    return float(np.percentile(np.array(values, dtype=float), 100 * p)) if values else None


@pytest.mark.parametrize("few", [1, 3, 4_096])
@pytest.mark.parametrize("p", [0.0, 0.5, 0.99, 1.0])
def test_percentile_of_crowded_values(spark, monkeypatch, few, p):
    """Most values lie in one histogram range, some far off; ranges are narrowed until few are left."""
    monkeypatch.setattr(evaluate, "_FEW_VALUES", few)
    monkeypatch.setattr(evaluate, "_BUCKETS", 4)
    rng = np.random.default_rng(1)
    values = [*(5 + rng.random(300) * 1e-6), *[5.0000005] * 100, 0.0, 1e12, -3.0, 5.0000005]
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    found = evaluate.latency_percentile(frame, "v", p).first()[0]
    assert found == pytest.approx(percentile_by_force(values, p), rel=1e-15)


def test_percentile_plans_order_few_rows(spark, monkeypatch):
    """No window runs over the values, however many lie together."""
    monkeypatch.setattr(evaluate, "_FEW_VALUES", 10)
    rows = spark.range(5_000).selectExpr("CASE WHEN id < 4990 THEN 7 + id / 1e9 ELSE id * 1e6 END AS v")
    assert "Window" not in evaluate.latency_percentile(rows, "v", 0.99)._jdf.queryExecution().toString()
    assert evaluate.latency_percentile(rows, "v", 0.5).first()[0] == pytest.approx(7 + 2499.5 / 1e9, rel=1e-15)
    assert evaluate.latency_percentile(rows.limit(0), "v", 0.5).first()[0] is None
