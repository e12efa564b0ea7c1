import math

import pytest
from pyspark.sql import functions as F

from quintavote.functions.distance import centroid_score, dist_f64, dist_int, norm_sq
from quintavote.functions.quantize import query_code, query_codes, reference_code
from quintavote.operators.vectorize import with_reference_codes


@pytest.mark.parametrize(
    "value, code",
    [(-1.0, -10_000), (-0.999, -10_000), (-0.998, 0), (-0.5, 0), (0.0, 0), (0.00005, 1),
     (0.00004, 0), (1.0, 10_000), (1.5, 10_000)],
)
def test_query_code(spark, value, code):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(query_code("v")).first()[0] == code


@pytest.mark.parametrize(
    "value, code",
    [(-0.5, -5_000), (-1.0, -10_000), (0.00005, 1), (-0.00005, -1), (1.5, 15_000), (3.2767, 32_767),
     (3.3, None)],
)
def test_reference_code(spark, value, code):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(reference_code("v")).first()[0] == code


def test_reference_beyond_sixteen_bits_is_an_error(spark):
    df = spark.createDataFrame([([0.0] * 13 + [4.0],)], "vector array<double>")
    with pytest.raises(Exception, match="sixteen bits"):
        with_reference_codes(df).collect()


def test_distances(spark):
    df = spark.createDataFrame(
        [([10_000] * 14, [-10_000] * 14, [1.0] * 14, [0.5] * 14)],
        "a array<smallint>, b array<smallint>, x array<double>, y array<double>",
    ).withColumn("n", norm_sq("y", 14))
    row = df.select(
        dist_int("a", "b", 14), dist_f64("x", "y", 14), centroid_score("x", "y", "n", 14)
    ).first()
    assert tuple(row) == (14 * 400_000_000, 3.5, 3.5 - 14.0)


def test_codes_of_a_vector(spark):
    df = spark.createDataFrame([([0.5, -1.0, 2.0],)], "vector array<double>")
    assert df.select(query_codes("vector")).first()[0] == [5_000, -10_000, 10_000]


def test_codes_round_halves_away_from_zero_without_decimals(spark):
    """The code of a value is that of ``round``, also next to a half."""
    halves = [(n + 0.5) / 10_000 for n in (0, 1, 2, 3, 4_095, 4_096, 8_191, 9_998)]
    near = [math.nextafter(v, end) for v in halves for end in (0.0, 1.0)]
    rows = [(v,) for v in halves + near + [0.49999999999999994 / 10_000, 0.0, 1.0, 0.3]]
    df = spark.createDataFrame(rows + [(-v,) for v, in rows], "v double").select(
        "v", query_code("v").alias("q"), reference_code("v").alias("r")
    )
    assert "round" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    wanted = df.select("q", "r", F.round(F.greatest("v", F.lit(0.0)) * 10_000).cast("int"), F.round(F.col("v") * 10_000).cast("int"))
    for q, r, unsigned, signed in wanted.collect():
        assert (r == signed) and (q == unsigned or (q == -10_000 and signed <= -9_990))
