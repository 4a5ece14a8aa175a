import random

import pytest
from pyspark.ml.regression import IsotonicRegression

from tidewatch.operators.isotonic import isotonic_steps


def plain(rows):
    sums = {}
    for x, y, w in rows:
        a, b = sums.get(x, (0.0, 0.0))
        sums[x] = (a + w, b + w * y)
    held = []
    for x in sorted(sums):
        held.append([x, x, *sums[x]])
        while len(held) > 1 and held[-2][3] / held[-2][2] >= held[-1][3] / held[-1][2]:
            _, hi, w, s = held.pop()
            held[-1][1:] = [hi, held[-1][2] + w, held[-1][3] + s]
    return [(lo, hi, w, s / w) for lo, hi, w, s in held]


@pytest.mark.parametrize("slope", [1, 0, -1])
def test_steps_equal_plain_pooling(spark, slope):
    rng = random.Random(slope)
    rows = []
    for _ in range(1500):
        x = rng.randrange(400) / 400
        rows.append((x, int(rng.random() < 0.5 + slope * (x - 0.5)), float(rng.randrange(1, 4))))
    df = spark.createDataFrame([*rows, (None, 1, 1.0), (float("nan"), 1, 1.0), (0.5, None, 1.0)], "x double, y int, w double")
    got = sorted(tuple(r) for r in isotonic_steps(df, "x", "y", "w").collect())
    want = plain(rows)
    assert [g[:2] for g in got] == [v[:2] for v in want]
    assert [v for g in got for v in g[2:]] == pytest.approx([v for g in want for v in g[2:]])
    if slope == 1:
        model = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w").fit(df.where("y is not null and x is not null and not isnan(x)").selectExpr("x", "CAST(y AS DOUBLE) AS y", "w"))
        curve = dict(zip(model.boundaries.toArray().tolist(), model.predictions.toArray().tolist()))
        assert all(curve[lo] == pytest.approx(v) and curve[hi] == pytest.approx(v) for lo, hi, _, v in got)


def test_steps_of_nothing_and_of_one_score(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0)], "x double, y int")
    assert [tuple(r) for r in isotonic_steps(df, "x", "y").collect()] == [(0.5, 0.5, 2.0, 0.5)]
    assert isotonic_steps(df.where("y > 1"), "x", "y").count() == 0
