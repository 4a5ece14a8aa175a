import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import ordering as o


def frame(spark, n=5000, hot=0.4, seed=3):
    rng = np.random.default_rng(seed)
    v = np.where(rng.random(n) < hot, 7.0, rng.normal(10, 5, n).round(2))
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "g": np.where(np.arange(n) % 3 == 0, "a", "b"), "v": v}))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("partitions", [1, 7])
def test_positions_are_the_total_order_even_when_one_value_is_hot(spark, descending, partitions):
    got = o.positions(frame(spark).repartition(partitions), "v", "id", descending=descending, buckets=16).toPandas()
    want = got.sort_values(["v", "id"], ascending=[not descending, True])
    assert want.position.tolist() == list(range(len(got)))


def test_hot_value_is_spread_over_several_buckets(spark):
    points = o.cut_points(frame(spark), ["v"], 16)["v"]
    assert points.count(7.0) >= 5


def test_positions_per_group(spark):
    got = o.positions(frame(spark), "v", "id", groups=["g"], buckets=8).toPandas()
    for _, part in got.groupby("g"):
        assert part.sort_values(["v", "id"]).position.tolist() == list(range(len(part)))


def test_running_totals_match_cumsum(spark):
    df = frame(spark).groupBy("g", "v").agg(F.count("*").alias("n"))
    got = o.running_totals(df, ["g"], "v", ["n"], buckets=9).toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values("v")
        assert part.n_upto.tolist() == part.n.cumsum().tolist()
        assert (part.n_before == part.n_upto - part.n).all()
        assert (part.n_total == part.n.sum()).all()


def test_exact_quantiles_match_numpy(spark):
    df = frame(spark)
    probs = {"lo": 0.0, "p1": 0.1, "mid": 0.5, "p95": 0.95, "hi": 1.0}
    got = {(r["g"], r["name"]): r["quantile"] for r in o.exact_quantiles(df, ["g"], "v", probs).collect()}
    local = df.toPandas()
    for g, part in local.groupby("g"):
        for name, p in probs.items():
            assert got[(g, name)] == pytest.approx(np.quantile(part.v, p), abs=1e-12)


@pytest.mark.parametrize("rows", [None, 1, 777, 4999, 5000, 9000])
def test_sample_is_exact_and_independent_of_layout(spark, rows):
    a = o.sample_rows(frame(spark).repartition(1), ["id"], rows).select("id").toPandas().id
    b = o.sample_rows(frame(spark).repartition(6), ["id"], rows).select("id").toPandas().id
    assert sorted(a) == sorted(b)
    assert len(a) == (5000 if rows in (None, 9000) else rows)


def test_hash_select_rounds_half_to_even_and_respects_the_filter(spark):
    df = spark.range(5).withColumn("v", F.when(F.col("id") >= 0, F.lit(None).cast("string")))
    got = o.hash_select(df, ["id"], fraction=0.5, where=F.col("v").isNull())
    assert got.count() == 5
    assert got.where("selected").count() == 2  # 2.5 rounds to 2


def test_timestamps_and_big_integers_order_exactly(spark):
    rows = [(i, (1 << 60) + (i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, big long").withColumn("ts", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") % 5))
    for order in ("big", "ts"):
        got = o.positions(df, order, "id", buckets=8).toPandas()
        assert got.sort_values([order, "id"]).position.tolist() == list(range(200))


def test_keys_at_ranks(spark):
    df = spark.range(0, 3000, 3).withColumnRenamed("id", "k").repartition(5)
    n = F.col("__rows")
    row = o.keys_at_ranks(df, "k", {"first": F.lit(0), "mid": F.floor(n / 2), "last": n - 1, "past": n}, buckets=7).first()
    assert (row["first"], row["mid"], row["last"], row["past"]) == (0, 1500, 2997, None)


@pytest.mark.parametrize("descending", [False, True])
def test_null_and_nan_stand_where_spark_sorts_them(spark, descending):
    values = [float(i % 11) for i in range(60)] + [None] * 9 + [float("nan")] * 7
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, v double").repartition(4)
    order = F.col("v").desc() if descending else F.col("v").asc()
    want = [r["id"] for r in df.coalesce(1).orderBy(order, "id").collect()]
    got = o.positions(df, "v", "id", descending=descending, total="n", buckets=6).orderBy("position").collect()
    assert [r["id"] for r in got] == want and [r["position"] for r in got] == list(range(76)) and {r["n"] for r in got} == {76}


def test_running_totals_keep_null_orders_and_null_groups(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 1.0, 2), ("a", 2.0, 4), (None, 5.0, 8), ("a", float("nan"), 16)], "g string, v double, n int")
    got = {(r["g"], str(r["v"])): (r["n_before"], r["n_upto"], r["n_total"]) for r in o.running_totals(df, ["g"], "v", ["n"], buckets=3).collect()}
    assert got == {("a", "None"): (0, 1, 23), ("a", "1.0"): (1, 3, 23), ("a", "2.0"): (3, 7, 23), ("a", "nan"): (7, 23, 23), (None, "5.0"): (0, 8, 8)}


def test_text_is_ordered_and_refused_samples_raise(spark):
    words = ["prefix" + w for w in "delta alpha omega beta gamma".split()] * 3 + [None, "", "é"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id bigint, w string")
    want = [r["id"] for r in df.coalesce(1).orderBy("w", "id").collect()]
    assert [r["id"] for r in o.positions(df, "w", "id", buckets=4).orderBy("position").collect()] == want
    with pytest.raises(ValueError):
        o.sample_rows(df, ["id"], 0)
