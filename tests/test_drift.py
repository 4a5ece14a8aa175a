import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.operators import drift as d


def shares(spark, pairs):
    return d.psi_from_shares(spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "r double, c double"), [], "r", "c").first()["psi"]


def test_hand_worked_index(spark):
    assert shares(spark, [(0.7, 0.5), (0.3, 0.5)]) == pytest.approx(0.169459, abs=1e-6)
    assert shares(spark, [(700, 500), (300, 500)]) == pytest.approx(0.169459, abs=1e-6)
    assert shares(spark, [(0.7, 0.7), (0.3, 0.3)]) == pytest.approx(0.0)
    assert 1 < shares(spark, [(0.5, 1), (0.5, 0)]) < 100


def one(spark, reference, current, kind):
    r = spark.createDataFrame([(x,) for x in reference], f"v {kind}")
    c = spark.createDataFrame([("w", x) for x in current], f"w string, v {kind}")
    return r, c


def test_categorical(spark):
    r, c = one(spark, ["x"] * 70 + ["y"] * 30, ["x"] * 50 + ["y"] * 50, "string")
    assert d.categorical_psi(r, c, ["w"], ["v"]).first()["psi"] == pytest.approx(0.169459, abs=1e-6)
    r, c = one(spark, ["x", None, "y"], ["x", "y", None, None], "string")
    assert d.categorical_psi(r, c, ["w"], ["v"]).first()["psi"] == pytest.approx(0.0)
    r, c = one(spark, ["x"] * 5 + ["y"] * 5, ["x"] * 5 + ["z"] * 5, "string")
    assert d.categorical_psi(r, c, ["w"], ["v"]).first()["psi"] > 5


def test_quantile_bins_drop_nothing(spark):
    r, c = one(spark, [float(x) for x in range(100)], [-500.0, 500.0], "double")
    cuts = d.quantile_bins(d.reference_quantile_edges(r, ["v"])["v"])
    assert len(cuts) == 9
    psi = d.quantile_psi(r, c, ["w"], ["v"]).first()
    assert psi["cur_rows"] == 2 and psi["psi"] > 1


def test_constant_and_two_valued_references(spark):
    r, c = one(spark, [5.0] * 100, [5.0] * 50 + [9.0] * 50, "double")
    assert 0 < d.quantile_psi(r, c, ["w"], ["v"]).first()["psi"] < 100
    r, c = one(spark, [0.0] * 95 + [1.0] * 5, [1.0] * 100, "double")
    assert d.quantile_psi(r, c, ["w"], ["v"]).first()["psi"] == pytest.approx(0.0)  # two quantiles leave one bin


def test_constant_on_both_sides_is_quiet(spark):
    r, c = one(spark, [3.0] * 20, [3.0] * 7, "double")
    row = d.sturges_psi(r, c, ["w"], ["v"]).first()
    assert row["psi"] == 0.0 and row["cur_rows"] == 7


def local_sturges(r, c):
    p = np.concatenate([r, c])
    k = int(np.ceil(np.log2(len(p)) + 1))
    edges = np.linspace(p.min(), p.max(), k + 1)
    a, b = (np.maximum(np.histogram(x, edges)[0] / len(x), 1e-6) for x in (r, c))
    return ((b - a) * np.log(b / a)).sum()


def local_ks(r, c):
    v = np.unique(np.concatenate([r, c]))
    return np.abs(np.searchsorted(np.sort(r), v, "right") / len(r) - np.searchsorted(np.sort(c), v, "right") / len(c)).max()


def test_many_windows_match_numpy(spark):
    rng = np.random.default_rng(1)
    r = pd.DataFrame({"a": rng.normal(0, 1, 900).round(2), "b": rng.integers(0, 4, 900).astype(float)})
    c = pd.DataFrame({"w": rng.choice(["p", "q", "s"], 700), "a": rng.normal(0.4, 1, 700).round(2), "b": rng.integers(0, 5, 700).astype(float)})
    c.loc[::50, "a"] = np.nan
    rs, cs = spark.createDataFrame(r).repartition(5), spark.createDataFrame(c).repartition(7)
    psi = {(x["w"], x["feature"]): x["psi"] for x in d.sturges_psi(rs, cs, ["w"], ["a", "b"]).collect()}
    ks = {(x["w"], x["feature"]): x["ks_statistic"] for x in d.ks_test(rs, cs, ["w"], ["a", "b"]).collect()}
    for w, part in c.groupby("w"):
        for f in ("a", "b"):
            cur = part[f].dropna().to_numpy()
            assert psi[(w, f)] == pytest.approx(local_sturges(r[f].to_numpy(), cur), abs=1e-9)
            assert ks[(w, f)] == pytest.approx(local_ks(r[f].to_numpy(), cur), abs=1e-12)


def test_p_value_moves_with_the_statistic(spark):
    r, c = one(spark, [float(x % 100) for x in range(500)], [float(x % 100) for x in range(400)], "double")
    assert d.ks_test(r, c, ["w"], ["v"]).first()["ks_p_value"] > 0.99
    r, c = one(spark, [float(x % 100) for x in range(500)], [float(x % 100) + 30 for x in range(400)], "double")
    assert d.ks_test(r, c, ["w"], ["v"]).first()["ks_p_value"] < 1e-6


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50)), min_size=2, max_size=6))
def test_index_is_symmetric_and_zero_on_itself(spark, pairs):
    if sum(a for a, _ in pairs) == 0 or sum(b for _, b in pairs) == 0:
        return
    assert shares(spark, pairs) == pytest.approx(shares(spark, [(b, a) for a, b in pairs]), abs=1e-9)
    assert shares(spark, [(a, a) for a, _ in pairs]) == pytest.approx(0.0)


def test_events_carry_names_and_statistics_only(spark):
    rng = np.random.default_rng(2)
    r = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=300), "g": rng.choice(["a", "b"], 300), "p": rng.random(300)}))
    c = spark.createDataFrame(pd.DataFrame({"scenario": "s1", "i": 3, "x": rng.normal(2, 1, 200), "g": rng.choice(["a", "b"], 200), "p": rng.random(200)}))
    spec = d.MonitorSpec(("scenario", "i"), ("x",), ("g",), "p")
    events = d.window_events(r, c, spec, scenario="scenario", window_start=F.lit("2026-01-04").cast("timestamp"), window_end=F.lit("2026-01-05").cast("timestamp"), window_number=F.col("i"))
    row = events.first()
    assert row["event_id"].startswith("de-s1-w003-") and len(row["event_id"]) == len("de-s1-w003-") + 8
    assert [s["feature"] for s in row["feature_stats"]] == ["g", "x"]
    assert set(row["feature_stats"][0].asDict()) == {"feature", "kind", "psi", "ks_p_value", "breaching", "severe"}
    assert row["feature_stats"][0]["ks_p_value"] is None and row["feature_stats"][1]["breaching"] and row["max_psi"] == row["feature_stats"][1]["psi"]
    assert row["reference_rows"] == 300 and row["current_rows"] == 200 and row["policy_thresholds"]["monitored_features"] == 2
    assert events.select(d.quiet()).first()[0] is False


def test_thresholds_round_up_to_the_step(spark):
    df = spark.createDataFrame([("a", 0.12), ("a", 0.05), ("b", 0.15)], "feature string, psi double")
    assert {r["feature"]: round(r["threshold"], 6) for r in d.calibrated_thresholds(df).collect()} == {"a": 0.15, "b": 0.15}
