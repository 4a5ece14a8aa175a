import numpy as np
import pandas as pd
import pytest

from tidewatch.operators import ordering, quality as q
from tidewatch.operators import shadow as s


def scored(spark, y, p, **extra):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(y)), "m": "a", "y": y, "p": np.asarray(p, dtype=float), **extra}))


def test_calibration_error(spark):
    exact = scored(spark, [1, 0, 0, 0, 1, 1, 1, 0], [0.25] * 4 + [0.75] * 4)
    assert q.calibration_error(exact, ["m"], "y", "p").first()[1] == pytest.approx(0.0)
    assert q.calibration_error(scored(spark, [0] * 10, [0.9] * 10), ["m"], "y", "p").first()[1] == pytest.approx(0.9)


def test_bins_are_closed_on_the_right_and_empty_ones_kept(spark):
    rows = q.reliability_table(scored(spark, [0, 1, 1], [0.0, 0.1, 1.0]), ["m"], "y", "p").orderBy("bin").collect()
    assert [r["count"] for r in rows] == [2, 0, 0, 0, 0, 0, 0, 0, 0, 1]
    assert rows[1]["mean_predicted"] is None


def test_recall_at_the_top(spark):
    df = scored(spark, [1, 1, 0, 0, 0, 0, 0, 0, 0, 0], [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05])
    assert q.recall_top_fraction(df, ["m"], "y", "p", "id", 0.1).first()["recall_at_top_decile"] == 0.5
    assert q.recall_top_fraction(df, ["m"], "y", "p", "id", 0.2).first()["recall_at_top_decile"] == 1.0
    none = scored(spark, [0] * 10, [0.1] * 10)
    assert q.recall_top_fraction(none, ["m"], "y", "p", "id").first()["recall_at_top_decile"] is None


def test_ties_at_the_cut_follow_the_tie_order(spark):
    df = scored(spark, [0, 1, 0, 1] * 25, [0.5] * 100)
    row = q.recall_top_fraction(df, ["m"], "y", "p", "id", 0.1).first()
    assert (row["top_rows"], row["top_positives"]) == (10, 5)


def test_confusion(spark):
    df = scored(spark, [0, 0, 1, 1], [0.1, 0.6, 0.4, 0.9])
    row = q.confusion_counts(df, ["m"], "y", "p", 0.5).first()
    assert (row["true_negatives"], row["false_positives"], row["false_negatives"], row["true_positives"]) == (1, 1, 1, 1)
    assert (row["precision"], row["recall"], row["predicted_positive_rate"]) == (0.5, 0.5, 0.5)
    quiet = q.confusion_counts(df, ["m"], "y", "p", 0.95).first()
    assert quiet["precision"] == 0.0


def test_auc_and_average_precision_match_brute_force(spark):
    rng = np.random.default_rng(5)
    y, p = rng.integers(0, 2, 400), rng.random(400).round(2)
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean()
    ap = sum(((y == 1) & (p == t)).sum() / y.sum() * y[p >= t].mean() for t in np.unique(p))
    got = q.ranking_metrics(scored(spark, y, p).repartition(7), ["m"], "y", "p").first()
    assert got["roc_auc"] == pytest.approx(auc, abs=1e-12) and got["average_precision"] == pytest.approx(ap, abs=1e-12)
    turned = q.ranking_metrics(scored(spark, y, 1 - p), ["m"], "y", "p").first()
    assert turned["roc_auc"] == pytest.approx(1 - auc, abs=1e-12)


def test_one_class_subgroups_have_no_auc_and_null_is_a_group(spark):
    df = scored(spark, [0, 1, 0, 1, 1, 1, 1], [0.1, 0.9, 0.4, 0.3, 0.2, 0.5, 0.6], sex=["F", "F", "F", "F", "M", "M", "M"], site=["x", None, None, "x", "x", "x", "x"])
    got = {(r["column_name"], r["group_value"]): r for r in q.subgroup_metrics(df, ["m"], "y", "p", ["sex", "site"]).collect()}
    assert got[("sex", "M")]["roc_auc"] is None and got[("sex", "M")]["count"] == 3
    assert got[("sex", "F")]["roc_auc"] == 0.75
    assert got[("site", "nan")]["count"] == 2


def test_refused_sets(spark):
    df = spark.createDataFrame([("a", 1, 0.5, 1), ("a", 1, 0.4, 2), ("b", None, 0.5, 3), ("c", 1, 0.5, 4), ("c", 0, 0.2, 5)], "s string, y int, p double, id int")
    good, refused = q.gate_metrics(df, ["s"], "y", "p", "id")
    assert {r["s"]: r["reason"] for r in refused.collect()} == {"a": "single class", "b": "unlabelled"}
    assert [r["s"] for r in good.collect()] == ["c"]


def pairs(spark, rows):
    return spark.createDataFrame(
        [(i, i, "1", "2", float(a), None if b is None else float(b), 0.5) for i, (a, b) in enumerate(rows)],
        "id int, ts int, champion_version string, shadow_version string, champion_score double, shadow_score double, decision_threshold double",
    )


def test_shadow_agreement(spark):
    row = s.shadow_stats(pairs(spark, [(0.40, 0.60), (0.45, 0.55), (0.70, 0.30), (0.10, 0.20)])).first()
    assert (row["flips_to_positive"], row["flips_to_negative"], row["decision_agreement"]) == (2, 1, 0.25)
    edge = s.shadow_stats(pairs(spark, [(0.5, 0.49)])).first()
    assert edge["flips_to_negative"] == 1 and edge["spearman"] is None


def test_shadow_ranks_and_failures(spark):
    assert s.shadow_stats(pairs(spark, [(0.1, 0.9), (0.5, 0.5), (0.9, 0.1)])).first()["spearman"] == -1.0
    assert s.shadow_stats(pairs(spark, [(0.1, 0.4), (0.5, 0.4)])).first()["spearman"] is None
    failed = s.shadow_stats(pairs(spark, [(0.1, None), (0.5, None)])).first()
    assert (failed["requests"], failed["scored"], failed["failed"], failed["mean_shift"], failed["decision_agreement"]) == (2, 0, 2, None, None)


def test_spearman_matches_average_ranks(spark):
    rng = np.random.default_rng(9)
    a, b = rng.random(300).round(1), rng.random(300).round(1)
    want = pd.Series(a).rank().corr(pd.Series(b).rank())
    assert s.shadow_stats(pairs(spark, list(zip(a, b)))).first()["spearman"] == pytest.approx(want, abs=1e-6)


def test_aliases_and_preconditions(spark):
    moves = spark.createDataFrame(
        [("2026-01-01", "set", "champion", "1", "r"), ("2026-01-02", "set", "shadow", "2", "r"), ("2026-01-03", "set", "shadow", "3", "r"), ("2026-01-04", "delete", "old", None, "r")],
        "timestamp_utc string, action string, alias string, to_version string, run_id string",
    )
    now = {r["alias"]: r["version"] for r in s.current_aliases(moves).collect()}
    assert now == {"champion": "1", "shadow": "3", "old": None}
    runs = spark.createDataFrame([("r1", "PASS", True, "3", "1"), ("r2", "PASS", True, "2", "1"), ("r3", "BLOCK", False, "3", "0")], "run_id string, outcome string, shadow_alias_moved boolean, challenger_version string, champion_version string")
    counts = spark.createDataFrame([("1", "3", 50)], "champion_version string, shadow_version string, requests long")
    got = {r["run_id"]: r for r in s.promotion_preconditions(runs, s.current_aliases(moves), counts).collect()}
    assert got["r1"]["ready_to_approve"] and not got["r2"]["ready_to_approve"]
    assert not got["r2"]["challenger_in_shadow"] and not got["r3"]["champion_unchanged_since_gate"] and got["r2"]["seen"] == 0


def test_sets_with_unscored_rows_are_refused_by_name(spark):
    rows = [("a", 1, 0.5, "x"), ("a", 0, None, "y"), ("b", 1, 0.5, "x"), ("b", 0, 0.2, "y"), ("c", None, 0.1, "x"), ("d", 1, 0.1, "x"), ("e", 1, float("nan"), "x"), ("e", 0, 0.3, "z"), ("f", None, None, "w"), ("f", 1, 0.2, "v"), ("f", 0, 0.1, "u")]
    df = spark.createDataFrame(rows, "s string, y int, p double, k string")
    good, refused = q.gate_metrics(df, ["s"], "y", "p", "k")
    assert {r["s"]: r["reason"] for r in refused.collect()} == {"a": "unscored rows", "c": "unlabelled", "d": "single class", "e": "unscored rows"}
    assert {r["s"]: r["rows"] for r in good.collect()} == {"b": 2, "f": 2}


def test_small_groups_are_shuffled_once(spark, monkeypatch):
    rows = [(f"m{i % 7}" if i % 50 else None, i, (i * 31 % 40) / 40.0 if i % 11 else None, int(i * 17 % 5 < 2)) for i in range(2000)]
    df = spark.createDataFrame(rows, "m string, id int, p double, y int").repartition(5)
    small = q.ranking_metrics(df, ["m"], "y", "p")
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("BroadcastExchange") <= 2 + 1  # the input's own, the group's, the union's
    found = lambda got: sorted(repr([round(v, 12) if isinstance(v, float) else v for v in r]) for r in got.collect())
    top = lambda: found(q.recall_top_fraction(df.where("m IS NOT NULL"), ["m"], "y", "p", "id"))
    few, recall = [found(small)], [top()]
    for most in (1, 287):  # all groups are large; some are
        monkeypatch.setattr(ordering, "TASK_ROWS", most)
        few.append(found(q.ranking_metrics(df, ["m"], "y", "p")))
        recall.append(top())
    assert len(few[0]) == 8 and few[0] == few[1] == few[2]
    assert len(recall[0]) == 7 and recall[0] == recall[1] == recall[2]
