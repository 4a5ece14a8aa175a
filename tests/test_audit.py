import re

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.text import DATE_PATTERN, FIGURE_PATTERN, four_places, squeeze
from tidewatch.operators import attribution, grounding, lifecycle as l, training

CARD = "card_id string, action string, disposition string, window_start timestamp"
RUN = "run_id string, card_id string, created_at timestamp, outcome string, shadow_alias_moved boolean"
APPROVAL = "approval_id string, ts timestamp, card_id string, kind string, subject string, run_id string, decision string"


def ts(day):
    from datetime import datetime

    return datetime(2026, 1, day)


def states(spark, cards, runs=(), approvals=()):
    df = l.with_state(
        spark.createDataFrame([(*c, ts(1)) for c in cards], CARD), spark.createDataFrame(list(runs), RUN), spark.createDataFrame(list(approvals), APPROVAL)
    )
    return {r["card_id"]: r["state"] for r in df.collect()}


def test_states(spark):
    cards = [
        ("no", "NO_OP", "NONE"), ("al", "ALERT_ONLY", "NONE"), ("ae", "ALERT_ONLY", "ESCALATE_HUMAN"), ("aa", "FULL_RETRAIN", "ESCALATE_HUMAN"),
        ("ar", "FULL_RETRAIN", "AUTO_PROCEED_SHADOW"), ("rr", "FULL_RETRAIN", "ESCALATE_HUMAN"), ("ok", "FULL_RETRAIN", "ESCALATE_HUMAN"),
        ("bl", "FULL_RETRAIN", "AUTO_PROCEED_SHADOW"), ("sh", "FULL_RETRAIN", "AUTO_PROCEED_SHADOW"), ("pa", "FULL_RETRAIN", "AUTO_PROCEED_SHADOW"),
        ("pr", "FULL_RETRAIN", "AUTO_PROCEED_SHADOW"), ("px", "FULL_RETRAIN", "AUTO_PROCEED_SHADOW"), ("pb", "FULL_RETRAIN", "AUTO_PROCEED_SHADOW"),
    ]
    runs = [
        ("r-bl", "bl", ts(2), "BLOCK", False), ("r-sh", "sh", ts(2), "PASS", True), ("r-pa", "pa", ts(2), "PASS", False), ("r-pr", "pr", ts(2), "PASS", True),
        ("r-px", "px", ts(2), "PASS", True), ("r-pb1", "pb", ts(2), "PASS", True), ("r-pb2", "pb", ts(3), "BLOCK", False),
    ]
    approvals = [
        ("a1", ts(2), "rr", "RETRAIN", "rr", None, "REJECT"), ("a2", ts(2), "ok", "RETRAIN", "ok", None, "APPROVE"), ("a3", ts(3), "pr", "PROMOTION", "r-pr", "r-pr", "APPROVE"),
        ("a4", ts(3), "px", "PROMOTION", "r-px", "r-px", "REJECT"), ("a5", ts(3), "pb", "PROMOTION", "r-pb1", "r-pb1", "APPROVE"),
    ]
    assert states(spark, cards, runs, approvals) == {
        "no": "NO_OP", "al": "ALERT", "ae": "ALERT (escalated)", "aa": "AWAITING AUTHORISATION", "ar": "AWAITING RETRAIN", "rr": "RETRAIN REJECTED",
        "ok": "AWAITING RETRAIN", "bl": "BLOCKED", "sh": "IN SHADOW", "pa": "PASSED (not in shadow)", "pr": "PROMOTED", "px": "PROMOTION REJECTED", "pb": "BLOCKED",
    }


def test_backlogs(spark):
    cards = spark.createDataFrame([("a", "FULL_RETRAIN", "AUTO_PROCEED_SHADOW", ts(2)), ("b", "FULL_RETRAIN", "ESCALATE_HUMAN", ts(1)), ("c", "FULL_RETRAIN", "ESCALATE_HUMAN", ts(3)), ("d", "NO_OP", "NONE", ts(1))], CARD)
    none = spark.createDataFrame([], RUN)
    people = spark.createDataFrame([("x", ts(2), "b", "RETRAIN", "b", None, "APPROVE")], APPROVAL)

    def ids(df):
        return [r["card_id"] for r in df.collect()]

    assert ids(l.awaiting_retrain(cards, none, people)) == ["a"]
    assert ids(l.awaiting_retrain(cards, none, people, include_approved=True)) == ["b", "a"]
    assert ids(l.awaiting_retrain(cards, none, people, automated_only=False, limit=2)) == ["b", "a"]
    assert ids(l.awaiting_authorisation(cards, none, people)) == ["c"]


def test_alias_moves_name_cards_or_runs(spark):
    run, card = "rr-2026-01-03-1a2b3c4d-9f8e7d6c", "dc-2026-01-03-1a2b3c4d"
    moves = spark.createDataFrame([(f"card {card} (run {run})",), (f"run {run}",), (f"run {run}",), ("by hand",), (None,), ("dc-2026-01-03-ffffffff",)], "reason string")
    runs = spark.createDataFrame([(run, card)], "run_id string, card_id string")
    cards = spark.createDataFrame([(card,)], "card_id string")
    got = sorted(r["reason"] for r in l.moves_by_card(moves, runs, cards).collect())
    assert got == sorted([f"card {card} (run {run})", f"run {run}", f"run {run}"])


def test_reasons_are_checked(spark):
    df = spark.createDataFrame([(" approve", "a   b c  "), ("Reject", "long   enough\n reason"), ("maybe", "x" * 20), ("APPROVE", "x" * 1001), (None, None)], "decision string, reason string")
    got = [(r["decision"], r["fault"]) for r in l.checked_decisions(df).collect()]
    assert got == [("APPROVE", "reason too short"), ("REJECT", None), ("MAYBE", "unknown decision"), ("APPROVE", "reason too long"), ("", "unknown decision")]
    assert spark.sql("SELECT ' a \n b ' x").select(squeeze("x")).first()[0] == "a b"


def test_upper_median_drops_nulls_after_the_limit(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, None), (4, 9.0)], "t int, v double")
    assert l.upper_median_of_latest(df, "v", "t", "t", 3).first()["median"] == 9.0
    assert l.upper_median_of_latest(df.where("v IS NULL"), "v", "t", "t", 3).first()["median"] is None


def test_fixed_places_round_the_binary_value(spark):
    values = [0.50615, 0.00015, 2.5, 1234.56785, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(four_places("v")).collect()]
    assert got == ["n/a" if v is None else f"{v:.4f}" for v in values]


TEXTS = [
    "PSI 0.4177 in 2 of 25 features, 41.8% and -3.5; policy-v2, S1, dc-2026-01-01-1a2b3c4d on 2026-01-03.",
    "1,234 and 12,3456 and 5,6 and 1.2.3 and v1.0 and 10.0.0.1 and 7. End 8", "É5 5É 3-4 -7 (9) x_1 1_000 99%", "", "no figures",
]


def test_figures_and_dates_match_a_plain_search(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {}
    for r in grounding.quoted_figures(df, "id", "text").orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append(r["written"])
    pattern = re.compile(FIGURE_PATTERN.replace("(?U)", ""))
    assert got == {i: [m.group(1) for m in pattern.finditer(t)] for i, t in enumerate(TEXTS) if pattern.search(t)}
    days = {r["id"]: r["written"] for r in grounding.quoted_dates(df, "id", "text").collect()}
    assert days == {i: m.group(1) for i, t in enumerate(TEXTS) if (m := re.search(DATE_PATTERN.replace("(?U)", ""), t))}


def test_grounding_by_rounding_percent_and_dates(spark):
    texts = spark.createDataFrame(
        [("a", "0.4177 or 0.42, 41.8%, 42% of it on 2026-01-03"), ("b", "0.418 then 3 on 2026-01-04"), ("c", " "), ("d", "0.5061")], "id string, text string"
    )
    known = spark.createDataFrame([("a", 0.417667), ("b", 0.417667), ("b", 2.0), ("d", 0.50615)], "id string, number double")
    known_days = grounding.stored_dates(spark.createDataFrame([("a", "2026-01-03T00:00:00Z"), ("b", "2026-01-03")], "id string, s string"), "id", [F.col("s")])
    got = {r["id"]: r for r in grounding.grounding_report(texts, "id", "text", known, known_days).collect()}
    assert got["a"]["grounded"] and got["a"]["numbers"] == 4
    assert not got["b"]["grounded"] and (got["b"]["ungrounded_numbers"], got["b"]["ungrounded_dates"]) == (1, 1)
    assert not got["c"]["grounded"] and got["d"]["grounded"]
    leaves = grounding.numeric_leaves(spark.sql("SELECT 'x' id, 0.5 a, array(1,2,3) b, 'run 7 of 40%' t"), "id", [F.col("a")], [F.col("b")], "t")
    assert sorted(r["number"] for r in leaves.collect()) == [0.5, 3.0, 7.0]


def test_attribution(spark):
    df = spark.createDataFrame([(1.0, 10.0), (3.0, 30.0)], "a double, b double")
    made = attribution.linear_contributions(df, {"a": 2.0, "b": -0.1})
    top = made.select(attribution.top_contributions("contributions", 1).alias("t")).collect()
    assert {r["t"][0]["feature"] for r in top} == {"a"} and {r["t"][0]["contribution"] for r in top} == {-2.0, 2.0}
    assert [r["feature"] for r in attribution.global_importance(made).collect()] == ["a", "b"]
    assert "feature_value" not in made.select(attribution.without_values("contributions").alias("t")).schema["t"].dataType.elementType.names


def test_encoder_fits_on_train_only(spark):
    spec = training.FeatureSpec(("x",), ("g",), {"band": ("[0-10)", "[10-20)")})
    train = spark.createDataFrame([(1.0, "a", "[0-10)", 0), (3.0, "b", "[10-20)", 1), (None, None, "[0-10)", 1)], "x double, g string, band string, y int")
    encoder = training.fit_encoder(train, spec)
    assert encoder.medians == {"x": 2.0}
    new = spark.createDataFrame([(None, "zzz", "[90-100)", 0), (5.0, "b", "[10-20)", 0)], "x double, g string, band string, y int")
    rows = [r["features"].toArray().tolist() for r in encoder.transform(new).collect()]
    assert rows[0] == [2.0, -1.0, 0.0, 0.0, 0.0]
    assert rows[1][:2] == [5.0, 1.0] and sum(rows[1][2:]) == 1.0


def test_training_calibrates_out_of_fold(spark):
    df = spark.range(600).select("id", (F.col("id") % 10).cast("double").alias("x"), ((F.col("id") % 10 >= 6) != (F.col("id") % 7 == 0)).cast("int").alias("y"))
    spec = training.FeatureSpec(("x",))
    (encoder, base), calibrated, trees = training.train_models(df, spec, "y", "id", max_trees=4, floor=2, depth=2, folds=2)
    assert trees >= 2 and len(calibrated.members) == 2
    scored = calibrated.score(training.score(df, encoder, base, "raw")).agg(F.min("p"), F.max("p"), F.corr("p", "y")).first()
    assert 0 <= scored[0] < scored[1] <= 1 and scored[2] > 0.4
    logistic = training.fit_logistic(df, spec, "y")
    assert training.score(df, *logistic).where("p > 0.5").count() > 0
    assert training.training_metadata(df, df, "y", trees).first()["train_rows"] == 600
