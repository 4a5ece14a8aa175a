import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import decisions as d
from tidewatch.operators import gate as g
from tidewatch.operators import backtest
from tidewatch.sources.schemas import DRIFT_EVENT

EPOCH = datetime(2026, 1, 1)


def event(scenario, day, psis, *, prediction=False, prediction_psi=0.01, monitored=25, event_id=None, max_psi="stats"):
    stats = [(f, "numerical", p, None, p >= 0.1, p >= 0.25) for f, p in psis.items()]
    start = EPOCH + timedelta(days=day)
    top = (max(psis.values()) if psis else None) if max_psi == "stats" else max_psi
    return (
        event_id or f"de-{scenario}-{day}", start, start, start + timedelta(days=1), scenario, stats, prediction, prediction_psi, top,
        sum(p >= 0.1 for p in psis.values()), 10000, 2000, None, "v1", "d1", (0.1, 0.25, 0.05, 0.1, monitored),
    )


def cards(spark, events, policy="policy-v1", **history):
    df = spark.createDataFrame(events, DRIFT_EVENT)
    made = d.decide(df, d.policy_table(spark).where(F.col("policy_version") == policy), **history)
    return {(r["scenario"], (r["window_start"] - EPOCH).days): r for r in made.collect()}


def golden():
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "FIXTURES.md")
    rows = [line.strip("| \n").split("|") for line in open(path) if line.startswith("| S")]
    return [[c.strip() for c in r] for r in rows if len(r) == 7 and r[0].strip() in {"S1", "S2", "S3", "S4", "S5"}]


def test_published_decisions(spark):
    v2_breaches = {("S3", i): n for i, n in enumerate((1, 2, 4, 3, 3))}
    events, want = [], {}
    for scenario, window, top, breaching, drift, v1, v2 in golden():
        w, n, top = int(window), int(breaching), float(top)
        wide = v2_breaches.get((scenario, w), 1)
        psis = {"f0": top}
        for i in range(1, n):
            psis[f"f{i}"] = 0.21 if top >= 0.25 and i < wide else 0.11
        events.append(event(scenario, w, psis, prediction=drift == "true"))
        want[(scenario, w)] = [tuple(x.strip() for x in v.split("/")) for v in (v1, v2)]
    assert len(events) == 25
    for i, policy in enumerate(("policy-v1", "policy-v2")):
        got = cards(spark, events, policy)
        for key, pair in want.items():
            action, rule, confidence = pair[i]
            assert (got[key]["action"], got[key]["rule_id"]) == (action, rule), (policy, key)
            assert got[key]["confidence"] == pytest.approx(float(confidence), abs=1e-4), (policy, key)


def runs(spark, sequence, current):
    events = [event("s", i, {f: 0.15 for f in names}) for i, names in enumerate([*sequence, current])]
    df = d.breach_runs(spark.createDataFrame(events, DRIFT_EVENT), d.policy_table(spark).where("policy_version = 'policy-v1'"))
    row = df.orderBy(F.desc("window_start")).first()
    return row["consecutive_breaching_windows"], tuple(row["persistent_features"])


@pytest.mark.parametrize(
    "past, current, want",
    [
        ([["a"], ["a", "c"]], ["a", "b"], (3, ("a",))),
        ([["a"], ["z"], ["a"]], ["a"], (2, ("a",))),
        ([["a"], []], ["a"], (1, ("a",))),
        ([["a"]], [], (0, ())),
        ([["a"]] * 30, ["a"], (31, ("a",))),
        ([["b"], ["a", "b"], ["a", "b"]], ["a", "b"], (4, ("b",))),
    ],
)
def test_run_lengths(spark, past, current, want):
    assert runs(spark, past, current) == want


def test_replayed_windows_are_not_each_others_history(spark):
    events = [event("s", 0, {"a": 0.2}, event_id="x"), event("s", 0, {"a": 0.2}, event_id="y"), event("s", 1, {"a": 0.2}, event_id="z"), event("t", 1, {"a": 0.2}, event_id="u")]
    df = d.breach_runs(spark.createDataFrame(events, DRIFT_EVENT), d.policy_table(spark).where("policy_version = 'policy-v1'"))
    assert {r["event_id"]: r["consecutive_breaching_windows"] for r in df.collect()} == {"x": 1, "y": 1, "z": 3, "u": 1}


def test_run_lengths_with_a_limit(spark):
    events = [event("s", i, {"a": 0.2}) for i in range(30)]
    df = d.breach_runs(spark.createDataFrame(events, DRIFT_EVENT), d.policy_table(spark).where("policy_version = 'policy-v1'"), limit=16)
    assert sorted(r["consecutive_breaching_windows"] for r in df.collect()) == [*range(1, 17), *[17] * 14]


def test_each_rule_and_disposition(spark):
    got = cards(
        spark,
        [
            event("quiet", 0, {"a": 0.05}),
            event("mild", 0, {"a": 0.10, "b": 0.12}),
            event("many", 0, {"a": 0.11, "b": 0.12, "c": 0.13}),
            event("again", 0, {"a": 0.12}), event("again", 1, {"a": 0.13, "b": 0.12}),
            event("severe", 0, {"a": 0.25}),
            event("scores", 0, {"a": 0.01}, prediction=True, prediction_psi=0.3),
            *[event("sure", i, {f"f{j}": 0.9 for j in range(4)}, monitored=4) for i in range(3)],
        ],
    )
    seen = {k: (r["rule_id"], r["action"], r["disposition"], r["status"]) for k, r in got.items()}
    assert seen[("quiet", 0)] == ("1", "NO_OP", "NONE", "CLOSED")
    assert seen[("mild", 0)] == ("2", "ALERT_ONLY", "NONE", "CLOSED")
    assert seen[("many", 0)] == ("uncovered", "ALERT_ONLY", "NONE", "CLOSED")
    assert seen[("again", 1)] == ("3", "INCREMENTAL_RETRAIN", "AUTO_PROCEED_SHADOW", "OPEN")
    assert seen[("severe", 0)] == ("4", "FULL_RETRAIN", "ESCALATE_HUMAN", "OPEN")
    assert seen[("scores", 0)] == ("4", "FULL_RETRAIN", "ESCALATE_HUMAN", "OPEN")
    assert seen[("sure", 2)] == ("4", "FULL_RETRAIN", "AUTO_PROCEED_SHADOW", "OPEN")
    assert got[("mild", 0)]["trigger"]["breaching_features"][0]["feature"] == "b"
    assert got[("again", 1)]["rationale"].startswith("over the limit 2 windows in a row: a")
    assert got[("severe", 0)]["rationale"].startswith("a severe at PSI 0.2500; confidence ")
    assert got[("scores", 0)]["rationale"].startswith("scores moved, PSI 0.3000;")
    assert got[("sure", 2)]["confidence"] == pytest.approx(0.875)
    assert got[("quiet", 0)]["card_id"].startswith("dc-2026-01-01-")


def test_cooldown_and_matured_labels(spark):
    start = [EPOCH]
    recent = spark.createDataFrame([("s", start[0], 3.5, 0)], "scenario string, window_start timestamp, days_since_last_retrain double, retrains_in_cooldown long")
    row = cards(spark, [event("s", 0, {"a": 0.4})], retrains=recent)[("s", 0)]
    assert (row["rule_id"], row["action"], row["disposition"], row["downgraded_from"]) == ("6", "ALERT_ONLY", "ESCALATE_HUMAN", "FULL_RETRAIN")
    assert "last retrain 3.50 days ago, cooldown 7" in row["rationale"]
    spent = recent.withColumns({"days_since_last_retrain": F.lit(9.0), "retrains_in_cooldown": F.lit(1).cast("long")})
    assert "retrains used 1 of 1" in cards(spark, [event("s", 0, {"a": 0.4})], retrains=spent)[("s", 0)]["rationale"]
    assert cards(spark, [event("s", 0, {"a": 0.01})], retrains=spent)[("s", 0)]["rule_id"] == "1"
    matured = spark.createDataFrame([("s", start[0], True, 0.031)], "scenario string, window_start timestamp, labels_matured boolean, matured_auroc_drop_seen double")
    row = cards(spark, [event("s", 0, {"a": 0.01})], matured=matured)[("s", 0)]
    assert (row["rule_id"], row["disposition"], row["trigger"]["label_maturity"]) == ("5", "ESCALATE_HUMAN", "matured")
    at = matured.withColumn("matured_auroc_drop_seen", F.lit(0.03))
    assert cards(spark, [event("s", 0, {"a": 0.01})], matured=at)[("s", 0)]["rule_id"] == "1"


def test_ceiling_and_missing_maximum(spark):
    assert {r["ceiling"] for r in d.confidence_ceiling(d.policy_table(spark)).collect()} == {0.875}
    row = cards(spark, [event("s", 0, {"a": 0.3}, max_psi=None)])[("s", 0)]
    assert row["trigger"]["max_psi"] == 0.3
    assert cards(spark, [event("s", 0, {}, monitored=0)])[("s", 0)]["confidence_breakdown"]["breadth"] == 0.0


def test_retrain_history_counts_runs_before_the_window(spark):
    windows = spark.createDataFrame([("s", EPOCH + timedelta(days=i)) for i in (0, 3, 20)], "scenario string, window_start timestamp")
    made = spark.createDataFrame([("s", EPOCH + timedelta(days=1)), ("s", EPOCH + timedelta(days=2)), ("t", EPOCH)], "scenario string, created_at timestamp")
    got = {(r["window_start"] - EPOCH).days: (r["days_since_last_retrain"], r["retrains_in_cooldown"]) for r in d.retrain_history(windows, made, 7.0).collect()}
    assert got == {0: (None, 0), 3: (1.0, 2), 20: (18.0, 0)}


def test_latency_and_rates(spark):
    schema = "policy_version string, scenario string, window_index int, breaching_features int, prediction_drift boolean, action string, disposition string, confidence double, gate_retrained string, gate_bad string"
    rows = [("p", "a", i, b, False, act, "NONE", 0.1 * i, None, None) for i, (b, act) in enumerate([(0, "NO_OP"), (0, "NO_OP"), (2, "FULL_RETRAIN")])]
    rows += [("p", "b", 0, 0, False, "NO_OP", "NONE", 0.2, None, None)]
    got = {r["scenario"]: r for r in backtest.summarise(spark.createDataFrame(rows, schema)).collect()}
    assert got["a"]["detection_latency_windows"] == 2 and got["b"]["detection_latency_windows"] is None
    assert got["a"]["acting_card_rate"] == 0.3333 and got["a"]["monitor_breach_rate"] == 0.3333
    assert backtest.false_trigger_rate(spark.createDataFrame(rows, schema), "b").first()[1] == 0.0


# --- gate -------------------------------------------------------------------------------------
def metric(spark, keys, **changes):
    base = dict(rows=2000, roc_auc=0.68, recall_at_top_decile=0.24, brier_score=0.09, expected_calibration_error=0.02)
    base.update(changes)
    return [(*keys, s, *base.values()) for s in ("frozen_holdout", "recent_labeled_window")]


M = "eval_set string, rows long, roc_auc double, recall_at_top_decile double, brier_score double, expected_calibration_error double"
G = "eval_set string, column_name string, group_value string, roc_auc double"
GROUPS = [("age", "[50-60)", 0.70), ("gender", "Female", 0.69), ("gender", "Male", 0.67), ("race", "Other", None)]


def verdict(spark, changes=None, groups=None, drop_set=None):
    sets = ("frozen_holdout", "recent_labeled_window")
    champion = spark.createDataFrame(metric(spark, ()), M)
    challenger = spark.createDataFrame(metric(spark, ("2",), **(changes or {})), "challenger string, " + M)
    if drop_set:
        challenger = challenger.where(F.col("eval_set") != drop_set)
    ours = spark.createDataFrame([(s, *x) for s in sets for x in GROUPS], G)
    theirs = spark.createDataFrame([("2", s, *x) for s in sets for x in (groups or GROUPS)], "challenger string, " + G)
    checks = g.gate_checks(champion, challenger, ours, theirs, g.criteria_table(spark))
    return g.gate_verdicts(checks).first()


@pytest.mark.parametrize(
    "changes, outcome",
    [
        ({}, "PASS"), ({"roc_auc": 0.675}, "PASS"), ({"roc_auc": 0.674999}, "BLOCK"), ({"recall_at_top_decile": 0.239999}, "BLOCK"),
        ({"brier_score": 0.095}, "PASS"), ({"brier_score": 0.095001}, "BLOCK"), ({"expected_calibration_error": 0.05}, "PASS"), ({"expected_calibration_error": 0.050001}, "BLOCK"),
    ],
)
def test_gate_boundaries(spark, changes, outcome):
    row = verdict(spark, changes)
    assert row["outcome"] == outcome
    assert row["failed_criteria_count"] == (0 if outcome == "PASS" else 2) == len(row["reasons"])


def test_gate_subgroups_and_coverage(spark):
    worse = [("age", "[50-60)", 0.70), ("gender", "Female", 0.679), ("gender", "Male", None), ("race", "New", 0.5)]
    row = verdict(spark, groups=worse)
    assert row["outcome"] == "BLOCK" and row["failed_criteria_count"] == 2
    assert row["reasons"][0].startswith("subgroup_non_regression [frozen_holdout]: gender=Female: AUROC 0.679000, champion 0.690000, at least 0.680000")
    assert verdict(spark, groups=[("gender", "Female", 0.68)])["outcome"] == "PASS"
    gone = verdict(spark, drop_set="recent_labeled_window")
    assert gone["outcome"] == "BLOCK" and gone["reasons"] == ["evaluation_set_present [recent_labeled_window]: recent_labeled_window lacks the challenger's metrics"]


def test_authorisation_and_pins(spark):
    cards_ = spark.createDataFrame(
        [("a", "FULL_RETRAIN", "AUTO_PROCEED_SHADOW"), ("b", "FULL_RETRAIN", "ESCALATE_HUMAN"), ("c", "FULL_RETRAIN", "ESCALATE_HUMAN"), ("d", "FULL_RETRAIN", "ESCALATE_HUMAN"), ("e", "NO_OP", "NONE")],
        "card_id string, action string, disposition string",
    )
    people = spark.createDataFrame([("RETRAIN", "b", "APPROVE", "ann"), ("RETRAIN", "c", "REJECT", "bob")], "kind string, subject string, decision string, approver string")
    named = spark.createDataFrame([("c", "eve"), ("d", "eve")], "card_id string, authorized_by string")
    got = {r["card_id"]: (r["authorisation"], r["authorized_by"]) for r in g.authorisation(cards_, people, named).collect()}
    assert got == {"a": ("authorised", None), "b": ("authorised", "ann"), "c": ("rejected", None), "d": ("authorised", "eve"), "e": ("not a retrain card", None)}
    assert {r["card_id"]: r["authorisation"] for r in g.authorisation(cards_, people).collect()}["d"] == "needs authorisation"


def test_run_ids_name_their_card(spark):
    row = spark.sql("SELECT 'dc-2026-01-03-1a2b3c4d' c").select(g.run_id(F.col("c"), F.lit("live"), F.lit("2")).alias("a"), g.run_id(F.col("c"), F.lit("live"), F.lit(None)).alias("b")).first()
    assert row["a"].startswith("rr-2026-01-03-1a2b3c4d-") and row["a"] != row["b"] and len(row["b"]) == 31


def test_cards_are_gated_on_their_own_window_and_thresholds(spark):
    from datetime import datetime

    from tidewatch.operators import gate

    day = [datetime(2026, 1, d) for d in (1, 2, 3)]
    strict = {t: float(gate.CRITERIA[t]) for t in gate.THRESHOLDS}
    lenient = {**strict, "auroc_non_inferiority_margin": 0.3, "max_ece": 1.0}
    cards = spark.createDataFrame(
        [("a", "s", day[0], strict), ("b", "s", day[0], lenient), ("c", "s", day[1], strict), ("d", "s", day[2], strict)],
        "card_id string, scenario string, window_start timestamp, acceptance_criteria map<string,double>",
    )
    metrics = "rows long, roc_auc double, recall_at_top_decile double, brier_score double, expected_calibration_error double"
    good, worse = (100, 0.7, 0.3, 0.1, 0.02), (100, 0.5, 0.3, 0.1, 0.06)
    frozen = spark.createDataFrame([("v1", "frozen_holdout", *good), ("v2", "frozen_holdout", *good)], f"model string, eval_set string, {metrics}")
    own = [("v1", "s", day[0], *good), ("v2", "s", day[0], *worse), ("v1", "s", day[1], *good), ("v2", "s", day[1], *good)]  # the third day has no labels
    windows = spark.createDataFrame(own, f"model string, scenario string, window_start timestamp, {metrics}")
    group = "column_name string, group_value string, roc_auc double"
    frozen_groups = spark.createDataFrame([("v1", "frozen_holdout", "g", "x", 0.7), ("v2", "frozen_holdout", "g", "x", 0.7)], f"model string, eval_set string, {group}")
    window_groups = spark.createDataFrame([("v1", "s", day[1], "g", "x", 0.7), ("v2", "s", day[1], "g", "x", None)], f"model string, scenario string, window_start timestamp, {group}")
    pairs = cards.selectExpr("card_id", "'v2' AS challenger")
    found = gate.gate_own_windows(cards, pairs, (frozen, frozen_groups), (windows, window_groups), gate.criteria_table(spark), champion="v1").collect()
    got = {r.card_id: (r.outcome, r.checks, r.failed_criteria_count) for r in found}
    assert got == {"a": ("BLOCK", 11, 2), "b": ("PASS", 11, 0), "c": ("PASS", 12, 0), "d": ("BLOCK", 7, 1)}
    assert next(r for r in found if r.card_id == "d").reasons == ["evaluation_set_present [recent_labeled_window]: recent_labeled_window lacks the champion's metrics"]
