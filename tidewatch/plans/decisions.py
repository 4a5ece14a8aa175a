"""Decisions, gate, shadow and backlogs over the derived monitoring tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.operators import backtest, decisions, drift, gate, lifecycle, perturb, shadow
from tidewatch.operators.preparation import row_windows, window_end, window_start
from tidewatch.operators.quality import gate_metrics, metric_deltas, subgroup_metrics, unpivot_scores
from tidewatch.plans import check_sql as c
from tidewatch.plans import tables as t
from tidewatch.plans.preparation import bits_sql, uniform_sql
from tidewatch.plans.registry import query

DATE = "strftime(w, '%Y-%m-%d') AS window_date"


def _date(column: str = "window_start") -> F.Column:
    return F.date_format(column, "yyyy-MM-dd").alias("window_date")


@query(
    "breach_run_length",
    c.with_(
        c.RUNS_OF_BREACHES, recursive=True,
        select=f"SELECT policy_version, scenario, {DATE}, CAST(run AS BIGINT) AS run, array_to_string(persistent, ',') AS persistent FROM facts",
    ),
)
def breach_run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = decisions.breach_runs(t.events(spark, sf_dir), decisions.policy_table(spark))
    return runs.select(
        "policy_version", "scenario", _date(), F.col("consecutive_breaching_windows").cast("bigint").alias("run"),
        F.array_join("persistent_features", ",").alias("persistent"),
    )


@query(
    "confidence_terms",
    c.with_(
        c.RUNS_OF_BREACHES, recursive=True,
        select=f"""SELECT policy_version, scenario, {DATE}, round(severity, 6) AS severity, round(breadth, 6) AS breadth,
                   round(persistence, 6) AS persistence, evidence, confidence FROM weighed""",
    ),
)
def confidence_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decisions.with_confidence(decisions.evidence(t.events(spark, sf_dir), decisions.policy_table(spark)))
    return found.select(
        "policy_version", "scenario", _date(), "severity", "breadth", "persistence", "evidence", "confidence"
    )


@query(
    "policy_decisions",
    c.with_(
        c.CARDS, recursive=True,
        select=f"""
SELECT card_id, policy_version, scenario, {DATE}, action, disposition, rule_id, confidence,
       CASE WHEN action IN ('FULL_RETRAIN', 'INCREMENTAL_RETRAIN') THEN 'OPEN' ELSE 'CLOSED' END AS status,
       {c.RATIONALE} AS rationale
FROM cards""",
    ),
)
def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = decisions.decide(t.events(spark, sf_dir), decisions.policy_table(spark))
    return cards.select(
        "card_id", "policy_version", "scenario", _date(), "action", "disposition", "rule_id", "confidence", "status",
        "rationale",
    )


@query(
    "confidence_ceiling",
    c.with_(
        c.CARDS, recursive=True,
        select="SELECT policy_version, count(*) AS cards, 0.875::DOUBLE AS ceiling, count(*) FILTER (confidence > 0.875) AS above FROM cards GROUP BY ALL",
    ),
)
def confidence_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No card may claim more confidence than its policy can reach."""
    ceilings = decisions.confidence_ceiling(decisions.policy_table(spark))
    joined = t.cards(spark, sf_dir).join(F.broadcast(ceilings), "policy_version")
    return joined.groupBy("policy_version").agg(
        F.count(F.lit(1)).alias("cards"), F.max("ceiling").alias("ceiling"), F.count_if(F.col("confidence") > F.col("ceiling")).alias("above")
    )


@query(
    "decide_backlog",
    c.with_(
        c.CARDS, recursive=True,
        select=f"SELECT card_id, scenario, {DATE}, action, rule_id FROM cards WHERE policy_version = 'policy-v2' AND n % 3 <> 0",
    ),
)
def decide_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows a policy has not decided yet are decided against the full history, once."""
    events, cards = t.events(spark, sf_dir), t.cards(spark, sf_dir)
    on_record = cards.where((F.col("policy_version") == "policy-v2") & (t.window_number() % 3 == 0))
    waiting = decisions.undecided(events, on_record, "policy-v2")
    policies = decisions.policy_table(spark).where("policy_version = 'policy-v2'")
    new = decisions.decide(events, policies).join(waiting.select(F.col("event_id").alias("drift_event_id")), "drift_event_id", "left_semi")
    return new.select("card_id", "scenario", _date(), "action", "rule_id")


# Two looser policies, scores that move in one window of four, labels and retrains on some windows:
# together they reach every rule, the downgrade and the uncovered case.
COVERAGE_POLICIES = (
    {**decisions.POLICIES[0], "policy_version": "policy-c1", "psi_breach": 0.25, "psi_severe": 0.6, "alert_only_max_features": 1},
    {**decisions.POLICIES[0], "policy_version": "policy-c2", "psi_breach": 0.4, "psi_severe": 0.75, "alert_only_max_features": 1},
)
COVERAGE_SQL = c.with_(
    c.RUNS_OF_BREACHES.replace("('policy-v1', 0.1::DOUBLE), ('policy-v2', 0.2::DOUBLE)", "('policy-c1', 0.25::DOUBLE), ('policy-c2', 0.4::DOUBLE)"),
    """
numbered AS (SELECT *, CAST(date_diff('day', DATE '2024-01-11', w) AS BIGINT) AS n, CASE policy_version WHEN 'policy-c1' THEN 0.6::DOUBLE ELSE 0.75::DOUBLE END AS severe FROM weighed),
told AS (
  SELECT * EXCLUDE (prediction_drift, confidence), n % 4 = 3 AS drift, n % 7 = 2 AS matured, CASE WHEN n % 7 = 2 THEN 0.01::DOUBLE * (n % 5) END AS lost,
         CASE n % 6 WHEN 5 THEN 2.5::DOUBLE WHEN 4 THEN 9::DOUBLE END AS days, CASE WHEN n % 6 = 4 THEN 1 ELSE 0 END AS used,
         round(0.35 * severity + 0.2 * breadth + 0.2 * persistence + 0.25 * CASE WHEN n % 7 = 2 THEN 1::DOUBLE ELSE 0.5::DOUBLE END, 6) AS confidence FROM numbered),
picked AS (
  SELECT *, CASE WHEN matured AND lost > 0.03 THEN '5' WHEN coalesce(top >= severe, false) OR drift THEN '4' WHEN run >= 2 AND len(persistent) > 0 THEN '3'
                 WHEN breach_count = 1 AND run < 2 THEN '2' WHEN breach_count = 0 THEN '1' ELSE 'uncovered' END AS rule FROM told),
acting AS (SELECT *, CASE WHEN rule IN ('4', '5') THEN 'FULL_RETRAIN' WHEN rule = '3' THEN 'INCREMENTAL_RETRAIN' WHEN rule = '1' THEN 'NO_OP' ELSE 'ALERT_ONLY' END AS wanted FROM picked),
held AS (SELECT *, wanted LIKE '%RETRAIN' AND (coalesce(days < 7, false) OR used >= 1) AS held_back FROM acting)
""",
    recursive=True,
    select="""
SELECT policy_version, scenario, strftime(w, '%Y-%m-%d') AS window_date, confidence, CASE WHEN held_back THEN '6' ELSE rule END AS rule_id,
       CASE WHEN held_back THEN 'ALERT_ONLY' ELSE wanted END AS action, CASE WHEN held_back THEN wanted END AS downgraded_from,
       CASE WHEN held_back OR rule = '5' OR (rule = '4' AND confidence < 0.75) THEN 'ESCALATE_HUMAN' WHEN rule IN ('3', '4') THEN 'AUTO_PROCEED_SHADOW' ELSE 'NONE' END AS disposition,
       CASE WHEN held_back THEN wanted || ' held back, ' || CASE WHEN coalesce(days < 7, false) THEN 'last retrain ' || printf('%.2f', days) || ' days ago, cooldown 7' ELSE 'retrains used ' || used || ' of 1' END
         WHEN rule = '5' THEN 'labels are in: AUROC lost ' || printf('%.4f', lost) || ', allowed 0.03'
         WHEN rule = '4' THEN CASE WHEN coalesce(top >= severe, false) THEN worst || ' severe at PSI ' || printf('%.4f', top) ELSE 'scores moved, PSI ' || coalesce(printf('%.4f', prediction_psi), 'unknown') END
              || '; confidence ' || printf('%.4f', confidence) || CASE WHEN confidence >= 0.75 THEN ' reaches ' ELSE ' misses ' END || '0.75'
         WHEN rule = '3' THEN 'over the limit ' || run || ' windows in a row: ' || array_to_string(persistent, ', ')
         WHEN rule = '2' THEN breach_count || ' mild breach(es) in PSI [' || psi_breach || ', ' || severe || '), not yet repeated: alert'
         WHEN rule = '1' THEN 'quiet window: all features stay below PSI ' || psi_breach || ', scores steady'
         ELSE breach_count || ' breach(es) of PSI ' || psi_breach || ' fit no rule of ' || policy_version || ': ALERT_ONLY' END AS rationale FROM held""",
)


@query("rule_coverage", COVERAGE_SQL)
def rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards under looser policies with matured labels and retrain history, so that every rule has its say."""
    n = t.window_number()
    events = t.events(spark, sf_dir).withColumn("prediction_drift", n % 4 == 3)
    keyed = events.select("scenario", "window_start", n.alias("n"))
    matured = keyed.where("n % 7 = 2").select("scenario", "window_start", F.lit(True).alias("labels_matured"), (F.lit(0.01) * (F.col("n") % 5)).alias("matured_auroc_drop_seen"))
    days = F.when(F.col("n") % 6 == 5, F.lit(2.5)).when(F.col("n") % 6 == 4, F.lit(9.0))
    retrains = keyed.where("n % 6 in (4, 5)").select("scenario", "window_start", days.alias("days_since_last_retrain"), F.when(F.col("n") % 6 == 4, 1).otherwise(0).cast("bigint").alias("retrains_in_cooldown"))
    cards = decisions.decide(events, decisions.policy_table(spark, COVERAGE_POLICIES), retrains=retrains, matured=matured)
    return cards.select("policy_version", "scenario", _date(), "confidence", "rule_id", "action", "downgraded_from", "disposition", "rationale")


@query(
    "retrain_cooldown_history",
    c.with_(
        c.AUDIT, recursive=True,
        select=f"""
SELECT d.scenario, strftime(d.w, '%Y-%m-%d') AS window_date,
       round((epoch_us(CAST(d.w AS TIMESTAMP)) - max(epoch_us(r.created_at))) / 86400000000::DOUBLE, 6) AS days_since_last_retrain,
       count(r.run_id) FILTER (r.created_at >= CAST(d.w AS TIMESTAMP) - INTERVAL 7 DAY) AS retrains_in_cooldown
FROM dev d LEFT JOIN runs r ON r.scenario = d.scenario AND r.created_at < CAST(d.w AS TIMESTAMP) GROUP BY d.scenario, d.w""",
    ),
)
def retrain_cooldown_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = decisions.retrain_history(t.events(spark, sf_dir), t.runs(spark, sf_dir), 7.0)
    return history.select("scenario", _date(), F.round("days_since_last_retrain", 6).alias("days_since_last_retrain"), "retrains_in_cooldown")


# --- gate -----------------------------------------------------------------------------------
@query("gate_checks", c.with_(c.CHECKS, select="SELECT challenger, eval_set, criterion, passed, observed, required, subgroup FROM gchecks"))
def gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.checks(spark, sf_dir).select("challenger", "eval_set", "criterion", "passed", "observed", "required", "subgroup")


@query("gate_failed_checks", c.with_(c.CHECKS, select="SELECT challenger, eval_set, criterion, subgroup FROM gchecks WHERE NOT passed"))
def gate_failed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.checks(spark, sf_dir).where("NOT passed").select("challenger", "eval_set", "criterion", "subgroup")


@query("gate_verdict", c.with_(c.CHECKS, select="SELECT challenger, 'gate-v1' AS criteria_version, outcome, checks, failed AS failed_criteria_count, failed AS reasons FROM verdicts"))
def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.gate_verdicts(t.checks(spark, sf_dir)).withColumn("reasons", F.size("reasons").cast("bigint"))


@query(
    "gate_coverage",
    c.with_(
        c.CHECKS,
        select="""
SELECT challenger, CASE WHEN challenger = 'v3' THEN 'BLOCK' ELSE outcome END AS outcome,
       CASE WHEN challenger = 'v3' THEN (SELECT count(*) FROM gchecks g WHERE g.challenger = v.challenger AND g.eval_set = 'frozen_holdout') + 1 ELSE checks END AS checks
FROM verdicts v""",
    ),
)
def gate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A challenger never measured on a required set is blocked."""
    champion, challenger, champion_groups, challenger_groups = t.sides(spark, sf_dir)
    seen = ~((F.col("challenger") == "v3") & (F.col("eval_set") == "recent_labeled_window"))
    checks = gate.gate_checks(champion, challenger.where(seen), champion_groups, challenger_groups.where(seen), gate.criteria_table(spark))
    return gate.gate_verdicts(checks).select("challenger", "outcome", "checks")


@query(
    "gate_by_card",
    c.with_(
        c.CARDS, c.CHECKS, recursive=True,
        select="""
SELECT card_id, v.challenger, v.outcome, v.checks, v.failed AS failed_criteria_count, 'card:' || card_id AS criteria_version
FROM cards JOIN verdicts v ON v.challenger = CASE WHEN n % 2 = 0 THEN 'v3' ELSE 'v2' END OR (v.challenger = 'v9' AND n % 3 = 0) WHERE policy_version = 'policy-v2' AND action IN ('FULL_RETRAIN', 'INCREMENTAL_RETRAIN')""",
    ),
)
def gate_by_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every retrain card gates its own challengers, one trained and for some one known to be bad, under the thresholds it pinned."""
    cards = t.retrain_cards(spark, sf_dir)
    own = F.when(F.col("n") % 2 == 0, F.lit("v3")).otherwise(F.lit("v2"))
    pairs = cards.select("card_id", F.explode(F.array_compact(F.array(own, F.when(F.col("n") % 3 == 0, F.lit("v9"))))).alias("challenger"))
    found = gate.gate_cards(cards, pairs, *t.sides(spark, sf_dir), gate.criteria_table(spark))
    return found.drop("reasons")


# Two policies whose cards pin different thresholds.
LENIENT = {"auroc_non_inferiority_margin": 0.2, "recall_top_decile_min_ratio": 0.5, "max_brier_increase": 0.5, "max_ece": 0.9, "max_subgroup_auroc_drop": 0.45}
GATE_POLICIES = (decisions.POLICIES[0], {**decisions.POLICIES[1], "acceptance_criteria": LENIENT})
_W = "model, scenario, w"
OWN_WINDOWS = c.with_(
    c.CARDS, c.METRICS,
    f"""
labelled AS (
  SELECT s.event_id AS doc_id, s.scenario, s.w, CAST(l.toxic AS VARCHAR) AS toxic, l.quality AS y, s.score FROM cur s JOIN labels l ON l.doc_id = s.event_id % (SELECT count(*) FROM documents)),
wl AS (
  SELECT 'v1' AS model, doc_id, scenario, w, toxic, y, score AS p FROM labelled UNION ALL SELECT 'v2', doc_id, scenario, w, toxic, y, CAST((doc_id * 37) % 101 AS DOUBLE) / 101::DOUBLE FROM labelled
  UNION ALL SELECT 'v3', doc_id, scenario, w, toxic, y, 0.8::DOUBLE + 0.1::DOUBLE * score FROM labelled UNION ALL SELECT 'v9', doc_id, scenario, w, toxic, y, 1::DOUBLE - score FROM labelled),
{c.auc('wl', _W, 'rank_w').strip()},
{c.ece('wl', _W, 'ece_w').strip()},
{c.top_recall('wl', _W, 'top_w').strip()},
wm AS (
  SELECT model, scenario, w, b.rows, round(roc_auc, 6) AS roc_auc, round(recall, 6) AS recall, round(brier, 6) AS brier, round(ece, 6) AS ece
  FROM (SELECT model, scenario, w, count(*) AS rows, avg((p - y) * (p - y)) AS brier FROM wl GROUP BY ALL HAVING count(DISTINCT y) = 2) b
  JOIN rank_w USING (model, scenario, w) JOIN ece_w USING (model, scenario, w) JOIN top_w USING (model, scenario, w)),
wg_long AS (SELECT model, scenario, w, 'toxic=' || coalesce(toxic, 'nan') AS label, y, p FROM wl),
{c.auc('wg_long', _W + ', label', 'wg_auc').strip()},
bars(policy_version, margin, ratio, up, ece_top, fall) AS (VALUES ('policy-v1', 0.005::DOUBLE, 1::DOUBLE, 0.005::DOUBLE, 0.05::DOUBLE, 0.01::DOUBLE), ('policy-v2', 0.2::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE, 0.45::DOUBLE)),
gp AS (
  SELECT card_id, policy_version, scenario, w, u.challenger FROM cards, unnest([CASE WHEN n % 2 = 0 THEN 'v3' ELSE 'v2' END, CASE WHEN n % 3 = 0 THEN 'v9' END]) AS u(challenger)
  WHERE action IN ('FULL_RETRAIN', 'INCREMENTAL_RETRAIN') AND u.challenger IS NOT NULL),
faced AS (
  SELECT gp.*, 'frozen' AS eval_set, a.roc_auc AS aa, b.roc_auc AS ba, a.recall_at_top_decile AS ar, b.recall_at_top_decile AS br, a.brier_score AS ab, b.brier_score AS bb, b.expected_calibration_error AS be, true AS present
  FROM gp JOIN metrics a ON a.model = 'v1' AND a.eval_set = 'frozen_holdout' JOIN metrics b ON b.model = gp.challenger AND b.eval_set = 'frozen_holdout'
  UNION ALL
  SELECT gp.*, 'own', a.roc_auc, b.roc_auc, a.recall, b.recall, a.brier, b.brier, b.ece, a.model IS NOT NULL AND b.model IS NOT NULL
  FROM gp LEFT JOIN wm a ON a.model = 'v1' AND a.scenario = gp.scenario AND a.w = gp.w LEFT JOIN wm b ON b.model = gp.challenger AND b.scenario = gp.scenario AND b.w = gp.w),
groups_of AS (
  SELECT gp.card_id, gp.challenger, 'frozen' AS eval_set, a.roc_auc AS before, b.roc_auc AS after
  FROM gp JOIN grp b ON b.model = gp.challenger AND b.eval_set = 'frozen_holdout' JOIN grp a ON a.model = 'v1' AND a.eval_set = b.eval_set AND a.column_name = b.column_name AND a.group_value = b.group_value
  UNION ALL
  SELECT gp.card_id, gp.challenger, 'own', round(a.roc_auc, 6), round(b.roc_auc, 6)
  FROM gp JOIN wg_auc b ON b.model = gp.challenger AND b.scenario = gp.scenario AND b.w = gp.w JOIN wg_auc a ON a.model = 'v1' AND a.scenario = b.scenario AND a.w = b.w AND a.label = b.label),
told AS (
  SELECT card_id, challenger, CASE WHEN present THEN 5 ELSE 1 END AS checks,
         CASE WHEN NOT present THEN 1 ELSE CAST(round(ba - (aa - margin), 9) < 0 AS INTEGER) + CAST(round(br - ar * ratio, 9) < 0 AS INTEGER)
              + CAST(round(ab + up - bb, 9) < 0 AS INTEGER) + CAST(round(ece_top - be, 9) < 0 AS INTEGER) END AS failed
  FROM faced JOIN bars USING (policy_version)
  UNION ALL
  SELECT g.card_id, g.challenger, 1, CASE WHEN before IS NULL OR after IS NULL THEN 0 ELSE CAST(round(after - (before - fall), 9) < 0 AS INTEGER) END
  FROM groups_of g JOIN faced f USING (card_id, challenger, eval_set) JOIN bars USING (policy_version) WHERE present)""",
    recursive=True,
    select="""SELECT card_id, policy_version, scenario, challenger, CASE WHEN sum(failed) = 0 THEN 'PASS' ELSE 'BLOCK' END AS outcome, CAST(sum(checks) AS BIGINT) AS checks, CAST(sum(failed) AS BIGINT) AS failed_criteria_count
FROM told JOIN gp USING (card_id, challenger) GROUP BY card_id, policy_version, scenario, challenger""",
)


def challengers_of(cards: DataFrame) -> DataFrame:
    """(card_id, challenger): one trained for the card and, for some, one known to be bad."""
    n = t.window_number()
    own = F.when(n % 2 == 0, F.lit("v3")).otherwise(F.lit("v2"))
    return cards.select("card_id", F.explode(F.array_compact(F.array(own, F.when(n % 3 == 0, F.lit("v9"))))).alias("challenger"))


@query("gate_own_window", OWN_WINDOWS)
def gate_own_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every retrain card gates its challengers on the window it is about, under the thresholds its policy pinned."""
    cards = decisions.decide(t.events(spark, sf_dir), decisions.policy_table(spark, GATE_POLICIES)).where(F.col("action").isin(*decisions.RETRAIN_ACTIONS))
    cards = t.written_once(spark, sf_dir, "gate_cards", lambda: cards)
    held = (t.set_metrics(spark, sf_dir), t.group_metrics(spark, sf_dir))
    frozen = tuple(df.where(F.col("eval_set") == "frozen_holdout") for df in held)
    found = gate.gate_own_windows(cards, challengers_of(cards), frozen, t.window_metrics(spark, sf_dir), gate.criteria_table(spark), champion="v1")
    return found.join(cards.select("card_id", "policy_version", "scenario"), "card_id").select(
        "card_id", "policy_version", "scenario", "challenger", "outcome", "checks", "failed_criteria_count"
    )


@query(
    "gate_worst_subgroup",
    c.with_(
        c.METRICS,
        select="""
SELECT challenger, eval_set, w.subgroup AS subgroup, w.drop_ AS auroc_drop FROM (
  SELECT b.model AS challenger, b.eval_set, max({'drop_': round(a.roc_auc - b.roc_auc, 6), 'subgroup': b.column_name || '=' || b.group_value}) AS w
  FROM grp a JOIN grp b USING (eval_set, column_name, group_value)
  WHERE a.model = 'v1' AND b.model <> 'v1' AND a.roc_auc IS NOT NULL AND b.roc_auc IS NOT NULL GROUP BY ALL)""",
    ),
)
def gate_worst_subgroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, champion_groups, challenger_groups = t.sides(spark, sf_dir)
    return gate.worst_subgroup(champion_groups, challenger_groups)


@query(
    "headline_metrics",
    c.with_(
        c.METRICS,
        "u AS (UNPIVOT (SELECT model, eval_set, roc_auc, recall_at_top_decile, brier_score, expected_calibration_error FROM metrics WHERE model IN ('v1', 'v3')) ON roc_auc, recall_at_top_decile, brier_score, expected_calibration_error INTO NAME metric VALUE value)",
        select="""SELECT eval_set, metric, max(value) FILTER (model = 'v1') AS v1, max(value) FILTER (model = 'v3') AS v3,
                  round(max(value) FILTER (model = 'v3') - max(value) FILTER (model = 'v1'), 6) AS delta FROM u GROUP BY ALL""",
    ),
)
def headline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_deltas(t.set_metrics(spark, sf_dir), ["eval_set"], "model", "v1", "v3", gate.METRICS)


# --- shadow and promotion ---------------------------------------------------------------------
SHADOW_STATS = """
ranked AS (
  SELECT shadow_version, c, s,
         rank() OVER (PARTITION BY shadow_version ORDER BY c) + (count(*) OVER (PARTITION BY shadow_version, c) - 1) / 2.0 AS rc,
         rank() OVER (PARTITION BY shadow_version ORDER BY s) + (count(*) OVER (PARTITION BY shadow_version, s) - 1) / 2.0 AS rs
  FROM shadow WHERE s IS NOT NULL),
rho AS (SELECT shadow_version, corr(rc, rs) AS spearman FROM ranked GROUP BY ALL),
stats AS (
  SELECT champion_version, shadow_version, count(*) AS requests, count(s) AS scored, count(*) - count(s) AS failed,
         avg(CASE WHEN s IS NOT NULL THEN CAST((c >= 0.5) = (s >= 0.5) AS INTEGER) END) AS agreement,
         count(*) FILTER (c < 0.5 AND s >= 0.5) AS flips_to_positive, count(*) FILTER (c >= 0.5 AND s < 0.5) AS flips_to_negative,
         avg(abs(s - c)) AS mean_abs_diff, quantile_cont(abs(s - c), 0.95) AS p95_abs_diff, max(abs(s - c)) AS max_abs_diff,
         avg(CASE WHEN s IS NOT NULL THEN c END) AS cm, avg(s) AS sm
  FROM shadow GROUP BY ALL)
"""


@query(
    "shadow_agreement",
    c.with_(
        c.SHADOW, SHADOW_STATS,
        select="""
SELECT champion_version, shadow_version, requests, scored, failed, 0.5::DOUBLE AS decision_threshold, round(agreement, 6) AS decision_agreement,
       flips_to_positive, flips_to_negative, round(mean_abs_diff, 6) AS mean_abs_diff, round(p95_abs_diff, 6) AS p95_abs_diff,
       round(max_abs_diff, 6) AS max_abs_diff, round(spearman, 6) AS spearman, round(cm, 6) AS champion_mean_score,
       round(sm, 6) AS shadow_mean_score, round(sm - cm, 6) AS mean_shift
FROM stats JOIN rho USING (shadow_version)""",
    ),
)
def shadow_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shadow.shadow_stats(t.shadow_predictions(spark, sf_dir))


@query(
    "shadow_pair_alignment",
    """
SELECT model_version, count(*) AS requests, count(*) FILTER (d.doc_id IS NOT NULL AND d.doc_id % 50 <> 0) AS scored,
       round(avg(CASE WHEN d.doc_id % 50 <> 0 THEN abs(CAST((d.doc_id * 37) % 101 AS DOUBLE) / 101::DOUBLE - least(value, 500::DOUBLE) / 500::DOUBLE) END), 6) AS mean_abs_diff
FROM (SELECT *, 'v' || (user_id % 3 + 1) AS model_version FROM events) e LEFT JOIN documents d ON d.doc_id = e.event_id GROUP BY ALL
""",
)
def shadow_pair_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = t.shadow_predictions(spark, sf_dir).select("request_id", "shadow_score")
    pairs = shadow.pair_requests(t.predictions(spark, sf_dir).select("request_id", "model_version", "score"), late)
    return pairs.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("requests"), F.count("shadow_score").alias("scored"),
        F.round(F.avg(F.abs(F.col("shadow_score") - F.col("score"))), 6).alias("mean_abs_diff"),
    )


ALIASES = "now AS (SELECT (SELECT arg_max(to_version, (timestamp_utc, run_id)) FROM moves WHERE alias = 'champion') AS champion_now, (SELECT arg_max(to_version, (timestamp_utc, run_id)) FROM moves WHERE alias = 'shadow') AS shadow_now)"


@query("current_aliases", c.with_(c.AUDIT, recursive=True, select="SELECT alias, arg_max(to_version, (timestamp_utc, run_id)) AS version FROM moves GROUP BY ALL"))
def current_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shadow.current_aliases(t.alias_moves(spark, sf_dir))


@query(
    "promotion_preconditions",
    c.with_(
        c.AUDIT, c.SHADOW, ALIASES, recursive=True,
        select="""
SELECT run_id, outcome = 'PASS' AND shadow_alias_moved AS gate_pass, coalesce(shadow_now = challenger_version, false) AS challenger_in_shadow,
       coalesce(champion_now = r.champion_version, false) AS champion_unchanged_since_gate, coalesce(s.requests, 0) >= 50 AS shadow_window_complete,
       coalesce(s.requests, 0) AS seen,
       outcome = 'PASS' AND shadow_alias_moved AND coalesce(shadow_now = challenger_version, false) AND coalesce(champion_now = r.champion_version, false) AND coalesce(s.requests, 0) >= 50 AS ready_to_approve
FROM runs r CROSS JOIN now LEFT JOIN (SELECT champion_version, shadow_version, count(*) AS requests FROM shadow GROUP BY ALL) s
  ON s.champion_version = champion_now AND s.shadow_version = challenger_version""",
    ),
)
def promotion_preconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = shadow.pair_counts(t.shadow_predictions(spark, sf_dir))
    checked = shadow.promotion_preconditions(t.runs(spark, sf_dir), shadow.current_aliases(t.alias_moves(spark, sf_dir)), counts)
    return checked.select("run_id", "gate_pass", "challenger_in_shadow", "champion_unchanged_since_gate", "shadow_window_complete", "seen", "ready_to_approve")


@query(
    "promotion_evidence",
    c.with_(
        c.AUDIT, c.SHADOW, ALIASES, recursive=True,
        select="""
SELECT run_id, c.scenario, c.rule_id, r.outcome, r.failed_criteria_count, CAST(coalesce(d.sets, 0) AS BIGINT) AS sets_with_drop,
       round(d.worst, 6) AS worst_drop, s.requests AS shadow_requests
FROM runs r JOIN cards c USING (card_id) CROSS JOIN now
LEFT JOIN (SELECT b.model AS challenger_version, count(DISTINCT b.eval_set) AS sets, max(round(a.roc_auc - b.roc_auc, 6)) AS worst
           FROM grp a JOIN grp b USING (eval_set, column_name, group_value) WHERE a.model = 'v1' AND a.roc_auc IS NOT NULL AND b.roc_auc IS NOT NULL GROUP BY ALL) d USING (challenger_version)
LEFT JOIN (SELECT champion_version, shadow_version, count(*) AS requests FROM shadow GROUP BY ALL) s
  ON s.champion_version = champion_now AND s.shadow_version = challenger_version""",
    ),
)
def promotion_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, champion_groups, challenger_groups = t.sides(spark, sf_dir)
    found = shadow.promotion_evidence(
        t.runs(spark, sf_dir), t.cards(spark, sf_dir), gate.worst_subgroup(champion_groups, challenger_groups),
        shadow.shadow_stats(t.shadow_predictions(spark, sf_dir)), shadow.current_aliases(t.alias_moves(spark, sf_dir)),
    )
    worst = F.array_max(F.transform("worst_subgroup_auroc_drop", lambda d: d["auroc_drop"]))
    return found.select(
        "run_id", "card.scenario", "card.rule_id", "gate.outcome", "gate.failed_criteria_count",
        F.coalesce(F.size("worst_subgroup_auroc_drop"), F.lit(0)).cast("bigint").alias("sets_with_drop"),
        F.round(worst, 6).alias("worst_drop"), F.col("shadow_window.requests").alias("shadow_requests"),
    )


# --- backlogs ---------------------------------------------------------------------------------
@query(
    "retrain_backlog",
    c.with_(
        c.AUDIT, recursive=True,
        select=f"""
SELECT card_id, scenario, {DATE}, disposition FROM cards c
WHERE action IN ('FULL_RETRAIN', 'INCREMENTAL_RETRAIN') AND card_id NOT IN (SELECT card_id FROM runs)
  AND (disposition = 'AUTO_PROCEED_SHADOW' OR card_id IN (SELECT subject FROM approvals WHERE kind = 'RETRAIN' AND decision = 'APPROVE'))""",
    ),
)
def retrain_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = lifecycle.awaiting_retrain(t.cards(spark, sf_dir), t.runs(spark, sf_dir), t.approvals(spark, sf_dir), include_approved=True)
    return waiting.select("card_id", "scenario", _date(), "disposition")


@query(
    "retrain_backlog_oldest",
    c.with_(
        c.AUDIT, recursive=True,
        select=f"""
SELECT card_id, {DATE}, row_number() OVER (ORDER BY w, card_id) AS place FROM cards c
WHERE action IN ('FULL_RETRAIN', 'INCREMENTAL_RETRAIN') AND card_id NOT IN (SELECT card_id FROM runs) AND disposition = 'AUTO_PROCEED_SHADOW'
ORDER BY place LIMIT 5""",
    ),
)
def retrain_backlog_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five automated cards that wait longest, in the order in which they are handed out."""
    waiting = lifecycle.awaiting_retrain(t.cards(spark, sf_dir), t.runs(spark, sf_dir), t.approvals(spark, sf_dir), limit=5)
    # A limited order is one partition, whose ids count its rows.
    return waiting.select("card_id", _date(), (F.monotonically_increasing_id() + 1).alias("place"))


@query(
    "authorisation_backlog",
    c.with_(
        c.AUDIT, recursive=True,
        select=f"""
SELECT card_id, scenario, {DATE}, policy_version FROM cards
WHERE action IN ('FULL_RETRAIN', 'INCREMENTAL_RETRAIN') AND disposition = 'ESCALATE_HUMAN' AND card_id NOT IN (SELECT card_id FROM runs)
  AND card_id NOT IN (SELECT subject FROM approvals WHERE kind = 'RETRAIN')""",
    ),
)
def authorisation_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = lifecycle.awaiting_authorisation(t.cards(spark, sf_dir), t.runs(spark, sf_dir), t.approvals(spark, sf_dir))
    return waiting.select("card_id", "scenario", _date(), "policy_version")


@query(
    "promotion_backlog",
    c.with_(
        c.AUDIT, recursive=True,
        select="SELECT run_id, card_id, challenger_version FROM runs WHERE outcome = 'PASS' AND shadow_alias_moved AND run_id NOT IN (SELECT subject FROM approvals WHERE kind = 'PROMOTION')",
    ),
)
def promotion_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.pending_promotions(t.runs(spark, sf_dir), t.approvals(spark, sf_dir)).select("run_id", "card_id", "challenger_version")


@query(
    "retrain_authorisation",
    c.with_(
        c.AUDIT, recursive=True,
        select="""
SELECT c.card_id, CASE WHEN action NOT IN ('FULL_RETRAIN', 'INCREMENTAL_RETRAIN') THEN 'not a retrain card'
         WHEN disposition = 'ESCALATE_HUMAN' AND decision = 'REJECT' THEN 'rejected' WHEN disposition = 'AUTO_PROCEED_SHADOW' THEN 'authorised'
         WHEN disposition = 'ESCALATE_HUMAN' AND decision = 'APPROVE' THEN 'authorised' ELSE 'needs authorisation' END AS authorisation,
       CASE WHEN disposition = 'ESCALATE_HUMAN' AND decision = 'APPROVE' THEN approver END AS authorized_by
FROM cards c LEFT JOIN approvals a ON a.kind = 'RETRAIN' AND a.subject = c.card_id""",
    ),
)
def retrain_authorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.authorisation(t.cards(spark, sf_dir), t.approvals(spark, sf_dir)).select("card_id", "authorisation", "authorized_by")


@query(
    "pinned_version_check",
    c.with_(
        c.CARDS, recursive=True,
        select="""
SELECT card_id, CASE WHEN n % 4 = 0 THEN 'ok' WHEN scenario = 'error' THEN 'missing' WHEN n % 4 = 1 THEN 'mismatch' ELSE 'ok' END AS version_status
FROM cards""",
    ),
)
def pinned_version_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t.window_number()
    pins = t.cards(spark, sf_dir).withColumn("candidate_data_version", F.when(n % 4 == 0, F.lit(None)).when(n % 4 == 1, F.lit("d0")).otherwise(F.lit("d1")))
    present = t.events(spark, sf_dir).where(F.col("scenario") != "error").select("scenario", "data_version").distinct()
    return gate.pinned_version_status(pins, present).select("card_id", "version_status")


# --- back-test summary ------------------------------------------------------------------------
def _decision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = t.cards(spark, sf_dir)
    counted = t.events(spark, sf_dir).select(F.col("event_id").alias("drift_event_id"), F.col("breaching_feature_count").alias("breaching_features"))
    by_mode = t.runs(spark, sf_dir).groupBy("card_id").agg(
        F.max(F.when(F.col("mode") == "live", F.col("outcome"))).alias("gate_retrained"), F.max(F.when(F.col("mode") == "demo_bad", F.col("outcome"))).alias("gate_bad")
    )
    joined = cards.join(counted, "drift_event_id").join(by_mode, "card_id", "left")
    return joined.withColumn("window_index", t.window_number().cast("bigint"))


@query(
    "backtest_summary",
    c.with_(
        c.AUDIT, recursive=True,
        select="""
SELECT policy_version, scenario, count(*) AS windows, round(avg(CAST(breaching_feature_count > 0 OR prediction_drift AS INTEGER)), 4) AS monitor_breach_rate,
       round(avg(CAST(action <> 'NO_OP' AS INTEGER)), 4) AS acting_card_rate, min(n) FILTER (action <> 'NO_OP') AS detection_latency_windows,
       array_to_string(list_sort(list(DISTINCT action)), ',') AS actions, array_to_string(list_sort(list(DISTINCT disposition)), ',') AS dispositions,
       round(min(confidence), 4) AS confidence_min, round(max(confidence), 4) AS confidence_max, count(g.good) AS gated_cards,
       count(*) FILTER (g.good = 'PASS') AS retrained_pass, count(*) FILTER (g.good = 'BLOCK') AS retrained_block, count(*) FILTER (g.bad = 'BLOCK') AS bad_challenger_block
FROM cards c LEFT JOIN (SELECT card_id, max(outcome) FILTER (mode = 'live') AS good, max(outcome) FILTER (mode = 'demo_bad') AS bad FROM runs GROUP BY ALL) g USING (card_id)
GROUP BY policy_version, scenario""",
    ),
)
def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.summarise(_decision_rows(spark, sf_dir))


@query(
    "false_trigger_rate",
    c.with_(c.CARDS, recursive=True, select="SELECT policy_version, round(avg(CAST(action <> 'NO_OP' AS INTEGER)), 4) AS false_trigger_rate FROM cards WHERE scenario = 'view' GROUP BY ALL"),
)
def false_trigger_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.false_trigger_rate(t.cards(spark, sf_dir), "view")


# --- back-test end to end -----------------------------------------------------------------------
BLOCK = 500
_PERTURBED = f"""
strm AS (
  SELECT event_id, CAST(ts AS DATE) AS w, value, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k, CAST(hour(ts) AS BIGINT) AS hour,
         CAST(user_id % 10 AS VARCHAR) AS ub, least(value, 500::DOUBLE) / 500::DOUBLE AS score FROM events),
ref AS (SELECT * FROM strm WHERE w < DATE '2024-01-11'),
base AS (
  SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos, count(*) OVER () AS total, CASE WHEN ub IN ('7', '8', '9') THEN 4 ELSE 1 END AS wt
  FROM strm WHERE w >= DATE '2024-01-11'),
summed AS (SELECT *, sum(wt) OVER (ORDER BY event_id) AS upto, sum(wt) OVER () AS weight FROM base),
spread AS (
  SELECT *, CAST(floor((upto - wt)::DOUBLE / weight::DOUBLE * total + 0.5::DOUBLE) AS BIGINT) AS a, CAST(floor(upto::DOUBLE / weight::DOUBLE * total + 0.5::DOUBLE) AS BIGINT) AS b FROM summed),
placed AS (
  SELECT 'S1' AS scenario, pos, total, value, CAST(greatest(round_even(k * 1.2::DOUBLE + sqrt(-2::DOUBLE * ln({uniform_sql('event_id', '42-k-a')})) * cos(6.283185307179586::DOUBLE * ({uniform_sql('event_id', '42-k-b')})), 0), (SELECT min(k) FROM base)) AS BIGINT) AS k, hour, ub, score FROM base
  UNION ALL SELECT 'S3', u.p, total, value, k, hour, ub, score FROM spread, unnest(range(a, b)) AS u(p)
  UNION ALL SELECT 'S5', pos, total, value, k, hour, ub, score FROM base),
cur AS (SELECT scenario, CAST(DATE '2026-01-01' + CAST(pos // {BLOCK} AS INTEGER) AS DATE) AS w, value, k, hour, ub, score FROM placed WHERE (pos // {BLOCK} + 1) * {BLOCK} <= total)
"""


@query(
    "backtest_end_to_end",
    c.with_(
        c.CARDS.replace(c.STREAM.strip(), _PERTURBED.strip()), recursive=True,
        select="""
SELECT policy_version, scenario, count(*) AS windows, round(avg(CAST(breaching_feature_count > 0 OR prediction_drift AS INTEGER)), 4) AS monitor_breach_rate,
       round(avg(CAST(action <> 'NO_OP' AS INTEGER)), 4) AS acting_card_rate, min(date_diff('day', DATE '2026-01-01', w)) FILTER (action <> 'NO_OP') AS detection_latency_windows,
       array_to_string(list_sort(list(DISTINCT action)), ',') AS actions, array_to_string(list_sort(list(DISTINCT disposition)), ',') AS dispositions,
       round(min(confidence), 4) AS confidence_min, round(max(confidence), 4) AS confidence_max
FROM cards GROUP BY policy_version, scenario""",
    ),
)
def backtest_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perturb the serving stream three ways, cut it into blocks, measure, decide, summarise.

    S2 (nulls filled), S4 (relabelled at the base rate) and the gate are left out, here and in the SQL.
    """
    reference, serving = t.split_stream(t.stream(spark, sf_dir))
    base = serving.select("event_id", "value", "k", "hour", "ub", "score")
    changed = backtest.perturbed_streams(
        base,
        {
            "S1": lambda df: perturb.scale_jitter(df, ["event_id"], ["k"], portable=True),
            "S3": lambda df: perturb.weighted_resample(df, "event_id", F.when(F.col("ub").isin("7", "8", "9"), 4).otherwise(1)),
            "S5": perturb.unchanged,
        },
    )
    # Written before it is cut: placing the rows reads every perturbed stream three times.
    streams = t.written_once(spark, sf_dir, "three_streams", lambda: changed)
    # Written before it is measured: the perturbed streams are read by several aggregations.
    windows = t.written_once(spark, sf_dir, "perturbed_windows", lambda: row_windows(streams, "event_id", "event_id", BLOCK, groups=["scenario"], keep_partial=False))
    spec = drift.MonitorSpec(("scenario", "window_index"), ("value", "k", "hour"), ("ub",), "score")
    index = F.col("window_index")
    events = drift.window_events(reference, windows, spec, scenario="scenario", window_start=window_start(index), window_end=window_end(index), window_number=index)
    events = t.written_once(spark, sf_dir, "backtest_events", lambda: events)
    cards = decisions.decide(events, decisions.policy_table(spark))
    counted = events.select(F.col("event_id").alias("drift_event_id"), F.col("breaching_feature_count").alias("breaching_features"))
    rows = cards.join(counted, "drift_event_id").withColumns(
        {
            "window_index": F.datediff(F.col("window_start").cast("date"), F.lit("2026-01-01").cast("date")).cast("bigint"),
            "gate_retrained": F.lit(None).cast("string"),
            "gate_bad": F.lit(None).cast("string"),
        }
    )
    summary = backtest.summarise(rows)
    return summary.drop("gated_cards", "retrained_pass", "retrained_block", "bad_challenger_block")


# --- back-test of all five perturbations, gated -------------------------------------------------
_FIVE = f"""
strm AS (
  SELECT event_id, CAST(ts AS DATE) AS w, value, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k, CAST(hour(ts) AS BIGINT) AS hour,
         CAST(user_id % 10 AS VARCHAR) AS ub, least(value, 500::DOUBLE) / 500::DOUBLE AS score,
         CASE event_id % 4 WHEN 1 THEN '>7' WHEN 2 THEN 'Norm' WHEN 3 THEN '>8' END AS grade, l.quality AS y
  FROM events LEFT JOIN labels l ON l.doc_id = event_id % (SELECT count(*) FROM documents)),
ref AS (SELECT * FROM strm WHERE w < DATE '2024-01-11'),
base AS (
  SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos, count(*) OVER () AS total, CASE WHEN ub IN ('7', '8', '9') THEN 4 ELSE 1 END AS wt,
         row_number() OVER (PARTITION BY grade IS NULL ORDER BY {bits_sql('event_id', '42-rows')}, event_id) AS gn, count(*) OVER (PARTITION BY grade IS NULL) AS gc, {uniform_sql('event_id', '42-values')} AS gu,
         row_number() OVER (ORDER BY {bits_sql('event_id', '42-rows')}, event_id) AS ln, avg(y) OVER () AS rate, {uniform_sql('event_id', '42-labels')} AS lu
  FROM strm WHERE w >= DATE '2024-01-11'),
summed AS (SELECT *, sum(wt) OVER (ORDER BY event_id) AS upto, sum(wt) OVER () AS weight FROM base),
spread AS (
  SELECT *, CAST(floor((upto - wt)::DOUBLE / weight::DOUBLE * total + 0.5::DOUBLE) AS BIGINT) AS a, CAST(floor(upto::DOUBLE / weight::DOUBLE * total + 0.5::DOUBLE) AS BIGINT) AS b FROM summed),
placed AS (
  SELECT 'S1' AS scenario, pos, total, value, CAST(greatest(round_even(k * 1.2::DOUBLE + sqrt(-2::DOUBLE * ln({uniform_sql('event_id', '42-k-a')})) * cos(6.283185307179586::DOUBLE * ({uniform_sql('event_id', '42-k-b')})), 0), (SELECT min(k) FROM base)) AS BIGINT) AS k, hour, ub, score, grade, y FROM base
  UNION ALL SELECT 'S2', pos, total, value, k, hour, ub, score,
    coalesce(grade, CASE WHEN gn <= round_even(gc * 0.4::DOUBLE, 0) THEN CASE WHEN gu < 0.25 THEN '>7' WHEN gu < 0.25 + 0.2 THEN '>8' ELSE 'Norm' END END), y FROM base
  UNION ALL SELECT 'S3', u.p, total, value, k, hour, ub, score, grade, y FROM spread, unnest(range(a, b)) AS u(p)
  UNION ALL SELECT 'S4', pos, total, value, k, hour, ub, score, grade, CASE WHEN ln <= round_even(total * 0.3::DOUBLE, 0) THEN CASE WHEN lu < rate THEN 1 ELSE 0 END ELSE y END FROM base
  UNION ALL SELECT 'S5', pos, total, value, k, hour, ub, score, grade, y FROM base),
cur AS (SELECT scenario, CAST(DATE '2026-01-01' + CAST(pos // {BLOCK} AS INTEGER) AS DATE) AS w, pos, value, k, hour, ub, score, grade, y FROM placed WHERE (pos // {BLOCK} + 1) * {BLOCK} <= total)
"""
_FIVE_CARDS = (
    c.CARDS.replace(c.STREAM.strip(), _FIVE.strip())
    .replace("dev_long AS (", c.categorical("grade", out="grades").strip() + ",\ndev_long AS (", 1)
    .replace("psi, NULL FROM cats)", "psi, NULL FROM cats UNION ALL SELECT scenario, w, feature, 'categorical', psi, NULL FROM grades)")
    .replace("breach_count / 4::DOUBLE", "breach_count / 5::DOUBLE")
)


def _model_rows(side: str, keys: str) -> str:
    models = (("v1", "score"), ("v3", "0.8::DOUBLE + 0.1::DOUBLE * score"), ("v9", "1::DOUBLE - score"))
    return " UNION ALL ".join(f"SELECT '{m}' AS model, {keys}, ub, y, {p} AS p FROM {side} WHERE y IS NOT NULL" for m, p in models)


def _measured_sql(rows: str, keys: str, tie: str, out: str) -> str:
    return f"""
{c.auc(rows, keys, out + '_rank').strip()},
{c.ece(rows, keys, out + '_ece').strip()},
{c.top_recall(rows, keys, out + '_top', tie).strip()},
{out} AS (
  SELECT {keys}, round(roc_auc, 6) AS roc_auc, round(recall, 6) AS recall, round(brier, 6) AS brier, round(ece, 6) AS ece
  FROM (SELECT {keys}, avg((p - y) * (p - y)) AS brier FROM {rows} GROUP BY ALL HAVING count(DISTINCT y) = 2) b
  JOIN {out}_rank USING ({keys}) JOIN {out}_ece USING ({keys}) JOIN {out}_top USING ({keys})),
{c.auc(rows, keys + ', ub', out + '_ub').strip()}"""


_GATED = f"""
bars(policy_version, margin, ratio, up, ece_top, fall) AS (VALUES ('policy-v1', 0.005::DOUBLE, 1::DOUBLE, 0.005::DOUBLE, 0.05::DOUBLE, 0.01::DOUBLE), ('policy-v2', 0.2::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE, 0.45::DOUBLE)),
gp AS (SELECT card_id, policy_version, scenario, w, u.challenger FROM cards, unnest(['v3', 'v9']) AS u(challenger) WHERE action IN ('FULL_RETRAIN', 'INCREMENTAL_RETRAIN')),
faced AS (
  SELECT gp.*, 'frozen' AS eval_set, a.roc_auc AS aa, b.roc_auc AS ba, a.recall AS ar, b.recall AS br, a.brier AS ab, b.brier AS bb, b.ece AS be, true AS present
  FROM gp JOIN fm a ON a.model = 'v1' JOIN fm b ON b.model = gp.challenger
  UNION ALL
  SELECT gp.*, 'own', a.roc_auc, b.roc_auc, a.recall, b.recall, a.brier, b.brier, b.ece, a.model IS NOT NULL AND b.model IS NOT NULL
  FROM gp LEFT JOIN wm a ON a.model = 'v1' AND a.scenario = gp.scenario AND a.w = gp.w LEFT JOIN wm b ON b.model = gp.challenger AND b.scenario = gp.scenario AND b.w = gp.w),
groups_of AS (
  SELECT gp.card_id, gp.challenger, 'frozen' AS eval_set, round(a.roc_auc, 6) AS before, round(b.roc_auc, 6) AS after FROM gp JOIN fm_ub b ON b.model = gp.challenger JOIN fm_ub a ON a.model = 'v1' AND a.ub = b.ub
  UNION ALL
  SELECT gp.card_id, gp.challenger, 'own', round(a.roc_auc, 6), round(b.roc_auc, 6)
  FROM gp JOIN wm_ub b ON b.model = gp.challenger AND b.scenario = gp.scenario AND b.w = gp.w JOIN wm_ub a ON a.model = 'v1' AND a.scenario = b.scenario AND a.w = b.w AND a.ub = b.ub),
told AS (
  SELECT card_id, challenger, CASE WHEN NOT present THEN 1 ELSE CAST(round(ba - (aa - margin), 9) < 0 AS INTEGER) + CAST(round(br - ar * ratio, 9) < 0 AS INTEGER)
         + CAST(round(ab + up - bb, 9) < 0 AS INTEGER) + CAST(round(ece_top - be, 9) < 0 AS INTEGER) END AS failed FROM faced JOIN bars USING (policy_version)
  UNION ALL
  SELECT g.card_id, g.challenger, CASE WHEN before IS NULL OR after IS NULL THEN 0 ELSE CAST(round(after - (before - fall), 9) < 0 AS INTEGER) END
  FROM groups_of g JOIN faced f USING (card_id, challenger, eval_set) JOIN bars USING (policy_version) WHERE present),
verdict AS (SELECT card_id, challenger, CASE WHEN sum(failed) = 0 THEN 'PASS' ELSE 'BLOCK' END AS outcome FROM told GROUP BY ALL),
sided AS (SELECT card_id, max(outcome) FILTER (challenger = 'v3') AS good, max(outcome) FILTER (challenger = 'v9') AS bad FROM verdict GROUP BY card_id)
"""


@query(
    "backtest_five_scenarios",
    c.with_(
        _FIVE_CARDS,
        f"wl AS ({_model_rows('cur', 'scenario, w, pos')})", _measured_sql("wl", _W, "pos", "wm"),
        f"fl AS ({_model_rows('ref', 'event_id')})", _measured_sql("fl", "model", "event_id", "fm"),
        _GATED, recursive=True,
        select="""
SELECT policy_version, scenario, count(*) AS windows, round(avg(CAST(breaching_feature_count > 0 OR prediction_drift AS INTEGER)), 4) AS monitor_breach_rate,
       round(avg(CAST(action <> 'NO_OP' AS INTEGER)), 4) AS acting_card_rate, min(date_diff('day', DATE '2026-01-01', w)) FILTER (action <> 'NO_OP') AS detection_latency_windows,
       array_to_string(list_sort(list(DISTINCT action)), ',') AS actions, array_to_string(list_sort(list(DISTINCT disposition)), ',') AS dispositions,
       round(min(confidence), 4) AS confidence_min, round(max(confidence), 4) AS confidence_max, count(g.good) AS gated_cards,
       count(*) FILTER (g.good = 'PASS') AS retrained_pass, count(*) FILTER (g.good = 'BLOCK') AS retrained_block, count(*) FILTER (g.bad = 'BLOCK') AS bad_challenger_block
FROM cards LEFT JOIN sided g USING (card_id) GROUP BY policy_version, scenario""",
    ),
)
def backtest_five_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five perturbations of the serving stream, measured, decided, and gated on each card's own window.

    Labels go through the perturbations with their rows: S3 repeats them, S4 redraws a share of them, and
    the gate sees what is left in the window a card is about.
    """
    documents = t.table(spark, sf_dir, "documents").count()
    grade = F.when(F.col("event_id") % 4 == 1, F.lit(">7")).when(F.col("event_id") % 4 == 2, F.lit("Norm")).when(F.col("event_id") % 4 == 3, F.lit(">8"))
    told = t.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("__doc"), F.col("quality").cast("int").alias("y"))
    rows = t.stream(spark, sf_dir).withColumn("grade", grade).withColumn("__doc", F.col("event_id") % documents).join(told, "__doc", "left").drop("__doc")
    reference, serving = t.split_stream(t.written_once(spark, sf_dir, "labelled_stream", lambda: rows))
    base = serving.select("event_id", "value", "k", "hour", "ub", "score", "grade", "y")
    changed = backtest.perturbed_streams(
        base,
        {
            "S1": lambda df: perturb.scale_jitter(df, ["event_id"], ["k"], portable=True),
            "S2": lambda df: perturb.fill_nulls(df, ["event_id"], "grade", portable=True),
            "S3": lambda df: perturb.weighted_resample(df, "event_id", F.when(F.col("ub").isin("7", "8", "9"), 4).otherwise(1)),
            "S4": lambda df: perturb.relabel_at_base_rate(df, ["event_id"], "y", portable=True),
            "S5": perturb.unchanged,
        },
    )
    # Written before it is cut: placing the rows reads every perturbed stream three times.
    streams = t.written_once(spark, sf_dir, "five_streams", lambda: changed)
    windows = t.written_once(spark, sf_dir, "five_windows", lambda: row_windows(streams, "event_id", "event_id", BLOCK, groups=["scenario"], keep_partial=False))
    spec = drift.MonitorSpec(("scenario", "window_index"), ("value", "k", "hour"), ("ub", "grade"), "score")
    index = F.col("window_index")
    found = drift.window_events(reference, windows, spec, scenario="scenario", window_start=window_start(index), window_end=window_end(index), window_number=index)
    events = t.written_once(spark, sf_dir, "five_events", lambda: found)
    cards = t.written_once(spark, sf_dir, "five_cards", lambda: decisions.decide(events, decisions.policy_table(spark, GATE_POLICIES)))
    retrains = cards.where(F.col("action").isin(*decisions.RETRAIN_ACTIONS))

    def scored(df: DataFrame) -> DataFrame:
        score = F.col("score")
        models = df.where("y IS NOT NULL").withColumns({"p_v1": score, "p_v3": F.lit(0.8) + F.lit(0.1) * score, "p_v9": F.lit(1.0) - score})
        return unpivot_scores(models, {"v1": "p_v1", "v3": "p_v3", "v9": "p_v9"})

    def measured(df: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
        held = t.written_once(spark, sf_dir, f"five_{name}_rows", lambda: scored(df))
        whole = lambda: gate_metrics(held, keys, "y", "p", "event_id")[0].withColumns({m: F.round(m, 6) for m in gate.METRICS})
        parts = lambda: subgroup_metrics(held, keys, "y", "p", ("ub",)).withColumn("roc_auc", F.round("roc_auc", 6))
        return t.written_once(spark, sf_dir, f"five_{name}_metrics", whole), t.written_once(spark, sf_dir, f"five_{name}_groups", parts)

    frozen = measured(reference.withColumn("eval_set", F.lit("frozen_holdout")), ["model", "eval_set"], "frozen")
    own = measured(windows.withColumn("window_start", window_start(index)), ["model", "scenario", "window_start"], "own")
    pairs = retrains.select("card_id", F.explode(F.array(F.lit("v3"), F.lit("v9"))).alias("challenger"))
    verdicts = gate.gate_own_windows(retrains, pairs, frozen, own, gate.criteria_table(spark), champion="v1")
    outcome = lambda m: F.max(F.when(F.col("challenger") == m, F.col("outcome")))
    sided = verdicts.groupBy("card_id").agg(outcome("v3").alias("gate_retrained"), outcome("v9").alias("gate_bad"))
    counted = events.select(F.col("event_id").alias("drift_event_id"), F.col("breaching_feature_count").alias("breaching_features"))
    joined = cards.join(counted, "drift_event_id").join(sided, "card_id", "left")
    number = F.datediff(F.col("window_start").cast("date"), F.lit("2026-01-01").cast("date")).cast("bigint")
    return backtest.summarise(joined.withColumn("window_index", number))
