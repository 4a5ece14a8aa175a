"""Lifecycle, overview and audit queries over the derived audit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.operators import lifecycle
from tidewatch.plans import check_sql as c
from tidewatch.plans import tables as t
from tidewatch.plans.registry import query


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.with_state(t.cards(spark, sf_dir), t.runs(spark, sf_dir), t.approvals(spark, sf_dir))


def _second(column: str = "ts") -> F.Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


@query("lifecycle_state", c.with_(c.AUDIT, recursive=True, select="SELECT card_id, action, disposition, state FROM stated"))
def lifecycle_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stated(spark, sf_dir).select("card_id", "action", "disposition", "state")


@query("cards_by_state", c.with_(c.AUDIT, recursive=True, select="SELECT state, count(*) AS cards FROM stated GROUP BY ALL"))
def cards_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.cards_by_state(_stated(spark, sf_dir))


OVERVIEW = """
SELECT 'predictions' AS figure, '' AS part, count(*) AS count FROM events
UNION ALL SELECT 'successful_predictions', '', count(*) FROM events WHERE event_type <> 'error'
UNION ALL SELECT 'predictions_by_version', 'v' || (user_id % 3 + 1), count(*) FROM events WHERE event_type <> 'error' GROUP BY ALL
UNION ALL SELECT 'drift_windows', '', count(*) FROM dev
UNION ALL SELECT 'breaching_windows', '', count(*) FROM dev WHERE breaching_feature_count > 0
UNION ALL SELECT 'cards', '', count(*) FROM cards
UNION ALL SELECT 'cards_by_state', state, count(*) FROM stated GROUP BY ALL
UNION ALL SELECT 'shadow_scores', '', count(*) FROM documents
"""


@query("overview_counts", c.with_(c.AUDIT, recursive=True, select=OVERVIEW))
def overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.overview(t.predictions(spark, sf_dir), t.events(spark, sf_dir), _stated(spark, sf_dir), t.shadow_predictions(spark, sf_dir))


@query(
    "median_latency_latest500",
    """WITH latest AS (SELECT value FROM events WHERE event_type <> 'error' ORDER BY ts DESC, 'rq-' || event_id DESC LIMIT 500),
s AS (SELECT list_sort(list(value)) AS v FROM latest) SELECT round(v[len(v) // 2 + 1], 6) AS median FROM s""",
)
def median_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = t.predictions(spark, sf_dir).where("status = 'success'")
    return lifecycle.upper_median_of_latest(ok, "latency_ms", "ts", "request_id", 500).select(F.round("median", 6).alias("median"))


@query("prediction_versions", "SELECT 'v' || (user_id % 3 + 1) AS model_version, count(*) AS predictions, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events WHERE event_type <> 'error' GROUP BY ALL")
def prediction_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = t.predictions(spark, sf_dir).where("status = 'success'")
    return ok.groupBy("model_version").agg(F.count(F.lit(1)).alias("predictions"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_at"))


@query("prediction_lookup", "SELECT 'rq-' || event_id AS request_id, 'user-' || user_id AS caller, round(value, 6) AS latency_ms FROM events WHERE user_id = 7 ORDER BY ts DESC, 'rq-' || event_id LIMIT 50")
def prediction_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lifecycle.find_predictions(t.predictions(spark, sf_dir), " user-7 ", limit=50)
    return found.select("request_id", "caller", F.round("latency_ms", 6).alias("latency_ms"))


AUDIT_LOG = """
log AS (
  SELECT CAST(w AS TIMESTAMP) + INTERVAL 1 DAY AS ts, 'drift' AS kind, event_id AS ref, scenario AS subject,
         strftime(w, '%Y-%m-%d') || ': breaches ' || breaching_feature_count || ', PSI ' || printf('%.4f', max_psi) || CASE WHEN prediction_drift THEN ', scores moved' ELSE '' END AS summary FROM dev
  UNION ALL SELECT CAST(w AS TIMESTAMP) + INTERVAL 1 DAY, 'card', card_id, scenario,
         action || ' by rule ' || rule_id || ' of ' || policy_version || ', ' || disposition || ', confidence ' || printf('%.4f', confidence) || ', now ' || state FROM stated
  UNION ALL SELECT created_at, 'retrain', run_id, card_id, outcome || ' of ' || challenger_version || ' against ' || champion_version || ', ' || mode || ', failures ' || failed_criteria_count || coalesce(', let through by ' || authorized_by, '') FROM runs
  UNION ALL SELECT ts, 'approval', approval_id, card_id, approver || ': ' || decision || ' for ' || kind || ', ' || reason FROM approvals
  UNION ALL SELECT CAST(timestamp_utc AS TIMESTAMP), 'alias', alias, to_version, actor || ': ' || action || ' ' || alias || ' from ' || coalesce(from_version, 'None') || ' to ' || to_version || ', ' || reason FROM moves)
"""


def _log(spark: SparkSession, sf_dir: str, query_text: str = "") -> DataFrame:
    return lifecycle.audit_log(
        t.events(spark, sf_dir), _stated(spark, sf_dir), t.runs(spark, sf_dir), t.approvals(spark, sf_dir), t.alias_moves(spark, sf_dir), query=query_text
    )


@query("audit_log", c.with_(c.AUDIT, AUDIT_LOG, recursive=True, select="SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, kind, ref, subject, summary FROM log"))
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).withColumn("ts", _second())


@query(
    "audit_search",
    c.with_(
        c.AUDIT, AUDIT_LOG, recursive=True,
        select="SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, kind, ref, subject, summary FROM log WHERE contains(lower(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || kind || ' ' || ref || ' ' || subject || ' ' || summary), 'ops-')",
    ),
)
def audit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, " OPS- ").withColumn("ts", _second())


@query(
    "audit_newest500",
    c.with_(c.AUDIT, AUDIT_LOG, recursive=True, select="SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, kind, ref, subject FROM log QUALIFY row_number() OVER (ORDER BY ts DESC, kind, ref) <= 500"),
)
def audit_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.newest(_log(spark, sf_dir), limit=500).select(_second(), "kind", "ref", "subject")


@query(
    "alias_moves_for_card",
    c.with_(
        c.AUDIT, recursive=True,
        select="""
SELECT card_id, m.timestamp_utc, m.alias, m.to_version, m.reason FROM moves m JOIN (
  SELECT card_id, card_id AS key_ FROM cards UNION SELECT card_id, run_id FROM runs) k ON contains(m.reason, k.key_) GROUP BY ALL""",
    ),
)
def alias_moves_for_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lifecycle.moves_by_card(t.alias_moves(spark, sf_dir), t.runs(spark, sf_dir), t.cards(spark, sf_dir))
    return found.select("card_id", "timestamp_utc", "alias", "to_version", "reason")


@query(
    "card_history_counts",
    c.with_(
        c.AUDIT, recursive=True,
        select="""
SELECT s.card_id, s.state, d.current_rows, coalesce(r.n, 0) AS runs, coalesce(a.n, 0) AS approvals, r.last_outcome FROM stated s JOIN dev d ON d.event_id = s.drift_event_id
LEFT JOIN (SELECT card_id, count(*) AS n, arg_max(outcome, (created_at, run_id)) AS last_outcome FROM runs GROUP BY ALL) r USING (card_id)
LEFT JOIN (SELECT card_id, count(*) AS n FROM approvals GROUP BY ALL) a USING (card_id)""",
    ),
)
def card_history_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = lifecycle.card_history(t.cards(spark, sf_dir), t.events(spark, sf_dir), t.runs(spark, sf_dir), t.approvals(spark, sf_dir))

    def size(column: str) -> F.Column:
        return F.coalesce(F.size(column), F.lit(0)).cast("bigint").alias(column)

    return history.select("card_id", "state", "current_rows", size("runs"), size("approvals"), F.element_at("runs", -1)["outcome"].alias("last_outcome"))


REPORT = f"""
SELECT card_id, 'decision' AS section, 'state' AS key, state AS value FROM stated
UNION ALL SELECT card_id, 'decision', 'policy', policy_version FROM stated
UNION ALL SELECT card_id, 'decision', 'rule', rule_id FROM stated
UNION ALL SELECT card_id, 'decision', 'action', action FROM stated
UNION ALL SELECT card_id, 'decision', 'disposition', disposition FROM stated
UNION ALL SELECT card_id, 'decision', 'confidence', printf('%.4f', confidence) FROM stated
UNION ALL SELECT card_id, 'decision', 'status', CASE WHEN action IN ('FULL_RETRAIN', 'INCREMENTAL_RETRAIN') THEN 'OPEN' ELSE 'CLOSED' END FROM stated
UNION ALL SELECT card_id, 'evidence', 'event', drift_event_id FROM stated
UNION ALL SELECT card_id, 'evidence', 'features', '4' FROM stated
UNION ALL SELECT card_id, 'evidence', 'psi', printf('%.4f', max_psi) FROM stated
UNION ALL SELECT card_id, 'evidence', 'scores moved', CAST(prediction_drift AS VARCHAR) FROM stated
UNION ALL SELECT card_id, 'evidence', 'run', CAST(run AS VARCHAR) FROM stated
UNION ALL SELECT card_id, 'evidence', 'rows', reference_rows || ' / ' || current_rows FROM stated JOIN dev ON event_id = drift_event_id
UNION ALL SELECT card_id, 'reasoning', 'held back from', '-' FROM stated
UNION ALL SELECT card_id, 'reasoning', 'rationale', {c.RATIONALE} FROM stated
UNION ALL SELECT card_id, 'decision', 'stream', scenario FROM stated
UNION ALL SELECT card_id, 'decision', 'window', strftime(w, '%Y-%m-%d') || ' to ' || strftime(w + INTERVAL 1 DAY, '%Y-%m-%d') FROM stated
UNION ALL SELECT card_id, 'decision', 'made', strftime(w + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') FROM stated
UNION ALL SELECT card_id, 'decision', 'confidence: ' || k, printf('%.4f', v) FROM (SELECT card_id, unnest(['severity', 'breadth', 'persistence', 'evidence']) AS k, unnest([round(severity, 6), round(breadth, 6), round(persistence, 6), evidence]) AS v FROM stated)
UNION ALL SELECT card_id, 'evidence', 'score psi', coalesce(printf('%.4f', prediction_psi), '-') FROM stated
UNION ALL SELECT card_id, 'evidence', 'labels', 'leading_indicators' FROM stated
UNION ALL SELECT card_id, 'criteria', 'data', 'd1' FROM stated
UNION ALL SELECT card_id, 'lineage', 'model', 'v1' FROM stated
UNION ALL SELECT card_id, 'lineage', 'reference', 'd1' FROM stated
UNION ALL SELECT card_id, 'evidence', 'breach of ' || feature, printf('%.4f', psi) FROM stated s JOIN dev_long l ON l.scenario = s.scenario AND l.w = s.w AND l.feature <> 'score' AND l.psi >= s.psi_breach
UNION ALL SELECT card_id, 'criteria', k, v FROM stated, (VALUES ('auroc_non_inferiority_margin', '0.005'), ('recall_top_decile_min_ratio', '1.0'), ('max_brier_increase', '0.005'), ('max_ece', '0.05'), ('max_subgroup_auroc_drop', '0.01')) AS cr(k, v)
UNION ALL SELECT card_id, 'runs', run_id, outcome || ', failures ' || failed_criteria_count || ', ' || mode FROM runs
UNION ALL SELECT card_id, 'people', approval_id, approver || ': ' || decision || ', ' || reason FROM approvals
UNION ALL SELECT card_id, 'moves', timestamp_utc || ' ' || action || ' ' || alias, actor || ': ' || coalesce(from_version, 'None') || ' to ' || to_version FROM (
  SELECT DISTINCT k.card_id, m.* FROM moves m JOIN (SELECT card_id, card_id AS key_ FROM cards UNION SELECT card_id, run_id FROM runs) k ON contains(m.reason, k.key_))
"""


@query("card_report_long", c.with_(c.AUDIT, recursive=True, select=REPORT))
def card_report_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, cards, approvals = t.runs(spark, sf_dir), t.cards(spark, sf_dir), t.approvals(spark, sf_dir)
    history = lifecycle.card_history(cards, t.events(spark, sf_dir), runs, approvals)
    moves = lifecycle.moves_by_card(t.alias_moves(spark, sf_dir), runs, cards)
    return lifecycle.card_report(history, moves)


@query(
    "decision_validation",
    """
WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' approve ' WHEN 1 THEN 'REJECT' WHEN 2 THEN 'maybe' ELSE 'Approve' END AS decision, text AS reason FROM documents),
n AS (SELECT doc_id, upper(trim(decision)) AS decision, length(trim(regexp_replace(reason, '\\s+', ' ', 'g'))) AS len FROM d)
SELECT doc_id, decision, len AS reason_length, CASE WHEN decision NOT IN ('APPROVE', 'REJECT') THEN 'unknown decision' WHEN len < 10 THEN 'reason too short' WHEN len > 1000 THEN 'reason too long' END AS fault FROM n
""",
)
def decision_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 4
    d = t.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(kind == 0, F.lit(" approve ")).when(kind == 1, F.lit("REJECT")).when(kind == 2, F.lit("maybe")).otherwise(F.lit("Approve")).alias("decision"), F.col("text").alias("reason")
    )
    checked = lifecycle.checked_decisions(d)
    return checked.select("doc_id", "decision", F.length("reason").cast("bigint").alias("reason_length"), "fault")
