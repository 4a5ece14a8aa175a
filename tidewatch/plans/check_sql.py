"""Common table expressions of the checking SQL, written for DuckDB."""

from __future__ import annotations


def with_(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n" + select


STREAM = """
strm AS (
  SELECT event_id, ts, CAST(ts AS DATE) AS w, event_type AS scenario, value,
         CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k, CAST(hour(ts) AS BIGINT) AS hour,
         CAST(user_id % 10 AS VARCHAR) AS ub, least(value, 500::DOUBLE) / 500::DOUBLE AS score
  FROM events),
ref AS (SELECT * FROM strm WHERE w < DATE '2024-01-11'),
cur AS (SELECT * FROM strm WHERE w >= DATE '2024-01-11')
"""


def _long(side: str, keys: str, features: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT {keys}'{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM {side}" for f in features)


def numeric_long(features: tuple[str, ...] = ("value", "k", "hour", "score"), keys: str = "scenario, w, ") -> str:
    return f"num_ref AS ({_long('ref', '', features)}),\nnum_cur AS ({_long('cur', keys, features)})"


def floor_psi(r: str, c: str) -> str:
    """One term of the stability index from two shares."""
    rr, cc = f"greatest({r}, 1e-6::DOUBLE)", f"greatest({c}, 1e-6::DOUBLE)"
    return f"({cc} - {rr}) * ln({cc} / {rr})"


def sturges(keys: str = "scenario, w") -> str:
    k = keys
    return f"""
bounds AS (
  SELECT {k}, feature, least(c.lo, r.lo) AS lo, greatest(c.hi, r.hi) AS hi, r.n AS nr, c.n AS nc,
         CAST(ceil(log2(r.n + c.n) + 1) AS BIGINT) AS bins
  FROM (SELECT {k}, feature, min(v) AS lo, max(v) AS hi, count(*) AS n FROM num_cur GROUP BY ALL) c
  JOIN (SELECT feature, min(v) AS lo, max(v) AS hi, count(*) AS n FROM num_ref GROUP BY ALL) r USING (feature)),
edges AS (
  SELECT {k}, feature, nr, nc, bins, u.i AS i, lo + u.i * ((hi - lo) / bins) AS edge
  FROM bounds, unnest(range(1, bins)) AS u(i) WHERE hi > lo),
ref_values AS (SELECT feature, v, count(*) AS n FROM num_ref GROUP BY ALL),
cur_values AS (SELECT {k}, feature, v, count(*) AS n FROM num_cur GROUP BY ALL),
ref_below AS (
  SELECT {k}, e.feature, e.i, coalesce(sum(r.n), 0) AS below
  FROM edges e LEFT JOIN ref_values r ON r.feature = e.feature AND r.v < e.edge GROUP BY ALL),
cur_below AS (
  SELECT {', '.join('e.' + x.strip() for x in k.split(','))}, e.feature, e.i, coalesce(sum(c.n), 0) AS below
  FROM edges e LEFT JOIN cur_values c ON c.feature = e.feature AND {' AND '.join(f'c.{x.strip()} = e.{x.strip()}' for x in k.split(','))} AND c.v < e.edge
  GROUP BY ALL),
cumulative AS (
  SELECT {k}, feature, i, r.below AS rb, c.below AS cb FROM ref_below r JOIN cur_below c USING ({k}, feature, i)
  UNION ALL SELECT {k}, feature, bins, nr, nc FROM bounds WHERE hi > lo),
bin_counts AS (
  SELECT {k}, feature, rb - coalesce(lag(rb) OVER q, 0) AS n_ref, cb - coalesce(lag(cb) OVER q, 0) AS n_cur
  FROM cumulative WINDOW q AS (PARTITION BY {k}, feature ORDER BY i)),
sturges AS (
  SELECT {k}, feature, coalesce(sum(CASE WHEN n_ref IS NOT NULL THEN {floor_psi('n_ref / nr::DOUBLE', 'n_cur / nc::DOUBLE')} END), 0) AS psi
  FROM bounds LEFT JOIN bin_counts USING ({k}, feature) GROUP BY ALL)
"""


KS = """
ref_cum AS (SELECT feature, v, sum(n) OVER (PARTITION BY feature ORDER BY v) AS upto FROM (SELECT feature, v, count(*) AS n FROM num_ref GROUP BY ALL)),
ref_size AS (SELECT feature, count(*) AS nr FROM num_ref GROUP BY ALL),
cur_cum AS (
  SELECT scenario, w, feature, v, sum(n) OVER q AS cu, sum(n) OVER q - n AS cb
  FROM (SELECT scenario, w, feature, v, count(*) AS n FROM num_cur GROUP BY ALL)
  WINDOW q AS (PARTITION BY scenario, w, feature ORDER BY v)),
cur_size AS (SELECT scenario, w, feature, count(*) AS nc FROM num_cur GROUP BY ALL),
at_or_below AS (SELECT c.*, coalesce(r.upto, 0) AS ru FROM cur_cum c ASOF LEFT JOIN ref_cum r ON c.feature = r.feature AND c.v >= r.v),
strictly_below AS (SELECT c.*, coalesce(r.upto, 0) AS rb FROM at_or_below c ASOF LEFT JOIN ref_cum r ON c.feature = r.feature AND c.v > r.v),
ks_d AS (
  SELECT scenario, w, feature, max(nr) AS nr, max(nc) AS nc,
         max(greatest(abs(cu / nc::DOUBLE - ru / nr::DOUBLE), abs(cb / nc::DOUBLE - rb / nr::DOUBLE))) AS d
  FROM strictly_below JOIN ref_size USING (feature) JOIN cur_size USING (scenario, w, feature) GROUP BY ALL),
ks_l AS (SELECT *, sqrt(nr::DOUBLE * nc / (nr + nc)) * d AS lam FROM ks_d),
ks AS (
  SELECT scenario, w, feature, d,
         CASE WHEN lam < 0.18 THEN 1::DOUBLE ELSE least(greatest((
           SELECT sum((CASE WHEN j % 2 = 1 THEN 2 ELSE -2 END) * exp(-2::DOUBLE * j * j * lam * lam)) FROM range(1, 101) AS t(j)), 0), 1) END AS p
  FROM ks_l)
"""


def categorical(feature: str, keys: str = "scenario, w", out: str = "cats") -> str:
    return f"""
{out}_r AS (SELECT CAST({feature} AS VARCHAR) AS bin, count(*) AS n FROM ref WHERE {feature} IS NOT NULL GROUP BY ALL),
{out}_c AS (SELECT {keys}, CAST({feature} AS VARCHAR) AS bin, count(*) AS n FROM cur WHERE {feature} IS NOT NULL GROUP BY ALL),
{out}_k AS (SELECT {keys}, sum(n) AS nc FROM {out}_c GROUP BY ALL),
{out}_bins AS (SELECT bin FROM {out}_r UNION SELECT bin FROM {out}_c),
{out} AS (
  SELECT {", ".join(out + "_k." + x.strip() for x in keys.split(","))}, '{feature}' AS feature,
         sum({floor_psi(f"coalesce(r.n, 0) / (SELECT sum(n) FROM {out}_r)::DOUBLE", "coalesce(c.n, 0) / nc::DOUBLE")}) AS psi
  FROM {out}_k CROSS JOIN {out}_bins b LEFT JOIN {out}_r r ON r.bin = b.bin LEFT JOIN {out}_c c ON c.bin = b.bin AND {" AND ".join(f"c.{x.strip()} = {out}_k.{x.strip()}" for x in keys.split(","))} GROUP BY ALL)
"""


DRIFT_LONG = f"""
{STREAM.strip()},
{numeric_long()},
{sturges().strip()},
{KS.strip()},
{categorical('ub').strip()},
dev_long AS (
  SELECT scenario, w, feature, 'numerical' AS kind, psi, CASE WHEN feature <> 'score' THEN p END AS ks_p FROM sturges LEFT JOIN ks USING (scenario, w, feature)
  UNION ALL SELECT scenario, w, feature, 'categorical', psi, NULL FROM cats)
"""

EVENTS = f"""
{DRIFT_LONG.strip()},
dev AS (
  SELECT 'de-' || lower(scenario) || '-w' || lpad(CAST(date_diff('day', DATE '2024-01-11', w) AS VARCHAR), 3, '0') || '-' ||
           substr(sha256('run|' || scenario || '|' || strftime(w, '%Y-%m-%d')), 1, 8) AS event_id,
         scenario, w, max(CASE WHEN feature = 'score' THEN psi END) AS prediction_psi,
         coalesce(max(CASE WHEN feature = 'score' THEN psi END) >= 0.1, false) AS prediction_drift,
         max(CASE WHEN feature <> 'score' THEN psi END) AS max_psi,
         count(*) FILTER (feature <> 'score' AND psi >= 0.1) AS breaching_feature_count,
         (SELECT count(*) FROM ref) AS reference_rows,
         max(rows) AS current_rows
  FROM dev_long JOIN (SELECT scenario, w, count(*) AS rows FROM cur GROUP BY ALL) USING (scenario, w) GROUP BY scenario, w)
"""

# Needs WITH RECURSIVE.
DECIDED_RUNS = """
policies(policy_version, psi_breach) AS (VALUES ('policy-v1', 0.1::DOUBLE), ('policy-v2', 0.2::DOUBLE)),
named_sets AS (
  SELECT policy_version, psi_breach, d.scenario, d.w,
         coalesce(list(feature ORDER BY feature) FILTER (psi >= psi_breach), []) AS names,
         max(psi) FILTER (psi >= psi_breach) AS top,
         arg_max(feature, psi) FILTER (psi >= psi_breach) AS worst
  FROM dev_long d CROSS JOIN policies WHERE feature <> 'score' GROUP BY policy_version, psi_breach, d.scenario, d.w),
named AS (SELECT *, row_number() OVER (PARTITION BY policy_version, scenario ORDER BY w) AS rn FROM named_sets),
walk AS (
  SELECT policy_version, scenario, rn, 0 AS depth, names AS shared FROM named WHERE len(names) > 0
  UNION ALL
  SELECT k.policy_version, k.scenario, k.rn, k.depth + 1, list_sort(list_intersect(k.shared, n.names))
  FROM walk k JOIN named n ON n.policy_version = k.policy_version AND n.scenario = k.scenario AND n.rn = k.rn - k.depth - 1
  WHERE len(list_intersect(k.shared, n.names)) > 0),
runs_of AS (SELECT policy_version, scenario, rn, max(depth) + 1 AS run, arg_max(shared, depth) AS persistent FROM walk GROUP BY ALL),
facts AS (
  SELECT n.*, e.event_id, e.prediction_drift, e.prediction_psi, e.max_psi, e.breaching_feature_count, len(n.names) AS breach_count,
         coalesce(r.run, 0) AS run, coalesce(r.persistent, []) AS persistent
  FROM named n JOIN dev e USING (scenario, w) LEFT JOIN runs_of r USING (policy_version, scenario, rn)),
terms AS (
  SELECT *, least(greatest(coalesce(max_psi, 0), 0) / 0.5, 1) AS severity, least(breach_count / 4::DOUBLE, 1) AS breadth,
         least(run / 3::DOUBLE, 1) AS persistence, 0.5::DOUBLE AS evidence
  FROM facts),
weighed AS (SELECT *, round(0.35 * severity + 0.2 * breadth + 0.2 * persistence + 0.25 * evidence, 6) AS confidence FROM terms)
"""

RUNS_OF_BREACHES = f"{EVENTS.strip()},\n{DECIDED_RUNS.strip()}"

RULED = """
ruled AS (
  SELECT *, CASE WHEN coalesce(top >= 0.25, false) OR prediction_drift THEN '4'
                 WHEN run >= 2 AND len(persistent) > 0 THEN '3'
                 WHEN breach_count BETWEEN 1 AND 2 AND run < 2 THEN '2'
                 WHEN breach_count = 0 THEN '1' ELSE 'uncovered' END AS rule_id
  FROM weighed),
cards AS (
  SELECT 'dc-' || strftime(w, '%Y-%m-%d') || '-' || substr(sha256(event_id || '|' || policy_version), 1, 8) AS card_id,
         policy_version, event_id AS drift_event_id, scenario, w, CAST(date_diff('day', DATE '2024-01-11', w) AS BIGINT) AS n,
         CASE rule_id WHEN '4' THEN 'FULL_RETRAIN' WHEN '3' THEN 'INCREMENTAL_RETRAIN' WHEN '1' THEN 'NO_OP' ELSE 'ALERT_ONLY' END AS action,
         CASE WHEN rule_id = '4' AND confidence >= 0.75 THEN 'AUTO_PROCEED_SHADOW' WHEN rule_id = '4' THEN 'ESCALATE_HUMAN'
              WHEN rule_id = '3' THEN 'AUTO_PROCEED_SHADOW' ELSE 'NONE' END AS disposition,
         rule_id, confidence, severity, breadth, persistence, evidence, breach_count, run, persistent, max_psi, prediction_drift,
         breaching_feature_count, top, worst, psi_breach, prediction_psi, names
  FROM ruled)
"""

CARDS = f"{RUNS_OF_BREACHES.strip()},\n{RULED.strip()}"

SCORED = """
scored AS (
  SELECT l.doc_id, d.lang, d.source, CAST(l.toxic AS VARCHAR) AS toxic, l.quality AS y,
         CASE WHEN l.doc_id % 2 = 0 THEN 'frozen_holdout' ELSE 'recent_labeled_window' END AS eval_set,
         CAST(least(d.n_chars, 5000) AS DOUBLE) / 5000::DOUBLE AS p_v1,
         CAST((l.doc_id * 37) % 101 AS DOUBLE) / 101::DOUBLE AS p_v2,
         0.8::DOUBLE + 0.1::DOUBLE * (CAST(least(d.n_chars, 5000) AS DOUBLE) / 5000::DOUBLE) AS p_v3,
         1::DOUBLE - CAST(least(d.n_chars, 5000) AS DOUBLE) / 5000::DOUBLE AS p_v9
  FROM labels l JOIN documents d USING (doc_id)),
long AS (
  SELECT 'v1' AS model, doc_id, lang, source, toxic, y, eval_set, p_v1 AS p FROM scored
  UNION ALL SELECT 'v2', doc_id, lang, source, toxic, y, eval_set, p_v2 FROM scored
  UNION ALL SELECT 'v3', doc_id, lang, source, toxic, y, eval_set, p_v3 FROM scored
  UNION ALL SELECT 'v9', doc_id, lang, source, toxic, y, eval_set, p_v9 FROM scored)
"""


def auc(source: str, keys: str, out: str) -> str:
    """AUC with ties averaged, average precision and class totals per key."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""
{out}_s AS (SELECT {k}p, sum(y) AS pos, sum(1 - y) AS neg, count(*) AS n FROM {source} GROUP BY ALL),
{out}_w AS (
  SELECT *, sum(neg) OVER ({part}ORDER BY p) - neg AS neg_before, sum(pos) OVER ({part}ORDER BY p) - pos AS pos_before,
         sum(n) OVER ({part}ORDER BY p) - n AS n_before,
         sum(pos) OVER ({part}) AS pt, sum(neg) OVER ({part}) AS nt, sum(n) OVER ({part}) AS tot
  FROM {out}_s),
{out} AS (
  SELECT {k}CAST(max(tot) AS BIGINT) AS rows, max(pt) AS pt, max(nt) AS nt,
         CASE WHEN max(pt) > 0 AND max(nt) > 0 THEN sum(pos * (neg_before + 0.5::DOUBLE * neg)) / (max(pt)::DOUBLE * max(nt)) END AS roc_auc,
         CASE WHEN max(pt) > 0 THEN sum(pos * ((pt - pos_before) / (tot - n_before)::DOUBLE)) / max(pt)::DOUBLE END AS average_precision
  FROM {out}_w GROUP BY ALL)
"""


def ece(source: str, keys: str, out: str) -> str:
    k = f"{keys}, " if keys else ""
    bins = " + ".join(f"CAST(p > {i * 0.1!r}::DOUBLE AS BIGINT)" for i in range(1, 10))
    return f"""
{out}_b AS (SELECT {k}{bins} AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y FROM {source} GROUP BY ALL),
{out} AS (SELECT {k}sum(n * abs(mean_y - mean_p)) / sum(n) AS ece FROM {out}_b GROUP BY ALL)
"""


def top_recall(source: str, keys: str, out: str, tie: str = "doc_id") -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""
{out}_r AS (SELECT *, row_number() OVER ({part}ORDER BY p DESC, {tie}) AS place, count(*) OVER ({part}) AS total FROM {source}),
{out} AS (
  SELECT {k}CAST(max(greatest(1, round_even(total * 0.1::DOUBLE, 0))) AS BIGINT) AS top_rows,
         CAST(sum(CASE WHEN place <= greatest(1, round_even(total * 0.1::DOUBLE, 0)) THEN y ELSE 0 END) AS BIGINT) AS top_positives,
         CASE WHEN sum(y) > 0 THEN sum(CASE WHEN place <= greatest(1, round_even(total * 0.1::DOUBLE, 0)) THEN y ELSE 0 END) / sum(y)::DOUBLE END AS recall
  FROM {out}_r GROUP BY ALL)
"""


METRICS = f"""
{SCORED.strip()},
{auc('long', 'model, eval_set', 'rank_m').strip()},
{ece('long', 'model, eval_set', 'ece_m').strip()},
{top_recall('long', 'model, eval_set', 'top_m').strip()},
metrics AS (
  SELECT model, eval_set, b.rows, round(pr, 6) AS positive_rate, round(roc_auc, 6) AS roc_auc, round(recall, 6) AS recall_at_top_decile,
         round(brier, 6) AS brier_score, round(ece, 6) AS expected_calibration_error
  FROM (SELECT model, eval_set, count(*) AS rows, avg(y) AS pr, avg((p - y) * (p - y)) AS brier FROM long GROUP BY ALL) b
  JOIN rank_m USING (model, eval_set) JOIN ece_m USING (model, eval_set) JOIN top_m USING (model, eval_set)),
grp_long AS (
  SELECT model, eval_set, 'lang' AS column_name, coalesce(lang, 'nan') AS group_value, y, p FROM long
  UNION ALL SELECT model, eval_set, 'toxic', coalesce(toxic, 'nan'), y, p FROM long),
{auc('grp_long', 'model, eval_set, column_name, group_value', 'grp_auc').strip()},
grp AS (SELECT model, eval_set, column_name, group_value, round(roc_auc, 6) AS roc_auc FROM grp_auc)
"""

CHECKS = f"""
{METRICS.strip()},
sets(set_order, eval_set) AS (VALUES (0, 'frozen_holdout'), (1, 'recent_labeled_window')),
chal(challenger) AS (VALUES ('v2'), ('v3'), ('v9')),
pairs AS (
  SELECT challenger, s.set_order, s.eval_set, a.model IS NOT NULL AND b.model IS NOT NULL AS present, b.rows AS rows,
         a.roc_auc AS a_auc, b.roc_auc AS b_auc, a.recall_at_top_decile AS a_rec, b.recall_at_top_decile AS b_rec,
         a.brier_score AS a_bri, b.brier_score AS b_bri, b.expected_calibration_error AS b_ece
  FROM chal CROSS JOIN sets s LEFT JOIN metrics a ON a.model = 'v1' AND a.eval_set = s.eval_set
  LEFT JOIN metrics b ON b.model = challenger AND b.eval_set = s.eval_set),
gchecks AS (
  SELECT challenger, eval_set, 0 AS check_order, 'evaluation_set_present' AS criterion, present AS passed, CAST(rows AS DOUBLE) AS observed, NULL::DOUBLE AS required, NULL::VARCHAR AS subgroup FROM pairs
  UNION ALL SELECT challenger, eval_set, 1, 'auroc_non_inferiority', round(b_auc - (a_auc - 0.005), 9) >= 0, b_auc, round(a_auc - 0.005, 9), NULL FROM pairs WHERE present
  UNION ALL SELECT challenger, eval_set, 2, 'recall_at_top_decile', round(b_rec - a_rec, 9) >= 0, b_rec, round(a_rec, 9), NULL FROM pairs WHERE present
  UNION ALL SELECT challenger, eval_set, 3, 'brier_score', round(a_bri + 0.005 - b_bri, 9) >= 0, b_bri, round(a_bri + 0.005, 9), NULL FROM pairs WHERE present
  UNION ALL SELECT challenger, eval_set, 4, 'calibration_ece', round(0.05 - b_ece, 9) >= 0, b_ece, 0.05, NULL FROM pairs WHERE present
  UNION ALL
  SELECT p.challenger, p.eval_set, 5, 'subgroup_non_regression',
         CASE WHEN g.before IS NULL OR g.after IS NULL THEN true ELSE round(g.after - (g.before - 0.01), 9) >= 0 END,
         g.after, round(g.before - 0.01, 9), g.column_name || '=' || g.group_value
  FROM pairs p JOIN (
    SELECT c.challenger, coalesce(a.eval_set, b.eval_set) AS eval_set, coalesce(a.column_name, b.column_name) AS column_name,
           coalesce(a.group_value, b.group_value) AS group_value, a.roc_auc AS before, b.roc_auc AS after
    FROM chal c, (SELECT * FROM grp WHERE model = 'v1') a FULL JOIN (SELECT * FROM grp WHERE model <> 'v1') b
      ON a.eval_set = b.eval_set AND a.column_name = b.column_name AND a.group_value = b.group_value
    WHERE b.model = c.challenger OR b.model IS NULL) g USING (challenger, eval_set)
  WHERE p.present),
verdicts AS (
  SELECT challenger, CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'BLOCK' END AS outcome, count(*) AS checks,
         count(*) FILTER (NOT passed) AS failed FROM gchecks GROUP BY ALL)
"""

# Cards, runs, approvals and alias moves as the Spark side derives them.
AUDIT = f"""
{CARDS.strip()},
{CHECKS.strip()},
rc AS (SELECT * FROM cards WHERE policy_version = 'policy-v2' AND action IN ('INCREMENTAL_RETRAIN', 'FULL_RETRAIN')),
due AS (
  SELECT *, CASE WHEN disposition = 'ESCALATE_HUMAN' THEN 'ops-lead' END AS authorized_by FROM rc
  WHERE (disposition = 'AUTO_PROCEED_SHADOW' AND n % 5 <> 4) OR (disposition = 'ESCALATE_HUMAN' AND n % 4 = 0)),
made AS (
  SELECT *, 'live' AS mode, CASE WHEN n % 2 = 0 THEN 'v3' ELSE 'v2' END AS challenger, 6 AS hours FROM due
  UNION ALL SELECT *, 'demo_bad', 'v9', 3 FROM due WHERE n % 3 = 0),
runs AS (
  SELECT 'rr-' || substr(card_id, 4) || '-' || substr(sha256(card_id || '|' || mode || '|' || challenger), 1, 8) AS run_id,
         CAST(w AS TIMESTAMP) + INTERVAL 1 DAY + hours * INTERVAL 1 HOUR AS created_at, card_id, scenario, policy_version, action, mode,
         'v1' AS champion_version, challenger AS challenger_version, v.outcome, v.failed AS failed_criteria_count,
         v.outcome = 'PASS' AS shadow_alias_moved, authorized_by, n
  FROM made JOIN verdicts v USING (challenger)),
approvals AS (
  SELECT 'ap-retrain-' || card_id AS approval_id, CAST(w AS TIMESTAMP) + INTERVAL 1 DAY + INTERVAL 1 HOUR AS ts, card_id, 'RETRAIN' AS kind,
         card_id AS subject, NULL::VARCHAR AS run_id, 'ops-lead' AS approver, CASE WHEN n % 4 = 2 THEN 'REJECT' ELSE 'APPROVE' END AS decision,
         'reviewed the drift evidence' AS reason, NULL::VARCHAR AS champion_version_before, NULL::VARCHAR AS champion_version_after
  FROM rc WHERE disposition = 'ESCALATE_HUMAN' AND n % 4 <> 3
  UNION ALL
  SELECT 'ap-promotion-' || run_id, created_at + INTERVAL 2 HOUR, card_id, 'PROMOTION', run_id, run_id, 'ops-chief',
         CASE WHEN n % 3 = 0 THEN 'APPROVE' ELSE 'REJECT' END, 'looked at shadow agreement', 'v1', CASE WHEN n % 3 = 0 THEN challenger_version ELSE 'v1' END
  FROM runs WHERE outcome = 'PASS' AND n % 3 <> 2),
moves AS (
  SELECT strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS timestamp_utc, 'set' AS action, 'shadow' AS alias, NULL::VARCHAR AS from_version,
         challenger_version AS to_version, run_id, 'gate PASS for decision card ' || card_id AS reason, 'gate' AS actor
  FROM runs WHERE shadow_alias_moved
  UNION ALL
  SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'set', 'champion', champion_version_before, champion_version_after, run_id,
         'promotion approved (retrain run ' || run_id || '): ' || reason, approver
  FROM approvals WHERE kind = 'PROMOTION' AND decision = 'APPROVE'),
last_run AS (SELECT card_id, arg_max(run_id, (created_at, run_id)) AS run_id, arg_max(outcome, (created_at, run_id)) AS outcome, arg_max(shadow_alias_moved, (created_at, run_id)) AS moved FROM runs GROUP BY ALL),
stated AS (
  SELECT c.*, CASE
    WHEN c.action = 'NO_OP' THEN 'NO_OP'
    WHEN c.action = 'ALERT_ONLY' THEN CASE WHEN c.disposition = 'ESCALATE_HUMAN' THEN 'ALERT (escalated)' ELSE 'ALERT' END
    WHEN l.card_id IS NULL AND ra.decision = 'REJECT' THEN 'RETRAIN REJECTED'
    WHEN l.card_id IS NULL AND c.disposition = 'ESCALATE_HUMAN' AND ra.decision IS NULL THEN 'AWAITING AUTHORISATION'
    WHEN l.card_id IS NULL THEN 'AWAITING RETRAIN'
    WHEN l.outcome <> 'PASS' THEN 'BLOCKED'
    WHEN pa.decision = 'APPROVE' THEN 'PROMOTED'
    WHEN pa.decision IS NOT NULL THEN 'PROMOTION REJECTED'
    WHEN l.moved THEN 'IN SHADOW' ELSE 'PASSED (not in shadow)' END AS state
  FROM cards c LEFT JOIN last_run l USING (card_id)
  LEFT JOIN approvals ra ON ra.kind = 'RETRAIN' AND ra.subject = c.card_id
  LEFT JOIN approvals pa ON pa.kind = 'PROMOTION' AND pa.subject = l.run_id)
"""

SHADOW = """
shadow AS (
  SELECT doc_id AS id, 'v1' AS champion_version, CASE WHEN lang = 'en' THEN 'v3' ELSE 'v2' END AS shadow_version,
         CAST(least(n_chars, 5000) AS DOUBLE) / 5000::DOUBLE AS c,
         CASE WHEN doc_id % 50 <> 0 THEN CAST((doc_id * 37) % 101 AS DOUBLE) / 101::DOUBLE END AS s
  FROM documents)
"""

# A card's sentence, from the columns of ``cards``.
RATIONALE = """CASE rule_id
         WHEN '1' THEN 'quiet window: all features stay below PSI ' || psi_breach || ', scores steady'
         WHEN '2' THEN breach_count || ' mild breach(es) in PSI [' || psi_breach || ', 0.25), not yet repeated: alert'
         WHEN '3' THEN 'over the limit ' || run || ' windows in a row: ' || array_to_string(persistent, ', ')
         WHEN 'uncovered' THEN breach_count || ' breach(es) of PSI ' || psi_breach || ' fit no rule of ' || policy_version || ': ALERT_ONLY'
         ELSE CASE WHEN coalesce(top >= 0.25, false) THEN worst || ' severe at PSI ' || printf('%.4f', top) ELSE 'scores moved, PSI ' || coalesce(printf('%.4f', prediction_psi), 'unknown') END
              || '; confidence ' || printf('%.4f', confidence) || CASE WHEN confidence >= 0.75 THEN ' reaches ' ELSE ' misses ' END || '0.75' END"""
