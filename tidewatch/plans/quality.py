"""Model-quality queries over labelled, scored documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.operators import quality
from tidewatch.plans import check_sql as c
from tidewatch.plans import tables as t
from tidewatch.plans.registry import query

MODELS = {"v1": "p_v1", "v2": "p_v2", "v3": "p_v3", "v9": "p_v9"}


def _r(*names: str) -> list[F.Column]:
    return [F.round(n, 6).alias(n) for n in names]


@query("roc_auc", c.with_(c.SCORED, c.auc("long", "model, eval_set", "a"), select="SELECT model, eval_set, rows, round(roc_auc, 6) AS roc_auc FROM a"))
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.ranking_metrics(t.scored_long(spark, sf_dir), ["model", "eval_set"], "y", "p")
    return found.select("model", "eval_set", "rows", *_r("roc_auc"))


@query("average_precision", c.with_(c.SCORED, c.auc("long", "model", "a"), select="SELECT model, round(average_precision, 6) AS average_precision FROM a"))
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.ranking_metrics(t.scored_long(spark, sf_dir), ["model"], "y", "p")
    return found.select("model", *_r("average_precision"))


@query(
    "brier_logloss",
    c.with_(
        c.SCORED,
        select="""
SELECT model, count(*) AS rows, round(avg(y), 6) AS positive_rate, round(avg((p - y) * (p - y)), 6) AS brier_score,
       round(avg(-CASE WHEN y = 1 THEN ln(least(greatest(p, 2.220446049250313e-16::DOUBLE), 1 - 2.220446049250313e-16::DOUBLE))
                       ELSE ln(1 - least(greatest(p, 2.220446049250313e-16::DOUBLE), 1 - 2.220446049250313e-16::DOUBLE)) END), 6) AS log_loss
FROM long GROUP BY ALL""",
    ),
)
def brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.pointwise_metrics(t.scored_long(spark, sf_dir), ["model"], "y", "p")
    return found.select("model", "rows", *_r("positive_rate", "brier_score", "log_loss"))


@query("ece", c.with_(c.SCORED, c.ece("long", "model, eval_set", "e"), select="SELECT model, eval_set, round(ece, 6) AS expected_calibration_error FROM e"))
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.calibration_error(t.scored_long(spark, sf_dir), ["model", "eval_set"], "y", "p")
    return found.select("model", "eval_set", *_r("expected_calibration_error"))


@query(
    "reliability_table",
    c.with_(
        c.SCORED, c.ece("long", "model", "e"),
        select="""
SELECT m.model, CAST(b.bin AS BIGINT) AS bin, round(b.bin / 10::DOUBLE, 6) AS bin_lower, round((b.bin + 1) / 10::DOUBLE, 6) AS bin_upper, coalesce(n, 0) AS count,
       round(mean_p, 6) AS mean_predicted, round(mean_y, 6) AS observed_rate
FROM (SELECT DISTINCT model FROM long) m CROSS JOIN range(10) AS b(bin) LEFT JOIN e_b ON e_b.model = m.model AND e_b.bin = b.bin""",
    ),
)
def reliability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.reliability_table(t.scored_long(spark, sf_dir), ["model"], "y", "p")
    return found.select("model", F.col("bin").cast("bigint").alias("bin"), *_r("bin_lower", "bin_upper"), "count", *_r("mean_predicted", "observed_rate"))


@query(
    "recall_top_fraction",
    c.with_(c.SCORED, c.top_recall("long", "model, eval_set", "r"), select="SELECT model, eval_set, top_rows, top_positives, round(recall, 6) AS recall_at_top_decile FROM r"),
)
def recall_top_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.recall_top_fraction(t.scored_long(spark, sf_dir), ["model", "eval_set"], "y", "p", "doc_id")
    return found.select("model", "eval_set", "top_rows", "top_positives", *_r("recall_at_top_decile"))


@query("top_decile_cut", c.with_(c.SCORED, select="SELECT model, eval_set, round(quantile_cont(p, 0.9), 6) AS threshold FROM long GROUP BY ALL"))
def top_decile_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.top_fraction_cut(t.scored_long(spark, sf_dir), ["model", "eval_set"], "p").select("model", "eval_set", *_r("threshold"))


_CONFUSION = """
  count(*) FILTER (p < cut AND y = 0) AS true_negatives, count(*) FILTER (p >= cut AND y = 0) AS false_positives,
  count(*) FILTER (p < cut AND y = 1) AS false_negatives, count(*) FILTER (p >= cut AND y = 1) AS true_positives,
  round(count(*) FILTER (p >= cut) / count(*)::DOUBLE, 6) AS predicted_positive_rate,
  round(coalesce(count(*) FILTER (p >= cut AND y = 1) / nullif(count(*) FILTER (p >= cut), 0)::DOUBLE, 0), 6) AS precision,
  round(coalesce(count(*) FILTER (p >= cut AND y = 1) / nullif(count(*) FILTER (y = 1), 0)::DOUBLE, 0), 6) AS recall
"""
_COUNTS = ("true_negatives", "false_positives", "false_negatives", "true_positives")
_RATES = ("predicted_positive_rate", "precision", "recall")


@query("confusion_counts", c.with_(c.SCORED, select=f"SELECT model, {_CONFUSION} FROM (SELECT *, 0.5::DOUBLE AS cut FROM long) GROUP BY ALL"))
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.confusion_counts(t.scored_long(spark, sf_dir), ["model"], "y", "p", quality.DEFAULT_THRESHOLD)
    return found.select("model", *_COUNTS, *_r(*_RATES))


@query(
    "confusion_at_top_decile",
    c.with_(
        c.SCORED, "cuts AS (SELECT model, quantile_cont(p, 0.9) AS cut FROM long GROUP BY ALL)",
        select=f"SELECT model, round(max(cut), 6) AS threshold, {_CONFUSION} FROM long JOIN cuts USING (model) GROUP BY ALL",
    ),
)
def confusion_at_top_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.confusion_at_top_fraction(t.scored_long(spark, sf_dir), ["model"], "y", "p")
    return found.select("model", *_r("threshold"), *_COUNTS, *_r(*_RATES))


_GROUPS = """
g AS (
  SELECT model, 'lang' AS column_name, coalesce(lang, 'nan') AS group_value, y, p FROM long
  UNION ALL SELECT model, 'source', coalesce(source, 'nan'), y, p FROM long
  UNION ALL SELECT model, 'toxic', coalesce(CASE WHEN toxic <> '1' THEN toxic END, 'nan'), y, p FROM long)
"""


@query(
    "subgroup_metrics",
    c.with_(
        c.SCORED, _GROUPS, c.auc("g", "model, column_name, group_value", "a"),
        select="SELECT model, column_name, group_value, rows AS count, round(pt / rows::DOUBLE, 6) AS positive_rate, round(roc_auc, 6) AS roc_auc FROM a",
    ),
)
def subgroup_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.scored_long(spark, sf_dir).withColumn("toxic", F.when(F.col("toxic") != "1", F.col("toxic")))
    found = quality.subgroup_metrics(rows, ["model"], "y", "p", ["lang", "source", "toxic"])
    return found.select("model", "column_name", "group_value", "count", *_r("positive_rate", "roc_auc"))


@query(
    "metric_block",
    c.with_(
        c.METRICS,
        select="SELECT model, eval_set, rows, positive_rate, roc_auc, recall_at_top_decile, brier_score, expected_calibration_error FROM metrics",
    ),
)
def metric_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t.rounded_metrics(t.scored_long(spark, sf_dir))
    return found.select("model", "eval_set", "rows", "positive_rate", "roc_auc", "recall_at_top_decile", "brier_score", "expected_calibration_error")


@query(
    "metric_report_delta",
    c.with_(
        c.SCORED, "pair AS (SELECT * FROM long WHERE model IN ('v1', 'v3'))",
        c.auc("pair", "model", "a"), c.ece("pair", "model", "e"),
        "b AS (SELECT model, avg((p - y) * (p - y)) AS brier_score FROM pair GROUP BY ALL)",
        "u AS (UNPIVOT (SELECT model, roc_auc, average_precision, ece AS expected_calibration_error, brier_score FROM a JOIN e USING (model) JOIN b USING (model)) ON roc_auc, average_precision, expected_calibration_error, brier_score INTO NAME metric VALUE value)",
        select="""SELECT metric, round(max(value) FILTER (model = 'v1'), 6) AS v1, round(max(value) FILTER (model = 'v3'), 6) AS v3,
                  round(max(value) FILTER (model = 'v3') - max(value) FILTER (model = 'v1'), 6) AS delta FROM u GROUP BY ALL""",
    ),
)
def metric_report_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.unpivot_scores(t.scored(spark, sf_dir), {"v1": "p_v1", "v3": "p_v3"})
    block = quality.metric_block(rows, ["model"], "y", "p", "doc_id")
    found = quality.metric_deltas(block, [], "model", "v1", "v3", ["roc_auc", "average_precision", "expected_calibration_error", "brier_score"])
    return found.select("metric", *_r("v1", "v3"), "delta")


@query(
    "refused_metric_sets",
    c.with_(
        c.SCORED,
        "s AS (SELECT source, lang, y FROM scored)",
        select="SELECT source, lang, 'single class' AS reason FROM s GROUP BY ALL HAVING count(DISTINCT y) < 2",
    ),
)
def refused_metric_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of one outcome class have no AUC and are refused, by name."""
    rows = t.scored(spark, sf_dir).withColumn("p", F.col("p_v1"))
    _, refused = quality.gate_metrics(rows, ["source", "lang"], "y", "p", "doc_id")
    return refused


@query(
    "flattened_metrics",
    c.with_(
        c.METRICS,
        "u AS (UNPIVOT (SELECT model, eval_set, roc_auc, brier_score, CAST(rows AS DOUBLE) AS rows FROM metrics) ON roc_auc, brier_score, rows INTO NAME metric VALUE value)",
        select="SELECT model, eval_set, CASE WHEN metric = 'rows' THEN 'set_size_rows' ELSE 'headline_' || metric END AS metric_name, value FROM u",
    ),
)
def flattened_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = {"headline": ["roc_auc", "brier_score", "model"], "set size": ["rows"]}
    return quality.flatten_metrics(t.set_metrics(spark, sf_dir), ["model", "eval_set"], blocks)
