"""The streaming monitor run over the event table with availableNow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.operators import decisions
from tidewatch.operators.drift import ks_test, quantile_bins, reference_quantile_edges
from tidewatch.operators.quality import ranking_metrics
from tidewatch.plans import check_sql as c
from tidewatch.plans import tables as t
from tidewatch.plans.registry import query
from tidewatch.session import shared_folder
from tidewatch.sources.readers import as_utc_timestamps, stream_table
from tidewatch.streaming import labels, monitor, sketches, windows

CATEGORICAL = ["scenario", "ub"]


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = t.table(spark, sf_dir, name).schema
    return as_utc_timestamps(stream_table(spark, sf_dir, schema, f"{name}.parquet"))


STREAM_SQL = c.with_(
    c.STREAM,
    "num_ref AS (SELECT value AS v FROM ref)",
    "cuts AS (SELECT list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS qs FROM num_ref)",
    "tagged AS (SELECT w, w < DATE '2024-01-11' AS is_ref, ub, scenario, CAST((SELECT len(list_filter(qs, lambda x: x > list_min(qs) AND x < list_max(qs) AND x <= s.value)) FROM cuts) AS VARCHAR) AS vb FROM strm s)",
    "long_b AS (SELECT w, is_ref, 'value' AS feature, vb AS bin FROM tagged UNION ALL SELECT w, is_ref, 'ub', ub FROM tagged UNION ALL SELECT w, is_ref, 'scenario', scenario FROM tagged)",
    "r AS (SELECT feature, bin, count(*) AS n FROM long_b WHERE is_ref GROUP BY ALL)",
    "cu AS (SELECT w, feature, bin, count(*) AS n FROM long_b WHERE NOT is_ref GROUP BY ALL)",
    "ct AS (SELECT w, feature, sum(n) AS nc FROM cu GROUP BY ALL)",
    "rt AS (SELECT feature, sum(n) AS nr FROM r GROUP BY ALL)",
    "bins AS (SELECT DISTINCT feature, bin FROM long_b)",
    f"""psi AS (SELECT ct.w, ct.feature, max(nc) AS nc, sum({c.floor_psi('coalesce(r.n, 0) / nr::DOUBLE', 'coalesce(cu.n, 0) / nc::DOUBLE')}) AS psi
        FROM ct JOIN rt USING (feature) JOIN bins b ON b.feature = ct.feature LEFT JOIN r ON r.feature = ct.feature AND r.bin = b.bin
        LEFT JOIN cu ON cu.w = ct.w AND cu.feature = ct.feature AND cu.bin = b.bin GROUP BY ct.w, ct.feature)""",
    select="SELECT strftime(w, '%Y-%m-%d') AS window_date, round(max(psi), 6) AS max_psi, count(*) FILTER (psi >= 0.1) AS breaching_feature_count, CAST(max(nc) AS BIGINT) AS current_rows FROM psi GROUP BY w",
)


@query("stream_drift_events", STREAM_SQL)
def stream_drift_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams the serving days, then closes the windows still open: equal to the batch result."""
    reference, serving = t.split_stream(t.stream(spark, sf_dir))
    cuts = {name: quantile_bins(e) for name, e in reference_quantile_edges(reference, ["value"]).items()}
    bins = t.written_once(spark, sf_dir, "reference_bins", lambda: monitor.reference_bins(reference, cuts, CATEGORICAL))
    _, rows = t.split_stream(t.as_stream_features(_stream(spark, sf_dir, "events")))
    folder = shared_folder(spark, "stream")
    running = monitor.start_monitor(rows, bins, "ts", cuts, CATEGORICAL, events_path=f"{folder}/events", checkpoint=f"{folder}/checkpoint")
    running.awaitTermination()
    monitor.close_open_windows(as_utc_timestamps(serving), bins, "ts", cuts, CATEGORICAL, events_path=f"{folder}/events")
    found = spark.read.parquet(f"{folder}/events")
    return found.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_date"), F.round("max_psi", 6).alias("max_psi"), "breaching_feature_count", "current_rows")


# Two streams' windows and two policies: the events of the stream, then the rule table of the batch plans.
_STREAM_EVENTS = (
    c.STREAM,
    """tagged AS (SELECT scenario, w, w < DATE '2024-01-11' AS is_ref, ub, CAST((SELECT len(list_filter(qs, lambda x: x > list_min(qs) AND x < list_max(qs) AND x <= s.value))
        FROM (SELECT list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS qs FROM ref)) AS VARCHAR) AS vb,
        CAST((SELECT len(list_filter(qs, lambda x: x > list_min(qs) AND x < list_max(qs) AND x <= s.score))
        FROM (SELECT list_distinct(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS qs FROM ref)) AS VARCHAR) AS sb FROM strm s)""",
    "long_b AS (SELECT scenario, w, is_ref, 'value' AS feature, vb AS bin FROM tagged UNION ALL SELECT scenario, w, is_ref, 'ub', ub FROM tagged UNION ALL SELECT scenario, w, is_ref, 'score', sb FROM tagged)",
    "r AS (SELECT feature, bin, count(*) AS n FROM long_b WHERE is_ref GROUP BY ALL)",
    "cu AS (SELECT scenario, w, feature, bin, count(*) AS n FROM long_b WHERE NOT is_ref GROUP BY ALL)",
    "ct AS (SELECT scenario, w, feature, sum(n) AS nc FROM cu GROUP BY ALL)",
    "rt AS (SELECT feature, sum(n) AS nr FROM r GROUP BY ALL)",
    "bins AS (SELECT DISTINCT feature, bin FROM long_b)",
    f"""dev_long AS (SELECT ct.scenario, ct.w, ct.feature, max(nc) AS nc, sum({c.floor_psi('coalesce(r.n, 0) / nr::DOUBLE', 'coalesce(cu.n, 0) / nc::DOUBLE')}) AS psi
        FROM ct JOIN rt USING (feature) JOIN bins b ON b.feature = ct.feature LEFT JOIN r ON r.feature = ct.feature AND r.bin = b.bin
        LEFT JOIN cu ON cu.scenario = ct.scenario AND cu.w = ct.w AND cu.feature = ct.feature AND cu.bin = b.bin GROUP BY ct.scenario, ct.w, ct.feature)""",
    """dev AS (SELECT 'de-' || lower(scenario) || '-d' || strftime(w, '%Y%m%d') || '-' || substr(sha256('stream|' || scenario || '|' || strftime(w, '%Y-%m-%d') || ' 00:00:00'), 1, 8) AS event_id,
        scenario, w, max(psi) FILTER (feature = 'score') AS prediction_psi, coalesce(max(psi) FILTER (feature = 'score') >= 0.1, false) AS prediction_drift,
        max(psi) FILTER (feature <> 'score') AS max_psi, count(*) FILTER (feature <> 'score' AND psi >= 0.1) AS breaching_feature_count FROM dev_long GROUP BY scenario, w)""",
    c.DECIDED_RUNS.replace("breach_count / 4::DOUBLE", "breach_count / 2::DOUBLE"),
    c.RULED,
)


@query(
    "stream_decisions",
    c.with_(*_STREAM_EVENTS, recursive=True, select="SELECT card_id, policy_version, scenario, strftime(w, '%Y-%m-%d') AS window_date, action, disposition, rule_id, CAST(run AS BIGINT) AS run, confidence FROM cards"),
)
def stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stream's windows measured and decided as they close, under both policies, with the real rule table."""
    reference, serving = t.split_stream(t.stream(spark, sf_dir))
    cuts = {name: quantile_bins(e) for name, e in reference_quantile_edges(reference, ["value", "score"]).items()}
    bins = t.written_once(spark, sf_dir, "decision_bins", lambda: monitor.reference_bins(reference, cuts, ["ub"]))
    _, rows = t.split_stream(t.as_stream_features(_stream(spark, sf_dir, "events")))
    folder = shared_folder(spark, "stream-decisions")
    policies = decisions.policy_table(spark)
    options = {"scenario": "scenario", "score": "score", "events_path": f"{folder}/events", "policies": policies, "cards_path": f"{folder}/cards"}
    monitor.start_monitor(rows, bins, "ts", cuts, ["ub"], checkpoint=f"{folder}/checkpoint", **options).awaitTermination()
    monitor.close_open_windows(as_utc_timestamps(serving), bins, "ts", cuts, ["ub"], **options)
    cards = spark.read.parquet(f"{folder}/cards")
    run = F.col("trigger.consecutive_breaching_windows").cast("bigint").alias("run")
    return cards.select("card_id", "policy_version", "scenario", F.date_format("window_start", "yyyy-MM-dd").alias("window_date"), "action", "disposition", "rule_id", run, "confidence")


@query(
    "stream_dual_scoring",
    """SELECT 'audit' AS sink, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, count(*) AS rows, round(sum(CASE WHEN event_type <> 'error' THEN least(value, 500) / 500 END), 4) AS total FROM events GROUP BY ALL
UNION ALL SELECT 'shadow', CASE WHEN user_id % 10 = 0 THEN 'shadow_failed' ELSE 'scored' END, count(*), round(sum(CASE WHEN user_id % 10 <> 0 THEN least(value, 250) / 250 END), 4) FROM events GROUP BY ALL""",
)
def stream_dual_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _stream(spark, sf_dir, "events").select(F.concat(F.lit("rq-"), F.col("event_id").cast("string")).alias("request_id"), "event_type", "user_id", "value")
    folder = shared_folder(spark, "scoring")

    def score(df: DataFrame) -> DataFrame:
        return df.select("request_id", F.when(F.col("event_type") != "error", F.least(F.col("value"), F.lit(500.0)) / 500.0).alias("score"))

    def shadow(df: DataFrame) -> DataFrame:
        return df.select("request_id", F.when(F.col("user_id") % 10 != 0, F.least(F.col("value"), F.lit(250.0)) / 250.0).alias("score"))

    running = monitor.start_scoring(requests, score, shadow, audit_path=f"{folder}/audit", shadow_path=f"{folder}/shadow", checkpoint=f"{folder}/checkpoint")
    running.awaitTermination()
    parts = [spark.read.parquet(f"{folder}/{sink}").withColumn("sink", F.lit(sink)) for sink in ("audit", "shadow")]
    return parts[0].unionByName(parts[1]).groupBy("sink", "status").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("score"), 4).alias("total"))


@query(
    "matured_auroc",
    c.with_(
        "m AS (SELECT strftime(e.ts, '%Y-%m-%d') AS window_date, least(value, 500::DOUBLE) / 500 AS p, l.quality AS y FROM events e JOIN labels l ON l.doc_id = e.event_id)",
        c.auc("m", "window_date", "a"),
        select="SELECT window_date, rows, round(roc_auc, 6) AS roc_auc FROM a",
    ),
)
def matured_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC per prediction day once labels have come in, up to thirty days later."""
    p = t.predictions(spark, sf_dir).select("request_id", "ts", "score")
    shown = t.table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("seen"))
    l = t.table(spark, sf_dir, "labels").join(shown, "doc_id").select(
        F.concat(F.lit("rq-"), F.col("doc_id").cast("string")).alias("request_id"),
        (F.col("seen") + F.make_dt_interval((F.col("doc_id") % 31).cast("int"))).alias("label_ts"), F.col("quality").alias("y"),
    )
    matured = monitor.matured_predictions(p, l)
    return ranking_metrics(matured.withColumn("window_date", F.date_format("ts", "yyyy-MM-dd")), ["window_date"], "y", "score").select("window_date", "rows", F.round("roc_auc", 6).alias("roc_auc"))


# --- windows without rows, windows of a number of rows ----------------------------------------
@query(
    "stream_quiet_windows",
    """
WITH e AS (SELECT event_type AS scenario, date_trunc('hour', ts) AS h, value FROM events),
passed AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events),
spans AS (SELECT scenario, unnest(generate_series(min(h), (SELECT date_trunc('hour', mark) FROM passed) - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS h FROM e GROUP BY scenario)
SELECT s.scenario, strftime(s.h, '%Y-%m-%d %H:%M') AS window_start, count(e.h) AS current_rows, count(e.h) = 0 AS quiet
FROM spans s LEFT JOIN e ON e.scenario = s.scenario AND e.h = s.h GROUP BY s.scenario, s.h""",
)
def stream_quiet_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour of every stream the watermark has passed has its drift event, hours without a row too."""
    reference, _ = t.split_stream(t.stream(spark, sf_dir))
    cuts = {name: quantile_bins(e) for name, e in reference_quantile_edges(reference, ["value"]).items()}
    bins = t.written_once(spark, sf_dir, "quiet_bins", lambda: monitor.reference_bins(reference, cuts, ["ub"]))
    rows = t.as_stream_features(_stream(spark, sf_dir, "events"))
    folder = shared_folder(spark, "stream-quiet")
    running = monitor.start_monitor(
        rows, bins, "ts", cuts, ["ub"], events_path=f"{folder}/events", checkpoint=f"{folder}/checkpoint", scenario="scenario", width="1 hour", quiet=True
    )
    running.awaitTermination()
    quiet = (F.col("max_psi").isNull() & (F.size("feature_stats") == 0)).alias("quiet")
    return spark.read.parquet(f"{folder}/events").select("scenario", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "current_rows", quiet)


@query(
    "stream_row_windows",
    """
SELECT scenario, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 150 AS window_index
FROM (SELECT *, event_type AS scenario FROM events)""",
)
def stream_row_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 150 rows of each stream, numbered as the watermark passes; equal to the batch form's."""
    features = t.as_stream_features(_stream(spark, sf_dir, "events")).select("scenario", "event_id", "ts")
    folder = shared_folder(spark, "stream-rows")
    windows.start_row_windows(features, "ts", "event_id", 150, group="scenario", path=f"{folder}/rows", checkpoint=f"{folder}/checkpoint").awaitTermination()
    everything = as_utc_timestamps(t.stream(spark, sf_dir)).select("scenario", "event_id", "ts")
    windows.close_row_windows(everything, "ts", "event_id", 150, group="scenario", path=f"{folder}/rows")
    return spark.read.parquet(f"{folder}/rows").select("scenario", "event_id", "window_index")


# --- Kolmogorov-Smirnov from sketches -----------------------------------------------------------
@query(
    "stream_ks_sketch",
    c.with_(
        c.STREAM,
        c.numeric_long(("value", "hour")),
        c.KS,
        select="SELECT scenario, strftime(w, '%Y-%m-%d') AS window_date, feature, CAST(nc AS BIGINT) AS current_rows, round(d, 6) AS ks_statistic, true AS within_bound FROM ks JOIN cur_size USING (scenario, w, feature)",
    ),
)
def stream_ks_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch statistic of each window, and whether that of the stream's sketches lies within its stated bound of it."""
    reference, serving = t.split_stream(t.stream(spark, sf_dir))
    numeric = ["value", "hour"]
    cuts = {name: quantile_bins(e) for name, e in reference_quantile_edges(reference, numeric).items()}
    bins = t.written_once(spark, sf_dir, "ks_bins", lambda: monitor.reference_bins(reference, cuts, []))
    grid = t.written_once(spark, sf_dir, "ks_grid", lambda: sketches.reference_grid(reference, cuts))
    _, rows = t.split_stream(t.as_stream_features(_stream(spark, sf_dir, "events")))
    folder = shared_folder(spark, "stream-ks")
    keys = ["scenario", "window_start", "window_end"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        sketches.ks_of_bins(batch, grid, keys).write.mode("overwrite").parquet(f"{folder}/ks/batch_id={batch_id}")

    counts = monitor.windowed_bins(rows, "ts", cuts, [], scenario="scenario", sketch_k=sketches.K)
    counts.writeStream.outputMode("append").foreachBatch(handle).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    closed = spark.read.parquet(f"{folder}/ks")
    late = monitor.windowed_bins(as_utc_timestamps(serving), "ts", cuts, [], scenario="scenario", sketch_k=sketches.K)
    late = sketches.ks_of_bins(late.join(closed.select(*keys).distinct(), keys, "left_anti"), grid, keys)
    seen = closed.select(*late.columns).unionByName(late).select("scenario", F.col("window_start").cast("date").alias("w"), "feature", F.col("ks_statistic").alias("sketched"), "ks_bound")
    exact = ks_test(reference, serving, ["scenario", "w"], numeric)
    within = F.abs(F.col("sketched") - F.col("ks_statistic")) <= F.col("ks_bound") + 1e-9
    return exact.join(seen, ["scenario", "w", "feature"], "left").select(
        "scenario", F.date_format("w", "yyyy-MM-dd").alias("window_date"), "feature", F.col("cur_rows").cast("bigint").alias("current_rows"),
        F.round("ks_statistic", 6).alias("ks_statistic"), F.coalesce(within, F.lit(False)).alias("within_bound"),
    )


# --- late labels to rule 5 ----------------------------------------------------------------------
LABEL_DAYS = 5  # labels come up to so many days after the prediction
_MATURED = f"""
paired AS (
  SELECT s.scenario, s.w, s.w < DATE '2024-01-11' AS is_ref, s.score AS p, l.quality AS y, s.ts + (s.event_id % {LABEL_DAYS + 1}) * INTERVAL 1 DAY AS label_ts
  FROM strm s JOIN labels l ON l.doc_id = s.event_id % (SELECT count(*) FROM documents)),
graded AS (SELECT *, least(greatest(CAST(floor(p * 1000::DOUBLE) AS BIGINT), 0), 999) AS bin FROM paired),
ref_bins AS (SELECT scenario, bin, sum(y) AS pos, sum(1 - y) AS neg FROM graded WHERE is_ref GROUP BY ALL),
champion AS (
  SELECT scenario, sum(won) / (sum(pos)::DOUBLE * nullif(sum(neg), 0)) AS champion_auc FROM (
    SELECT *, pos * (coalesce(sum(neg) OVER (PARTITION BY scenario ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5::DOUBLE * neg) AS won FROM ref_bins) GROUP BY scenario),
day_bins AS (SELECT scenario, w, bin, sum(y) AS pos, sum(1 - y) AS neg FROM graded WHERE NOT is_ref GROUP BY ALL),
day_auc AS (
  SELECT scenario, w, sum(won) / (nullif(sum(pos), 0)::DOUBLE * nullif(sum(neg), 0)) AS roc_auc FROM (
    SELECT *, pos * (coalesce(sum(neg) OVER (PARTITION BY scenario, w ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5::DOUBLE * neg) AS won FROM day_bins) GROUP BY scenario, w),
matured AS (
  SELECT scenario, w, champion_auc - roc_auc AS lost FROM day_auc JOIN champion USING (scenario)
  WHERE w + INTERVAL 1 DAY + INTERVAL {LABEL_DAYS} DAY + INTERVAL 1 HOUR <= (SELECT max(label_ts) FROM paired WHERE NOT is_ref))
"""


@query(
    "stream_matured_rule",
    c.with_(
        c.RUNS_OF_BREACHES, _MATURED,
        """
told AS (
  SELECT f.* EXCLUDE (confidence, evidence), coalesce(m.lost IS NOT NULL, false) AS matured, m.lost,
         round(0.35 * severity + 0.2 * breadth + 0.2 * persistence + 0.25 * CASE WHEN m.lost IS NOT NULL THEN 1::DOUBLE ELSE 0.5::DOUBLE END, 6) AS confidence
  FROM weighed f LEFT JOIN matured m USING (scenario, w)),
picked AS (
  SELECT *, CASE WHEN matured AND lost > 0.03 THEN '5' WHEN coalesce(top >= 0.25, false) OR prediction_drift THEN '4' WHEN run >= 2 AND len(persistent) > 0 THEN '3'
                 WHEN breach_count BETWEEN 1 AND 2 AND run < 2 THEN '2' WHEN breach_count = 0 THEN '1' ELSE 'uncovered' END AS rule_id FROM told)""",
        recursive=True,
        select="""
SELECT policy_version, scenario, strftime(w, '%Y-%m-%d') AS window_date, rule_id, confidence, CASE WHEN matured THEN 'matured' ELSE 'leading_indicators' END AS label_maturity, round(lost, 6) AS auroc_drop,
       CASE WHEN rule_id IN ('4', '5') THEN 'FULL_RETRAIN' WHEN rule_id = '3' THEN 'INCREMENTAL_RETRAIN' WHEN rule_id = '1' THEN 'NO_OP' ELSE 'ALERT_ONLY' END AS action,
       CASE WHEN rule_id = '5' OR (rule_id = '4' AND confidence < 0.75) THEN 'ESCALATE_HUMAN' WHEN rule_id IN ('3', '4') THEN 'AUTO_PROCEED_SHADOW' ELSE 'NONE' END AS disposition
FROM picked""",
    ),
)
def stream_matured_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams, predictions and the labels that come days later, decide the windows whose labels are in."""
    folder = shared_folder(spark, "stream-labels")
    documents = t.table(spark, sf_dir, "documents").count()
    said = as_utc_timestamps(t.stream(spark, sf_dir)).withColumn("doc_id", F.col("event_id") % documents).join(t.table(spark, sf_dir, "labels"), "doc_id")
    pairs = said.select("event_id", "scenario", "w", "score", F.col("quality").alias("y"), F.col("ts"))
    reference, later = t.split_stream(pairs)
    arrives = (F.col("ts") + F.make_dt_interval((F.col("event_id") % (LABEL_DAYS + 1)).cast("int"))).alias("label_ts")
    later.select(F.col("event_id").alias("request_id"), arrives, "y").write.parquet(f"{folder}/labels")
    champion = labels.auc_of_histograms(labels.histograms(reference, ["scenario"], "y", "score"), ["scenario"]).select("scenario", F.col("roc_auc").alias("champion_auc"))
    champion.write.parquet(f"{folder}/champion")
    _, served = t.split_stream(t.as_stream_features(_stream(spark, sf_dir, "events")))
    feed = spark.readStream.schema(spark.read.parquet(f"{folder}/labels").schema).parquet(f"{folder}/labels")
    running = labels.start_maturing(
        served.select(F.col("event_id").alias("request_id"), "scenario", "ts", "score"), feed, spark.read.parquet(f"{folder}/champion"),
        scenario="scenario", evidence_path=f"{folder}/evidence", checkpoint=f"{folder}/checkpoint", delay=f"{LABEL_DAYS} days", late="1 hour",
    )
    running.awaitTermination()
    found = spark.read.parquet(f"{folder}/evidence").select("scenario", "window_start", "labels_matured", "matured_auroc_drop_seen")
    cards = decisions.decide(t.events(spark, sf_dir), decisions.policy_table(spark), matured=found)
    return cards.select(
        "policy_version", "scenario", F.date_format("window_start", "yyyy-MM-dd").alias("window_date"), "rule_id", "confidence", F.col("trigger.label_maturity").alias("label_maturity"),
        F.round("trigger.matured_auroc_drop", 6).alias("auroc_drop"), "action", "disposition",
    )
