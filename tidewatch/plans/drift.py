"""Windows and drift over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.operators import drift
from tidewatch.operators.ordering import running_totals
from tidewatch.operators.preparation import day_windows, next_window_index, next_windows, row_windows, rows_of_windows, window_start
from tidewatch.plans import check_sql as c
from tidewatch.plans import tables as t
from tidewatch.plans.registry import query

DAY = ("w",)


def _day(col: str = "w") -> F.Column:
    return F.date_format(col, "yyyy-MM-dd").alias("window_date")


def _r(col: str, alias: str | None = None) -> F.Column:
    return F.round(col, 6).alias(alias or col)


@query(
    "row_windows",
    """
WITH placed AS (SELECT *, (row_number() OVER (ORDER BY ts, event_id) - 1) // 700 AS window_index, count(*) OVER () AS total FROM events)
SELECT CAST(window_index AS BIGINT) AS window_index, count(*) AS rows, min(event_id) AS first_event, max(event_id) AS last_event,
       strftime(TIMESTAMP '2026-01-01' + CAST(window_index AS BIGINT) * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_start,
       round(avg(value), 6) AS mean_value
FROM placed WHERE (window_index + 1) * 700 <= total GROUP BY window_index
""",
)
def row_windows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.table(spark, sf_dir, "events").select("event_id", "ts", "value")
    blocks = row_windows(events, "ts", "event_id", 700, keep_partial=False)
    return blocks.groupBy("window_index").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("event_id").alias("first_event"),
        F.max("event_id").alias("last_event"),
        F.date_format(window_start(F.first("window_index")), "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        F.round(F.avg("value"), 6).alias("mean_value"),
    )


@query(
    "event_time_windows",
    """
WITH spine AS (SELECT CAST(unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS DATE) AS d FROM events)
SELECT strftime(d, '%Y-%m-%d') AS window_date, count(event_id) AS rows, CAST(count(DISTINCT user_id) AS BIGINT) AS users,
       coalesce(round(sum(value), 4), 0) AS total_value
FROM spine LEFT JOIN events ON ts::DATE = d GROUP BY d
""",
)
def event_time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.table(spark, sf_dir, "events")
    bounds = events.agg(F.min("ts").cast("date").alias("a"), F.max("ts").cast("date").alias("b"))
    spine = bounds.select(F.explode(F.sequence("a", "b")).alias("window_date"))
    aggregates = [F.count(F.lit(1)).alias("rows"), F.count_distinct(F.col("user_id")).alias("users"), F.round(F.sum("value"), 4).alias("total_value")]
    out = day_windows(events, "ts", spine, aggregates, {"rows": 0, "users": 0, "total_value": 0.0})
    return out.withColumn("window_date", F.date_format("window_date", "yyyy-MM-dd"))


def _categorical_sql(rounding: str = "round(psi, 6) AS psi, psi >= 0.1 AS breaching") -> str:
    return c.with_(
        c.STREAM, c.categorical("scenario", keys="w", out="cats"),
        select=f"SELECT strftime(w, '%Y-%m-%d') AS window_date, {rounding} FROM cats",
    )


@query("psi_categorical_by_window", _categorical_sql())
def psi_categorical_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, serving = t.split_stream(t.stream(spark, sf_dir).select("w", "scenario"))
    psi = drift.categorical_psi(reference, serving, DAY, ["scenario"])
    return psi.select(_day(), _r("psi"), (F.col("psi") >= drift.PSI_BREACH).alias("breaching"))


def _quantile_sql() -> str:
    features = ("value", "k", "hour")
    return c.with_(
        c.STREAM,
        c.numeric_long(features, keys="w, "),
        "q AS (SELECT feature, list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS qs FROM num_ref GROUP BY ALL)",
        "cuts AS (SELECT feature, list_filter(qs, lambda x: x > list_min(qs) AND x < list_max(qs)) AS inner_cuts FROM q)",
        "r AS (SELECT feature, len(list_filter(inner_cuts, lambda e: e <= v)) AS bin, count(*) AS n FROM num_ref JOIN cuts USING (feature) GROUP BY ALL)",
        "cb AS (SELECT w, feature, len(list_filter(inner_cuts, lambda e: e <= v)) AS bin, count(*) AS n FROM num_cur JOIN cuts USING (feature) GROUP BY ALL)",
        "rt AS (SELECT feature, sum(n) AS t FROM r GROUP BY ALL)",
        "ct AS (SELECT w, feature, sum(n) AS t FROM cb GROUP BY ALL)",
        select=f"""
SELECT strftime(ct.w, '%Y-%m-%d') AS window_date, ct.feature, round(sum({c.floor_psi('r.n / rt.t::DOUBLE', 'coalesce(cb.n, 0) / ct.t::DOUBLE')}), 6) AS psi
FROM ct JOIN rt USING (feature) JOIN r USING (feature) LEFT JOIN cb ON cb.w = ct.w AND cb.feature = ct.feature AND cb.bin = r.bin GROUP BY ALL""",
    )


@query("psi_numeric_quantile_by_window", _quantile_sql())
def psi_numeric_quantile_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, serving = t.split_stream(t.stream(spark, sf_dir).select("w", "value", "k", "hour"))
    psi = drift.quantile_psi(reference, serving, DAY, ["value", "k", "hour"])
    return psi.select(_day(), "feature", _r("psi"))


@query(
    "psi_numeric_sturges_by_window",
    c.with_(c.STREAM, c.numeric_long(("value", "k"), keys="w, "), c.sturges("w"), select="SELECT strftime(w, '%Y-%m-%d') AS window_date, feature, round(psi, 6) AS psi FROM sturges"),
)
def psi_numeric_sturges_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, serving = t.split_stream(t.stream(spark, sf_dir).select("w", "value", "k"))
    return drift.sturges_psi(reference, serving, DAY, ["value", "k"]).select(_day(), "feature", _r("psi"))


@query(
    "psi_constant_reference",
    c.with_(
        c.STREAM,
        "shifted AS (SELECT w, CASE WHEN k < 10 THEN 4 WHEN k >= 60 THEN 9 ELSE 5 END AS v FROM cur)",
        "binned AS (SELECT w, CASE WHEN v < 5 THEN 0 WHEN v = 5 THEN 1 ELSE 2 END AS bin, count(*) AS n FROM shifted GROUP BY ALL)",
        "tot AS (SELECT w, sum(n) AS t FROM binned GROUP BY ALL)",
        "spine AS (SELECT w, t, u.b AS bin, CASE WHEN u.b = 1 THEN 1::DOUBLE ELSE 0::DOUBLE END AS r FROM tot, unnest([0, 1, 2]) AS u(b))",
        select=f"SELECT strftime(w, '%Y-%m-%d') AS window_date, round(sum({c.floor_psi('r', 'coalesce(n, 0) / t::DOUBLE')}), 6) AS psi FROM spine LEFT JOIN binned USING (w, bin) GROUP BY w",
    ),
)
def psi_constant_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, serving = t.split_stream(t.stream(spark, sf_dir).select("w", "k"))
    moved = F.when(F.col("k") < 10, 4.0).when(F.col("k") >= 60, 9.0).otherwise(5.0)
    flat = reference.select(F.when(F.col("k").isNotNull(), F.lit(5.0)).alias("level"))
    return drift.quantile_psi(flat, serving.select("w", moved.alias("level")), DAY, ["level"]).select(_day(), _r("psi"))


@query(
    "ks_test_by_window",
    c.with_(c.STREAM, c.numeric_long(("value", "k", "hour")), c.KS, select="SELECT scenario, strftime(w, '%Y-%m-%d') AS window_date, feature, round(d, 6) AS ks_statistic, round(p, 6) AS ks_p_value FROM ks"),
)
def ks_test_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, serving = t.split_stream(t.stream(spark, sf_dir))
    ks = drift.ks_test(reference, serving, ["scenario", "w"], ["value", "k", "hour"])
    return ks.select("scenario", _day(), "feature", _r("ks_statistic"), _r("ks_p_value"))


@query(
    "prediction_drift_by_window",
    c.with_(c.STREAM, c.numeric_long(("score",), keys="w, "), c.sturges("w"), select="SELECT strftime(w, '%Y-%m-%d') AS window_date, round(psi, 6) AS prediction_psi, psi >= 0.1 AS prediction_drift FROM sturges"),
)
def prediction_drift_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, serving = t.split_stream(t.stream(spark, sf_dir).select("w", "score"))
    psi = drift.sturges_psi(reference, serving, DAY, ["score"])
    return psi.select(_day(), _r("psi", "prediction_psi"), (F.col("psi") >= drift.PREDICTION_PSI).alias("prediction_drift"))


@query(
    "drift_events",
    c.with_(
        c.EVENTS,
        select="""
SELECT event_id, scenario, strftime(w, '%Y-%m-%d') AS window_date, round(prediction_psi, 6) AS prediction_psi, prediction_drift,
       round(max_psi, 6) AS max_psi, breaching_feature_count, reference_rows, current_rows,
       breaching_feature_count = 0 AND NOT prediction_drift AS quiet FROM dev""",
    ),
)
def drift_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.build_events(*t.split_stream(t.stream(spark, sf_dir)))
    return events.select(
        "event_id", "scenario", F.date_format("window_start", "yyyy-MM-dd").alias("window_date"), _r("prediction_psi"), "prediction_drift",
        _r("max_psi"), "breaching_feature_count", "reference_rows", "current_rows", drift.quiet().alias("quiet"),
    )


@query(
    "drift_feature_stats",
    c.with_(
        c.DRIFT_LONG,
        select="""
SELECT scenario, strftime(w, '%Y-%m-%d') AS window_date, feature, kind, round(psi, 6) AS psi, round(ks_p, 6) AS ks_p_value,
       psi >= 0.1 AS breaching, psi >= 0.25 AS severe FROM dev_long WHERE feature <> 'score'""",
    ),
)
def drift_feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = t.events(spark, sf_dir).select("scenario", F.date_format("window_start", "yyyy-MM-dd").alias("window_date"), F.inline("feature_stats"))
    return stats.select("scenario", "window_date", "feature", "kind", _r("psi"), _r("ks_p_value"), "breaching", "severe")


@query(
    "reference_stability_halves",
    c.with_(
        c.STREAM.replace("cur AS", "cur_unused AS"),
        "half_ref AS (SELECT * FROM ref WHERE w < DATE '2024-01-06')",
        "half_cur AS (SELECT * FROM ref WHERE w >= DATE '2024-01-06')",
        "long_r AS (SELECT 'value' AS feature, value AS v FROM half_ref UNION ALL SELECT 'k', CAST(k AS DOUBLE) FROM half_ref)",
        "long_c AS (SELECT 'value' AS feature, value AS v FROM half_cur UNION ALL SELECT 'k', CAST(k AS DOUBLE) FROM half_cur)",
        "q AS (SELECT feature, list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS qs FROM long_r GROUP BY ALL)",
        "cuts AS (SELECT feature, list_filter(qs, lambda x: x > list_min(qs) AND x < list_max(qs)) AS inner_cuts FROM q)",
        "both_sides AS (SELECT feature, v, 1 AS is_ref FROM long_r UNION ALL SELECT feature, v, 0 FROM long_c)",
        """counts AS (
             SELECT feature, 'numerical' AS kind, CAST(len(list_filter(inner_cuts, lambda e: e <= v)) AS VARCHAR) AS bin, sum(is_ref) AS r, sum(1 - is_ref) AS c
             FROM both_sides JOIN cuts USING (feature) GROUP BY ALL
             UNION ALL SELECT 'ub', 'categorical', ub, count(*) FILTER (w < DATE '2024-01-06'), count(*) FILTER (w >= DATE '2024-01-06') FROM ref GROUP BY ub)""",
        "tot AS (SELECT feature, sum(r) AS rt, sum(c) AS ct FROM counts GROUP BY ALL)",
        select=f"SELECT feature, kind, round(sum({c.floor_psi('r / rt::DOUBLE', 'c / ct::DOUBLE')}), 6) AS psi FROM counts JOIN tot USING (feature) GROUP BY ALL",
    ),
)
def reference_stability_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, _ = t.split_stream(t.stream(spark, sf_dir).select("w", "value", "k", "ub"))
    spec = drift.MonitorSpec((), ("value", "k"), ("ub",))
    return drift.self_stability(reference, F.col("w") >= F.lit("2024-01-06").cast("date"), spec).select("feature", "kind", _r("psi"))


@query(
    "calibrate_threshold",
    c.with_(c.DRIFT_LONG, select="SELECT feature, round(max(psi), 6) AS max_psi, round(ceil(max(psi) / 0.05::DOUBLE) * 0.05::DOUBLE, 6) AS threshold FROM dev_long WHERE feature <> 'score' GROUP BY feature"),
)
def calibrate_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = t.events(spark, sf_dir).select(F.inline("feature_stats"))
    return drift.calibrated_thresholds(long).select("feature", _r("max_psi"), _r("threshold"))


@query(
    "breach_persistence",
    c.with_(
        c.DRIFT_LONG,
        """steps AS (SELECT scenario, feature, w, psi >= 0.1 AS hit, row_number() OVER (PARTITION BY scenario, feature ORDER BY w)
                       - row_number() OVER (PARTITION BY scenario, feature, psi >= 0.1 ORDER BY w) AS island FROM dev_long WHERE feature <> 'score')""",
        "runs AS (SELECT scenario, feature, count(*) AS len FROM steps WHERE hit GROUP BY scenario, feature, island)",
        select="SELECT scenario, feature, max(len) AS longest_run, CAST(sum(len) AS BIGINT) AS breaching_windows FROM runs GROUP BY ALL",
    ),
)
def breach_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest streak of breaching windows of each stream's features.

    Windows and breaches are numbered by running totals; within a streak both grow together.
    """
    stats = t.events(spark, sf_dir).select("scenario", "window_start", F.inline("feature_stats"))
    marked = stats.select("scenario", "feature", "window_start", F.lit(1).alias("seen"), F.col("breaching").cast("int").alias("hit"))
    numbered = running_totals(marked, ["scenario", "feature"], "window_start", ["seen", "hit"]).where("hit = 1")
    runs = numbered.groupBy("scenario", "feature", (F.col("seen_upto") - F.col("hit_upto")).alias("island")).agg(F.count(F.lit(1)).alias("len"))
    return runs.groupBy("scenario", "feature").agg(F.max("len").alias("longest_run"), F.sum("len").alias("breaching_windows"))


@query("monitored_streams", c.with_(c.STREAM, select="SELECT scenario, count(DISTINCT w) AS windows FROM cur GROUP BY ALL"))
def monitored_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.events(spark, sf_dir).groupBy("scenario").agg(F.count(F.lit(1)).alias("windows")).orderBy("scenario")


@query(
    "next_window_index",
    c.with_(c.STREAM, select="SELECT scenario, CAST(date_diff('day', DATE '2024-01-11', max(w)) + 1 AS BIGINT) AS next_index FROM cur GROUP BY ALL"),
)
def next_window_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_window_index(t.events(spark, sf_dir), epoch="2024-01-11 00:00:00")


@query(
    "next_window_on_demand",
    c.with_(
        c.STREAM,
        "placed AS (SELECT scenario, value, (row_number() OVER (PARTITION BY scenario ORDER BY ts, event_id) - 1) // 50 AS i, count(*) OVER (PARTITION BY scenario) AS total FROM cur)",
        "done AS (SELECT scenario, CAST(count(DISTINCT w) // 5 AS BIGINT) AS next_index FROM cur GROUP BY ALL)",
        select="SELECT scenario, CAST(i AS BIGINT) AS window_index, count(*) AS rows, round(sum(value), 4) AS total FROM placed JOIN done USING (scenario) WHERE (i + 1) * 50 <= total AND i = next_index GROUP BY ALL",
    ),
)
def next_window_on_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first block of each stream that the record, here a fifth of the days, does not cover."""
    _, serving = t.split_stream(t.stream(spark, sf_dir))
    blocks = row_windows(serving.select("scenario", "ts", "event_id", "value"), "ts", "event_id", 50, groups=["scenario"], keep_partial=False)
    days = t.events(spark, sf_dir).groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))
    on_record = days.where("n >= 5").select("scenario", window_start(F.floor(F.col("n") / 5) - 1).alias("window_start"))
    due = next_windows(blocks, on_record)
    return due.groupBy("scenario", "window_index").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "rows_of_windows",
    c.with_(c.EVENTS, select="SELECT scenario, count(*) AS rows, round(sum(value), 4) AS total FROM cur JOIN (SELECT scenario, w FROM dev WHERE prediction_drift) USING (scenario, w) GROUP BY ALL"),
)
def rows_of_windows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled rows of the windows whose score distribution moved."""
    _, serving = t.split_stream(t.stream(spark, sf_dir).select("scenario", "w", "value"))
    drifting = t.events(spark, sf_dir).where("prediction_drift").select("scenario", F.col("window_start").cast("date").alias("w"))
    found = rows_of_windows(serving, drifting, ["scenario", "w"])
    return found.groupBy("scenario").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total"))
