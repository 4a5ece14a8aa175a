"""The driver's tables and the monitoring tables derived from them.

Derived tables that many queries read (drift events, cards) are written once per session to
the shared folder and read back, as the audit tables of a running system would be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.operators import decisions, drift, gate, quality
from tidewatch.operators.ordering import union_all
from tidewatch.session import configure, shared_folder
from tidewatch.sources.schemas import ALIAS_MOVE

REFERENCE_END = "2024-01-11"
SPEC = drift.MonitorSpec(("scenario", "w"), ("value", "k", "hour"), ("ub",), "score")
GROUP_COLUMNS = ("lang", "toxic")
_WRITTEN: dict[tuple, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _version(spark: SparkSession, sf_dir: str) -> int:
    """Changes with the names, sizes and times of the input's files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(sf_dir)
    return found.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()[0]


def written_once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name, _version(spark, sf_dir))
    if key not in _WRITTEN:
        path = shared_folder(spark, name)
        build().write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def forget() -> None:
    """Derived tables are built anew when next asked for."""
    _WRITTEN.clear()


# --- the event stream -----------------------------------------------------------------------
def as_stream_features(events: DataFrame) -> DataFrame:
    """Window keys and monitored columns of raw events, for batch frames and streams alike."""
    return events.select(
        "event_id",
        "ts",
        F.col("ts").cast("date").alias("w"),
        F.col("event_type").alias("scenario"),
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.hour("ts").cast("bigint").alias("hour"),
        (F.col("user_id") % 10).cast("string").alias("ub"),
        (F.least(F.col("value"), F.lit(500.0)) / 500.0).alias("score"),
    )


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_stream_features(table(spark, sf_dir, "events"))


def split_stream(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reference, serving): the first ten days against the rest."""
    end = F.lit(REFERENCE_END).cast("date")
    return rows.where(F.col("w") < end), rows.where(F.col("w") >= end)


def build_events(reference: DataFrame, serving: DataFrame) -> DataFrame:
    return drift.window_events(
        reference, serving, SPEC, scenario="scenario",
        window_start=F.col("w"), window_end=F.date_add("w", 1),
        window_number=F.datediff("w", F.lit(REFERENCE_END).cast("date")),
        model_version="v1", data_version="d1",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_once(spark, sf_dir, "drift_events", lambda: build_events(*split_stream(stream(spark, sf_dir))))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return decisions.decide(events(spark, sf_dir), decisions.policy_table(spark), candidate_data_version="d1")

    return written_once(spark, sf_dir, "decision_cards", build)


def window_number(start: str = "window_start") -> F.Column:
    return F.datediff(F.col(start).cast("date"), F.lit(REFERENCE_END).cast("date"))


# --- scored rows and the gate ---------------------------------------------------------------
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    joined = labels.join(documents, "doc_id")
    champion = F.least(F.col("n_chars"), F.lit(5000)).cast("double") / 5000.0
    return joined.select(
        "doc_id", "lang", "source", F.col("toxic").cast("string").alias("toxic"), F.col("quality").alias("y"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("frozen_holdout")).otherwise(F.lit("recent_labeled_window")).alias("eval_set"),
        champion.alias("p_v1"),
        (F.pmod(F.col("doc_id") * 37, F.lit(101)).cast("double") / 101.0).alias("p_v2"),
        (F.lit(0.8) + F.lit(0.1) * champion).alias("p_v3"),
        (F.lit(1.0) - champion).alias("p_v9"),
    )


def scored_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unpivot_scores(scored(spark, sf_dir), {"v1": "p_v1", "v2": "p_v2", "v3": "p_v3", "v9": "p_v9"})


def rounded_metrics(rows: DataFrame) -> DataFrame:
    block = quality.metric_block(rows, ["model", "eval_set"], "y", "p", "doc_id")
    return block.withColumns({m: F.round(m, 6) for m in ("positive_rate", *gate.METRICS)})


def set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_once(spark, sf_dir, "set_metrics", lambda: rounded_metrics(scored_long(spark, sf_dir)))


def group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        found = quality.subgroup_metrics(scored_long(spark, sf_dir), ["model", "eval_set"], "y", "p", GROUP_COLUMNS)
        return found.withColumn("roc_auc", F.round("roc_auc", 6))

    return written_once(spark, sf_dir, "group_metrics", build)


def window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows of the serving windows, scored by every model."""
    documents = table(spark, sf_dir, "documents").count()
    _, serving = split_stream(stream(spark, sf_dir))
    rows = serving.withColumn("doc_id", F.col("event_id") % documents).join(table(spark, sf_dir, "labels"), "doc_id").select(
        "event_id", "scenario", F.col("w").cast("timestamp").alias("window_start"), "ub", F.col("toxic").cast("string").alias("toxic"), F.col("quality").alias("y"),
        F.col("score").alias("p_v1"), (F.pmod(F.col("event_id") * 37, F.lit(101)).cast("double") / 101.0).alias("p_v2"),
        (F.lit(0.8) + F.lit(0.1) * F.col("score")).alias("p_v3"), (F.lit(1.0) - F.col("score")).alias("p_v9"),
    )
    return quality.unpivot_scores(rows, {"v1": "p_v1", "v2": "p_v2", "v3": "p_v3", "v9": "p_v9"})


def window_metrics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Metrics and subgroup metrics by model and serving window; windows of one class are refused."""
    keys = ["model", "scenario", "window_start"]
    scores = written_once(spark, sf_dir, "window_scores", lambda: window_scores(spark, sf_dir))

    def measured() -> DataFrame:
        found, _ = quality.gate_metrics(scores, keys, "y", "p", "event_id")
        return found.withColumns({m: F.round(m, 6) for m in ("positive_rate", *gate.METRICS)})

    metrics = written_once(spark, sf_dir, "window_metrics", measured)
    groups = written_once(spark, sf_dir, "window_groups", lambda: quality.subgroup_metrics(scores, keys, "y", "p", ("toxic",)).withColumn("roc_auc", F.round("roc_auc", 6)))
    return metrics, groups


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Champion and challenger metrics and subgroup metrics."""
    m, g = set_metrics(spark, sf_dir), group_metrics(spark, sf_dir)
    is_champion = F.col("model") == "v1"
    return (
        m.where(is_champion).drop("model"), m.where(~is_champion).withColumnRenamed("model", "challenger"),
        g.where(is_champion).drop("model"), g.where(~is_champion).withColumnRenamed("model", "challenger"),
    )


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.gate_checks(*sides(spark, sf_dir), gate.criteria_table(spark))


# --- people and runs ------------------------------------------------------------------------
def retrain_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cards(spark, sf_dir).where(F.col("policy_version") == "policy-v2").where(F.col("action").isin(*decisions.RETRAIN_ACTIONS))
    return c.withColumn("n", window_number())


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs a team could have made: automated cards but every fifth window, and approved ones."""

    def build() -> DataFrame:
        c = retrain_cards(spark, sf_dir)
        auto = (F.col("disposition") == decisions.AUTO) & (F.col("n") % 5 != 4)
        approved = (F.col("disposition") == decisions.ESCALATE) & (F.col("n") % 4 == 0)
        due = c.where(auto | approved).withColumn("authorized_by", F.when(F.col("disposition") == decisions.ESCALATE, F.lit("ops-lead")))
        verdicts = gate.gate_verdicts(checks(spark, sf_dir))
        live = due.withColumn("challenger", F.when(F.col("n") % 2 == 0, F.lit("v3")).otherwise(F.lit("v2")))
        bad = due.where(F.col("n") % 3 == 0).withColumn("challenger", F.lit("v9"))
        parts = []
        for rows, mode, hours in ((live, "live", 6), (bad, "demo_bad", 3)):
            when = F.timestamp_seconds(F.unix_timestamp("window_end") + hours * 3600)
            row = gate.retrain_rows(rows, verdicts, join_on=["challenger"], mode=mode, champion_version=F.lit("v1"), created_at=when)
            parts.append(row.join(rows.select("card_id", "authorized_by", "n"), "card_id"))
        return union_all(parts)

    return written_once(spark, sf_dir, "retrain_runs", build)


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on escalated cards and on runs that passed."""

    def build() -> DataFrame:
        c = retrain_cards(spark, sf_dir).where(F.col("disposition") == decisions.ESCALATE).where(F.col("n") % 4 != 3)
        none = F.lit(None).cast("string")
        say = F.when(F.col("n") % 4 == 2, F.lit("REJECT")).otherwise(F.lit("APPROVE"))
        on_cards = c.select(
            gate.approval_id(F.lit("RETRAIN"), F.col("card_id")).alias("approval_id"),
            F.timestamp_seconds(F.unix_timestamp("window_end") + 3600).alias("ts"), "card_id", F.lit("RETRAIN").alias("kind"),
            F.col("card_id").alias("subject"), none.alias("run_id"), F.lit("ops-lead").alias("approver"), say.alias("decision"),
            F.lit("reviewed the drift evidence").alias("reason"), none.alias("champion_version_before"), none.alias("champion_version_after"),
        )
        r = runs(spark, sf_dir).where(F.col("outcome") == "PASS").where(F.col("n") % 3 != 2)
        verdict = F.when(F.col("n") % 3 == 0, F.lit("APPROVE")).otherwise(F.lit("REJECT"))
        on_runs = r.select(
            gate.approval_id(F.lit("PROMOTION"), F.col("run_id")).alias("approval_id"),
            F.timestamp_seconds(F.unix_timestamp("created_at") + 7200).alias("ts"), "card_id", F.lit("PROMOTION").alias("kind"),
            F.col("run_id").alias("subject"), "run_id", F.lit("ops-chief").alias("approver"), verdict.alias("decision"),
            F.lit("looked at shadow agreement").alias("reason"), F.lit("v1").alias("champion_version_before"),
            F.when(verdict == "APPROVE", F.col("challenger_version")).otherwise(F.lit("v1")).alias("champion_version_after"),
        )
        return on_cards.unionByName(on_runs)

    return written_once(spark, sf_dir, "approvals", build)


def alias_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passing run moved ``shadow``; every approved promotion moved ``champion``."""
    none = F.lit(None).cast("string")
    stamp = "yyyy-MM-dd'T'HH:mm:ss"
    r = runs(spark, sf_dir).where("shadow_alias_moved")
    shadowed = r.select(
        F.date_format("created_at", stamp).alias("timestamp_utc"), F.lit("set").alias("action"), F.lit("readmission").alias("model_name"),
        F.lit("shadow").alias("alias"), none.alias("from_version"), F.col("challenger_version").alias("to_version"), "run_id", none.alias("git_commit"),
        F.concat(F.lit("gate PASS for decision card "), F.col("card_id")).alias("reason"), F.lit("gate").alias("actor"),
    )
    a = approvals(spark, sf_dir).where("kind = 'PROMOTION' AND decision = 'APPROVE'")
    promoted = a.select(
        F.date_format("ts", stamp).alias("timestamp_utc"), F.lit("set").alias("action"), F.lit("readmission").alias("model_name"),
        F.lit("champion").alias("alias"), F.col("champion_version_before").alias("from_version"), F.col("champion_version_after").alias("to_version"),
        "run_id", none.alias("git_commit"),
        F.concat(F.lit("promotion approved (retrain run "), F.col("run_id"), F.lit("): "), F.col("reason")).alias("reason"), F.col("approver").alias("actor"),
    )
    return shadowed.unionByName(promoted).select(*[f.name for f in ALIAS_MOVE.fields])


# --- requests -------------------------------------------------------------------------------
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("rq-"), F.col("event_id").cast("string")).alias("request_id"), "ts", F.sha2("props", 256).alias("input_hash"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("caller"),
        F.concat(F.lit("v"), (F.col("user_id") % 3 + 1).cast("string")).alias("model_version"),
        (F.least(F.col("value"), F.lit(500.0)) / 500.0).alias("score"), F.lit(0.5).alias("decision_threshold"), F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("success")).alias("status"),
    )


def shadow_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models on the same documents; every fiftieth shadow score failed."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    score = F.pmod(F.col("doc_id") * 37, F.lit(101)).cast("double") / 101.0
    failed = F.col("doc_id") % 50 == 0
    return d.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("rq-"), F.col("doc_id").cast("string")).alias("request_id"), F.col("doc_id").alias("ts"),
        F.lit("v1").alias("champion_version"), F.when(F.col("lang") == "en", F.lit("v3")).otherwise(F.lit("v2")).alias("shadow_version"),
        (F.least(F.col("n_chars"), F.lit(5000)).cast("double") / 5000.0).alias("champion_score"),
        F.when(~failed, score).alias("shadow_score"), F.lit(0.5).alias("decision_threshold"),
        F.when(failed, F.lit("shadow_failed")).otherwise(F.lit("scored")).alias("status"),
    )
