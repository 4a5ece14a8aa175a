"""Perturb, measure, decide, summarise: how a monitor and a policy behave on known changes."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.operators.decisions import NO_OP
from tidewatch.operators.ordering import union_all


def perturbed_streams(stream: DataFrame, perturbations: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """All perturbed copies of a stream as one frame, tagged ``scenario``."""
    return union_all([change(stream).withColumn("scenario", F.lit(name)) for name, change in perturbations.items()])


def acting() -> Column:
    return F.col("action") != NO_OP


def summarise(decisions: DataFrame, keys: tuple[str, ...] = ("policy_version", "scenario")) -> DataFrame:
    """Rates, ranges and detection latency per policy and scenario.

    ``decisions`` has window_index, breaching_features, prediction_drift, action, disposition,
    confidence and, where gated, gate_retrained and gate_bad.
    """
    seen = (F.col("breaching_features") > 0) | F.col("prediction_drift")
    return decisions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows"),
        F.round(F.avg(seen.cast("double")), 4).alias("monitor_breach_rate"),
        F.round(F.avg(acting().cast("double")), 4).alias("acting_card_rate"),
        F.min(F.when(acting(), F.col("window_index"))).alias("detection_latency_windows"),
        F.array_join(F.array_sort(F.collect_set("action")), ",").alias("actions"),
        F.array_join(F.array_sort(F.collect_set("disposition")), ",").alias("dispositions"),
        F.round(F.min("confidence"), 4).alias("confidence_min"),
        F.round(F.max("confidence"), 4).alias("confidence_max"),
        F.count("gate_retrained").alias("gated_cards"),
        F.count_if(F.col("gate_retrained") == "PASS").alias("retrained_pass"),
        F.count_if(F.col("gate_retrained") == "BLOCK").alias("retrained_block"),
        F.count_if(F.col("gate_bad") == "BLOCK").alias("bad_challenger_block"),
    )


def false_trigger_rate(decisions: DataFrame, control: str, keys: tuple[str, ...] = ("policy_version",)) -> DataFrame:
    """Share of control windows whose card acts."""
    return decisions.where(F.col("scenario") == control).groupBy(*keys).agg(F.round(F.coalesce(F.avg(acting().cast("double")), F.lit(0.0)), 4).alias("false_trigger_rate"))
