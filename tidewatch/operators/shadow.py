"""Agreement of two models on the same requests, and what a promotion needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.operators.ordering import cut_points, exact_quantiles, running_totals, salted_join

PAIR = ("champion_version", "shadow_version")
MIN_REQUESTS = 50


def pair_counts(shadow: DataFrame, pair: Sequence[str] = PAIR) -> DataFrame:
    return shadow.groupBy(*pair).agg(F.count(F.lit(1)).alias("requests"))


def latest_threshold(shadow: DataFrame, pair: Sequence[str] = PAIR, default: float = 0.5) -> DataFrame:
    """The threshold of the newest request of each pair."""
    newest = F.max_by(F.col("decision_threshold"), F.struct("ts", "id"))
    return shadow.groupBy(*pair).agg(F.coalesce(newest, F.lit(default)).alias("threshold"))


def average_ranks(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, value, rank): ties share the mean of their places."""
    points = cut_points(df.select(F.col(value).cast("double").alias("v")), ["v"])["v"]
    counted = df.groupBy(*groups, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counted, groups, "v", ["n"], points=points)
    return ranked.select(*groups, F.col("v").alias(value), (F.col("n_before") + (F.col("n") + 1) / 2.0).alias("rank"))


def spearman(df: DataFrame, groups: Sequence[str], left: str, right: str) -> DataFrame:
    """Rank correlation per group, null when a side is constant or has fewer than two rows.

    Pairs of equal scores are counted first; ranks then join to distinct scores, not to rows.
    """
    pairs = df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(*groups, left, right).agg(F.count(F.lit(1)).alias("__n"))
    rows = df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(*groups, left, right)
    a = average_ranks(rows, groups, left).withColumnRenamed("rank", "__ra")
    b = average_ranks(rows, groups, right).withColumnRenamed("rank", "__rb")
    x, y, n = F.col("__ra"), F.col("__rb"), F.col("__n").cast("double")
    # Ranks are centred on their known mean, (rows + 1) / 2, to keep the sums small.
    sizes = pairs.groupBy(*groups).agg(F.sum("__n").alias("__rows"))
    joined = pairs.join(a, [*groups, left]).join(b, [*groups, right])
    joined = joined.join(sizes, list(groups)) if groups else joined.join(F.broadcast(sizes))
    mid = (F.col("__rows") + 1) / 2.0
    sums = joined.groupBy(*groups).agg(
        F.sum(n * (x - mid) * (y - mid)).alias("xy"), F.sum(n * (x - mid) * (x - mid)).alias("xx"), F.sum(n * (y - mid) * (y - mid)).alias("yy")
    )
    r = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    return sums.select(*groups, r.alias("spearman"))


def shadow_stats(shadow: DataFrame, thresholds: DataFrame | None = None, pair: Sequence[str] = PAIR) -> DataFrame:
    """One row per model pair; a failed shadow score is counted, never dropped."""
    pair = list(pair)
    limits = thresholds if thresholds is not None else latest_threshold(shadow, pair)
    both = salted_join(shadow, limits, pair)
    c, s = F.col("champion_score"), F.col("shadow_score")
    scored = s.isNotNull()
    diff = F.abs(s - c)
    yes_c, yes_s = c >= F.col("threshold"), s >= F.col("threshold")
    basic = both.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count(s).alias("scored"),
        F.count_if(~scored).alias("failed"),
        F.max("threshold").alias("decision_threshold"),
        F.avg(F.when(scored, (yes_c == yes_s).cast("double"))).alias("decision_agreement"),
        F.count_if(scored & ~yes_c & yes_s).alias("flips_to_positive"),
        F.count_if(scored & yes_c & ~yes_s).alias("flips_to_negative"),
        F.avg(diff).alias("mean_abs_diff"),
        F.max(diff).alias("max_abs_diff"),
        F.avg(F.when(scored, c)).alias("champion_mean_score"),
        F.avg(s).alias("shadow_mean_score"),
    )
    gaps = shadow.where(scored).select(*pair, diff.alias("gap"))
    p95 = exact_quantiles(gaps, pair, "gap", {"p95": 0.95}).select(*pair, F.col("quantile").alias("p95_abs_diff"))
    ranks = spearman(shadow.where(scored), pair, "champion_score", "shadow_score")
    joined = basic.join(p95, pair, "left").join(ranks, pair, "left")
    rounded = ("decision_agreement", "mean_abs_diff", "p95_abs_diff", "max_abs_diff", "spearman", "champion_mean_score", "shadow_mean_score")
    shift = F.round(F.col("shadow_mean_score") - F.col("champion_mean_score"), 6)
    return joined.withColumn("mean_shift", shift).withColumns({m: F.round(m, 6) for m in rounded})


def pair_requests(predictions: DataFrame, shadow_scores: DataFrame) -> DataFrame:
    """Champion and shadow scores side by side; a request the shadow missed keeps a null."""
    return predictions.join(shadow_scores, "request_id", "left")


def current_aliases(moves: DataFrame) -> DataFrame:
    """Where each alias points now; a deleted alias points nowhere."""
    target = F.when(F.col("action") == "delete", F.lit(None)).otherwise(F.col("to_version"))
    last = F.max_by(F.struct(target.alias("version")), F.struct("timestamp_utc", "run_id"))
    return moves.groupBy("alias").agg(last.alias("__v")).select("alias", "__v.version")


def promotion_preconditions(runs: DataFrame, aliases: DataFrame, counts: DataFrame, min_requests: int = MIN_REQUESTS) -> DataFrame:
    """The four conditions of an approval, evaluated for every run at once."""
    now = F.broadcast(  # one row
        aliases.agg(
            F.max(F.when(F.col("alias") == "champion", F.col("version"))).alias("champion_now"),
            F.max(F.when(F.col("alias") == "shadow", F.col("version"))).alias("shadow_now"),
        )
    )
    seen = counts.select(F.col("champion_version").alias("champion_now"), F.col("shadow_version").alias("challenger_version"), F.col("requests").alias("seen"))
    joined = runs.join(now).join(seen, ["champion_now", "challenger_version"], "left")

    def holds(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    checks = {
        "gate_pass": holds((F.col("outcome") == "PASS") & F.col("shadow_alias_moved")),
        "challenger_in_shadow": holds(F.col("shadow_now") == F.col("challenger_version")),
        "champion_unchanged_since_gate": holds(F.col("champion_now") == F.col("champion_version")),
        "shadow_window_complete": F.coalesce(F.col("seen"), F.lit(0)) >= min_requests,
    }
    ready = F.lit(True)
    for c in checks:
        ready = ready & F.col(c)
    return joined.withColumns(checks).withColumns({"seen": F.coalesce("seen", F.lit(0).cast("bigint")), "ready_to_approve": ready})


def promotion_evidence(runs: DataFrame, cards: DataFrame, worst: DataFrame, stats: DataFrame, aliases: DataFrame, min_requests: int = MIN_REQUESTS) -> DataFrame:
    """Card, gate, shadow window and preconditions of each run as one nested row."""
    counts = stats.select("champion_version", "shadow_version", "requests")
    checked = promotion_preconditions(runs, aliases, counts, min_requests)
    card = cards.select("card_id", F.struct("card_id", "scenario", "window_start", "policy_version", "rule_id", "action", "disposition", "confidence", "rationale").alias("card"))
    drops = worst.groupBy(F.col("challenger").alias("challenger_version")).agg(F.array_sort(F.collect_list(F.struct("eval_set", "subgroup", "auroc_drop"))).alias("worst_subgroup_auroc_drop"))
    window = stats.select(F.col("champion_version").alias("champion_now"), F.col("shadow_version").alias("challenger_version"), F.struct("*").alias("shadow_window"))
    preconditions = F.array(
        *[F.struct(F.lit(n).alias("name"), F.col(n).alias("satisfied")) for n in ("gate_pass", "challenger_in_shadow", "champion_unchanged_since_gate", "shadow_window_complete")]
    )
    gate = F.struct("run_id", "mode", "outcome", "criteria_version", "failed_criteria_count").alias("gate")
    return (
        checked.join(card, "card_id", "left").join(drops, "challenger_version", "left").join(window, ["champion_now", "challenger_version"], "left")
        .select("run_id", "card", gate, "worst_subgroup_auroc_drop", "shadow_window", preconditions.alias("preconditions"), "ready_to_approve")
    )
