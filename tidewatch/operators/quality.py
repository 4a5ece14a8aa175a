"""Model quality over tables of (keys, label, score): one plan for all models, sets and groups.

Rank metrics count rows per distinct score first and then take bucketed running totals over
the scores, so neither tied scores nor a large model or set ends up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.numbers import clipped_log_loss, right_closed_bin, safe_ratio
from tidewatch.operators.ordering import (
    BUCKET,
    assign_buckets,
    by_group_size,
    cut_points,
    exact_quantiles,
    running_totals,
    salted_join,
    sort_key,
    totals_of_small_groups,
    union_all,
)

# Standard settings of the metric report.
TOP_FRACTION, BINS, DEFAULT_THRESHOLD = 0.10, 10, 0.5
HEADLINE = ("roc_auc", "recall_at_top_decile", "brier_score", "expected_calibration_error")


def score_counts(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """(keys, score, pos, neg, n) per distinct score."""
    positive = (F.col(label) == 1).cast("bigint")
    return df.groupBy(*keys, F.col(score).cast("double").alias("p")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"), F.count(F.lit(1)).alias("n")
    )


def ranked_scores(df: DataFrame, keys: Sequence[str], label: str, score: str, small: bool = False) -> DataFrame:
    """Distinct scores with the label counts below, up to and over all of their group; a missing score ranks lowest.

    ``small`` groups are shuffled once, whole: the counts and their running totals stay where they are.
    """
    if small:
        return totals_of_small_groups(score_counts(df.repartition(*keys), keys, label, score), keys, "p", ["pos", "neg", "n"])
    points = cut_points(df.select(F.col(score).cast("double").alias("p")), ["p"])["p"]
    return running_totals(score_counts(df, keys, label, score), keys, "p", ["pos", "neg", "n"], points=points)


def ranking_metrics(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """(keys, rows, positives, roc_auc, average_precision); null where one class is absent."""
    return _measured(df, keys, label, score, TOP_FRACTION).select(*keys, "rows", "positives", "roc_auc", "average_precision")


def _measured(df: DataFrame, keys: Sequence[str], label: str, score: str, fraction: float, tie: str | None = None) -> DataFrame:
    """The summary of every group's order, with the top fraction's recall where ``tie`` is given."""
    parts = []
    for rows, small in by_group_size(df, keys):
        summary = _rank_summary(ranked_scores(rows, keys, label, score, small), keys, fraction)
        parts.append(summary if tie is None else _with_recall(rows, summary, keys, label, score, tie, small))
    return union_all(parts)


def _rank_summary(ranked: DataFrame, keys: Sequence[str], fraction: float) -> DataFrame:
    """Everything read off the ordered scores, in one pass.

    ``sure`` counts the positives of scores wholly inside the top fraction; ``cut`` is the one
    score the fraction's end falls into, with the number of rows to take from it.
    """
    won = F.col("pos") * (F.col("neg_before") + F.col("neg") * 0.5)
    # From the top down: everything at this score or above is called positive.
    hits = (F.col("pos_total") - F.col("pos_before")).cast("double")
    called = (F.col("n_total") - F.col("n_before")).cast("double")
    above = F.col("n_total") - F.col("n_upto")
    k = _top_count(F.col("n_total"), fraction)
    split = (above < k) & (above + F.col("n") > k)
    return ranked.groupBy(*keys).agg(
        F.max("n_total").alias("rows"),
        F.max("pos_total").alias("positives"),
        F.try_divide(F.sum(won.cast("double")), F.max("pos_total").cast("double") * F.max("neg_total").cast("double")).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * hits / called), F.max("pos_total").cast("double")).alias("average_precision"),
        F.max(k).alias("top_rows"),
        F.sum(F.when(above + F.col("n") <= k, F.col("pos")).otherwise(0)).alias("sure"),
        F.max(F.when(split, F.struct("p", (k - above).alias("take")))).alias("cut"),
    )


def _top_count(n: Column, fraction: float) -> Column:
    return F.greatest(F.lit(1), F.bround(n.cast("double") * F.lit(float(fraction))).cast("bigint"))


def recall_top_fraction(df: DataFrame, keys: Sequence[str], label: str, score: str, tie: str, fraction: float = TOP_FRACTION) -> DataFrame:
    """Share of all positives among the top fraction by score, ties in ``tie`` order."""
    return _measured(df, keys, label, score, fraction, tie).select(*keys, "top_rows", "top_positives", "recall_at_top_decile")


def _with_recall(df: DataFrame, summary: DataFrame, keys: Sequence[str], label: str, score: str, tie: str, small: bool = False) -> DataFrame:
    """Whole scores above the cut are counted; of the score the cut falls into, only one bucket
    of tie keys is ranked. Its other tied rows are counted per bucket in the map tasks."""
    keys = list(keys)
    cut = summary.where("cut IS NOT NULL").select(*keys, "cut.p", "cut.take")
    part = _tied_of_small(df, cut, keys, label, score, tie) if small else _tied(df, cut, keys, label, score, tie)
    joined = summary.join(part, list(keys), "left") if keys else summary.join(F.broadcast(part), how="left")
    found = F.col("sure") + F.coalesce("part", F.lit(0))
    return joined.withColumns({"top_positives": found, "recall_at_top_decile": safe_ratio(found, "positives")})


def _tied_of_small(df: DataFrame, cut: DataFrame, keys: list[str], label: str, score: str, tie: str) -> DataFrame:
    """(keys, part): positives among the first ``take`` rows of the cut's score, in groups that one task can order."""
    rows = df.select(*keys, F.col(score).cast("double").alias("p"), F.col(tie).alias("__tie"), (F.col(label) == 1).cast("bigint").alias("pos"))
    ranked = rows.join(cut, [*keys, "p"]).withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy("__tie")))
    return ranked.where(F.col("__row") <= F.col("take")).groupBy(*keys).agg(F.sum("pos").alias("part"))


def _tied(df: DataFrame, cut: DataFrame, keys: list[str], label: str, score: str, tie: str) -> DataFrame:
    """As ``_tied_of_small`` for groups of any size."""
    rows = df.select(*keys, F.col(score).cast("double").alias("p"), sort_key(df, tie).alias("__t"), F.col(tie).alias("__tie"), (F.col(label) == 1).cast("bigint").alias("pos"))
    rows = assign_buckets(rows, {"__t": (BUCKET, cut_points(rows.select("__t"), ["__t"])["__t"])})
    tied = salted_join(rows, cut, [*keys, "p"])
    parts = tied.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos"), F.max("take").alias("take"))
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    whole = placed.where(F.col("before") + F.col("n") <= F.col("take")).select(*keys, "pos")
    edge = placed.where((F.col("before") < F.col("take")) & (F.col("before") + F.col("n") > F.col("take")))
    edge = edge.select(*keys, BUCKET, (F.col("take") - F.col("before")).alias("left"))
    ranked = tied.drop("take").join(edge, [*keys, BUCKET]).withColumn("__row", F.row_number().over(Window.partitionBy(*keys, BUCKET).orderBy("__tie")))
    last = ranked.where(F.col("__row") <= F.col("left")).select(*keys, "pos")
    return whole.unionByName(last).groupBy(*keys).agg(F.sum("pos").alias("part"))


def pointwise_metrics(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    y, p = F.col(label).cast("double"), F.col(score).cast("double")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(y).alias("positive_rate"),
        F.avg((p - y) * (p - y)).alias("brier_score"),
        F.avg(clipped_log_loss(label, p)).alias("log_loss"),
    )


def calibration_bins(df: DataFrame, keys: Sequence[str], label: str, score: str, bins: int = BINS) -> DataFrame:
    p = F.col(score).cast("double")
    return df.groupBy(*keys, right_closed_bin(p, bins).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg(p).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("observed_rate")
    )


def calibration_error(df: DataFrame, keys: Sequence[str], label: str, score: str, bins: int = BINS) -> DataFrame:
    """Expected calibration error over equal right-closed bins."""
    binned = calibration_bins(df, keys, label, score, bins)
    gap = F.abs(F.col("observed_rate") - F.col("mean_predicted")) * F.col("count")
    return binned.groupBy(*keys).agg((F.sum(gap) / F.sum("count")).alias("expected_calibration_error"))


def reliability_table(df: DataFrame, keys: Sequence[str], label: str, score: str, bins: int = BINS) -> DataFrame:
    """Every bin of every key; an empty bin has count 0 and null rates."""
    binned = calibration_bins(df, keys, label, score, bins)
    edge = F.array(*[F.struct(F.lit(b).alias("bin"), F.lit(b / bins).alias("bin_lower"), F.lit((b + 1) / bins).alias("bin_upper")) for b in range(bins)])
    spine = binned.select(*keys).distinct() if keys else binned.agg(F.count(F.lit(1)).alias("__any")).drop("__any")
    spine = spine.select(*keys, F.inline(edge))
    return spine.join(binned, [*keys, "bin"], "left").na.fill({"count": 0})


def confusion_counts(df: DataFrame, keys: Sequence[str], label: str, score: str, threshold: Column | float) -> DataFrame:
    """Counts and rates at a threshold (reached means positive); undefined rates are 0."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    called, true = F.col(score) >= t, F.col(label) == 1
    out = df.groupBy(*keys).agg(
        F.max(t).alias("threshold"),
        F.count_if(~called & ~true).alias("true_negatives"),
        F.count_if(called & ~true).alias("false_positives"),
        F.count_if(~called & true).alias("false_negatives"),
        F.count_if(called & true).alias("true_positives"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives", "true_negatives"))
    return out.withColumns(
        {
            "predicted_positive_rate": safe_ratio(tp + fp, tp + fp + fn + tn, 0.0),
            "precision": safe_ratio(tp, tp + fp, 0.0),
            "recall": safe_ratio(tp, tp + fn, 0.0),
        }
    )


def top_fraction_cut(df: DataFrame, keys: Sequence[str], score: str, fraction: float = TOP_FRACTION) -> DataFrame:
    """The score that flags the top fraction: the exact interpolated quantile."""
    points = cut_points(df.select(F.col(score).cast("double").alias("p")), ["p"])["p"]
    cut = exact_quantiles(df, keys, score, {"cut": 1.0 - fraction}, points=points)
    return cut.select(*keys, F.col("quantile").alias("threshold"))


def confusion_at_top_fraction(df: DataFrame, keys: Sequence[str], label: str, score: str, fraction: float = TOP_FRACTION) -> DataFrame:
    cut = top_fraction_cut(df, keys, score, fraction).withColumnRenamed("threshold", "__cut")
    joined = salted_join(df, cut, list(keys)) if keys else df.join(F.broadcast(cut))
    return confusion_counts(joined, keys, label, score, F.col("__cut"))


def subgroup_metrics(df: DataFrame, keys: Sequence[str], label: str, score: str, columns: Sequence[str]) -> DataFrame:
    """Rows, positive rate and AUC per value of each column, all columns in one pass.

    A null value is the group ``nan``; a group with one class has a null AUC.
    """
    groups = F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("group_value")) for c in columns])
    long = df.select(*keys, F.col(label).alias("y"), F.col(score).alias("p"), F.inline(groups))
    by = [*keys, "column_name", "group_value"]
    return ranking_metrics(long, by, "y", "p").select(
        *by, F.col("rows").alias("count"), safe_ratio("positives", "rows").alias("positive_rate"), "roc_auc"
    )


def metric_block(df: DataFrame, keys: Sequence[str], label: str, score: str, tie: str) -> DataFrame:
    """The full metric block, one row per key; rank metrics share one ordering."""
    parts = [
        pointwise_metrics(df, keys, label, score),
        calibration_error(df, keys, label, score),
        _measured(df, keys, label, score, TOP_FRACTION, tie).select(*keys, "roc_auc", "average_precision", "recall_at_top_decile"),
    ]
    return reduce(lambda a, b: a.join(b, list(keys)), parts)


def unpivot_scores(df: DataFrame, scores: dict[str, str], name: str = "model", out: str = "p") -> DataFrame:
    """One row per model and row, so two models are measured in one pass."""
    pairs = F.array(*[F.struct(F.lit(m).alias(name), F.col(c).cast("double").alias(out)) for m, c in scores.items()])
    return df.select(*[c for c in df.columns if c not in scores.values()], F.inline(pairs))


def metric_long(block: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return block.select(*keys, F.inline(pairs))


def metric_deltas(block: DataFrame, keys: Sequence[str], model: str, base: str, other: str, metrics: Sequence[str]) -> DataFrame:
    """(keys, metric, base, other, delta): two models side by side."""
    long = metric_long(block, [*keys, model], metrics)
    wide = long.groupBy(*keys, "metric").agg(
        F.max(F.when(F.col(model) == base, F.col("value"))).alias(base), F.max(F.when(F.col(model) == other, F.col("value"))).alias(other)
    )
    return wide.withColumn("delta", F.round(F.col(other) - F.col(base), 6))


def gate_metrics(df: DataFrame, keys: Sequence[str], label: str, score: str, tie: str) -> tuple[DataFrame, DataFrame]:
    """(usable metric rows, refused keys with a reason): unlabelled, one-class or partly unscored sets are refused."""
    labelled = df.where(F.col(label).isNotNull())
    known = F.col(label).isNotNull()
    unscored = F.col(score).isNull() | F.isnan(F.col(score).cast("double"))
    classes = df.groupBy(*keys).agg(
        F.count(F.col(label)).alias("labels"), F.count_distinct(F.col(label)).alias("classes"), F.count_if(known & unscored).alias("unscored")
    )
    reason = F.when(F.col("labels") == 0, F.lit("unlabelled")).when(F.col("classes") < 2, F.lit("single class")).when(F.col("unscored") > 0, F.lit("unscored rows"))
    refused = classes.select(*keys, reason.alias("reason")).where("reason is not null")
    good = labelled.join(refused.select(*keys), list(keys), "left_anti")
    return metric_block(good, keys, label, score, tie), refused


def evaluation_sets(frames: dict[str, DataFrame], name: str = "eval_set") -> DataFrame:
    return union_all([df.withColumn(name, F.lit(n)) for n, df in frames.items()])


def flatten_metrics(df: DataFrame, keys: Sequence[str], blocks: dict[str, Sequence[str]]) -> DataFrame:
    """``prefix_name`` rows of the numeric fields, names made safe for a metric store."""
    from tidewatch.functions.text import metric_name

    kinds = dict(df.dtypes)
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    pairs = [
        F.struct(metric_name(F.lit(f"{prefix}_{c}")).alias("metric_name"), F.col(c).cast("double").alias("value"))
        for prefix, columns in blocks.items()
        for c in columns
        if kinds.get(c) in numeric
    ]
    return df.select(*keys, F.inline(F.array(*pairs)))
