"""Late labels: matured pairs become score histograms per window, from which a window's AUC and its drop come."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.sources import sinks
from tidewatch.streaming.monitor import matured_predictions
from tidewatch.streaming.state import KeyedState

BINS = 1000
HISTOGRAM = "scenario string, window_start timestamp, bin int, pos bigint, neg bigint, clock timestamp"


def score_bin(score: Column, bins: int = BINS) -> Column:
    """The place of a score between 0 and 1 in a histogram of equal bins."""
    return F.least(F.greatest(F.floor(score * F.lit(bins)), F.lit(0)), F.lit(bins - 1)).cast("int")


def histograms(pairs: DataFrame, keys: Sequence[Column | str], label: str, score: str, bins: int = BINS, more: Sequence[Column] = ()) -> DataFrame:
    """(keys, bin, pos, neg): counts that add up over batches, whatever the order the labels come in.

    ``more`` are further aggregates of the same pass.
    """
    positive = (F.col(label) == 1).cast("bigint")
    return pairs.groupBy(*keys, score_bin(F.col(score), bins).alias("bin")).agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"), *more)


def auc_of_histograms(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rows, roc_auc): scores of one bin count as tied; null where a class is absent."""
    below = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") * 0.5)  # at most one row a bin
    placed = counts.withColumn("__won", won)
    total = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return placed.groupBy(*keys).agg(F.sum(F.col("pos") + F.col("neg")).alias("rows"), F.try_divide(F.sum("__won"), total).alias("roc_auc"))


def matured_evidence(final: DataFrame, champion: DataFrame) -> DataFrame:
    """(scenario, window_start, labels_matured, matured_auroc_drop_seen, rows, roc_auc) of final histograms.

    ``champion`` has (scenario, champion_auc): what the model reached where it was accepted. A window
    whose labels are all alike has no AUC, so it counts as not matured.
    """
    seen = auc_of_histograms(final, ["scenario", "window_start"]).join(champion, "scenario", "left")
    drop = F.col("champion_auc") - F.col("roc_auc")
    return seen.select("scenario", "window_start", drop.isNotNull().alias("labels_matured"), drop.alias("matured_auroc_drop_seen"), "rows", "roc_auc")


def start_maturing(
    predictions: DataFrame, labels: DataFrame, champion: DataFrame, *, scenario: str, evidence_path: str, checkpoint: str, label: str = "y", score: str = "score",
    width: str = "1 day", delay: str = "30 days", late: str = "1 day", bins: int = BINS, trigger: Mapping | None = None,
) -> StreamingQuery:
    """Joins two streams of predictions and labels and writes the evidence of each window whose labels can all have come.

    What is carried from batch to batch is one histogram per stream and window still open, at most
    ``bins`` rows each; a window leaves when the labels' time has passed its end by ``delay`` and ``late``.
    A batch is read once, into the histograms it leads to: each read would join the streams, and write
    the join's state, again.
    """
    pairs = matured_predictions(predictions, labels, delay=delay, late=late)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state, seen = (KeyedState(spark, f"{evidence_path}-{name}", HISTOGRAM) for name in ("open", "seen"))
        window = F.window("ts", width)
        keys = [F.col(scenario).alias("scenario"), window["start"].alias("window_start")]
        new = histograms(batch, keys, label, score, bins, [F.max("label_ts").alias("clock")])
        counts = new.unionByName(state.before(batch_id)).groupBy("scenario", "window_start", "bin")
        seen.store(counts.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("clock").alias("clock")), batch_id)
        merged = seen.before(batch_id + 1)
        clock = F.broadcast(merged.agg(F.max("clock").alias("now")))
        aged = merged.join(clock).withColumn("final", F.expr(f"window_start + INTERVAL {width} + INTERVAL {delay} + INTERVAL {late} <= now"))
        sinks.write_batch(matured_evidence(aged.where("final"), champion), evidence_path, batch_id)
        state.store(aged.where("NOT final").withColumn("clock", F.col("now")), batch_id)

    writer = pairs.writeStream.outputMode("append").foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
