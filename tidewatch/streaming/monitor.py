"""The monitor as Structured Streaming: count, close, measure, decide, append.

A query keeps only bin counts (and sketches) per (window, feature, bin) in its state. When the
watermark passes a window its counts leave the state in append mode and the batch sink turns them
into drift rows and decisions. Each batch writes folders of its own, so a batch repeated after a
failure adds nothing, and what it needs of earlier batches is carried in small keyed tables: no
batch reads the history.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidewatch.functions.numbers import digest_id
from tidewatch.operators import decisions
from tidewatch.operators.drift import CATEGORICAL, KS_P_VALUE, NUMERIC, PREDICTION_PSI, PSI_BREACH, PSI_SEVERE, psi_from_counts
from tidewatch.operators.ordering import assign_buckets
from tidewatch.sources import sinks
from tidewatch.streaming import sketches
from tidewatch.streaming.state import KeyedState
from tidewatch.streaming.windows import with_quiet_windows

STREAM = "scenario"
ROWS = "__rows"  # the pseudo-feature whose one bin counts all rows of a window
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSING = 1 << 40  # the batch folder of windows closed by hand, after all others


def to_bins(df: DataFrame, keep: Sequence[Column | str], cuts: Mapping[str, Sequence[float]], categorical: Sequence[str]) -> DataFrame:
    """Long (keep, feature, bin, value) rows with cut points fixed by the reference, and one per row for ROWS."""
    plan = {c: (f"__bin_{c}", points) for c, points in cuts.items()}
    wide = assign_buckets(df.withColumns({c: F.col(c).cast("double") for c in cuts}) if cuts else df, plan)
    none = F.lit(None).cast("double").alias("value")
    pairs = [
        F.struct(F.lit(ROWS).alias("feature"), F.lit("all").alias("bin"), none),
        *[F.struct(F.lit(c).alias("feature"), F.col(f"__bin_{c}").cast("string").alias("bin"), F.col(c).alias("value")) for c in cuts],
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("bin"), none) for c in categorical],
    ]
    return wide.select(*keep, F.inline(F.array(*pairs))).where("bin IS NOT NULL")


def reference_bins(reference: DataFrame, cuts: Mapping[str, Sequence[float]], categorical: Sequence[str]) -> DataFrame:
    return to_bins(reference, [], cuts, categorical).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n_ref"))


def _stream_of(df: DataFrame, scenario: str | None) -> Column:
    return (F.lit("stream") if scenario is None else F.col(scenario)).alias(STREAM)


def windowed_bins(
    stream: DataFrame, ts: str, cuts: Mapping[str, Sequence[float]], categorical: Sequence[str], *,
    scenario: str | None = None, width: str = "1 day", late: str = "1 hour", quiet: bool = False, sketch_k: int | None = None,
) -> DataFrame:
    """Bin counts per stream and event-time window, of a stream or of a batch frame.

    ``scenario`` names the column that tells the monitored streams apart; without it all rows
    are one stream. With ``quiet`` a window without rows has its one row too, that of ROWS with
    a count of 0; with ``sketch_k`` each bin of a number keeps a quantile sketch of its values.
    """
    marked = stream.withWatermark(ts, late) if stream.isStreaming else stream
    named = marked.withColumn("__stream", _stream_of(marked, scenario))
    long = to_bins(named, [F.col("__stream"), F.window(ts, width).alias("window"), ts], cuts, categorical)
    measures = [F.count(F.lit(1)).alias("n_cur")]
    if sketch_k is not None:
        measures.append(sketches.of_values(F.col("value"), sketch_k).alias("sketch"))
    counted = long.groupBy("__stream", F.col("window"), "feature", "bin").agg(*measures)
    names = [c for c in counted.columns if c not in ("__stream", "window", "feature", "bin")]
    if quiet:
        counted = with_quiet_windows(counted, "__stream", {"feature": ROWS, "bin": "all", "n_cur": 0})
    return counted.select(F.col("__stream").alias(STREAM), F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "feature", "bin", *names)


def psi_of_bins(counts: DataFrame, reference: DataFrame) -> DataFrame:
    """(scenario, window_start, window_end, feature, psi, ref_rows, current_rows) of closed windows' bin counts."""
    psi = psi_from_counts(reference, counts, [STREAM, "window_start", "window_end"])
    return psi.select(STREAM, "window_start", "window_end", "feature", "psi", "ref_rows", F.col("cur_rows").alias("current_rows"))


def measured_rows(
    psi: DataFrame, *, score: str | None = None, categorical: Sequence[str] = (), run_id: str = "stream", model_version: str | None = None, data_version: str | None = None,
) -> DataFrame:
    """One drift event per stream and closed window, in the columns the decision step reads.

    ``score`` names the feature that holds the model's score; it is measured apart from the others.
    """
    is_score = F.col("feature") == F.lit(score) if score else F.lit(False)
    is_feature = ~is_score & (F.col("feature") != ROWS)
    ks_p = F.col("ks_p_value") if "ks_p_value" in psi.columns else F.lit(None).cast("double")
    kind = F.when(F.col("feature").isin(*categorical), F.lit(CATEGORICAL)).otherwise(F.lit(NUMERIC)) if categorical else F.lit(NUMERIC)
    stat = F.when(
        is_feature,
        F.struct("feature", kind.alias("kind"), "psi", ks_p.alias("ks_p_value"), (F.col("psi") >= PSI_BREACH).alias("breaching"), (F.col("psi") >= PSI_SEVERE).alias("severe")),
    )
    whole = F.col("feature") == ROWS
    rows = psi.groupBy(STREAM, "window_start", "window_end").agg(
        F.array_sort(F.collect_list(stat)).alias("feature_stats"),  # one per monitored feature
        F.max(F.when(is_score, F.col("psi"))).alias("prediction_psi"), F.max(F.when(is_feature, F.col("psi"))).alias("max_psi"),
        F.count_if(is_feature & (F.col("psi") >= PSI_BREACH)).alias("breaching_feature_count"),
        F.max(F.when(whole, F.col("ref_rows"))).alias("reference_rows"), F.max(F.when(whole, F.col("current_rows"))).alias("current_rows"),
    )
    day = F.date_format("window_start", "yyyyMMdd")
    identity = F.concat_ws("|", F.lit(run_id), F.col(STREAM), F.col("window_start").cast("string"))
    text = lambda value: F.lit(value).cast("string")
    return rows.select(
        digest_id("de", F.concat(F.lower(F.col(STREAM)), F.lit("-d"), day), identity).alias("event_id"), F.col("window_end").cast("timestamp").alias("created_at"),
        "window_start", "window_end", STREAM, "feature_stats", F.coalesce(F.col("prediction_psi") >= PREDICTION_PSI, F.lit(False)).alias("prediction_drift"), "prediction_psi", "max_psi",
        "breaching_feature_count", "reference_rows", "current_rows", text(None).alias("report_uri"), text(model_version).alias("model_version"), text(data_version).alias("data_version"),
        F.struct(
            F.lit(PSI_BREACH).alias("psi_breach"), F.lit(PSI_SEVERE).alias("psi_severe"), F.lit(KS_P_VALUE).alias("ks_p_value"),
            F.lit(PREDICTION_PSI).alias("prediction_psi"), F.size("feature_stats").alias("monitored_features"),
        ).alias("policy_thresholds"),
    )


def measured_batch(
    counts: DataFrame, reference: DataFrame, *, score: str | None = None, categorical: Sequence[str] = (), grid: DataFrame | None = None
) -> DataFrame:
    """Drift events of bin counts; with the reference's ``grid`` of values also Kolmogorov-Smirnov, from the bins' sketches."""
    psi = psi_of_bins(counts, reference)
    if grid is not None:
        keys = [STREAM, "window_start", "window_end"]
        psi = psi.join(sketches.ks_of_bins(counts, grid, keys).select(*keys, "feature", "ks_p_value"), [*keys, "feature"], "left")
    return measured_rows(psi, score=score, categorical=categorical)


def start_monitor(
    stream: DataFrame, reference: DataFrame, ts: str, cuts: Mapping[str, Sequence[float]], categorical: Sequence[str], *,
    events_path: str, checkpoint: str, scenario: str | None = None, score: str | None = None, late: str = "1 hour", width: str = "1 day",
    quiet: bool = False, grid: DataFrame | None = None, sketch_k: int | None = None, policies: DataFrame | None = None,
    decide: Callable[[DataFrame], DataFrame] | None = None, cards_path: str | None = None, trigger: Mapping | None = None,
) -> StreamingQuery:
    """Starts the monitor. Measurements are written before decisions, and survive one that fails.

    ``reference`` is a stored table of reference bin counts. Under ``policies`` the windows of a
    batch are decided with the streaks earlier batches left, so a batch costs what its own windows
    cost. ``decide`` instead turns all events on record into cards, for deciders of another kind.
    A second start from the same checkpoint goes on where the first stopped.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, batch = batch.sparkSession, batch.persist()
        rows = measured_batch(batch, reference, score=score, categorical=categorical, grid=grid)
        sinks.write_batch(_unless_closed(rows, events_path), events_path, batch_id)
        if cards_path is not None and policies is not None:
            advance_cards(spark.read.schema(rows.schema).parquet(f"{events_path}/batch_id={batch_id}"), policies, cards_path, batch_id)
        elif cards_path is not None and decide is not None:
            append_cards(spark.read.schema(rows.schema).parquet(events_path), batch, decide, cards_path)
        batch.unpersist()

    counts = windowed_bins(stream, ts, cuts, categorical, scenario=scenario, late=late, width=width, quiet=quiet, sketch_k=sketch_k)
    writer = counts.writeStream.outputMode("append").foreachBatch(handle).option("checkpointLocation", checkpoint)
    return start_stateful(writer.trigger(**(trigger or {"availableNow": True})), stream.sparkSession)


def start_stateful(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Starts a query with the state store that processors with timers need; the session's own setting stays."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        return writer.start()
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def _unless_closed(rows: DataFrame, events_path: str) -> DataFrame:
    """Rows of windows that were not closed by hand: at most one window a stream was."""
    closed = sinks.stored(rows.sparkSession, f"{events_path}/batch_id={CLOSING}", rows)
    return rows.join(closed.select(*sinks.EVENT_KEY), list(sinks.EVENT_KEY), "left_anti")


def advance_cards(events: DataFrame, policies: DataFrame, cards_path: str, batch_id: int) -> None:
    """Writes the cards of a batch's events and the streaks the next batch goes on from.

    What is read: the events given, the policies, and one row per policy, stream and feature.
    """
    streaks = KeyedState(events.sparkSession, f"{cards_path}-streaks", decisions.STREAKS)
    carried = streaks.before(batch_id)
    sinks.write_batch(decisions.decide(events, policies, carried=carried), cards_path, batch_id)
    streaks.store(decisions.streaks_after(events, policies, carried), batch_id)


def append_cards(events: DataFrame, windows: DataFrame, decide: Callable[[DataFrame], DataFrame], cards_path: str) -> None:
    """Decides with all events as history and appends the cards of ``windows``, once per event and policy."""
    due = events.join(windows.select(*sinks.EVENT_KEY).distinct(), list(sinks.EVENT_KEY), "left_semi")
    cards = decide(events).join(due.select(F.col("event_id").alias("drift_event_id")), "drift_event_id", "left_semi")
    sinks.append_once(cards, cards_path, sinks.CARD_KEY)


def close_open_windows(
    rows: DataFrame, reference: DataFrame, ts: str, cuts: Mapping[str, Sequence[float]], categorical: Sequence[str], *, events_path: str,
    scenario: str | None = None, score: str | None = None, width: str = "1 day", grid: DataFrame | None = None, sketch_k: int | None = None,
    policies: DataFrame | None = None, decide: Callable[[DataFrame], DataFrame] | None = None, cards_path: str | None = None,
) -> None:
    """Measures (and decides), in batch, the windows the watermark has not passed when a stream is ended.

    They are written as a batch after all others; done again, it replaces itself.
    """
    counts = windowed_bins(rows, ts, cuts, categorical, scenario=scenario, width=width, sketch_k=sketch_k)
    done = rows.sparkSession.read.parquet(events_path).where(F.col("batch_id") != CLOSING)
    still_open = counts.join(done.select(*sinks.EVENT_KEY).distinct(), list(sinks.EVENT_KEY), "left_anti")
    measured = measured_batch(still_open, reference, score=score, categorical=categorical, grid=grid)
    sinks.write_batch(measured, events_path, CLOSING)
    if cards_path is not None and policies is not None:
        advance_cards(rows.sparkSession.read.schema(measured.schema).parquet(f"{events_path}/batch_id={CLOSING}"), policies, cards_path, CLOSING)
    elif cards_path is not None and decide is not None:
        events = rows.sparkSession.read.schema(measured.schema).parquet(events_path)
        append_cards(events, events, decide, cards_path)  # cards on record stay as they are


def start_scoring(
    requests: DataFrame, score: Callable[[DataFrame], DataFrame], shadow: Callable[[DataFrame], DataFrame], *, audit_path: str, shadow_path: str, checkpoint: str,
    trigger: Mapping | None = None,
) -> StreamingQuery:
    """Scores each request with two models; a request the shadow fails on stays as a row.

    The audit rows are written first: a shadow that fails never costs a served prediction.
    ``score`` and ``shadow`` add a nullable ``score`` column to the request frame.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        served = score(batch).withColumn("status", F.when(F.col("score").isNull(), F.lit("error")).otherwise(F.lit("success")))
        sinks.write_batch(served, audit_path, batch_id)
        doubled = shadow(batch).withColumn("status", F.when(F.col("score").isNull(), F.lit("shadow_failed")).otherwise(F.lit("scored")))
        sinks.write_batch(doubled, shadow_path, batch_id)
        batch.unpersist()

    writer = requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def matured_predictions(predictions: DataFrame, labels: DataFrame, *, delay: str = "30 days", late: str = "1 day") -> DataFrame:
    """Predictions joined to labels that arrive up to ``delay`` later.

    Both frames carry ``request_id``; predictions have ``ts`` and labels ``label_ts``. State is
    dropped once the watermark passes the delay.
    """
    p, l = predictions, labels
    if predictions.isStreaming:
        p, l = p.withWatermark("ts", late), l.withWatermark("label_ts", late)
    l = l.withColumnRenamed("request_id", "label_request_id")
    in_time = F.expr(f"label_request_id = request_id AND label_ts >= ts AND label_ts <= ts + INTERVAL {delay}")
    return p.join(l, in_time, "inner").drop("label_request_id")
