"""Windows a stream's rows do not make by themselves: those without rows, and those of a number of rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewatch.operators.ordering import positions
from tidewatch.sources import sinks
from tidewatch.streaming.state import KeyedState


class _QuietWindows(StatefulProcessor):
    """Hands on the rows of closed windows and adds one row for each window between and after them that has none.

    The state of a stream is the end and the width of its last window. A timer at the end of the next
    one fires when the watermark passes it; by then rows it may have had have come in.
    """

    def __init__(self, columns: Sequence[str], fill: Mapping[str, object]) -> None:
        self.columns, self.fill = list(columns), dict(fill)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ends long, width long")

    def _quiet(self, key: tuple, starts: Sequence[int], width: int) -> pd.DataFrame:
        rows = pd.DataFrame({c: [self.fill.get(c)] * len(starts) for c in self.columns})
        rows["key"], rows["starts"], rows["ends"] = key[0], list(starts), [s + width for s in starts]
        return rows[["key", "starts", "ends", *self.columns]]

    def _wait(self, ends: int, width: int) -> None:
        self.last.update((ends, width))
        self.handle.registerTimer((ends + width) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows))
        yield given[["key", "starts", "ends", *self.columns]]
        starts = sorted(set(given["starts"].astype("int64")))
        width = int(given["ends"].iloc[0] - given["starts"].iloc[0])
        ends = int(self.last.get()[0]) if self.last.exists() else starts[0]
        missing = []
        for s in starts:
            missing += range(ends, s, width)
            ends = max(ends, s + width)
        if missing:
            yield self._quiet(key, missing, width)
        self._wait(ends, width)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ends, width = (int(x) for x in self.last.get())
        upto = int(timerValues.getCurrentWatermarkInMs()) * 1000
        missing = range(ends, upto - width + 1, width)
        if len(missing):
            yield self._quiet(key, missing, width)
            self._wait(ends + width * len(missing), width)

    def close(self) -> None:
        pass


def with_quiet_windows(counted: DataFrame, stream: str, fill: Mapping[str, object]) -> DataFrame:
    """Closed windows' rows (stream, window, ...) and one row of ``fill`` for each window of a stream that has none.

    On a stream these are the windows from a stream's first one up to the watermark; of a batch
    frame those up to the stream's last one. Only what windows add up to passes through the state of
    a stream, never its rows, so a stream that holds most rows is no heavier than another.
    """
    columns = [c for c in counted.columns if c not in (stream, "window")]
    if not counted.isStreaming:
        spans = counted.groupBy(stream).agg(F.min("window.start").alias("a"), F.max("window.start").alias("b"), F.first(F.unix_micros("window.end") - F.unix_micros("window.start")).alias("w"))
        every = spans.select(stream, "w", F.explode(F.sequence(F.unix_micros("a"), F.unix_micros("b"), F.col("w"))).alias("s"))
        window = F.struct(F.timestamp_micros("s").alias("start"), F.timestamp_micros(F.col("s") + F.col("w")).alias("end")).alias("window")
        quiet = every.select(stream, window).join(counted.select(stream, "window").distinct(), [stream, "window"], "left_anti")
        return counted.unionByName(quiet.withColumns({c: F.lit(fill.get(c)).cast(counted.schema[c].dataType) for c in columns}))
    plain = counted.select(
        F.col(stream).alias("key"), F.unix_micros("window.start").alias("starts"), F.unix_micros("window.end").alias("ends"), *columns,
        F.window_time("window").alias("__at"),  # carries the watermark on
    )
    kinds = ", ".join(f"`{c}` {counted.schema[c].dataType.simpleString()}" for c in columns)
    found = plain.groupBy("key").transformWithStateInPandas(
        _QuietWindows(columns, fill), f"key {counted.schema[stream].dataType.simpleString()}, starts bigint, ends bigint, {kinds}", "append", "eventtime"
    )
    window = F.struct(F.timestamp_micros("starts").alias("start"), F.timestamp_micros("ends").alias("end"))
    return found.select(F.col("key").alias(stream), window.alias("window"), *columns)


def start_row_windows(
    stream: DataFrame, ts: str, tie: str, rows: int, *, group: str, path: str, checkpoint: str, late: str = "1 hour", span: str = "1 hour", parts: int = 16,
    out: str = "window_index", trigger: Mapping | None = None,
) -> StreamingQuery:
    """Windows of ``rows`` rows each, in the order of (ts, tie), per group: the batch form's windows, as the watermark passes.

    Rows wait in the state by span of time, spread over ``parts`` by the hash of their tie key, until
    no earlier row can come; so a group that holds most rows, or a moment that does, is spread too.
    Rows that leave are placed within their batch by a distributed numbering and after all earlier
    ones by the count their group has reached, one number a group, carried from batch to batch.
    """
    marked = stream.withWatermark(ts, late)
    held = marked.select(group, F.window(ts, span).alias("window"), F.pmod(F.xxhash64(tie), F.lit(parts)).alias("part"), F.struct(*stream.columns).alias("row"))
    closed = held.groupBy(group, "window", "part").agg(F.collect_list("row").alias("rows")).select(F.explode("rows").alias("row")).select("row.*")
    counts = f"{path}-counts"
    kind = stream.schema[group].dataType.simpleString()

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        place_rows(batch, KeyedState(batch.sparkSession, counts, f"`{group}` {kind}, rows bigint"), batch_id, ts, tie, rows, group, path, out)
        batch.unpersist()

    writer = closed.writeStream.outputMode("append").foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def place_rows(batch: DataFrame, counts: KeyedState, batch_id: int, ts: str, tie: str, rows: int, group: str, path: str, out: str = "window_index") -> None:
    """Writes a batch's rows with their windows, after those already counted, and the counts reached."""
    if batch.isEmpty():
        return
    so_far = counts.before(batch_id).withColumnRenamed("rows", "__before")
    placed = positions(batch, ts, tie, groups=[group], out="__pos")
    placed = placed.join(F.broadcast(so_far), placed[group].eqNullSafe(so_far[group]), "left").drop(so_far[group])  # one row a group
    whole = F.floor((F.col("__pos") + F.coalesce("__before", F.lit(0))) / F.lit(rows)).alias(out)
    sinks.write_batch(placed.select(*batch.columns, whole), path, batch_id)
    now = batch.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    kept = so_far.withColumnRenamed("__before", "rows")
    counts.store(now.unionByName(kept).groupBy(group).agg(F.sum("rows").alias("rows")), batch_id)


def close_row_windows(all_rows: DataFrame, ts: str, tie: str, rows: int, *, group: str, path: str, out: str = "window_index", closing: int = 1 << 40) -> None:
    """Places, in batch, the rows the watermark has not passed when a stream is ended; done again, it replaces itself."""
    spark = all_rows.sparkSession
    done = sinks.stored(spark, path, all_rows.withColumn("batch_id", F.lit(closing))).where(F.col("batch_id") != closing).select(group, tie)
    left = all_rows.join(done, (all_rows[tie] == done[tie]) & all_rows[group].eqNullSafe(done[group]), "left_anti")
    kind = all_rows.schema[group].dataType.simpleString()
    place_rows(left, KeyedState(spark, f"{path}-counts", f"`{group}` {kind}, rows bigint"), closing, ts, tie, rows, group, path, out)
