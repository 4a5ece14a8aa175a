from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import decisions
from tidewatch.streaming import monitor


def rows(spark, days, shift=0):
    start = datetime(2026, 1, 1)
    data = [(start + timedelta(days=d, minutes=7 * i), float((i * 13) % 100 + (shift if d >= 3 else 0)), "ab"[i % 2]) for d in days for i in range(200)]
    return spark.createDataFrame(data, "ts timestamp, v double, g string")


def test_stream_equals_batch_and_restart_adds_nothing(spark, tmp_path):
    reference = rows(spark, range(2))
    cuts = {"v": [20.0, 40.0, 60.0, 80.0]}
    bins_path = str(tmp_path / "bins")
    monitor.reference_bins(reference, cuts, ["g"]).write.parquet(bins_path)
    bins = spark.read.parquet(bins_path)
    source, out, check, cards = (str(tmp_path / n) for n in ("in", "events", "check", "cards"))
    rows(spark, range(0, 3), 50).coalesce(1).write.mode("append").parquet(source)

    def start():
        stream = spark.readStream.schema("ts timestamp, v double, g string").parquet(source)
        decide = lambda df: decisions.decide(df, decisions.policy_table(spark))
        q = monitor.start_monitor(stream, bins, "ts", cuts, ["g"], events_path=out, checkpoint=check, decide=decide, cards_path=cards)
        q.awaitTermination()
        return spark.read.parquet(out).count()

    first = start()
    assert first == 2  # the third day is still open
    assert start() == first  # a restart without new rows adds no window
    rows(spark, range(3, 5), 50).coalesce(1).write.mode("append").parquet(source)
    assert start() == 4
    everything = spark.read.parquet(source)
    monitor.close_open_windows(everything, bins, "ts", cuts, ["g"], events_path=out)
    monitor.close_open_windows(everything, bins, "ts", cuts, ["g"], events_path=out)
    got = {r["window_start"]: round(r["max_psi"], 9) for r in spark.read.parquet(out).collect()}
    batch = monitor.measured_rows(monitor.psi_of_bins(monitor.windowed_bins(everything, "ts", cuts, ["g"]), bins))
    assert got == {r["window_start"]: round(r["max_psi"], 9) for r in batch.collect()} and len(got) == 5
    actions = {(r["window_start"].day, r["policy_version"]): r["action"] for r in spark.read.parquet(cards).collect()}
    assert actions == {(day, f"policy-v{v}"): "FULL_RETRAIN" if day == 4 else "NO_OP" for day in range(1, 5) for v in (1, 2)}


def test_failed_shadow_scores_stay_as_rows(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(f"r{i}", float(i)) for i in range(10)], "request_id string, x double").write.parquet(source)
    stream = spark.readStream.schema("request_id string, x double").parquet(source)
    q = monitor.start_scoring(
        stream,
        lambda df: df.select("request_id", (F.col("x") / 10).alias("score")),
        lambda df: df.select("request_id", F.when(F.col("x") < 8, F.col("x") / 10).alias("score")),
        audit_path=str(tmp_path / "a"), shadow_path=str(tmp_path / "s"), checkpoint=str(tmp_path / "c"),
    )
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "a")).where("status = 'success'").count() == 10
    assert spark.read.parquet(str(tmp_path / "s")).where("status = 'shadow_failed'").count() == 2


def test_labels_within_the_delay_mature(spark):
    day = datetime(2026, 1, 1)
    p = spark.createDataFrame([("a", day), ("b", day)], "request_id string, ts timestamp")
    labels = spark.createDataFrame([("a", day + timedelta(days=30), 1), ("b", day + timedelta(days=31), 1)], "request_id string, label_ts timestamp, y int")
    assert [r["request_id"] for r in monitor.matured_predictions(p, labels).collect()] == ["a"]
    with pytest.raises(Exception):
        monitor.matured_predictions(p.drop("ts"), labels).collect()
