"""What a stream carries from batch to batch, against the batch forms over all rows."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import decisions
from tidewatch.operators.drift import KS_P_VALUE, ks_test
from tidewatch.operators.preparation import row_windows
from tidewatch.operators.quality import ranking_metrics
from tidewatch.streaming import labels, monitor, sketches, windows
from tidewatch.streaming.state import KeyedState

START = datetime(2026, 1, 1)
ROW = "event_id bigint, ts timestamp, v double, g string, s string"


def rows(spark, spec, per_day=60):
    """Rows of (stream, day, shift) in that order; ids tell repeats of a moment apart."""
    data, n = [], 0
    for stream, day, shift in spec:
        for i in range(per_day):
            data.append((n, START + timedelta(days=day, minutes=23 * (i // 2)), float((i * 13) % 100 + shift), "ab"[i % 2], stream))
            n += 1
    return spark.createDataFrame(data, ROW)


def fed(spark, folder, frames, one_file_a_batch=True):
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(folder)
    reader = spark.readStream.schema(ROW)
    return (reader.option("maxFilesPerTrigger", 1) if one_file_a_batch else reader).parquet(folder)


DAYS = [[("x", 0, 0), ("y", 0, 0)], [("x", 1, 30)], [("x", 2, 30), ("y", 2, 40)], [("x", 3, 30), ("y", 3, 40)], [("x", 4, 35)]]
CUTS = {"v": [20.0, 40.0, 60.0, 80.0]}


@pytest.fixture(scope="module")
def bins(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bins") / "b")
    monitor.reference_bins(rows(spark, [("x", 0, 0), ("x", 1, 0)]), CUTS, ["g"]).write.parquet(path)
    return spark.read.parquet(path)


def chosen(cards):
    names = ["card_id", "policy_version", "scenario", "window_start", "rule_id", "action", "disposition", "confidence", "rationale"]
    return sorted(tuple(r[c] for c in names) + (r["trigger"]["consecutive_breaching_windows"], tuple(r["trigger"]["persistent_features"])) for r in cards.collect())


def test_cards_of_a_batch_need_no_history(spark, tmp_path, bins, monkeypatch):
    events, cards, check = (str(tmp_path / n) for n in ("events", "cards", "check"))
    stream = fed(spark, str(tmp_path / "in"), [rows(spark, day) for day in DAYS])
    policies = decisions.policy_table(spark)
    read: list[tuple[int, int]] = []  # batch and the rows of the frames it is given or reads
    advance, before = monitor.advance_cards, KeyedState.before
    now = {}

    def counted(batch_events, p, path, batch_id):
        now["id"] = batch_id
        read.append((batch_id, batch_events.count()))
        assert all(f"batch_id={batch_id}/" in f for f in batch_events.inputFiles())
        advance(batch_events, p, path, batch_id)

    def carried(self, batch_id):
        found = before(self, batch_id)
        read.append((now["id"], found.count()))
        return found

    monkeypatch.setattr(monitor, "advance_cards", counted)
    monkeypatch.setattr(KeyedState, "before", carried)
    options = {"scenario": "s", "events_path": events, "policies": policies, "cards_path": cards}
    monitor.start_monitor(stream, bins, "ts", CUTS, ["g"], checkpoint=check, **options).awaitTermination()
    batches = {batch for batch, _ in read}
    assert len(batches) >= 4
    most = Counter()
    for batch, n in read:
        most[batch] += n
    assert max(most.values()) <= 2 + 2 * 2 * 2  # two streams' events; two policies, streams and features
    everything = spark.read.schema(ROW).parquet(str(tmp_path / "in"))
    for _ in range(2):
        monitor.close_open_windows(everything, bins, "ts", CUTS, ["g"], **options)
    stored = spark.read.parquet(events)
    assert stored.count() == 8
    assert chosen(spark.read.parquet(cards)) == chosen(decisions.decide(stored, policies))


def test_a_repeated_batch_writes_the_same(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path / "s"), "k string, n bigint")
    for batch in (0, 1, 1, 4):
        old = state.before(batch)
        state.store(old.selectExpr("k", "n + 1 AS n").unionByName(spark.createDataFrame([(f"b{batch}", 0)], "k string, n bigint")), batch)
    assert {r.k: r.n for r in state.latest().collect()} == {"b0": 2, "b1": 1, "b4": 0}
    assert state._versions() == [1, 4]


def test_streaks_go_on_where_the_history_is_cut(spark):
    rng = random.Random(5)
    stat = lambda f, hit: {"feature": f, "kind": "numerical", "psi": 0.5 if hit else 0.01, "ks_p_value": None, "breaching": hit, "severe": hit}
    schema = (
        "event_id string, created_at timestamp, window_start timestamp, window_end timestamp, scenario string, "
        "feature_stats array<struct<feature:string,kind:string,psi:double,ks_p_value:double,breaching:boolean,severe:boolean>>, prediction_drift boolean, prediction_psi double, "
        "max_psi double, model_version string, data_version string, policy_thresholds struct<monitored_features:int>"
    )
    data = []
    for s in ("a", "b", "c"):
        for d in range(14):
            if s != "c" or d < 5:
                at = START + timedelta(days=d)
                data.append((f"{s}{d}", at, at, at, s, [stat(f, rng.random() < 0.75) for f in "pqr"], False, None, 0.5, None, None, (3,)))
    events, policies = spark.createDataFrame(data, schema), decisions.policy_table(spark)
    whole = {(r.policy_version, r.event_id): (r.consecutive_breaching_windows, r.persistent_features) for r in decisions.breach_runs(events, policies).collect()}
    for cuts in ([3, 9],):
        carried, seen = spark.createDataFrame([], decisions.STREAKS), {}
        for lo, hi in zip([0, *cuts], [*cuts, 14]):
            part = events.where((F.col("window_start") >= F.lit(START + timedelta(days=lo))) & (F.col("window_start") < F.lit(START + timedelta(days=hi))))
            runs = decisions.breach_runs(part, policies, carried=carried)
            seen |= {(r.policy_version, r.event_id): (r.consecutive_breaching_windows, r.persistent_features) for r in runs.collect()}
            carried = spark.createDataFrame(decisions.streaks_after(part, policies, carried).collect(), decisions.STREAKS)
        assert seen == whole


def test_days_without_rows_have_events(spark, tmp_path, bins):
    events, check, source = (str(tmp_path / n) for n in ("events", "check", "in"))
    spec = [[("x", 0, 0), ("y", 1, 0)], [("x", 4, 0)], [("x", 5, 0)], [("y", 9, 0)], [("x", 12, 0)]]

    def run(stream):
        monitor.start_monitor(stream, bins, "ts", CUTS, ["g"], events_path=events, checkpoint=check, scenario="s", quiet=True, policies=decisions.policy_table(spark), cards_path=str(tmp_path / "cards")).awaitTermination()

    for part in (spec[:2], spec[2:]):  # the second start goes on from the state of the first
        run(fed(spark, source, [rows(spark, day) for day in part]))
    found = {(r.scenario, (r.window_start - START).days): r for r in spark.read.parquet(events).collect()}
    counts = {k: r.current_rows for k, r in found.items()}
    want = {("x", d): 60 if d in (0, 4, 5) else 0 for d in range(12)} | {("y", d): 60 if d in (1, 9) else 0 for d in range(1, 12)}
    assert counts == want and spark.read.parquet(events).count() == len(want)
    quiet = found["x", 2]
    assert quiet.max_psi is None and quiet.feature_stats == [] and quiet.breaching_feature_count == 0 and not quiet.prediction_drift
    actions = {(r.scenario, (r.window_start - START).days): r.action for r in spark.read.parquet(str(tmp_path / "cards")).where("policy_version = 'policy-v1'").collect()}
    assert actions["x", 2] == actions["y", 5] == "NO_OP" and len(actions) == len(want)
    batch = monitor.windowed_bins(spark.read.schema(ROW).parquet(source), "ts", CUTS, ["g"], scenario="s", quiet=True).where(F.col("feature") == monitor.ROWS)
    assert {(r.scenario, (r.window_start - START).days): r.n_cur for r in batch.collect() if (r.window_start - START).days < (12 if r.scenario == "x" else 10)} == {k: n for k, n in want.items() if k[0] == "x" or k[1] < 10}


def test_row_windows_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(6)
    data = [(i, START + timedelta(minutes=rng.randrange(0, 4000)), 0.0, "a", rng.choice("xxxxy") if i % 50 else None) for i in range(900)]
    data += [(1000 + i, START + timedelta(minutes=2000), 0.0, "a", "x") for i in range(80)]  # one moment
    data.sort(key=lambda r: r[1] + timedelta(minutes=rng.randrange(0, 50)))  # late within the hour
    frames = [spark.createDataFrame(data[k : k + 200], ROW) for k in range(0, len(data), 200)]
    path, check = str(tmp_path / "rows"), str(tmp_path / "check")
    for part in (frames[:3], frames[3:]):
        stream = fed(spark, str(tmp_path / "in"), part)
        windows.start_row_windows(stream, "ts", "event_id", 64, group="s", path=path, checkpoint=check, late="1 hour", span="30 minutes", parts=3).awaitTermination()
    placed = spark.read.parquet(path)
    assert 700 < placed.count() < len(data) and placed.select("batch_id").distinct().count() >= 3
    everything = spark.read.schema(ROW).parquet(str(tmp_path / "in"))
    for _ in range(2):
        windows.close_row_windows(everything, "ts", "event_id", 64, group="s", path=path)
    got = {r.event_id: r.window_index for r in spark.read.parquet(path).collect()}
    assert spark.read.parquet(path).count() == len(data)
    assert got == {r.event_id: r.window_index for r in row_windows(everything, "ts", "event_id", 64, groups=["s"]).collect()}


@pytest.mark.parametrize("k", [50, sketches.K])
def test_sketched_statistic_stays_within_its_bound(spark, k):
    rng = random.Random(7)
    value = lambda shift: round(rng.gauss(50 + shift, 12), 2) if rng.random() < 0.8 else float(rng.randrange(0, 6))
    reference = spark.createDataFrame([(value(0), float(i % 3), None) for i in range(6000)], "v double, c double, m double")
    serving = spark.createDataFrame(
        [(START + timedelta(days=d, seconds=i), value(4 * d), float(i % (2 + d)) if i % 11 else None, float("nan")) for d in range(4) for i in range((5000, 3, 900, 5000)[d])],
        "ts timestamp, v double, c double, m double",
    )
    cuts = {"v": [5.0, 40.0, 50.0, 60.0], "c": [1.0]}
    grid = sketches.reference_grid(reference, cuts)
    counts = monitor.windowed_bins(serving, "ts", cuts, [], sketch_k=k)
    keys = ["scenario", "window_start", "window_end"]
    found = {(r.window_start.date(), r.feature): r for r in sketches.ks_of_bins(counts, grid, keys, k).collect()}
    exact = ks_test(reference, serving.withColumn("day", F.col("ts").cast("date")), ["day"], ["v", "c"]).collect()
    assert len(found) == len(exact) == 8
    for r in exact:
        seen = found[r.day, r.feature]
        assert abs(seen.ks_statistic - r.ks_statistic) <= seen.ks_bound + 1e-12 and seen.cur_rows == r.cur_rows
        assert seen.ks_bound < (0.05 if r.feature == "v" and k > 50 and r.cur_rows > 10 else 0.9)
        if abs(seen.ks_statistic - r.ks_statistic) < 1e-9:
            assert seen.ks_p_value == pytest.approx(r.ks_p_value, abs=1e-6)


def test_stream_events_carry_the_p_value(spark, tmp_path, bins):
    reference = rows(spark, [("x", 0, 0), ("x", 1, 0)])
    grid = sketches.reference_grid(reference, CUTS)
    stream = fed(spark, str(tmp_path / "in"), [rows(spark, day) for day in DAYS[:3]])
    monitor.start_monitor(stream, bins, "ts", CUTS, ["g"], events_path=str(tmp_path / "e"), checkpoint=str(tmp_path / "c"), scenario="s", grid=grid, sketch_k=sketches.K).awaitTermination()
    stats = {(r.scenario, (r.window_start - START).days): {s.feature: s for s in r.feature_stats} for r in spark.read.parquet(str(tmp_path / "e")).collect()}
    assert stats["x", 0]["v"].ks_p_value > 0.9 and stats["x", 1]["v"].ks_p_value < KS_P_VALUE and stats["x", 1]["g"].ks_p_value is None


def test_late_labels_reach_rule_five(spark, tmp_path):
    rng = random.Random(8)
    said, told = [], []
    for d in range(8):
        for i in range(40):
            y = rng.randrange(2)
            good = d != 2  # on the third day the scores say nothing
            score = min(max((0.7 if y else 0.3) + rng.uniform(-0.25, 0.25), 0), 1) if good else rng.random()
            at = START + timedelta(days=d, minutes=30 * i)
            said.append((f"r{d}-{i}", "x", at, score))
            told.append((f"r{d}-{i}", at + timedelta(days=rng.randrange(0, 3), minutes=5), y))
    told.sort(key=lambda r: r[1])
    p_schema, l_schema = "request_id string, s string, ts timestamp, score double", "request_id string, label_ts timestamp, y int"
    for k in range(4):
        spark.createDataFrame(said[k * 80 : k * 80 + 80], p_schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
        spark.createDataFrame(told[k * 80 : k * 80 + 80], l_schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
    feed = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    champion = spark.createDataFrame([("x", 0.95)], "scenario string, champion_auc double")
    for _ in range(2):
        labels.start_maturing(
            feed("p", p_schema), feed("l", l_schema), champion, scenario="s", evidence_path=str(tmp_path / "e"), checkpoint=str(tmp_path / "c"), delay="3 days", late="1 hour"
        ).awaitTermination()
    found = {(r.window_start - START).days: r for r in spark.read.parquet(str(tmp_path / "e")).collect()}
    assert sorted(found) == list(range(len(found))) and 4 <= len(found) < 8  # the last days' labels may still come
    pairs = spark.createDataFrame(said, p_schema).join(spark.createDataFrame(told, l_schema), "request_id").withColumn("p", labels.score_bin(F.col("score")))
    exact = {(r.day - START.date()).days: r.roc_auc for r in ranking_metrics(pairs.withColumn("day", F.col("ts").cast("date")), ["day"], "y", "p").collect()}
    assert all(r.roc_auc == pytest.approx(exact[d]) and r.rows == 40 for d, r in found.items())
    held = KeyedState(spark, str(tmp_path / "e-open"), labels.HISTOGRAM).latest()
    assert {(r.window_start - START).days for r in held.select("window_start").distinct().collect()} == set(range(8)) - set(found)
    stat = [{"feature": "v", "kind": "numerical", "psi": 0.01, "ks_p_value": None, "breaching": False, "severe": False}]
    schema = (
        "event_id string, created_at timestamp, window_start timestamp, window_end timestamp, scenario string, "
        "feature_stats array<struct<feature:string,kind:string,psi:double,ks_p_value:double,breaching:boolean,severe:boolean>>, prediction_drift boolean, prediction_psi double, "
        "max_psi double, model_version string, data_version string, policy_thresholds struct<monitored_features:int>"
    )
    at = [START + timedelta(days=d) for d in range(8)]
    events = spark.createDataFrame([(f"e{d}", t, t, t, "x", stat, False, None, 0.01, None, None, (1,)) for d, t in enumerate(at)], schema)
    evidence = spark.read.parquet(str(tmp_path / "e")).select("scenario", "window_start", "labels_matured", "matured_auroc_drop_seen")
    cards = decisions.decide(events, decisions.policy_table(spark), matured=evidence).where("policy_version = 'policy-v2'").collect()
    rules = {(r.window_start - START).days: r.rule_id for r in cards}
    assert rules == {d: "5" if d in found and 0.95 - found[d].roc_auc > 0.03 else "1" for d in range(8)} and rules[2] == "5"


def test_maturing_reads_a_batch_once(spark, tmp_path):
    p_schema = "request_id bigint, s string, ts timestamp, score double"
    l_schema = "request_id bigint, label_ts timestamp, y int"
    said = [(i, "x", START + timedelta(hours=i), (i * 37 % 100) / 100.0) for i in range(240)]
    told = [(i, t + timedelta(days=i % 3), i % 2) for i, _, t, _ in said]
    spark.createDataFrame(said, p_schema).coalesce(1).write.parquet(str(tmp_path / "p"))
    spark.createDataFrame(told, l_schema).coalesce(1).write.parquet(str(tmp_path / "l"))
    predictions = spark.readStream.schema(p_schema).parquet(str(tmp_path / "p"))
    champion = spark.createDataFrame([("x", 0.95)], "scenario string, champion_auc double")
    query = labels.start_maturing(
        predictions, spark.readStream.schema(l_schema).parquet(str(tmp_path / "l")), champion, scenario="s", evidence_path=str(tmp_path / "e"), checkpoint=str(tmp_path / "c"),
        delay="3 days", late="1 hour",
    )
    query.awaitTermination()
    assert query.recentProgress[0].stateOperators[0].numRowsUpdated == 480  # each row of both streams goes into the state once
    assert {r.rows for r in spark.read.parquet(str(tmp_path / "e")).collect()} == {24}
