import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidewatch.functions.text import code_chapter
from tidewatch.operators import perturb as p
from tidewatch.operators import preparation as prep
from tidewatch.operators import validation as v
from tidewatch.sources import readers, sinks
from tidewatch.sources.schemas import ALIAS_MOVE, MEDICATIONS, RAW_ENCOUNTER_TEXT


def raw_row(**changes):
    row = {
        "encounter_id": "1", "patient_nbr": "10", "race": None, "gender": "Female", "age": "[60-70)", "weight": None, "admission_type_id": "1",
        "discharge_disposition_id": "1", "admission_source_id": "7", "time_in_hospital": "4", "payer_code": None, "medical_specialty": None,
        "num_lab_procedures": "40", "num_procedures": "2", "num_medications": "10", "number_outpatient": "0", "number_emergency": "1",
        "number_inpatient": "2", "diag_1": "250.83", "diag_2": "V27", "diag_3": "486", "number_diagnoses": "9", "max_glu_serum": None,
        "A1Cresult": ">7", "change": "Ch", "diabetesMed": "Yes", "readmitted": "<30", **{m: "No" for m in MEDICATIONS},
    }
    row.update(changes)
    return tuple(row[f.name] for f in RAW_ENCOUNTER_TEXT.fields)


def test_a_valid_encounter_has_no_violations(spark):
    df = spark.createDataFrame([raw_row()], RAW_ENCOUNTER_TEXT)
    assert v.with_violations(df, v.ENCOUNTER_EXPECTATIONS).first()["violations"] == []


def test_all_failures_are_collected(spark):
    rows = [
        raw_row(encounter_id="1", gender="Robot", age="60", time_in_hospital="15", number_diagnoses="0"),
        raw_row(encounter_id="1", readmitted=None, num_procedures="two", **{"glyburide-metformin": "Maybe"}),
        raw_row(encounter_id="2"),
    ]
    checked = v.with_violations(spark.createDataFrame(rows, RAW_ENCOUNTER_TEXT), v.ENCOUNTER_EXPECTATIONS)
    found = {tuple(sorted(r["violations"])) for r in checked.collect()}
    assert found == {
        ("age:matches", "encounter_id:unique", "gender:isin", "number_diagnoses:at_least", "time_in_hospital:between"),
        ("encounter_id:unique", "glyburide-metformin:isin", "num_procedures:type", "readmitted:not_null"),
        (),
    }
    report = {(r["column_name"], r["rule"]): r["failures"] for r in v.violation_report(checked).collect()}
    assert report[("encounter_id", "unique")] == 2
    assert v.passing(checked).count() == 1 and v.quarantined(checked).count() == 2


def test_request_bounds_are_narrower(spark):
    df = spark.createDataFrame([raw_row(num_lab_procedures="201", payer_code="x" * 33)], RAW_ENCOUNTER_TEXT)
    assert sorted(v.with_violations(df, v.REQUEST_EXPECTATIONS).first()["violations"]) == ["num_lab_procedures:between", "payer_code:max_length"]


def test_null_profile_lists_only_columns_with_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "x")], "a int, b string, c string")
    assert [(r[0], r[1]) for r in v.null_profile(df).collect()] == [("b", 1.0), ("c", 0.5)]


def small(spark):
    rows = [(1, 10, 1, None, None, "a", "<30"), (2, 10, 1, None, "MC", None, "NO"), (3, 20, 1, None, None, None, ">30"), (4, 30, 1, None, None, "b", "<30"), (5, 30, 1, None, None, "b", "NO")]
    return spark.createDataFrame(rows, "encounter_id long, patient_nbr long, discharge_disposition_id int, weight string, payer_code string, medical_specialty string, readmitted string")


def test_first_stay_per_patient(spark):
    kept = prep.first_per_key(small(spark), "patient_nbr", "encounter_id")
    assert sorted(r["encounter_id"] for r in kept.collect()) == [1, 3, 4]


def test_missing_policy_and_target(spark):
    df = prep.fill_missing(small(spark), ["weight"], ["payer_code", "medical_specialty"])
    assert df.where("payer_code = 'missing'").count() == 4 and "weight" not in df.columns
    flagged = prep.binary_target(small(spark)).orderBy("encounter_id")
    assert [r["readmitted_30d"] for r in flagged.collect()] == [1, 0, 0, 1, 0] and "readmitted" not in flagged.columns


def test_patient_whose_first_stay_is_excluded_keeps_the_second(spark):
    df = small(spark).withColumn("discharge_disposition_id", F.when(F.col("encounter_id") == 1, 11).when(F.col("encounter_id") == 3, F.lit(None)).otherwise(1))
    assert sorted(r["encounter_id"] for r in prep.clean_encounters(df).collect()) == [2, 3, 4]


def test_chapters(spark):
    codes = ["250.83", "V27", "486", None, "  ", "e900", "139.5", "249.7", "999.9", "abc", "999", "nan", " 428 "]
    df = spark.createDataFrame([(c,) for c in codes], "code string").select(code_chapter("code").alias("c"))
    assert [r["c"] for r in df.collect()] == [
        "diabetes", "supplementary_v", "respiratory", "missing", "missing", "external_causes_e", "other_unrecognized", "other_unrecognized",
        "other_unrecognized", "other_unrecognized", "injury_poisoning", "other_unrecognized", "circulatory",
    ]


def test_engineered_columns(spark):
    df = spark.createDataFrame([raw_row(insulin="Up", metformin="Down", time_in_hospital="0")], RAW_ENCOUNTER_TEXT)
    typed = v.coerced(df, v.ENCOUNTER_EXPECTATIONS)
    row = prep.monitored_features(typed).first()
    assert (row["service_utilization"], row["num_med_changes"], row["insulin_changed"]) == (3, 2, 1)
    assert row["procedure_rate"] is None and row["race"] == "missing" and row["admission_source_group"] == "emergency"
    assert len(prep.monitored_features(typed).columns) == 25
    with pytest.raises(Exception):
        prep.monitored_features(typed.drop("race"))


def test_split_is_ordered_disjoint_and_sized(spark):
    df = spark.range(1, 101).select(F.col("id").alias("encounter_id"), (F.col("id") + 999).alias("patient_nbr"))
    rows = prep.chronological_split(df, "encounter_id", unique_key="patient_nbr").groupBy("split").agg(F.count("*").alias("n"), F.min("encounter_id").alias("a"), F.max("encounter_id").alias("b")).collect()
    assert {r["split"]: (r["n"], r["a"], r["b"]) for r in rows} == {"train": (70, 1, 70), "eval_frozen": (15, 71, 85), "future_stream": (15, 86, 100)}
    with pytest.raises(ValueError):
        prep.chronological_split(df.unionByName(df), "encounter_id", unique_key="patient_nbr")


def test_partial_windows_and_bad_sizes(spark):
    df = spark.range(25)
    assert prep.row_windows(df, "id", "id", 10, keep_partial=False).count() == 20
    assert prep.row_windows(df, "id", "id", 10).count() == 25
    assert prep.row_windows(df, "id", "id", 10, max_windows=1).count() == 10
    with pytest.raises(ValueError):
        prep.row_windows(df, "id", "id", 0)


def encounters(spark, n=400):
    return spark.range(n).select(
        F.col("id").alias("encounter_id"), (F.col("id") % 50 + 1).alias("num_lab_procedures"), (F.col("id") % 20 + 1).alias("num_medications"),
        F.when(F.col("id") % 4 == 0, F.lit("Norm")).alias("A1Cresult"), F.when(F.col("id") % 5 == 0, F.lit("[80-90)")).otherwise(F.lit("[40-50)")).alias("age"),
        F.lit(0).alias("number_inpatient"), (F.col("id") % 2).alias("number_emergency"), F.lit(0).alias("number_outpatient"), (F.col("id") % 3 == 0).cast("int").alias("readmitted_30d"),
    )


@pytest.mark.parametrize("name", ["S1", "s2", "S3", "S4", "S5"])
def test_perturbations_repeat_and_keep_the_row_count(spark, name):
    df = encounters(spark)
    a = sorted(map(tuple, p.apply_named(df, name).select(*df.columns).collect()), key=str)
    b = sorted(map(tuple, p.apply_named(df.repartition(5), name).select(*df.columns).collect()), key=str)
    assert a == b and len(a) == 400
    assert len({r[0] for r in a}) == 400


def test_perturbation_sizes(spark):
    df = encounters(spark)
    assert p.apply_named(df, "S2").where("A1Cresult IS NOT NULL").count() == 100 + 120
    shifted = p.apply_named(df, "S1").agg(F.avg("num_lab_procedures"), F.min("num_lab_procedures")).first()
    assert shifted[0] > 28 and shifted[1] >= 1
    older = p.apply_named(df, "S3").where("age = '[80-90)'").count()
    assert 180 <= older <= 220  # a fifth of the rows with four times the weight
    with pytest.raises(KeyError):
        p.apply_named(df, "S6")
    with pytest.raises(ValueError):
        p.relabel_at_base_rate(df.drop("readmitted_30d"), ["encounter_id"])


def test_one_dominant_weight_is_repeated_exactly(spark):
    df = spark.range(1000)
    got = p.weighted_resample(df.withColumn("v", F.col("id")), "id", F.when(F.col("id") == 5, 999001).otherwise(1))
    assert got.count() == 1000 and got.where("v = 5").count() >= 998


def test_sources_and_sinks(spark, tmp_path):
    with pytest.raises(AnalysisException):
        readers.read_table(spark, str(tmp_path / "none"))
    assert readers.read_alias_log(spark, str(tmp_path / "log")).count() == 0
    log = spark.createDataFrame([("2026-01-01T00:00:00", "set", "m", "champion", None, "2", "r", None, "why", "me")], ALIAS_MOVE)
    sinks.append_json_lines(log, str(tmp_path / "log"))
    sinks.append_json_lines(log, str(tmp_path / "log"))
    assert readers.read_alias_log(spark, str(tmp_path / "log")).count() == 2
    with pytest.raises(ValueError):
        readers.require_columns(log, ["label"])
    assert [r["id"] for r in readers.read_page(spark.range(10), ["id"], 3, 2).collect()] == [3, 4]


def test_append_once_is_idempotent_and_null_safe(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = spark.createDataFrame([("c1", "live", None, "PASS"), ("c1", "live", "2", "BLOCK")], "card_id string, mode string, challenger_version string, outcome string")
    for _ in range(2):
        sinks.append_once(rows.withColumn("outcome", F.lit("X")) if _ else rows, path, sinks.RUN_KEY)
    assert sorted(r["outcome"] for r in spark.read.parquet(path).collect()) == ["BLOCK", "PASS"]


def test_second_decisions_are_refused(spark):
    schema = "approval_id string, ts timestamp, kind string, subject string, decision string"
    stored = spark.sql("SELECT 'a0' approval_id, TIMESTAMP'2026-01-01' ts, 'RETRAIN' kind, 'c0' subject, 'APPROVE' decision")
    new = spark.sql(
        "SELECT * FROM VALUES ('a0', TIMESTAMP'2026-01-02', 'RETRAIN', 'c0', 'REJECT'), ('a1', TIMESTAMP'2026-01-02', 'RETRAIN', 'c1', 'REJECT'),"
        " ('a1', TIMESTAMP'2026-01-03', 'RETRAIN', 'c1', 'APPROVE'), ('a2', TIMESTAMP'2026-01-02', 'RETRAIN', 'c2', 'REJECT'), ('a2', TIMESTAMP'2026-01-02', 'RETRAIN', 'c2', 'REJECT') AS t(approval_id, ts, kind, subject, decision)"
    )
    accepted, refused = sinks.split_decisions(new, stored)
    assert sorted((r["subject"], r["decision"]) for r in accepted.collect()) == [("c1", "REJECT"), ("c2", "REJECT")]
    assert sorted((r["subject"], r["copies"]) for r in refused.collect()) == [("c0", 1), ("c1", 1), ("c2", 1)]
    assert schema.count(",") == 4


def test_reconcile_reports_missing_tables(spark):
    a, b = spark.range(3), spark.range(4)
    rows = sinks.reconcile(sinks.table_counts({"x": a, "y": b}), sinks.table_counts({"x": a})).collect()
    assert {r["table_name"]: r["same"] for r in rows} == {"x": True, "y": False}
    prints = sinks.table_fingerprints({"x": a})
    assert sinks.reconcile(prints, sinks.table_fingerprints({"x": a.repartition(3)}), ["rows", "content"]).first()["same"]


def test_next_windows_and_reference(spark):
    rows = spark.range(40).select(F.lit("s").alias("scenario"), (F.col("id") / 10).cast("long").alias("window_index"), "id")
    done = spark.createDataFrame([("s", 1)], "scenario string, i long").select("scenario", prep.window_start("i").alias("window_start"))
    assert prep.next_window_index(done).first()["next_index"] == 2
    assert sorted(r["id"] for r in prep.next_windows(rows, done).collect()) == list(range(20, 30))
    assert sorted(r["id"] for r in prep.next_windows(rows, done.limit(0)).collect()) == list(range(10))
    typed = v.coerced(spark.createDataFrame([raw_row(encounter_id=str(i)) for i in range(30)], RAW_ENCOUNTER_TEXT), v.ENCOUNTER_EXPECTATIONS)
    ref = prep.monitoring_reference(typed, ["encounter_id"], lambda df: df.withColumn("risk_score", F.lit(0.1)), rows=12)
    assert ref.count() == 12 and "encounter_id" not in ref.columns and len(ref.columns) == 26


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "b")
    for batch in (0, 1, 1):
        sinks.write_batch(spark.range(5), path, batch)
    assert spark.read.parquet(path).count() == 10
