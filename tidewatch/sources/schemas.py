"""Explicit schemas: nothing is inferred at a boundary."""

from __future__ import annotations

from pyspark.sql import types as T

# The medication columns of an encounter row.
MEDICATIONS: tuple[str, ...] = (
    "metformin", "repaglinide", "nateglinide", "chlorpropamide", "glimepiride", "acetohexamide",
    "glipizide", "glyburide", "tolbutamide", "pioglitazone", "rosiglitazone", "acarbose",
    "miglitol", "troglitazone", "tolazamide", "examide", "citoglipton", "insulin",
    "glyburide-metformin", "glipizide-metformin", "glimepiride-pioglitazone",
    "metformin-rosiglitazone", "metformin-pioglitazone",
)


RAW_ENCOUNTER = T.StructType(
    [
        T.StructField("encounter_id", T.LongType()),
        T.StructField("patient_nbr", T.LongType()),
        T.StructField("race", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("age", T.StringType()),
        T.StructField("weight", T.StringType()),
        T.StructField("admission_type_id", T.IntegerType()),
        T.StructField("discharge_disposition_id", T.IntegerType()),
        T.StructField("admission_source_id", T.IntegerType()),
        T.StructField("time_in_hospital", T.IntegerType()),
        T.StructField("payer_code", T.StringType()),
        T.StructField("medical_specialty", T.StringType()),
        T.StructField("num_lab_procedures", T.IntegerType()),
        T.StructField("num_procedures", T.IntegerType()),
        T.StructField("num_medications", T.IntegerType()),
        T.StructField("number_outpatient", T.IntegerType()),
        T.StructField("number_emergency", T.IntegerType()),
        T.StructField("number_inpatient", T.IntegerType()),
        T.StructField("diag_1", T.StringType()),
        T.StructField("diag_2", T.StringType()),
        T.StructField("diag_3", T.StringType()),
        T.StructField("number_diagnoses", T.IntegerType()),
        T.StructField("max_glu_serum", T.StringType()),
        T.StructField("A1Cresult", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in MEDICATIONS],
        T.StructField("change", T.StringType()),
        T.StructField("diabetesMed", T.StringType()),
        T.StructField("readmitted", T.StringType()),
    ]
)

# The same row before its types are checked: every field as text.
RAW_ENCOUNTER_TEXT = T.StructType([T.StructField(f.name, T.StringType()) for f in RAW_ENCOUNTER.fields])

CLEAN_ENCOUNTER = T.StructType(
    [f for f in RAW_ENCOUNTER.fields if f.name not in ("weight", "readmitted")]
    + [T.StructField("readmitted_30d", T.IntegerType())]
)

FEATURE_STAT = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("psi", T.DoubleType()),
        T.StructField("ks_p_value", T.DoubleType()),
        T.StructField("breaching", T.BooleanType()),
        T.StructField("severe", T.BooleanType()),
    ]
)

MEASURED_THRESHOLDS = T.StructType(
    [
        T.StructField("psi_breach", T.DoubleType()),
        T.StructField("psi_severe", T.DoubleType()),
        T.StructField("ks_p_value", T.DoubleType()),
        T.StructField("prediction_psi", T.DoubleType()),
        T.StructField("monitored_features", T.IntegerType()),
    ]
)

DRIFT_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("window_start", T.TimestampType()),
        T.StructField("window_end", T.TimestampType()),
        T.StructField("scenario", T.StringType()),
        T.StructField("feature_stats", T.ArrayType(FEATURE_STAT)),
        T.StructField("prediction_drift", T.BooleanType()),
        T.StructField("prediction_psi", T.DoubleType()),
        T.StructField("max_psi", T.DoubleType()),
        T.StructField("breaching_feature_count", T.LongType()),
        T.StructField("reference_rows", T.LongType()),
        T.StructField("current_rows", T.LongType()),
        T.StructField("report_uri", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("data_version", T.StringType()),
        T.StructField("policy_thresholds", MEASURED_THRESHOLDS),
    ]
)

PREDICTION = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("input_hash", T.StringType()),
        T.StructField("caller", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("decision_threshold", T.DoubleType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("status", T.StringType()),
    ]
)

SHADOW_PREDICTION = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("champion_version", T.StringType()),
        T.StructField("shadow_version", T.StringType()),
        T.StructField("champion_score", T.DoubleType()),
        T.StructField("shadow_score", T.DoubleType()),
        T.StructField("decision_threshold", T.DoubleType()),
        T.StructField("status", T.StringType()),
    ]
)

RETRAIN_RUN = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("card_id", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("champion_version", T.StringType()),
        T.StructField("challenger_version", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("criteria_version", T.StringType()),
        T.StructField("failed_criteria_count", T.LongType()),
        T.StructField("shadow_alias_moved", T.BooleanType()),
        T.StructField("authorized_by", T.StringType()),
        T.StructField("data_version", T.StringType()),
    ]
)

APPROVAL = T.StructType(
    [
        T.StructField("approval_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("card_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("approver", T.StringType()),
        T.StructField("decision", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("champion_version_before", T.StringType()),
        T.StructField("champion_version_after", T.StringType()),
    ]
)

ALIAS_MOVE = T.StructType(
    [
        T.StructField("timestamp_utc", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("alias", T.StringType()),
        T.StructField("from_version", T.StringType()),
        T.StructField("to_version", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("git_commit", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("actor", T.StringType()),
    ]
)
