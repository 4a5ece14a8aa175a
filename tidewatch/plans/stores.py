"""Queries that store rows the way the service does and read them back: CSV, JSON lines, partitions, append-once tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.functions.text import MISSING, UNRECOGNIZED
from tidewatch.operators import preparation, validation
from tidewatch.plans import check_sql as c
from tidewatch.plans import tables as t
from tidewatch.plans.registry import query
from tidewatch.session import shared_folder
from tidewatch.sources import readers, sinks
from tidewatch.sources.schemas import MEDICATIONS, RAW_ENCOUNTER

CUT = "2024-01-16"

# --- encounters by way of CSV -------------------------------------------------------------------
# What an order says as an encounter, in SQL that both engines read; the other columns are constants.
ENCOUNTER = {
    "encounter_id": "o_orderkey",
    "patient_nbr": "o_custkey",
    "race": "CASE o_custkey % 4 WHEN 0 THEN 'Hispanic' WHEN 1 THEN 'Other' WHEN 2 THEN 'Caucasian' END",
    "gender": "CASE o_custkey % 2 WHEN 0 THEN 'Female' ELSE 'Male' END",
    "discharge_disposition_id": "o_orderkey % 30 + 1",
    "time_in_hospital": "o_orderkey % 14 + 1",
    "payer_code": "CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END",
    "num_procedures": "o_orderkey % 7",
    "number_outpatient": "o_custkey % 3",
    "number_emergency": "o_orderkey % 2",
    "number_inpatient": "o_custkey % 5",
    "diag_1": "CASE o_orderkey % 5 WHEN 0 THEN '250.83' WHEN 1 THEN 'V27' WHEN 2 THEN 'E909' WHEN 3 THEN 'none, yet' END",
    "insulin": "CASE o_custkey % 3 WHEN 0 THEN 'Up' ELSE 'No' END",
    "metformin": "CASE o_orderkey % 4 WHEN 0 THEN 'Down' ELSE 'Steady' END",
    "readmitted": "CASE o_orderstatus WHEN 'F' THEN '<30' WHEN 'O' THEN '>30' ELSE 'NO' END",
}
ALIKE = {c: "'No'" for c in MEDICATIONS} | {"age": "'[70-80)'", "change": "'Ch'", "diabetesMed": "'Yes'", "diag_2": "'428'", "diag_3": "'428'"}


def _raw_encounters(orders: DataFrame) -> DataFrame:
    said = ALIKE | ENCOUNTER
    texts = {"weight", "medical_specialty", "max_glu_serum", "A1Cresult"}
    return orders.select(*[F.expr(said.get(f.name, "NULL" if f.name in texts else "1")).cast("string").alias(f.name) for f in RAW_ENCOUNTER.fields])


@query(
    "encounters_from_csv",
    f"""WITH raw AS (SELECT {", ".join(f'{sql} AS {name}' for name, sql in ENCOUNTER.items())} FROM orders),
kept AS (SELECT *, row_number() OVER (PARTITION BY patient_nbr ORDER BY encounter_id) AS rn FROM raw WHERE discharge_disposition_id NOT IN ({", ".join(map(str, preparation.EXCLUDED_DISCHARGES))}))
SELECT encounter_id, CAST(readmitted = '<30' AS BIGINT) AS readmitted_30d, coalesce(race, '{MISSING}') AS race, gender, coalesce(payer_code, '{MISSING}') AS payer_code,
       '{MISSING}' AS medical_specialty, number_outpatient + number_emergency + number_inpatient AS service_utilization,
       CAST(insulin = 'Up' AS BIGINT) + CAST(metformin = 'Down' AS BIGINT) AS num_med_changes, CAST(insulin = 'Up' AS BIGINT) AS insulin_changed,
       round(num_procedures / time_in_hospital, 6) AS procedure_rate,
       CASE diag_1 WHEN '250.83' THEN 'diabetes' WHEN 'V27' THEN 'supplementary_v' WHEN 'E909' THEN 'external_causes_e' WHEN 'none, yet' THEN '{UNRECOGNIZED}' ELSE '{MISSING}' END AS diag_1_chapter
FROM kept WHERE rn = 1""",
)
def encounters_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw encounters stored as CSV with ``?`` for nulls, read as text, typed, cleaned and cut to the monitored columns."""
    path = shared_folder(spark, "raw-encounters")
    sinks.write_csv(_raw_encounters(t.table(spark, sf_dir, "orders")).na.fill("?"), path)
    typed = validation.coerced(readers.read_raw_encounters(spark, path), validation.ENCOUNTER_EXPECTATIONS)
    cleaned = preparation.clean_encounters(typed)
    seen = preparation.monitored_features(cleaned, keep=["encounter_id", preparation.TARGET])
    whole = ("encounter_id", preparation.TARGET, "service_utilization", "num_med_changes", "insulin_changed")
    text = ("race", "gender", "payer_code", "medical_specialty", "diag_1_chapter")
    return seen.select(*[F.col(n).cast("bigint").alias(n) for n in whole], *text, F.round("procedure_rate", 6).alias("procedure_rate"))


@query(
    "request_bounds",
    """WITH r AS (SELECT o_orderkey AS encounter_id, o_orderkey % 20 AS days, o_custkey % 30 AS diagnoses, o_orderkey % 11 = 0 AS unknown_gender, o_custkey % 13 = 0 AS long_payer FROM orders)
SELECT encounter_id, days BETWEEN 1 AND 14 AND diagnoses BETWEEN 1 AND 20 AND NOT unknown_gender AND NOT long_payer AS accepted FROM r""",
)
def request_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring requests against the narrower bounds of a request: numbers, domains and lengths of text."""
    sent = _raw_encounters(t.table(spark, sf_dir, "orders")).withColumns(
        {
            "time_in_hospital": F.col("encounter_id") % 20,
            "number_diagnoses": F.col("patient_nbr") % 30,
            "gender": F.when(F.col("encounter_id") % 11 == 0, "none").otherwise(F.col("gender")),
            "payer_code": F.when(F.col("patient_nbr") % 13 == 0, F.repeat(F.lit("x"), F.lit(33))).otherwise(F.col("payer_code")),
        }
    )
    sent = sent.withColumns({n: F.col(n).cast("bigint").cast("string") for n in ("time_in_hospital", "number_diagnoses")}).na.fill("428", ["diag_1"])
    checked = validation.with_violations(sent, validation.REQUEST_EXPECTATIONS)
    good = validation.passing(checked).select("encounter_id", F.lit(True).alias("accepted"))
    bad = validation.quarantined(checked).select("encounter_id", F.lit(False).alias("accepted"))
    return good.unionByName(bad).select(F.col("encounter_id").cast("bigint").alias("encounter_id"), "accepted")


@query(
    "monitoring_reference_scored",
    f"""WITH raw AS (SELECT {", ".join(f'{sql} AS {name}' for name, sql in ENCOUNTER.items())} FROM orders),
kept AS (SELECT *, row_number() OVER (PARTITION BY patient_nbr ORDER BY encounter_id) AS rn FROM raw WHERE discharge_disposition_id NOT IN ({", ".join(map(str, preparation.EXCLUDED_DISCHARGES))}))
SELECT coalesce(race, '{MISSING}') AS race, count(*) AS rows, round(sum(num_procedures / 10), 4) AS score, 26 AS columns FROM kept WHERE rn = 1 GROUP BY 1""",
)
def monitoring_reference_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference of a monitor: cleaned rows scored once and cut to the monitored columns and the score."""
    typed = validation.coerced(_raw_encounters(t.table(spark, sf_dir, "orders")), validation.ENCOUNTER_EXPECTATIONS)
    reference = preparation.monitoring_reference(preparation.clean_encounters(typed), ["encounter_id"], lambda df: df.withColumn("score", F.col("num_procedures") / 10))
    return reference.groupBy("race").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("score"), 4).alias("score"), F.lit(len(reference.columns)).alias("columns"))


# --- partitions, JSON ---------------------------------------------------------------------------
@query(
    "labelled_by_partition",
    """SELECT lang, count(*) AS rows, count(*) FILTER (doc_id % 7 = 0) AS without_length, round(coalesce(sum(CASE WHEN doc_id % 7 <> 0 THEN n_chars / 10 END), 0), 4) AS length,
       CAST(sum(quality) AS BIGINT) AS good FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
)
def labelled_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation table stored by language and read with a stated schema; not-a-number becomes null in a request."""
    length = F.when(F.col("doc_id") % 7 == 0, float("nan")).otherwise(F.col("n_chars") / 10)
    rows = t.table(spark, sf_dir, "documents").join(t.table(spark, sf_dir, "labels"), "doc_id").select("doc_id", length.alias("length"), "quality", "lang")
    path = shared_folder(spark, "labelled")
    sinks.write_partitioned(rows, path, "lang")
    found = preparation.request_payloads(readers.read_labelled(spark, path, rows.schema, "quality"), ["lang", "length", "quality"])
    return found.groupBy("lang").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("length").isNull()).alias("without_length"),
        F.round(F.coalesce(F.sum("length"), F.lit(0.0)), 4).alias("length"), F.sum("quality").cast("bigint").alias("good"),
    )


@query("report_as_json", "SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS users, max('rq-' || event_id) AS last_request FROM events GROUP BY event_type")
def report_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report stored as one JSON object a row, and read back."""
    report = t.table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("users"), F.max(F.concat(F.lit("rq-"), F.col("event_id"))).alias("last_request")
    )
    path = shared_folder(spark, "report")
    sinks.write_json_report(report, path)
    return readers.read_table(spark, path, report.schema, "json").select("event_type", "rows", "users", "last_request")


@query(
    "alias_log_on_file",
    c.with_(c.AUDIT, recursive=True, select="SELECT timestamp_utc, action, alias, from_version, to_version, run_id, reason, actor FROM moves"),
)
def alias_log_on_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alias log appended to in two goes, beside a log that nobody has begun."""
    moves, path = t.alias_moves(spark, sf_dir), shared_folder(spark, "alias-log")
    for alias in ("shadow", "champion"):
        sinks.append_json_lines(moves.where(F.col("alias") == alias), path)
    log = readers.read_alias_log(spark, path).unionByName(readers.read_alias_log(spark, shared_folder(spark, "no-log")))
    return log.select("timestamp_utc", "action", "alias", "from_version", "to_version", "run_id", "reason", "actor")


# --- once and only once -------------------------------------------------------------------------
@query(
    "decisions_first_kept",
    f"""WITH a AS (SELECT event_type AS kind, 'card-' || user_id AS subject, ts, 'a-' || event_id AS approval_id FROM events),
r AS (SELECT n.*, k.kind IS NULL AND row_number() OVER (PARTITION BY n.kind, n.subject ORDER BY n.ts, n.approval_id) = 1 AS accepted
      FROM a n LEFT JOIN (SELECT DISTINCT kind, subject FROM a WHERE ts < TIMESTAMP '{CUT}') k ON k.kind = n.kind AND k.subject = n.subject WHERE n.ts >= TIMESTAMP '{CUT}')
SELECT approval_id, accepted, CASE WHEN NOT accepted THEN subject || ': a ' || lower(kind) || ' decision is on record' END AS refusal FROM r""",
)
def decisions_first_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all decisions on a subject the first stands; the others are refused with the reason."""
    events = t.table(spark, sf_dir, "events")
    made = events.select(F.col("event_type").alias("kind"), F.concat(F.lit("card-"), F.col("user_id")).alias("subject"), "ts", F.concat(F.lit("a-"), F.col("event_id")).alias("approval_id"))
    accepted, refused = sinks.split_decisions(made.where(F.col("ts") >= CUT), made.where(F.col("ts") < CUT))
    kept = accepted.select("approval_id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("refusal"))
    return kept.unionByName(refused.select("approval_id", F.lit(False).alias("accepted"), "refusal"))


@query(
    "verdicts_appended_once",
    f"""WITH v AS (SELECT event_id, user_id AS card_id, event_type AS mode, CASE WHEN user_id % 2 = 1 THEN 'v' || user_id % 3 END AS challenger_version, ts FROM events)
SELECT card_id, mode, challenger_version, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY card_id, mode, challenger_version ORDER BY ts < TIMESTAMP '{CUT}', event_id) AS rn FROM v) WHERE rn = 1""",
)
def verdicts_appended_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts appended late ones first, then all of them: a stored row wins, null versions are equal, keys come once."""
    version = F.when(F.col("user_id") % 2 == 1, F.concat(F.lit("v"), F.col("user_id") % 3))
    made = t.table(spark, sf_dir, "events").select(F.col("user_id").alias("card_id"), F.col("event_type").alias("mode"), version.alias("challenger_version"), "event_id", "ts")
    path = shared_folder(spark, "verdicts")
    for batch in (made.where(F.col("ts") >= CUT), made):
        sinks.append_once(batch, path, sinks.RUN_KEY, order=["event_id"])
    return sinks.stored(spark, path, made).select("card_id", "mode", "challenger_version", "event_id")
