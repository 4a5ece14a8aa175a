"""Checks as data: every failing rule of every row, reports, quarantine and null profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.sources.schemas import MEDICATIONS


@dataclass(frozen=True)
class Expectation:
    """What one column must be. Checks other than ``nullable`` ignore nulls."""

    name: str
    kind: str
    nullable: bool = False
    unique: bool = False
    isin: tuple = ()
    between: tuple | None = None
    at_least: float | None = None
    matches: str | None = None
    max_length: int | None = None


def _row_rules(e: Expectation) -> list[tuple[str, Column]]:
    raw = F.col(f"`{e.name}`")
    value = raw.try_cast(e.kind)
    rules = [(f"{e.name}:type", raw.isNotNull() & value.isNull())]
    if not e.nullable:
        rules.append((f"{e.name}:not_null", raw.isNull()))
    if e.isin:
        rules.append((f"{e.name}:isin", ~value.isin(*e.isin)))
    if e.between:
        rules.append((f"{e.name}:between", ~value.between(*e.between)))
    if e.at_least is not None:
        rules.append((f"{e.name}:at_least", value < e.at_least))
    if e.matches:
        rules.append((f"{e.name}:matches", ~value.rlike(e.matches)))
    if e.max_length is not None:
        rules.append((f"{e.name}:max_length", F.length(raw) > e.max_length))
    return rules


def with_violations(df: DataFrame, expectations: Sequence[Expectation], out: str = "violations") -> DataFrame:
    """Adds the names of all failed rules of each row; an empty array when none failed.

    Repeated key values are found by a pre-aggregated count and joined back; that small
    side is broadcast, or the join skew-split, by adaptive execution.
    """
    found = [F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for e in expectations for name, broken in _row_rules(e)]
    for e in (e for e in expectations if e.unique):
        flag = f"__dup_{e.name}"
        repeated = df.where(F.col(e.name).isNotNull()).groupBy(e.name).count().where("count > 1").select(e.name, F.lit(True).alias(flag))
        df = df.join(repeated, e.name, "left")
        found.append(F.when(F.col(flag), F.lit(f"{e.name}:unique")))
    flags = [c for c in df.columns if c.startswith("__dup_")]
    return df.withColumn(out, F.array_compact(F.array(*found))).drop(*flags)


def violation_report(checked: DataFrame, violations: str = "violations") -> DataFrame:
    """Failures per rule over the whole frame."""
    return (
        checked.select(F.explode(violations).alias("violation"))
        .groupBy("violation")
        .agg(F.count(F.lit(1)).alias("failures"))
        .select(
            F.substring_index("violation", ":", 1).alias("column_name"),
            F.substring_index("violation", ":", -1).alias("rule"),
            "failures",
        )
    )


def passing(checked: DataFrame, violations: str = "violations") -> DataFrame:
    return checked.where(F.size(violations) == 0).drop(violations)


def quarantined(checked: DataFrame, violations: str = "violations") -> DataFrame:
    return checked.where(F.size(violations) > 0)


def coerced(df: DataFrame, expectations: Sequence[Expectation]) -> DataFrame:
    return df.withColumns({e.name: F.col(f"`{e.name}`").try_cast(e.kind) for e in expectations})


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of nulls per column, one pass, only columns that have any, largest first."""
    names = list(columns or df.columns)
    rates = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in names])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("null_rate")) for c in names])
    return rates.select(F.inline(pairs)).where("null_rate > 0").orderBy(F.desc("null_rate"), "column_name")


# The domains of a raw encounter.
_MEDICATION_VALUES = ("No", "Steady", "Up", "Down")
ENCOUNTER_EXPECTATIONS: tuple[Expectation, ...] = (
    Expectation("encounter_id", "bigint", unique=True),
    Expectation("patient_nbr", "bigint"),
    Expectation("race", "string", nullable=True),
    Expectation("gender", "string", isin=("Female", "Male", "Unknown/Invalid")),
    Expectation("age", "string", matches=r"^\[\d+-\d+\)$"),
    Expectation("weight", "string", nullable=True),
    Expectation("admission_type_id", "int", between=(1, 8)),
    Expectation("discharge_disposition_id", "int", between=(1, 30)),
    Expectation("admission_source_id", "int", between=(1, 30)),
    Expectation("time_in_hospital", "int", between=(1, 14)),
    Expectation("payer_code", "string", nullable=True),
    Expectation("medical_specialty", "string", nullable=True),
    Expectation("num_lab_procedures", "int", at_least=0),
    Expectation("num_procedures", "int", at_least=0),
    Expectation("num_medications", "int", at_least=0),
    Expectation("number_outpatient", "int", at_least=0),
    Expectation("number_emergency", "int", at_least=0),
    Expectation("number_inpatient", "int", at_least=0),
    Expectation("diag_1", "string", nullable=True),
    Expectation("diag_2", "string", nullable=True),
    Expectation("diag_3", "string", nullable=True),
    Expectation("number_diagnoses", "int", at_least=1),
    Expectation("max_glu_serum", "string", nullable=True, isin=(">200", ">300", "Norm")),
    Expectation("A1Cresult", "string", nullable=True, isin=(">7", ">8", "Norm")),
    *[Expectation(m, "string", nullable=True, isin=_MEDICATION_VALUES) for m in MEDICATIONS],
    Expectation("change", "string", isin=("Ch", "No")),
    Expectation("diabetesMed", "string", isin=("Yes", "No")),
    Expectation("readmitted", "string", isin=("NO", ">30", "<30")),
)

# The narrower bounds one scoring request must keep.
REQUEST_EXPECTATIONS: tuple[Expectation, ...] = (
    Expectation("time_in_hospital", "int", between=(1, 14)),
    Expectation("num_lab_procedures", "int", between=(0, 200)),
    Expectation("num_procedures", "int", between=(0, 20)),
    Expectation("num_medications", "int", between=(0, 200)),
    Expectation("number_outpatient", "int", between=(0, 100)),
    Expectation("number_emergency", "int", between=(0, 100)),
    Expectation("number_inpatient", "int", between=(0, 100)),
    Expectation("number_diagnoses", "int", between=(1, 20)),
    Expectation("admission_source_id", "int", between=(1, 30)),
    Expectation("race", "string", nullable=True, max_length=64),
    Expectation("gender", "string", isin=("Female", "Male", "Unknown/Invalid")),
    Expectation("age", "string", matches=r"^\[\d+-\d+\)$"),
    Expectation("payer_code", "string", nullable=True, max_length=32),
    Expectation("medical_specialty", "string", nullable=True, max_length=128),
    Expectation("max_glu_serum", "string", nullable=True, isin=(">200", ">300", "Norm")),
    Expectation("A1Cresult", "string", nullable=True, isin=(">7", ">8", "Norm")),
    Expectation("change", "string", isin=("Ch", "No")),
    Expectation("diabetesMed", "string", isin=("Yes", "No")),
    Expectation("diag_1", "string", nullable=True, max_length=16),
    Expectation("diag_2", "string", nullable=True, max_length=16),
    Expectation("diag_3", "string", nullable=True, max_length=16),
    *[Expectation(m, "string", isin=_MEDICATION_VALUES) for m in MEDICATIONS],
)
