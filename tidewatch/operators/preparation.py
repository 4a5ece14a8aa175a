"""Cleaning, engineered columns, chronological splits and position windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.numbers import hash_bits, safe_ratio
from tidewatch.functions.text import MISSING, SOURCE_GROUPS, code_chapter, map_or_default
from tidewatch.operators.ordering import keys_at_ranks, positions, sample_rows
from tidewatch.sources.readers import require_columns
from tidewatch.sources.schemas import MEDICATIONS

# Discharge codes after which a return cannot happen.
EXCLUDED_DISCHARGES = (11, 13, 14, 19, 20, 21)
CHANGED_DOSES = ("Up", "Down")
TARGET, RAW_TARGET = "readmitted_30d", "readmitted"
NON_FEATURES = ("encounter_id", "patient_nbr", TARGET, RAW_TARGET)

MONITORED_NUMERIC = (
    "time_in_hospital", "num_lab_procedures", "num_procedures", "num_medications", "number_outpatient",
    "number_emergency", "number_inpatient", "number_diagnoses", "service_utilization", "num_med_changes",
    "insulin_changed", "procedure_rate",
)
MONITORED_CATEGORICAL = (
    "race", "gender", "age", "payer_code", "medical_specialty", "max_glu_serum", "A1Cresult", "change",
    "diabetesMed", "diag_1_chapter", "diag_2_chapter", "diag_3_chapter", "admission_source_group",
)


def without_codes(df: DataFrame, column: str, codes: Sequence) -> DataFrame:
    """Drops rows holding one of the codes; a null code is kept."""
    return df.where(~F.coalesce(F.col(column).isin(*codes), F.lit(False)))


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes first in ``order``.

    A map-side combining aggregate, so a key with a third of the rows costs no more than one
    row per map task.
    """
    rest = [c for c in df.columns if c != key]
    kept = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__row"))
    return kept.select(key, "__row.*").select(*df.columns)


def has_repeated_key(df: DataFrame, key: str) -> bool:
    return bool(df.groupBy(key).count().where("count > 1").limit(1).take(1))


def fill_missing(df: DataFrame, drop: Sequence[str], fill: Sequence[str]) -> DataFrame:
    return df.drop(*drop).na.fill(MISSING, subset=list(fill))


def binary_target(df: DataFrame, source: str = RAW_TARGET, positive: str = "<30", out: str = TARGET) -> DataFrame:
    flag = F.coalesce(F.col(source) == positive, F.lit(False)).cast("int")
    return df.withColumn(out, flag).drop(source)


def clean_encounters(df: DataFrame) -> DataFrame:
    """Exclusions come before the dedup: a patient whose first stay is excluded keeps the next."""
    return (
        df.transform(without_codes, "discharge_disposition_id", EXCLUDED_DISCHARGES)
        .transform(first_per_key, "patient_nbr", "encounter_id")
        .transform(fill_missing, ["weight"], ["payer_code", "medical_specialty"])
        .transform(binary_target)
    )


def matching_columns(columns: Sequence[str], values: Sequence[str]) -> Column:
    """How many of the columns hold one of the values; nulls match nothing."""
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce(F.col(f"`{c}`").isin(*values), F.lit(False)).cast("int")
    return total


def engineer(df: DataFrame) -> DataFrame:
    """Adds the eight derived columns."""
    return df.withColumns(
        {
            "service_utilization": F.col("number_outpatient") + F.col("number_emergency") + F.col("number_inpatient"),
            "num_med_changes": matching_columns(MEDICATIONS, CHANGED_DOSES),
            "insulin_changed": matching_columns(["insulin"], CHANGED_DOSES),
            "procedure_rate": safe_ratio("num_procedures", "time_in_hospital"),
            "diag_1_chapter": code_chapter("diag_1"),
            "diag_2_chapter": code_chapter("diag_2"),
            "diag_3_chapter": code_chapter("diag_3"),
            "admission_source_group": map_or_default("admission_source_id", SOURCE_GROUPS),
        }
    )


def monitored_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The 25 monitored columns (and any window keys), null categories made explicit."""
    wide = engineer(df)
    names = [*MONITORED_NUMERIC, *MONITORED_CATEGORICAL]
    require_columns(wide, names, "monitored frame")
    return wide.select(*keep, *names).na.fill(MISSING, subset=list(MONITORED_CATEGORICAL))


def model_inputs(df: DataFrame) -> DataFrame:
    return df.drop(*NON_FEATURES)


def features_and_target(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    require_columns(df, [TARGET], "training frame")
    return df.drop(*NON_FEATURES), df.select(TARGET)


def request_payloads(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The contract columns with not-a-number turned into null."""
    floats = {c for c, kind in df.dtypes if kind in ("double", "float")}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in columns])


def chronological_split(
    df: DataFrame,
    order: str,
    train: float = 0.70,
    evaluate: float = 0.15,
    *,
    unique_key: str | None = None,
    out: str = "split",
) -> DataFrame:
    """Tags contiguous train / eval_frozen / future_stream blocks in the order of a unique key.

    The cuts are whole-row counts rounded down. Only the two keys at the cuts are looked up;
    tagging compares each row with them, so the rows themselves are not shuffled.
    """
    if unique_key is not None and has_repeated_key(df, unique_key):
        raise ValueError(f"split needs one row per {unique_key}")
    first = F.floor(F.col("__rows") * F.lit(train))
    second = first + F.floor(F.col("__rows") * F.lit(evaluate))
    cuts = F.broadcast(keys_at_ranks(df, order, {"__first": first, "__second": second}))
    block = (
        F.when(F.col(order) >= F.col("__second"), F.lit("future_stream"))
        .when(F.col(order) >= F.col("__first"), F.lit("eval_frozen"))
        .otherwise(F.lit("train"))
    )
    return df.join(cuts).withColumn(out, block).drop("__first", "__second")


def validation_tail(df: DataFrame, order: str, fraction: float = 0.15, out: str = "is_validation") -> DataFrame:
    """Flags the last ``fraction`` of the rows in the order of a unique key."""
    cut = F.broadcast(keys_at_ranks(df, order, {"__cut": F.floor(F.col("__rows") * F.lit(1.0 - fraction))}))
    return df.join(cut).withColumn(out, F.coalesce(F.col(order) >= F.col("__cut"), F.lit(False))).drop("__cut")


def shared_keys(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys found in more than one split; a leak-free split has none."""
    return (
        df.groupBy(key)
        .agg(F.count_distinct(F.col(split)).alias("splits"))
        .where("splits > 1")
    )


def grouped_holdout(
    df: DataFrame, group: str, percent: int = 20, seed: int | str = 42, out: str = "is_test", portable: bool = False
) -> DataFrame:
    """A random split that keeps each group whole."""
    return df.withColumn(out, F.pmod(hash_bits([group], seed, portable), F.lit(100)) < percent)


def row_windows(
    df: DataFrame,
    order: str,
    tie: str,
    rows: int,
    *,
    groups: Sequence[str] = (),
    keep_partial: bool = True,
    max_windows: int | None = None,
    out: str = "window_index",
) -> DataFrame:
    """Contiguous blocks of ``rows`` rows in stream order; a short last block stays unless told otherwise."""
    if rows < 1:
        raise ValueError("a window needs at least one row")
    placed = positions(df, order, tie, groups=groups, out="__pos", total="__rows")
    placed = placed.withColumn(out, F.floor(F.col("__pos") / F.lit(rows)))
    if max_windows is not None:
        placed = placed.where(F.col(out) < max_windows)
    if not keep_partial:
        placed = placed.where((F.col(out) + 1) * rows <= F.col("__rows"))
    return placed.drop("__pos", "__rows")


def window_start(index: Column | str, epoch: str = "2026-01-01 00:00:00", seconds: int = 86400) -> Column:
    """Bounds derived from the block's place, never from a clock."""
    c = F.col(index) if isinstance(index, str) else index
    return F.timestamp_seconds(F.unix_timestamp(F.lit(epoch).cast("timestamp")) + c.cast("bigint") * seconds)


def window_end(index: Column | str, epoch: str = "2026-01-01 00:00:00", seconds: int = 86400) -> Column:
    c = F.col(index) if isinstance(index, str) else index
    return window_start(c + 1, epoch, seconds)


def next_window_index(events: DataFrame, scenario: str = "scenario", start: str = "window_start", epoch: str = "2026-01-01 00:00:00", seconds: int = 86400) -> DataFrame:
    """The block after the last one on record, per stream."""
    offset = F.unix_timestamp(F.col(start)) - F.unix_timestamp(F.lit(epoch).cast("timestamp"))
    return events.groupBy(scenario).agg((F.max(F.round(offset / seconds)) + 1).cast("bigint").alias("next_index"))


def rows_of_windows(df: DataFrame, windows: DataFrame, keys: Sequence[str] = ("scenario", "window_start")) -> DataFrame:
    """The rows of the named windows: each is found again by its stream and start."""
    return df.join(windows.select(*keys).distinct(), list(keys), "left_semi")


def next_windows(windowed: DataFrame, events: DataFrame, scenario: str = "scenario", index: str = "window_index") -> DataFrame:
    """The rows of the one window of each stream that comes after those on record."""
    due = next_window_index(events)
    joined = windowed.join(due, scenario, "left")
    return joined.where(F.col(index) == F.coalesce("next_index", F.lit(0))).drop("next_index")


def monitoring_reference(df: DataFrame, keys: Sequence[str], score: Callable[[DataFrame], DataFrame], rows: int | None = None, seed: int | str = 42) -> DataFrame:
    """The reference of a monitor, scored once, monitored columns only: all rows, or an exact repeatable sample of ``rows``.

    ``score`` adds the score column to the rows. Persist or store the result; every
    window is measured against it.
    """
    scored = score(sample_rows(df, keys, rows, seed))
    added = [c for c in scored.columns if c not in df.columns]
    return monitored_features(scored, keep=added)


def value_shares(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    total = F.broadcast(counts.agg(F.sum("rows").alias("__total")))
    return counts.join(total).select(column, "rows", (F.col("rows").cast("double") / F.col("__total")).alias("share"))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """How many keys there are, how many come more than once, and the most copies of one."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("n") > 1).alias("repeated"), F.max("n").alias("most"))


def filtered_share(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.avg(F.coalesce(condition, F.lit(False)).cast("double")).alias("share"))


def day_windows(df: DataFrame, ts: str, spine: DataFrame, aggregates: Sequence[Column], fill: dict) -> DataFrame:
    """One row per day of ``spine`` (a ``window_date`` column), days without rows included."""
    measured = df.groupBy(F.col(ts).cast("date").alias("window_date")).agg(*aggregates)
    return spine.join(measured, "window_date", "left").na.fill(fill)
