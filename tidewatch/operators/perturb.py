"""Repeatable table perturbations used to back-test a monitor.

Draws are hashes of each row's key and a seed, so the outcome does not depend on how the
frame is partitioned. ``portable`` draws use md5 instead of xxhash64, for checks that another
engine repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.numbers import hash_normal, hash_uniform
from tidewatch.operators.ordering import BUCKET, assign_buckets, cut_points, hash_select, positions, sort_key
from tidewatch.operators.preparation import TARGET

SEED = 42
# The sizes of the five standard perturbations.
SHIFTED_COLUMNS = ("num_lab_procedures", "num_medications")
SHIFT_SCALE, SHIFT_JITTER = 1.20, 1.0
RECODED_COLUMN, RECODED_FRACTION = "A1Cresult", 0.40
RECODED_VALUES = ((">7", 0.25), (">8", 0.20), ("Norm", 0.55))
OLDER_BANDS, OLDER_WEIGHT, FREQUENT_WEIGHT = ("[70-80)", "[80-90)", "[90-100)"), 4, 3
RELABELLED_FRACTION = 0.30


def scale_jitter(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], scale: float = SHIFT_SCALE, sd: float = SHIFT_JITTER,
    seed: int | str = SEED, portable: bool = False,
) -> DataFrame:
    """Scales, jitters and rounds half to even, never below the column's own minimum."""
    floors = F.broadcast(df.agg(*[F.min(c).alias(f"__min_{c}") for c in columns]))
    joined = df.join(floors)
    moved = {
        c: F.greatest(
            F.rint(F.col(c).cast("double") * scale + hash_normal(keys, f"{seed}-{c}", portable) * sd),
            F.col(f"__min_{c}").cast("double"),
        ).cast("bigint")
        for c in columns
    }
    return joined.withColumns(moved).drop(*floors.columns)


def pick_weighted(u: Column, weighted: Sequence[tuple[str, float]]) -> Column:
    """The value whose cumulative weight interval holds ``u``."""
    total, out = 0.0, None
    for value, weight in weighted[:-1]:
        total += weight
        out = F.when(u < total, F.lit(value)) if out is None else out.when(u < total, F.lit(value))
    last = F.lit(weighted[-1][0])
    return last if out is None else out.otherwise(last)


def fill_nulls(
    df: DataFrame, keys: Sequence[str], column: str = RECODED_COLUMN, fraction: float = RECODED_FRACTION,
    weighted: Sequence[tuple[str, float]] = RECODED_VALUES, seed: int | str = SEED, portable: bool = False,
) -> DataFrame:
    """Gives exactly the rounded fraction of the nulls a value drawn by weight."""
    chosen = hash_select(df, keys, fraction=fraction, seed=f"{seed}-rows", where=F.col(column).isNull(), portable=portable, out="__sel")
    drawn = pick_weighted(hash_uniform(keys, f"{seed}-values", portable), weighted)
    return chosen.withColumn(column, F.when(F.col("__sel"), drawn).otherwise(F.col(column))).drop("__sel").select(*df.columns)


def weighted_resample(
    df: DataFrame, order: str, weight: Column, offset: float = 0.5, ids: Sequence[str] | None = None,
) -> DataFrame:
    """Systematic resampling with replacement: exactly as many rows out as in.

    The weights' prefix sum divides [0, n) among the rows in key order; a row is repeated once
    per whole number in its share. The k-th row out takes the k-th identifier in order, so
    identifiers stay unique. Weights are whole numbers, which keeps the sums exact.
    """
    ids = list(ids or [order])
    key = "__order_key"
    keyed = df.withColumns({key: sort_key(df, order), "__w": weight.cast("bigint")})
    keyed = assign_buckets(keyed, {key: (BUCKET, cut_points(keyed, [key])[key])})
    every = Window.partitionBy(F.lit(0))
    earlier = every.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(  # one row per bucket
        keyed.groupBy(BUCKET)
        .agg(F.sum("__w").alias("__part"), F.count(F.lit(1)).alias("__cnt"))
        .select(
            BUCKET,
            F.coalesce(F.sum("__part").over(earlier), F.lit(0)).alias("__base"),
            F.sum("__part").over(every).alias("__all"),
            F.sum("__cnt").over(every).alias("__n"),
        )
    )
    inside = Window.partitionBy(BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = keyed.withColumn("__upto", F.sum("__w").over(inside)).join(offsets, BUCKET)
    upto = F.col("__base") + F.col("__upto")

    def place(total: Column) -> Column:
        return F.floor(total.cast("double") / F.col("__all").cast("double") * F.col("__n") + F.lit(offset))

    first, last = place(upto - F.col("__w")), place(upto)
    copies = summed.withColumns({"__first": first, "__last": last - 1}).where("__last >= __first")
    # Two short sequences instead of one: a row of huge weight never becomes one huge array.
    step = 65536
    pieces = copies.withColumn("__piece", F.explode(F.sequence("__first", "__last", F.lit(step).cast("bigint"))))
    inner = F.sequence(F.col("__piece"), F.least(F.col("__piece") + step - 1, F.col("__last")))
    drawn = pieces.withColumn("__pos", F.explode(inner))
    labels = positions(df.select(*ids), order, order, out="__pos")
    body = [c for c in df.columns if c not in ids]
    return drawn.select("__pos", *body).join(labels, "__pos").select(*df.columns)


def relabel_at_base_rate(
    df: DataFrame, keys: Sequence[str], target: str = TARGET, fraction: float = RELABELLED_FRACTION,
    seed: int | str = SEED, portable: bool = False,
) -> DataFrame:
    """Redraws the label of an exact fraction of rows at the frame's own positive rate."""
    if target not in df.columns:
        raise ValueError(f"label column {target!r} is missing")
    rate = F.broadcast(df.agg(F.avg(F.col(target).cast("double")).alias("__rate")))
    chosen = hash_select(df, keys, fraction=fraction, seed=f"{seed}-rows", portable=portable, out="__sel").join(rate)
    redrawn = (hash_uniform(keys, f"{seed}-labels", portable) < F.col("__rate")).cast("int")
    return chosen.withColumn(target, F.when(F.col("__sel"), redrawn).otherwise(F.col(target))).select(*df.columns)


def unchanged(df: DataFrame) -> DataFrame:
    return df


def invert_score(df: DataFrame, score: str, out: str | None = None) -> DataFrame:
    """A known-bad model: the same ranking, upside down."""
    return df.withColumn(out or score, F.lit(1.0) - F.col(score))


def case_mix_weight() -> Column:
    visits = F.col("number_inpatient") + F.col("number_emergency") + F.col("number_outpatient")
    older = F.when(F.col("age").isin(*OLDER_BANDS), OLDER_WEIGHT).otherwise(1)
    return older * F.when(visits >= 1, FREQUENT_WEIGHT).otherwise(1)


STANDARD: dict[str, Callable[[DataFrame, int | str], DataFrame]] = {
    "S1": lambda df, seed: scale_jitter(df, ["encounter_id"], SHIFTED_COLUMNS, seed=seed),
    "S2": lambda df, seed: fill_nulls(df, ["encounter_id"], seed=seed),
    "S3": lambda df, seed: weighted_resample(df, "encounter_id", case_mix_weight()),
    "S4": lambda df, seed: relabel_at_base_rate(df, ["encounter_id"], seed=seed),
    "S5": lambda df, seed: unchanged(df),
}


def apply_named(df: DataFrame, name: str, seed: int | str = SEED, registry: dict | None = None) -> DataFrame:
    known = registry or STANDARD
    if name.upper() not in known:
        raise KeyError(f"unknown perturbation {name!r}; known: {', '.join(sorted(known))}")
    return known[name.upper()](df, seed)
