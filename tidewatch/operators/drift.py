"""Distribution drift of many windows and features at once.

All windows and features are measured by a fixed number of aggregations, however many there
are. The reference is never repeated per window: category shares are joined to counts, and
numeric windows look their own bin edges up in one cumulative reference distribution.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from tidewatch.functions.numbers import SHARE_FLOOR, digest_id, kolmogorov_p, psi_term, share
from tidewatch.operators.ordering import (
    salted_join,
    BUCKET,
    assign_buckets,
    assign_buckets_long,
    cut_points,
    exact_quantiles,
    union_all,
)

NUMERIC, CATEGORICAL = "numerical", "categorical"
# The thresholds a measurement is taken under.
PSI_BREACH, PSI_SEVERE, KS_P_VALUE, PREDICTION_PSI = 0.10, 0.25, 0.05, 0.10


@dataclass(frozen=True)
class MonitorSpec:
    """Which columns are watched, and the keys that name a window."""

    keys: tuple[str, ...]
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    score: str | None = None

    @property
    def all_numeric(self) -> tuple[str, ...]:
        return (*self.numeric, self.score) if self.score else self.numeric

    @property
    def monitored(self) -> int:
        return len(self.numeric) + len(self.categorical)


def unpivot_values(df: DataFrame, keys: Sequence[str], columns: Sequence[str], kind: str, buckets: Mapping[str, str] | None = None) -> DataFrame:
    """(keys, feature, value) for each column, nulls and not-a-numbers left out."""
    rows = ", ".join(f"'{c}', CAST(`{c}` AS {kind})" + (f", `{buckets[c]}`" if buckets else "") for c in columns)
    names = "feature, value" + (f", {BUCKET}" if buckets else "")
    long = df.selectExpr(*[f"`{k}`" for k in keys], f"stack({len(columns)}, {rows}) AS ({names})")
    return long.where("value IS NOT NULL AND NOT isnan(value)" if kind == "double" else "value IS NOT NULL")


# --- shares and stability index --------------------------------------------------------
def psi_from_shares(df: DataFrame, keys: Sequence[str], reference: str, current: str, out: str = "psi") -> DataFrame:
    """Stability index of binned counts or shares: one row per (keys, bin) in, one per key out."""
    sides = df.groupBy(*keys).agg(F.sum(reference).alias("__r"), F.sum(current).alias("__c"))
    joined = df.join(sides, list(keys)) if keys else df.join(F.broadcast(sides))
    term = psi_term(share(F.col(reference), F.col("__r")), share(F.col(current), F.col("__c")))
    return joined.groupBy(*keys).agg(F.sum(term).alias(out))


def psi_from_counts(reference: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, feature, psi, ref_rows, cur_rows) from counts per bin.

    ``reference`` is (feature, bin, n_ref), ``current`` (keys, feature, bin, n_cur). A bin a
    window lacks still counts, by its reference share against the floor. Those terms are summed
    once per feature and corrected by the bins the window does have, so no windows x bins table
    is built, however many bins a feature has.
    """
    floor = F.lit(SHARE_FLOOR)
    r = share(F.col("n_ref"), F.col("ref_rows"))
    ref_rows = reference.groupBy("feature").agg(F.sum("n_ref").alias("ref_rows"))
    absent = reference.join(F.broadcast(ref_rows), "feature").groupBy("feature").agg(  # one row per feature
        F.sum(psi_term(r, floor)).alias("all_absent"), F.max("ref_rows").alias("ref_rows")
    )
    cur_rows = current.groupBy(*keys, "feature").agg(F.sum("n_cur").alias("cur_rows"))
    present = current.join(reference, ["feature", "bin"], "left").join(cur_rows, [*keys, "feature"]).join(F.broadcast(absent), "feature")
    c = share(F.col("n_cur"), F.col("cur_rows"))
    correction = psi_term(r, c) - psi_term(r, floor)
    return present.groupBy(*keys, "feature").agg(
        (F.max("all_absent") + F.sum(correction)).alias("psi"),
        F.max("ref_rows").alias("ref_rows"),
        F.max("cur_rows").alias("cur_rows"),
    )


def categorical_psi(reference: DataFrame, serving: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys, feature, psi) with one bin per category either side has; nulls are left out."""

    def counts(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
        long = unpivot_values(df, by, features, "string").withColumnRenamed("value", "bin")
        return long.groupBy(*by, "feature", "bin").agg(F.count(F.lit(1)).alias(name))

    return psi_from_counts(counts(reference, [], "n_ref"), counts(serving, keys, "n_cur"), keys)


def reference_quantile_edges(reference: DataFrame, features: Sequence[str], bins: int = 10) -> dict[str, list[float]]:
    """Distinct reference quantiles per feature; features x (bins + 1) numbers on the driver.

    Quantiles are exact and ranked over distributed running totals.
    """
    cuts = cut_points(_numeric(reference, [], features), list(features))
    counted = value_counts(reference, [], features, cuts)
    names = {f"q{i}": i / bins for i in range(bins + 1)}
    found: dict[str, set[float]] = {c: set() for c in features}
    for row in exact_quantiles(counted, ["feature"], "value", names, weight="n").collect():
        found[row["feature"]].add(row["quantile"])
    return {c: sorted(v) for c, v in found.items()}


def quantile_bins(edges: Sequence[float]) -> list[float]:
    """Cut points inside the open outer bins.

    A constant reference is cut into below, equal and above; otherwise the first and last
    quantile are not cuts. Two distinct quantiles therefore leave one bin.
    """
    if len(edges) == 1:
        return [edges[0], math.nextafter(edges[0], math.inf)]
    return list(edges[1:-1])


def binned_psi(reference: DataFrame, serving: DataFrame, keys: Sequence[str], cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """(keys, feature, psi) with the same cut points for every window."""
    plan = {c: (f"__bin_{c}", points) for c, points in cuts.items()}
    ref = assign_buckets(reference.select(*[F.col(c).cast("double").alias(c) for c in cuts]), plan)
    cur = assign_buckets(serving.select(*keys, *[F.col(c).cast("double").alias(c) for c in cuts]), plan)
    rename = {f"__bin_{c}": c for c in cuts}
    ref = ref.select(*[F.col(b).alias(c) for b, c in rename.items()])
    cur = cur.select(*keys, *[F.col(b).alias(c) for b, c in rename.items()])
    return categorical_psi(ref, cur, keys, list(cuts))


def quantile_psi(reference: DataFrame, serving: DataFrame, keys: Sequence[str], features: Sequence[str], bins: int = 10) -> DataFrame:
    """Numeric stability index binned at reference quantiles, half-open bins, outer bins open."""
    edges = reference_quantile_edges(reference, features, bins)
    return binned_psi(reference, serving, keys, {c: quantile_bins(e) for c, e in edges.items()})


def population_stability(reference: DataFrame, serving: DataFrame, spec: MonitorSpec, bins: int = 10) -> DataFrame:
    """Both kinds at once: (keys, feature, kind, psi)."""
    parts = []
    if spec.numeric:
        parts.append(quantile_psi(reference, serving, spec.keys, spec.numeric, bins).withColumn("kind", F.lit(NUMERIC)))
    if spec.categorical:
        parts.append(categorical_psi(reference, serving, spec.keys, spec.categorical).withColumn("kind", F.lit(CATEGORICAL)))
    return union_all(parts)


# --- numeric drift against one cumulative reference -------------------------------------
def _numeric(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    return df.selectExpr(*[f"`{k}`" for k in keys], *[f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in features])


def numeric_cuts(reference: DataFrame, serving: DataFrame, features: Sequence[str]) -> dict[str, list[float]]:
    both = _numeric(reference, [], features).unionByName(_numeric(serving, [], features))
    return cut_points(both, list(features))


def bucketed_values(df: DataFrame, keys: Sequence[str], features: Sequence[str], cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """(keys, feature, bucket, value) of every usable number; rows without keys are in no window."""
    wide = _numeric(df, keys, features)
    for k in keys:
        wide = wide.where(F.col(k).isNotNull())
    wide = assign_buckets(wide, {c: (f"__b_{c}", cuts[c]) for c in features})
    return unpivot_values(wide, keys, features, "double", {c: f"__b_{c}" for c in features})


def value_counts(df: DataFrame, keys: Sequence[str], features: Sequence[str], cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """(keys, feature, bucket, value, n): distinct values counted before any ordering."""
    return bucketed_values(df, keys, features, cuts).groupBy(*keys, "feature", BUCKET, "value").agg(F.count(F.lit(1)).alias("n"))


def bucket_counts(df: DataFrame, keys: Sequence[str], features: Sequence[str], cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """(keys, feature, bucket, n), combined in the map tasks and small after the shuffle."""
    return bucketed_values(df, keys, features, cuts).groupBy(*keys, "feature", BUCKET).agg(F.count(F.lit(1)).alias("n"))


def _no_keys(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    kinds = dict(df.dtypes)
    return [F.lit(None).cast(kinds[k]).alias(k) for k in keys]


def _prior(partition: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)


# The bin of a value among equal-width bins, settled against the edges lo + i * step themselves. The guess is a
# column of its own: written out at each mention, the generated method outgrew what the JVM compiles.
_GUESS = "greatest(least(CAST(floor(try_divide(value - lo, step)) AS INT), bins - 1), 0)"
_DOWN = "CASE WHEN guess > 0 AND value < lo + guess * step THEN guess - 1 ELSE guess END"
_EQUAL_WIDTH_BIN = f"CASE WHEN guess < bins - 1 AND value >= lo + (guess + 1) * step THEN guess + 1 ELSE {_DOWN} END"


def sturges_psi(
    reference: DataFrame, serving: DataFrame, keys: Sequence[str], features: Sequence[str], cuts: Mapping[str, Sequence[float]] | None = None
) -> DataFrame:
    """Numeric stability index on equal-width bins: (keys, feature, psi, ref_rows, cur_rows).

    Each window is pooled with the reference; the number of bins is ceil(log2(n) + 1) for n
    pooled rows. Serving rows are binned where they lie, so only bounds and bin counts are
    shuffled. Edges differ per window, so they join the ordered reference values as rows of
    weight zero: the running reference count at an edge is the number of rows below it.
    """
    keys, by = list(keys), [*keys, "feature"]
    cuts = cuts or cut_points(_numeric(reference, [], features), list(features))
    ref = value_counts(reference, [], features, cuts)

    rows = _numeric(serving, keys, features)
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    rows = rows.withColumns({c: F.expr(f"CASE WHEN NOT isnan(`{c}`) THEN `{c}` END") for c in features})

    def bounds(df: DataFrame, group: Sequence[str], side: str) -> DataFrame:
        found = df.groupBy(*group).agg(*[F.expr(f"struct(min(`{c}`) AS lo, max(`{c}`) AS hi, count(`{c}`) AS n)").alias(c) for c in features])
        pieces = ", ".join(f"'{c}', `{c}`.lo, `{c}`.hi, `{c}`.n" for c in features)
        return found.selectExpr(*group, f"stack({len(features)}, {pieces}) AS (feature, lo_{side}, hi_{side}, {side}_rows)").where(f"{side}_rows > 0")

    clean = _numeric(reference, [], features).withColumns({c: F.expr(f"CASE WHEN NOT isnan(`{c}`) THEN `{c}` END") for c in features})
    pooled = bounds(rows, keys, "cur").join(F.broadcast(bounds(clean, [], "ref")), "feature")  # one row per feature
    plan = pooled.selectExpr(
        *by, "ref_rows", "cur_rows", "least(lo_ref, lo_cur) AS lo", "greatest(hi_ref, hi_cur) AS hi", "CAST(ceil(log2(CAST(ref_rows + cur_rows AS DOUBLE)) + 1) AS INT) AS bins"
    ).withColumn("step", F.expr("(hi - lo) / bins"))
    spreading = plan.where("hi > lo")

    # Reference rows below each inner edge.
    edges = spreading.selectExpr(*by, "lo", "step", "explode(sequence(1, bins - 1)) AS edge").selectExpr(*by, "edge", "lo + edge * step AS value")
    edges = assign_buckets_long(edges, "feature", "value", cuts)
    marked = ref.select("feature", BUCKET, "value", "n", F.lit(1).alias("__after"), *_no_keys(serving, keys), F.lit(None).cast("int").alias("edge"))
    asked = edges.select("feature", BUCKET, "value", F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("__after"), *keys, "edge")
    inside = Window.partitionBy("feature", BUCKET).orderBy("value", "__after").rowsBetween(Window.unboundedPreceding, 0)
    looked = marked.unionByName(asked).withColumn("__in", F.sum("n").over(inside)).where("edge is not null")
    per_bucket = bucket_counts(reference, [], features, cuts).unionByName(asked.select("feature", BUCKET, "n")).groupBy("feature", BUCKET).agg(F.sum("n").alias("n"))
    carried = per_bucket.select("feature", BUCKET, F.coalesce(F.sum("n").over(_prior(["feature"])), F.lit(0)).alias("__base"))
    below = looked.join(carried, ["feature", BUCKET]).selectExpr(*by, "edge", "__base + __in AS below")

    # Bin counts of the reference: differences of the counts below successive edges.
    last = spreading.selectExpr(*by, "bins AS edge", "ref_rows AS below")
    steps = Window.partitionBy(*by).orderBy("edge")
    ref_bins = below.unionByName(last).select(*by, (F.col("edge") - 1).alias("bin"), (F.col("below") - F.coalesce(F.lag("below").over(steps), F.lit(0))).alias("n_ref"))

    # Bin counts of each window. Plans are one row per window; a large window's rows are spread by salt.
    wide = spreading.groupBy(*keys).agg(*[F.expr(f"max(CASE WHEN feature = '{c}' THEN struct(lo, step, bins) END)").alias(f"__p_{c}") for c in features])
    guessed = salted_join(rows, wide, keys).withColumns({f"__g_{c}": F.expr(_of_plan(_GUESS, c)) for c in features})
    placed = guessed.selectExpr(*keys, *[f"{_bin_of(c)} AS `{c}`" for c in features])
    cur_bins = unpivot_values(placed, keys, features, "int").groupBy(*by, F.col("value").alias("bin")).agg(F.count(F.lit(1)).alias("n_cur"))

    compared = ref_bins.join(cur_bins, [*by, "bin"], "left").join(plan.select(*by, "ref_rows", "cur_rows"), by)
    term = psi_term(share(F.col("n_ref"), F.col("ref_rows")), share(F.coalesce("n_cur", F.lit(0)), F.col("cur_rows")))
    measured = compared.groupBy(*by).agg(F.sum(term).alias("psi"))
    # A pooled sample of one value has a single bin on both sides.
    return plan.select(*by, "ref_rows", "cur_rows").join(measured, by, "left").na.fill({"psi": 0.0})


def _of_plan(expression: str, column: str) -> str:
    """An expression over one column, its guess and the plan struct carried beside it."""
    names = {"value": f"`{column}`", "guess": f"`__g_{column}`", **{n: f"`__p_{column}`.{n}" for n in ("lo", "step", "bins")}}
    return re.sub(r"\b(value|guess|lo|step|bins)\b", lambda m: names[m.group(1)], expression)


def _bin_of(column: str) -> str:
    # least and greatest pass over nulls, so a missing value is kept out of the bins here.
    return f"CASE WHEN `{column}` IS NOT NULL AND `__p_{column}` IS NOT NULL THEN {_of_plan(_EQUAL_WIDTH_BIN, column)} END"


def ks_test(
    reference: DataFrame, serving: DataFrame, keys: Sequence[str], features: Sequence[str], cuts: Mapping[str, Sequence[float]] | None = None
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov per window: (keys, feature, ks_statistic, ks_p_value).

    The largest gap lies at, or just before, a value of the window, so the reference's
    cumulative counts are read at those values only. Distinct values are shuffled once for both
    sides; what lies below a bucket comes from counts per bucket, which are small.
    """
    keys = list(keys)
    cuts = cuts or numeric_cuts(reference, serving, features)
    ref, cur = value_counts(reference, [], features, cuts), value_counts(serving, keys, features, cuts)
    zero = F.lit(0).cast("bigint")
    both = ref.select("feature", BUCKET, "value", F.col("n").alias("n_ref"), zero.alias("n_cur"), *_no_keys(serving, keys), F.lit(False).alias("__cur")).unionByName(
        cur.select("feature", BUCKET, "value", zero.alias("n_ref"), F.col("n").alias("n_cur"), *keys, F.lit(True).alias("__cur"))
    )
    # All windows cluster on (feature, bucket): one shuffle serves them.
    all_rows = Window.partitionBy("feature", BUCKET).orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    at_value = Window.partitionBy("feature", BUCKET, "value")
    own_rows = Window.partitionBy("feature", BUCKET, "__cur", *keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    stepped = both.select(
        "*",
        F.sum("n_ref").over(all_rows).alias("__ref_upto"),
        F.sum("n_ref").over(at_value).alias("__ref_at"),
        F.sum("n_cur").over(own_rows).alias("__cur_upto"),
    ).where("__cur")
    cur_parts = bucket_counts(serving, keys, features, cuts)
    ref_parts = bucket_counts(reference, [], features, cuts).unionByName(cur_parts.select("feature", BUCKET, zero.alias("n"))).groupBy("feature", BUCKET).agg(F.sum("n").alias("n"))
    ref_base = ref_parts.select(
        "feature", BUCKET, F.coalesce(F.sum("n").over(_prior(["feature"])), zero).alias("__ref_base"), F.sum("n").over(Window.partitionBy("feature")).alias("ref_rows")
    )
    cur_base = cur_parts.select(
        *keys, "feature", BUCKET,
        F.coalesce(F.sum("n").over(_prior([*keys, "feature"])), zero).alias("__cur_base"),
        F.sum("n").over(Window.partitionBy(*keys, "feature")).alias("cur_rows"),
    )
    placed = stepped.join(ref_base, ["feature", BUCKET]).join(cur_base, [*keys, "feature", BUCKET])
    placed = placed.selectExpr(
        *keys, "feature", "ref_rows", "cur_rows", "n_cur", "__ref_at",
        "CAST(__ref_base + __ref_upto AS DOUBLE) AS r", "CAST(__cur_base + __cur_upto AS DOUBLE) AS c",
    )
    worst = F.expr("greatest(abs(c / cur_rows - r / ref_rows), abs((c - n_cur) / cur_rows - (r - __ref_at) / ref_rows))")
    found = placed.groupBy(*keys, "feature").agg(F.max(worst).alias("ks_statistic"), F.max("ref_rows").alias("ref_rows"), F.max("cur_rows").alias("cur_rows"))
    return found.withColumn("ks_p_value", kolmogorov_p(F.col("ks_statistic"), F.col("ref_rows"), F.col("cur_rows")))


# --- whole windows ----------------------------------------------------------------------
def feature_drift(reference: DataFrame, serving: DataFrame, spec: MonitorSpec) -> DataFrame:
    """Long form: one row per (keys, feature), the score included under its own name."""
    parts = []
    keys = list(spec.keys)
    if spec.all_numeric:
        cuts = numeric_cuts(reference, serving, spec.all_numeric)
        psi = sturges_psi(reference, serving, keys, spec.all_numeric, cuts).withColumn("kind", F.lit(NUMERIC))
        if spec.numeric:
            ks = ks_test(reference, serving, keys, spec.numeric, cuts).select(*keys, "feature", "ks_p_value")
            psi = psi.join(ks, [*keys, "feature"], "left")
        else:
            psi = psi.withColumn("ks_p_value", F.lit(None).cast("double"))
        parts.append(psi)
    if spec.categorical:
        cats = categorical_psi(reference, serving, keys, spec.categorical)
        parts.append(cats.withColumns({"ks_p_value": F.lit(None).cast("double"), "kind": F.lit(CATEGORICAL)}))
    if not parts:
        raise ValueError("no monitored features")
    columns = [*keys, "feature", "kind", "psi", "ks_p_value"]
    return union_all([p.select(*columns) for p in parts])


def window_events(
    reference: DataFrame, serving: DataFrame, spec: MonitorSpec, *, scenario: str, window_start: Column, window_end: Column,
    run_id: str = "run", created_at: Column | None = None, model_version: str | None = None, data_version: str | None = None,
    window_number: Column | None = None,
) -> DataFrame:
    """One drift event per window, quiet windows included: names and statistics, never values."""
    long = feature_drift(reference, serving, spec)
    keys = list(spec.keys)
    is_score = F.col("feature") == F.lit(spec.score) if spec.score else F.lit(False)
    stat = F.when(
        ~is_score,
        F.struct(
            "feature", "kind", "psi", "ks_p_value",
            (F.col("psi") >= PSI_BREACH).alias("breaching"), (F.col("psi") >= PSI_SEVERE).alias("severe"),
        ),
    )
    assembled = long.groupBy(*keys).agg(
        F.array_sort(F.collect_list(stat)).alias("feature_stats"),
        F.max(F.when(is_score, F.col("psi"))).alias("prediction_psi"),
        F.max(F.when(~is_score, F.col("psi"))).alias("max_psi"),
        F.count_if(~is_score & (F.col("psi") >= PSI_BREACH)).alias("breaching_feature_count"),
    )
    rows = serving.groupBy(*keys).agg(F.count(F.lit(1)).alias("current_rows"))
    ref_rows = F.broadcast(reference.agg(F.count(F.lit(1)).alias("reference_rows")))
    out = rows.join(assembled, keys, "left").join(ref_rows)
    number = window_number if window_number is not None else F.lit(0)
    identity = F.concat_ws("|", F.lit(run_id), *[F.col(k).cast("string") for k in keys])
    middle = F.concat(F.lower(F.col(scenario)), F.format_string("-w%03d", number.cast("int")))
    return out.select(
        digest_id("de", middle, identity).alias("event_id"),
        (created_at if created_at is not None else window_end).cast("timestamp").alias("created_at"),
        window_start.cast("timestamp").alias("window_start"),
        window_end.cast("timestamp").alias("window_end"),
        F.col(scenario).alias("scenario"),
        "feature_stats",
        F.coalesce(F.col("prediction_psi") >= PREDICTION_PSI, F.lit(False)).alias("prediction_drift"),
        "prediction_psi",
        "max_psi",
        "breaching_feature_count",
        "reference_rows",
        "current_rows",
        F.lit(None).cast("string").alias("report_uri"),
        F.lit(model_version).cast("string").alias("model_version"),
        F.lit(data_version).cast("string").alias("data_version"),
        F.struct(
            F.lit(PSI_BREACH).alias("psi_breach"), F.lit(PSI_SEVERE).alias("psi_severe"), F.lit(KS_P_VALUE).alias("ks_p_value"),
            F.lit(PREDICTION_PSI).alias("prediction_psi"), F.lit(spec.monitored).alias("monitored_features"),
        ).alias("policy_thresholds"),
    )


def quiet() -> Column:
    return (F.col("breaching_feature_count") == 0) & ~F.col("prediction_drift")


def self_stability(reference: DataFrame, half: Column, spec: MonitorSpec, bins: int = 10) -> DataFrame:
    """The second half of a slice measured against the first: a drift floor for thresholds."""
    tagged = reference.withColumn("__second", half)
    first, second = tagged.where(~F.col("__second")).drop("__second"), tagged.where("__second").drop("__second")
    keyed = second.withColumn("__half", F.lit("second"))
    return population_stability(first, keyed, MonitorSpec(("__half",), spec.numeric, spec.categorical), bins).drop("__half")


def calibrated_thresholds(long: DataFrame, step: float = 0.05) -> DataFrame:
    """Per feature, the largest index seen on control windows rounded up to ``step``."""
    return long.groupBy("feature").agg(
        F.max("psi").alias("max_psi"), (F.ceil(F.max("psi") / F.lit(step)) * F.lit(step)).alias("threshold")
    )
