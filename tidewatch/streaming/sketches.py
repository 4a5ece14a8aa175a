"""Kolmogorov-Smirnov of stream windows from mergeable quantile sketches kept beside the bin counts.

Each bin of a number holds its count, which is exact, and a KLL sketch of its values. The share of a
window's rows up to a value is then exact but for its own bin, of which the sketch gives the values at
RANKS even ranks; the error of a rank, its own and that of the steps, counts by the bin's share alone.
The largest gap to the reference is sought at a grid of the reference's own values; between two of them
it can grow by no more than the reference's rows that lie there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.operators.drift import kolmogorov_p, unpivot_values
from tidewatch.operators.ordering import assign_buckets, running_totals

K, POINTS, RANKS = 400, 64, 128


def of_values(value: Column, k: int = K) -> Column:
    """The aggregate kept in a window's state; missing values are left out."""
    return F.kll_sketch_agg_double(value, k)


def rank_error(k: int) -> float:
    """The rank error a sketch of this size states (at 99 %), as a share of its rows."""
    return 2.296 / k**0.9723


def reference_grid(reference: DataFrame, cuts: Mapping[str, Sequence[float]], points: int = POINTS) -> DataFrame:
    """(feature, bin, value, ref_below, ref_upto, ref_rows, ref_gap): the reference's exact counts at values of its own.

    Per bin there are the least and the greatest value, and per feature those at which a further
    ``points``-th of a bin's even share begins: a few hundred rows a feature. ``ref_gap`` counts the
    reference's rows strictly between a value and the one before it.
    """
    numeric = reference.withColumns({c: F.col(c).cast("double") for c in cuts})
    values = unpivot_values(numeric, [], list(cuts), "double").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    counted = running_totals(values, ["feature"], "value", ["n"])
    wide = counted.withColumns({f"__v_{i}": F.when(F.col("feature") == c, F.col("value")) for i, c in enumerate(cuts)})
    wide = assign_buckets(wide, {f"__v_{i}": (f"__b_{i}", cuts[c]) for i, c in enumerate(cuts)})
    placed = wide.withColumn("bin", F.coalesce(*[F.col(f"__b_{i}") for i in range(len(cuts))]).cast("int"))
    ends = placed.groupBy("feature", "bin").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    steps = F.create_map(*[x for c, p in cuts.items() for x in (F.lit(c), F.lit((len(p) + 1) * points))])[F.col("feature")]
    step = lambda n: F.floor(n * steps / F.col("n_total"))
    chosen = placed.join(ends, ["feature", "bin"]).where((step(F.col("n_before")) != step(F.col("n_upto"))) | F.col("value").isin(F.col("lo"), F.col("hi")))
    before = F.lag("n_upto", 1, 0).over(Window.partitionBy("feature").orderBy("value"))  # a few hundred rows
    return chosen.select(
        "feature", "bin", "value", F.col("n_before").alias("ref_below"), F.col("n_upto").alias("ref_upto"), F.col("n_total").alias("ref_rows"),
        (F.col("n_before") - before).alias("ref_gap"),
    )


def ks_of_bins(counts: DataFrame, grid: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """(keys, feature, ks_statistic, ks_bound, ref_rows, cur_rows, ks_p_value) of bins (keys, feature, bin, n_cur, sketch).

    ``ks_bound`` is how far the statistic may lie below or above that of the window's rows.
    """
    keys = list(keys)
    held = counts.join(F.broadcast(grid.select("feature").distinct()), "feature").withColumn("bin", F.col("bin").try_cast("int"))  # categories have other names
    windows = held.groupBy(*keys, "feature").agg(F.sum("n_cur").alias("cur_rows"), F.max("n_cur").alias("fullest"))
    every = grid.select("feature", "bin").distinct().unionByName(held.select("feature", "bin").distinct()).distinct()
    cells = windows.join(every, "feature").join(held.select(*keys, "feature", "bin", "n_cur", "sketch"), [*keys, "feature", "bin"], "left")
    n = F.coalesce("n_cur", F.lit(0))
    earlier = Window.partitionBy(*keys, "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # the bins of one feature
    at = cells.withColumns({"n": n, "below": F.coalesce(F.sum(n).over(earlier), F.lit(0))}).join(F.broadcast(grid), ["feature", "bin"])
    steps = F.array(*[F.lit(i / RANKS) for i in range(1, RANKS + 1)])
    at = at.withColumn("steps", F.when(F.col("sketch").isNotNull(), F.kll_sketch_get_quantile_double("sketch", steps)))
    part_of = lambda hit: F.coalesce(F.size(F.filter("steps", hit)) / F.lit(RANKS), F.lit(0.0))
    upto, under = part_of(lambda x: x <= F.col("value")), part_of(lambda x: x < F.col("value"))
    share = lambda part: (F.col("below") + F.col("n") * part) / F.col("cur_rows")
    gap = F.greatest(F.abs(share(upto) - F.col("ref_upto") / F.col("ref_rows")), F.abs(share(under) - F.col("ref_below") / F.col("ref_rows")))
    found = at.groupBy(*keys, "feature").agg(
        F.max(gap).alias("ks_statistic"), F.max(F.col("ref_gap") / F.col("ref_rows")).alias("between"), F.max("fullest").alias("fullest"),
        F.max("ref_rows").alias("ref_rows"), F.max("cur_rows").alias("cur_rows"),
    )
    bound = F.col("between") + F.lit(rank_error(k) + 1 / RANKS) * F.col("fullest") / F.col("cur_rows")
    return found.select(
        *keys, "feature", "ks_statistic", bound.alias("ks_bound"), "ref_rows", "cur_rows", kolmogorov_p(F.col("ks_statistic"), F.col("ref_rows"), F.col("cur_rows")).alias("ks_p_value")
    )

