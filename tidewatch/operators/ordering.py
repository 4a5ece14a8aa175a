"""Order-dependent operators that never gather an order into one task.

Every operator here cuts the order axis at quantile points taken once, as literals, so a
re-run of a lost task sees the same cuts. Rows are counted or summed per bucket, the small
per-bucket table is prefix-summed, and the order inside a bucket is settled by a window
partitioned on that bucket. The number of buckets follows ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.numbers import hash_bits

BUCKET = "__bucket"
TASK_ROWS = 200_000  # rows of a group that one task may order


def bucket_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sort_key(df: DataFrame, column: str) -> Column:
    """A double that never decreases as ``column`` increases, one to one below 2**53.

    Text gives the number of its first six bytes plus 2**53, so it is never taken as one to one.
    """
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double") * 32.0 + float(2**53)
    if kind.startswith("timestamp"):
        day = F.unix_date(c.cast("date")).cast("double") * 86400.0
        return day + F.hour(c) * 3600.0 + F.minute(c) * 60.0 + F.extract(F.lit("SECOND"), c).cast("double")
    if kind == "date":
        return F.unix_date(c).cast("double")
    return c.cast("double")


def cut_points(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> dict[str, list[float]]:
    """Approximate quantiles of each numeric column, one scan for all of them.

    Only the balance of the buckets depends on the approximation, never a result.
    """
    n = buckets or bucket_count(df)
    if n < 2 or not columns:
        return {c: [] for c in columns}
    probabilities = [i / n for i in range(1, n)]
    found = df.approxQuantile(list(columns), probabilities, 0.25 / n)
    return {c: list(points) for c, points in zip(columns, found, strict=True)}


def assign_buckets(df: DataFrame, cuts: Mapping[str, tuple[str, Sequence[float]]]) -> DataFrame:
    """Adds ``out`` = 0-based bucket of ``column`` for each ``column -> (out, points)``.

    Buckets are closed on the left; values outside the points fall in the end buckets.
    """
    usable = {c: (out, sorted(set(points))) for c, (out, points) in cuts.items() if len(set(points)) > 0}
    for c, (out, _) in cuts.items():
        if c not in usable:
            df = df.withColumn(out, F.when(F.col(c).isNotNull(), F.lit(0)))
    if not usable:
        return df
    columns = list(usable)
    raw = [f"{usable[c][0]}__raw" for c in columns]
    cutter = Bucketizer(
        splitsArray=[[-math.inf, *usable[c][1], math.inf] for c in columns],
        inputCols=columns,
        outputCols=raw,
        handleInvalid="keep",
    )
    valid = "CASE WHEN `{0}` IS NOT NULL AND NOT isnan(`{0}`) THEN CAST(`{1}` AS INT) END"
    cut = {usable[c][0]: F.expr(valid.format(c, name)) for c, name in zip(columns, raw, strict=True)}
    return cutter.transform(df).withColumns(cut).drop(*raw)


def assign_buckets_long(
    df: DataFrame, name: str, value: str, points: Mapping[str, Sequence[float]], out: str = BUCKET
) -> DataFrame:
    """As ``assign_buckets`` for rows whose cut points depend on the feature they name."""
    names = list(points)
    inputs = [f"__in_{i}" for i in range(len(names))]
    outputs = [f"__cut_{i}" for i in range(len(names))]
    df = df.select("*", *[F.when(F.col(name) == n, F.col(value)).alias(c) for n, c in zip(names, inputs, strict=True)])
    df = assign_buckets(df, {c: (o, points[n]) for n, c, o in zip(names, inputs, outputs, strict=True)})
    return df.withColumn(out, F.coalesce(*[F.col(o) for o in outputs])).drop(*inputs, *outputs)


def _on_equal(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join on keys in which nulls equal each other; the right side's keys are dropped."""
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])
    joined = left.join(right, same)
    for k in keys:
        joined = joined.drop(right[k])
    return joined


def running_totals(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    values: Sequence[str],
    *,
    points: Sequence[float] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Adds ``v_before``, ``v_upto`` and ``v_total`` for each summed column.

    ``df`` has one row per (groups, order). The order column is numeric, text, a date or a
    timestamp; a null comes before all values, NaN after them, and null group values are a group.
    A frame that already carries buckets keeps them.
    """
    key = "__order_key"
    keyed = df
    if BUCKET not in df.columns:
        keyed = df.withColumn(key, sort_key(df, order))
        if points is None:
            points = cut_points(keyed, [key], buckets)[key]
        keyed = assign_buckets(keyed, {key: (BUCKET, points)})
        # Nulls sort before all buckets, NaN after them.
        outside = F.when(F.col(key).isNull(), F.lit(-1)).when(F.isnan(key), F.lit(len(points) + 2))
        keyed = keyed.withColumn(BUCKET, F.coalesce(outside, F.col(BUCKET), F.lit(0))).drop(key)

    parts = keyed.groupBy(*groups, BUCKET).agg(*[F.sum(v).alias(f"{v}__part") for v in values])
    earlier = Window.partitionBy(*groups).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*groups)
    zero = F.lit(0)
    offsets = parts.select(
        *groups,
        BUCKET,
        *[F.coalesce(F.sum(f"{v}__part").over(earlier), zero).alias(f"{v}__base") for v in values],
        *[F.sum(f"{v}__part").over(group).alias(f"{v}_total") for v in values],
    )
    if not groups:
        offsets = F.broadcast(offsets)  # one row per bucket
    inside = Window.partitionBy(*groups, BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.select("*", *[F.coalesce(F.sum(v).over(inside), zero).alias(f"{v}__local") for v in values])
    joined = _on_equal(local, offsets, [*groups, BUCKET])
    before = {f"{v}_before": F.col(f"{v}__base") + F.col(f"{v}__local") for v in values}
    upto = {f"{v}_upto": F.col(f"{v}__base") + F.col(f"{v}__local") + F.col(v) for v in values}
    dropped = [BUCKET, *[f"{v}__base" for v in values], *[f"{v}__local" for v in values]]
    return joined.withColumns({**before, **upto}).drop(*dropped)


def by_group_size(df: DataFrame, groups: Sequence[str], rows: int | None = None) -> list[tuple[DataFrame, bool]]:
    """The rows in up to two frames, each with whether its groups are small enough to be ordered by one task.

    Groups of more than ``rows`` rows are counted and named first; there are at most as many as the table has
    such blocks of rows. Many small groups need no buckets, so their rows are shuffled once, by group.
    """
    if not groups:
        return [(df, False)]
    large = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > (rows or TASK_ROWS)).select(*[F.col(g).alias(f"__g_{g}") for g in groups])
    if large.isEmpty():
        return [(df, True)]
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in groups])
    return [(df.join(F.broadcast(large), same, "left_anti"), True), (df.join(F.broadcast(large), same, "left_semi"), False)]


def totals_of_small_groups(df: DataFrame, groups: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """As ``running_totals`` for groups that one task can order each."""
    group = Window.partitionBy(*groups)
    before = group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumns({**{f"{v}_before": F.coalesce(F.sum(v).over(before), F.lit(0)) for v in values}, **{f"{v}_total": F.sum(v).over(group) for v in values}})
    return summed.withColumns({f"{v}_upto": F.col(f"{v}_before") + F.col(v) for v in values})


def positions(
    df: DataFrame,
    order: str,
    tie: str,
    *,
    groups: Sequence[str] = (),
    descending: bool = False,
    out: str = "position",
    total: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Adds the exact 0-based position of each row in (order, tie) within its group.

    Null and NaN order values stand where Spark sorts them: nulls first and NaN last when
    ascending, the other way round when descending. ``total`` names a column for the size of
    the group. An order value so common that it spans several quantiles gets as many buckets of its
    own, cut on ``tie``, so a tied block of any size is still spread over many tasks.
    """
    key, tie_key = "__order_key", "__tie_key"
    sign = F.lit(-1.0 if descending else 1.0)
    keyed = df.withColumns({key: sort_key(df, order) * sign, tie_key: sort_key(df, tie)})
    points = cut_points(keyed, [key, tie_key], buckets)
    points = {c: [v for v in found if not math.isnan(v)] for c, found in points.items()}
    often = {v: n for v, n in Counter(points[key]).items() if n > 1 and abs(v) < 2**53}
    splits = sorted(set(points[key]) | {math.nextafter(v, math.inf) for v in often})
    # Bucket i > 0 starts at splits[i - 1]; a bucket that starts at a frequent value is split.
    widths = [1, *[often.get(v, 1) for v in splits]]
    starts = [0]
    for w in widths[:-1]:
        starts.append(starts[-1] + w)
    ties = sorted(set(points[tie_key]))
    keyed = assign_buckets(keyed, {key: ("__main", splits), tie_key: ("__side", ties)})
    main = F.coalesce(F.col("__main"), F.lit(0))
    side = F.when(F.isnan(tie_key), F.lit(len(ties))).otherwise(F.coalesce(F.col("__side"), F.lit(0)))
    width, start = F.get(F.lit(widths), main), F.get(F.lit(starts), main)
    bucket = start + F.floor(side * width / F.lit(len(ties) + 1)).cast("int")
    # Null and NaN have buckets of their own before and after all others, cut on the tie key alone.
    front, back = side - F.lit(len(ties) + 1), side + F.lit(sum(widths))
    nulls, nans = (back, front) if descending else (front, back)
    bucket = F.when(F.col(key).isNull(), nulls).when(F.isnan(key), nans).otherwise(bucket)
    keyed = keyed.withColumn(BUCKET, bucket).drop(key, tie_key, "__main", "__side")

    earlier = Window.partitionBy(*groups).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*groups, BUCKET)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(
            *groups, BUCKET, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"),
            F.sum("__n").over(Window.partitionBy(*groups)).alias("__total"),
        )
    )
    if not groups:
        offsets = F.broadcast(offsets)  # at most two rows per quantile bucket
    first = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*groups, BUCKET).orderBy(first, F.col(tie).asc())
    placed = _on_equal(keyed.withColumn("__row", F.row_number().over(inside)), offsets, [*groups, BUCKET])
    if total is not None:
        placed = placed.withColumn(total, F.col("__total"))
    return placed.withColumn(out, F.col("__base") + F.col("__row") - 1).drop("__base", "__row", "__total", BUCKET)


def keys_at_ranks(df: DataFrame, order: str, ranks: Mapping[str, Column], *, buckets: int | None = None) -> DataFrame:
    """One row with, per name, the unique ``order`` key at a 0-based rank, null past the end.

    Ranks are expressions over ``__rows``, the number of rows. Rows are counted per bucket and
    only the buckets that hold a wanted rank are sorted, so cutting a table by place moves
    almost none of it.
    """
    key = "__order_key"
    keyed = df.select(order).withColumn(key, sort_key(df, order))
    keyed = assign_buckets(keyed, {key: (BUCKET, cut_points(keyed, [key], buckets)[key])})
    every = Window.partitionBy(F.lit(0))
    earlier = every.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    counted = (
        keyed.groupBy(BUCKET)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(BUCKET, "__n", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"), F.sum("__n").over(every).alias("__rows"))
    )
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()])
    inside = (F.col("w.rank") >= F.col("__base")) & (F.col("w.rank") < F.col("__base") + F.col("__n"))
    targets = counted.select(BUCKET, "__base", F.explode(wanted).alias("w")).where(inside)
    holding = F.broadcast(  # at most one row per wanted rank
        targets.groupBy(BUCKET).agg(F.max("__base").alias("__base"), F.collect_list("w").alias("__targets"))
    )
    place = F.row_number().over(Window.partitionBy(BUCKET).orderBy(order)) - 1 + F.col("__base")
    ranked = keyed.join(holding, BUCKET).withColumn("__place", place)
    hits = ranked.select(order, F.explode(F.filter("__targets", lambda t: t["rank"] == F.col("__place"))).alias("t"))
    return hits.agg(*[F.max(F.when(F.col("t.name") == name, F.col(order))).alias(name) for name in ranks])


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    *,
    weight: str | None = None,
    points: Sequence[float] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group: (groups, name, quantile).

    Values are counted first, then ranked by bucketed running totals, so neither a hot value
    nor a large group is held in one task's memory, as the built-in exact percentile would.
    ``weight`` names a column of counts when ``df`` is already aggregated.
    """
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    ready = [BUCKET] if BUCKET in df.columns else []
    counted = (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*groups, *ready, F.col(value).cast("double").alias("__v"))
        .agg(rows.cast("bigint").alias("__n"))
    )
    ranked = running_totals(counted, groups, "__v", ["__n"], points=points, buckets=buckets)
    h = {name: (F.col("__n_total") - 1).cast("double") * F.lit(float(p)) for name, p in probabilities.items()}

    def holds(rank: Column) -> Column:
        return (F.col("__n_before") <= rank) & (rank < F.col("__n_upto"))

    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                holds(F.floor(x)).alias("low"),
                holds(F.ceil(x)).alias("high"),
                (x - F.floor(x)).alias("fraction"),
            )
            for name, x in h.items()
        ]
    )
    hits = ranked.select(
        *groups, "__v", F.explode(F.filter(wanted, lambda w: w["low"] | w["high"])).alias("w")
    )
    ends = hits.groupBy(*groups, F.col("w.name").alias("name")).agg(
        F.max(F.when(F.col("w.low"), F.col("__v"))).alias("__lo"),
        F.max(F.when(F.col("w.high"), F.col("__v"))).alias("__hi"),
        F.max("w.fraction").alias("__f"),
    )
    quantile = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__f")
    return ends.select(*groups, "name", quantile.alias("quantile"))


def hash_select(
    df: DataFrame,
    keys: Sequence[str],
    *,
    rows: int | None = None,
    fraction: float | None = None,
    seed: int | str = 42,
    where: Column | None = None,
    portable: bool = False,
    out: str = "selected",
) -> DataFrame:
    """Flags an exact number of rows, chosen by a hash of their key: the same on any layout.

    Hash values are counted in 65,536 equal ranges. Whole ranges below the wanted count are
    in, and only the one range that the count falls into is ranked, so no data is shuffled
    but that range. ``fraction`` is rounded half to even. Keys identify rows.
    """
    eligible = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    h = "__hash"
    tagged = df.withColumns({"__eligible": eligible, h: hash_bits(keys, seed, portable)})
    tagged = tagged.withColumn("__range", F.shiftright(F.col(h), 32))
    counted = tagged.where("__eligible").groupBy("__range").agg(F.count(F.lit(1)).alias("__in"))
    every = Window.partitionBy(F.lit(0))
    earlier = every.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    if rows is not None:
        wanted = F.lit(int(rows)).cast("bigint")
    else:
        wanted = F.bround(F.sum("__in").over(every) * F.lit(float(fraction))).cast("bigint")
    ranges = F.broadcast(  # at most 65,536 rows
        counted.select(
            "__range",
            F.coalesce(F.sum("__in").over(earlier), F.lit(0)).alias("__lower"),
            "__in",
            wanted.alias("__wanted"),
        )
    )
    marked = tagged.join(ranges, "__range", "left")
    edge = F.col("__eligible") & (F.col("__lower") < F.col("__wanted")) & (F.col("__lower") + F.col("__in") > F.col("__wanted"))
    edge = F.coalesce(edge, F.lit(False))
    clear = marked.where(~edge).withColumn(
        out, F.col("__eligible") & F.coalesce(F.col("__lower") < F.col("__wanted"), F.lit(False))
    )
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(h, *keys))
    split = marked.where(edge).withColumn(out, F.col("__lower") + rank <= F.col("__wanted"))
    return clear.unionByName(split).drop("__eligible", h, "__range", "__lower", "__in", "__wanted")


def sample_rows(df: DataFrame, keys: Sequence[str], rows: int | None, seed: int | str = 42, portable: bool = False) -> DataFrame:
    """Exactly ``rows`` rows without replacement, or the whole frame if it is no larger or ``rows`` is None."""
    if rows is None:
        return df
    if rows <= 0:
        raise ValueError("a sample needs at least one row")
    return hash_select(df, keys, rows=rows, seed=seed, portable=portable).where("selected").drop("selected")


def salted_join(left: DataFrame, small: DataFrame, keys: Sequence[str], salts: int = 32) -> DataFrame:
    """An inner join of many rows with a table of few rows per key, when a few keys hold most rows.

    Each key of the large side is spread over ``salts`` tasks by a hash of the row, and the small
    side repeated as often. Adaptive execution may still broadcast the small side by its measured size.
    """
    spread = left.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*keys, "__salt"]).drop("__salt")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
