"""Isotonic regression over tables of any size: neighbours that disagree are pooled within ranges, then across their edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.operators.ordering import assign_buckets, cut_points
from tidewatch.session import shared_folder

STEPS = "room bigint, lo double, hi double, weight double, total double"


def _pooled(frame: pd.DataFrame) -> pd.DataFrame:
    """Blocks in order, each merged into the one before it while its mean is no greater."""
    held: list[list[float]] = []
    for lo, hi, weight, total in frame.sort_values("lo")[["lo", "hi", "weight", "total"]].itertuples(index=False):
        held.append([lo, hi, weight, total])
        while len(held) > 1 and held[-2][3] * held[-1][2] >= held[-1][3] * held[-2][2]:
            _, hi, weight, total = held.pop()
            held[-1][1:] = [hi, held[-1][2] + weight, held[-1][3] + total]
    out = pd.DataFrame(held, columns=["lo", "hi", "weight", "total"])
    out.insert(0, "room", frame["room"].iloc[0])
    return out


def isotonic_steps(df: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    """(lo, hi, weight, value): the non-decreasing step function of ``score`` closest to ``label`` in squares.

    Rows are summed per distinct score first. Ranges of scores are pooled by themselves; as pooling
    may be done in any order, only ranges whose edges disagree are then put together and pooled on,
    and they hold no more than the blocks left of them. A table of one row per range is all that says
    which; nothing reaches the driver but whether any do. Rows without score or label have no say.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = df.select(F.col(score).cast("double").alias("lo"), F.col(label).cast("double").alias("y"), w.alias("w")).where("lo IS NOT NULL AND NOT isnan(lo) AND y IS NOT NULL AND w > 0")
    blocks = known.groupBy("lo").agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("y")).alias("total"))
    blocks = assign_buckets(blocks, {"lo": ("room", cut_points(blocks, ["lo"])["lo"])})
    blocks = blocks.select(F.coalesce(F.col("room"), F.lit(0)).cast("bigint").alias("room"), "lo", F.col("lo").alias("hi"), "weight", "total")
    while True:
        path = shared_folder(df.sparkSession, "isotonic")
        blocks.groupBy("room").applyInPandas(_pooled, STEPS).write.parquet(path)
        blocks = df.sparkSession.read.schema(STEPS).parquet(path)
        mean = F.col("total") / F.col("weight")
        edges = blocks.groupBy("room").agg(F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"))
        in_order = Window.orderBy("room")  # one row a range
        edges = edges.withColumn("apart", F.coalesce(F.lag("last").over(in_order) < F.col("first"), F.lit(True)))
        joint = edges.select("room", "apart", F.sum(F.col("apart").cast("bigint")).over(in_order).alias("next"))
        if joint.where("NOT apart").isEmpty():
            return blocks.select("lo", "hi", "weight", mean.alias("value"))
        blocks = blocks.join(F.broadcast(joint.select("room", "next")), "room").select(F.col("next").alias("room"), "lo", "hi", "weight", "total")


def step_ends(steps: DataFrame) -> DataFrame:
    """(x, value, weight): both ends of every step, which is all that a fitted curve needs to know."""
    ends = F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x")
    return steps.select(ends, "value", "weight")
