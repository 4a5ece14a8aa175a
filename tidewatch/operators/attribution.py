"""Rollups of per-row feature contributions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def linear_contributions(df: DataFrame, coefficients: Mapping[str, float], out: str = "contributions") -> DataFrame:
    """Exact contributions of a linear model, coefficient x (value - mean), as one array per row."""
    means = F.broadcast(df.agg(*[F.avg(c).alias(f"__mean_{c}") for c in coefficients]))
    parts = [
        F.struct(F.lit(c).alias("feature"), (F.lit(float(w)) * (F.col(c).cast("double") - F.col(f"__mean_{c}"))).alias("contribution"), F.col(c).cast("double").alias("feature_value"))
        for c, w in coefficients.items()
    ]
    return df.join(means).withColumn(out, F.array(*parts)).drop(*[f"__mean_{c}" for c in coefficients])


def global_importance(df: DataFrame, contributions: str = "contributions") -> DataFrame:
    """Mean absolute and mean contribution per feature, most important first."""
    long = df.select(F.inline(contributions))
    return (
        long.groupBy("feature")
        .agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"), F.avg("contribution").alias("mean_contribution"))
        .orderBy(F.desc("mean_abs_contribution"), "feature")
    )


def top_contributions(contributions: Column | str, n: int = 5) -> Column:
    """The ``n`` largest contributions by size, sign kept; settled within the row."""
    c = F.col(contributions) if isinstance(contributions, str) else contributions
    keyed = F.transform(c, lambda x: F.struct((-F.abs(x["contribution"])).alias("order"), x["feature"].alias("feature"), x["contribution"].alias("contribution"), x["feature_value"].alias("feature_value")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda x: x.dropFields("order"))


def without_values(contributions: Column | str) -> Column:
    """The same contributions with the row's own values removed."""
    c = F.col(contributions) if isinstance(contributions, str) else contributions
    return F.transform(c, lambda x: x.dropFields("feature_value"))
