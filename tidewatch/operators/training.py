"""Encoders, boosted trees and out-of-fold isotonic calibration on Spark ML."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tidewatch.functions.text import MISSING
from tidewatch.functions.numbers import hash_bits
from tidewatch.operators.drift import value_counts
from tidewatch.operators.isotonic import isotonic_steps, step_ends
from tidewatch.operators.ordering import cut_points, exact_quantiles
from tidewatch.operators.preparation import validation_tail

# Training settings.
MIN_TREES, FOLDS, VALIDATION_FRACTION, LEARNING_RATE = 25, 5, 0.15, 0.05
MOST_CATEGORIES = 10_000  # an indexer keeps its values on the driver; ``vocabulary`` has no such bound


@dataclass(frozen=True)
class FeatureSpec:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    ordinal: Mapping[str, tuple[str, ...]] | None = None


@dataclass(frozen=True)
class FittedEncoder:
    """One fitted transformation, the same for training and serving."""

    spec: FeatureSpec
    medians: Mapping[str, float]
    stages: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        return self.stages.transform(prepare(df, self.spec, self.medians))


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians: as many numbers on the driver as there are columns."""
    if not columns:
        return {}
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    counted = value_counts(wide, [], list(columns), cut_points(wide, list(columns)))
    return {r["feature"]: r["quantile"] for r in exact_quantiles(counted, ["feature"], "value", {"m": 0.5}, weight="n").collect()}


def prepare(df: DataFrame, spec: FeatureSpec, fitted: Mapping[str, float]) -> DataFrame:
    """Imputes numbers by the training median and text by a constant; encodes ordered bands."""
    numeric = {f"{c}__num": F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(float(fitted.get(c, 0.0)))) for c in spec.numeric}
    # 0-based place in the band list; unknown bands are -1.
    ordered = {f"{c}__ord": (F.coalesce(F.array_position(F.lit(list(bands)), F.col(c)), F.lit(0)) - 1).cast("double") for c, bands in (spec.ordinal or {}).items()}
    text = {f"{c}__cat": F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in spec.categorical}
    return df.withColumns({**numeric, **ordered, **text})


def _require_few_categories(train: DataFrame, columns: Sequence[str]) -> None:
    if not columns:
        return
    found = train.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in columns]).first()
    for c in columns:
        if found[c] > MOST_CATEGORIES:
            raise ValueError(f"{c} has more than {MOST_CATEGORIES} values; encode it with vocabulary.one_hot")


def fit_encoder(train: DataFrame, spec: FeatureSpec, *, scale: bool = False) -> FittedEncoder:
    """Unknown categories at serving time become all-zero vectors."""
    _require_few_categories(train, spec.categorical)
    fitted = medians(train, spec.numeric)
    cats = [f"{c}__cat" for c in spec.categorical]
    stages = []
    if cats:
        stages.append(StringIndexer(inputCols=cats, outputCols=[f"{c}_i" for c in cats], handleInvalid="keep", stringOrderType="alphabetAsc"))
        # The kept bucket is the last index, and the last index is dropped.
        stages.append(OneHotEncoder(inputCols=[f"{c}_i" for c in cats], outputCols=[f"{c}_v" for c in cats], dropLast=True, handleInvalid="error"))
    plain = [*[f"{c}__num" for c in spec.numeric], *[f"{c}__ord" for c in (spec.ordinal or {})]]
    if scale and plain:
        stages += [VectorAssembler(inputCols=plain, outputCol="__plain"), StandardScaler(inputCol="__plain", outputCol="__scaled", withMean=True)]
        plain = ["__scaled"]
    stages.append(VectorAssembler(inputCols=[*plain, *[f"{c}_v" for c in cats]], outputCol="features"))
    return FittedEncoder(spec, fitted, Pipeline(stages=stages).fit(prepare(train, spec, fitted)))


def _gbt(label: str, trees: int, depth: int, seed: int, rate: float = LEARNING_RATE, bins: int = 64) -> GBTClassifier:
    return GBTClassifier(labelCol=label, featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, maxBins=bins)


def select_tree_count(train: DataFrame, spec: FeatureSpec, label: str, order: str, *, max_trees: int, floor: int = MIN_TREES, depth: int = 4, seed: int = 42) -> int:
    """Early stopping on the last rows of the training slice in time order."""
    tagged = validation_tail(train, order, VALIDATION_FRACTION)
    encoder = fit_encoder(tagged.where("NOT is_validation"), spec)
    probe = _gbt(label, max_trees, depth, seed).setValidationIndicatorCol("is_validation")
    model = probe.fit(encoder.transform(tagged).select("features", label, "is_validation"))
    return max(model.getNumTrees, floor)


def fit_base(train: DataFrame, spec: FeatureSpec, label: str, *, trees: int, depth: int = 4, seed: int = 42) -> tuple[FittedEncoder, object]:
    encoder = fit_encoder(train, spec)
    return encoder, _gbt(label, trees, depth, seed).fit(encoder.transform(train).select("features", label))


def score(df: DataFrame, encoder: FittedEncoder, model: object, out: str = "p") -> DataFrame:
    """Batch scoring: the probability of the positive class."""
    scored = model.transform(encoder.transform(df))  # type: ignore[attr-defined]
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(out))


@dataclass(frozen=True)
class CalibratedModel:
    """Five models, each calibrated on the fold it did not see; their scores are averaged."""

    members: tuple[tuple[FittedEncoder, object, IsotonicRegressionModel], ...]

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        columns = list(df.columns)
        for i, (encoder, model, curve) in enumerate(self.members):
            df = score(df, encoder, model, f"__raw_{i}")
            df = curve.transform(df.withColumn("__x", F.col(f"__raw_{i}"))).withColumnRenamed("prediction", f"__cal_{i}").drop("__x")
        total = sum((F.col(f"__cal_{i}") for i in range(len(self.members))), F.lit(0.0))
        return df.select(*columns, (total / len(self.members)).alias(out))


def fit_calibrated(train: DataFrame, spec: FeatureSpec, label: str, key: str, *, trees: int, folds: int = FOLDS, depth: int = 4, seed: int = 42) -> CalibratedModel:
    tagged = train.withColumn("__fold", F.pmod(hash_bits([key], f"fold-{seed}"), F.lit(folds)))
    members = []
    for fold in range(folds):
        encoder, model = fit_base(tagged.where(F.col("__fold") != fold), spec, label, trees=trees, depth=depth, seed=seed)
        held = score(tagged.where(F.col("__fold") == fold), encoder, model, "__x")
        ends = step_ends(isotonic_steps(held, "__x", label))  # pooled beforehand: the fit holds the steps, not the rows
        curve = IsotonicRegression(featuresCol="x", labelCol="value", weightCol="weight", predictionCol="prediction").fit(ends).setFeaturesCol("__x")
        members.append((encoder, model, curve))
    return CalibratedModel(tuple(members))


def train_models(train: DataFrame, spec: FeatureSpec, label: str, key: str, *, max_trees: int = 1000, floor: int = MIN_TREES, depth: int = 4, folds: int = FOLDS, seed: int = 42) -> tuple[tuple[FittedEncoder, object], CalibratedModel, int]:
    """Base and calibrated models from the training slice only."""
    trees = select_tree_count(train, spec, label, key, max_trees=max_trees, floor=floor, depth=depth, seed=seed)
    return fit_base(train, spec, label, trees=trees, depth=depth, seed=seed), fit_calibrated(train, spec, label, key, trees=trees, folds=folds, depth=depth, seed=seed), trees


def fit_logistic(train: DataFrame, spec: FeatureSpec, label: str, *, balanced: bool = True) -> tuple[FittedEncoder, object]:
    """The baseline: scaled numbers, one-hot text, classes weighted to balance."""
    encoder = fit_encoder(train, spec, scale=True)
    rate = F.broadcast(train.agg(F.avg(F.col(label).cast("double")).alias("__rate")))
    weight = F.when(F.col(label) == 1, 0.5 / F.col("__rate")).otherwise(0.5 / (1 - F.col("__rate")))
    weighted = encoder.transform(train).join(rate).select("features", label, (weight if balanced else F.lit(1.0)).alias("w"))
    return encoder, LogisticRegression(labelCol=label, featuresCol="features", weightCol="w", maxIter=50).fit(weighted)


def score_external(df: DataFrame, predict, columns: Sequence[str], out: str = "p") -> DataFrame:
    """Any vectorised ``predict(frame) -> scores`` over Arrow batches."""
    schema = StructType([*df.schema.fields]).add(out, "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: predict(batch[list(columns)])})

    return df.mapInPandas(run, schema)


def training_metadata(train: DataFrame, evaluate: DataFrame, label: str, trees: int) -> DataFrame:
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(f"{name}_rows"), F.round(F.avg(F.col(label).cast("double")), 6).alias(f"{name}_positive_rate"))

    return side(train, "train").join(F.broadcast(side(evaluate, "eval"))).withColumn("trees", F.lit(trees))
