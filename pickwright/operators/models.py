"""Forests: crowd-pick regression and feature elimination on MLlib, upset classification on arrays (``forest``)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, ImputerModel, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwright.operators.forest import Forest, grown
from pickwright.session import cut_lineage
from pickwright.skew import spread

#: Trees that count as one made row where rows are dealt over tasks: a task holds about 125,000 rows of 200 trees.
TREES_A_ROW = 100
#: Classes of a label at most, as in MLlib.
CLASSES = 100


@dataclass
class FittedModel:
    model: PipelineModel
    features: list[str]
    mae: float | None = None

    def importances(self) -> dict[str, float]:
        forest = self.model.stages[-1]
        return dict(zip(self.features, [float(v) for v in forest.featureImportances.toArray()]))


def hash_split(df: DataFrame, id_cols: Sequence[str], train_percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """80/20 by a hash of the row's id: the same rows after any retry or repartitioning."""
    place = F.pmod(F.xxhash64(*id_cols), F.lit(100))
    return df.where(place < train_percent), df.where(place >= train_percent)


def _regressor(features: Sequence[str], target: str, trees: int, seed: int) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    forest = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=trees, seed=seed)
    return Pipeline(stages=[assembler, forest])


def train_pick_model(
    df: DataFrame, features: Sequence[str], target: str, id_cols: Sequence[str], trees: int = 50, seed: int = 42
) -> FittedModel:
    """Regression forest for the pick share; null features count 0; MAE on the held-out rows."""
    ready = df.na.fill(0, list(features)).where(F.col(target).isNotNull())
    train, test = hash_split(ready, id_cols)
    model = _regressor(features, target, trees, seed).fit(train)
    mae = RegressionEvaluator(labelCol=target, metricName="mae").evaluate(model.transform(test))
    return FittedModel(model, list(features), mae)


def predict_picks(fitted: FittedModel, df: DataFrame, out: str = "pick_pct") -> DataFrame:
    ready = df.na.fill(0, fitted.features)
    return fitted.model.transform(ready).withColumnRenamed("prediction", out).drop("features")


def fold_of(id_cols: Sequence[str], folds: int) -> Column:
    """A row's fold from the md5 of its id, so that any engine can tell it."""
    digits = F.substring(F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in id_cols])), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(folds)).cast("int")


@dataclass
class StackedModel:
    base: FittedModel
    final: FittedModel
    public: str
    #: Training rows with their fold and the prediction of a base forest that never saw the fold.
    rows: DataFrame

    def predict(self, df: DataFrame, out: str = "pick_pct") -> DataFrame:
        """The final forest where the public share is known, the base forest elsewhere."""
        marked = df.withColumn("_known", F.col(self.public))  # missing features become 0 on the way
        scored = predict_picks(self.final, predict_picks(self.base, marked, "base_pick"), "_final")
        picked = F.when(F.col("_known").isNotNull(), F.col("_final")).otherwise(F.col("base_pick"))
        return scored.withColumns({out: picked, self.public: F.col("_known")}).drop("_final", "_known")


def train_stacked_model(
    df: DataFrame, features: Sequence[str], public: str, target: str, id_cols: Sequence[str], folds: int = 3, trees: int = 50, seed: int = 42
) -> StackedModel:
    """A forest on the features, and one on the features, the public share and the first one's prediction.

    The second forest learns from rows with a public share only. Its ``base_pick`` is out of fold: each fold is predicted by
    a base forest trained on the others, so no row's own target comes back to it. The mean absolute error of both is taken
    over these held-out predictions, and for the final forest over folds of its own.
    """
    ready = df.na.fill(0, list(features)).where(F.col(target).isNotNull()).withColumn("fold", fold_of(id_cols, folds))
    parts = []
    for f in range(folds):
        fitted = FittedModel(_regressor(features, target, trees, seed).fit(ready.where(F.col("fold") != f)), list(features))
        parts.append(predict_picks(fitted, ready.where(F.col("fold") == f), "base_pick"))
    rows = cut_lineage(reduce(DataFrame.unionByName, parts))
    known, wide = rows.where(F.col(public).isNotNull()), [*features, public, "base_pick"]
    mae = lambda scored, out: scored.select(F.avg(F.abs(F.col(out) - F.col(target)))).first()[0]
    held = [
        predict_picks(FittedModel(_regressor(wide, target, trees, seed).fit(known.where(F.col("fold") != f)), wide), known.where(F.col("fold") == f), "_held")
        for f in range(folds)
    ]
    base = FittedModel(_regressor(features, target, trees, seed).fit(ready), list(features), mae(rows, "base_pick"))
    final = FittedModel(_regressor(wide, target, trees, seed).fit(known), wide, mae(reduce(DataFrame.unionByName, held), "_held"))
    return StackedModel(base, final, public, rows)


def rfe(
    df: DataFrame, features: Sequence[str], target: str, keep: int = 15, step: int = 5, trees: int = 30, seed: int = 42
) -> list[str]:
    """Drop the ``step`` least important features per round until ``keep`` are left."""
    left = list(features)
    ready = df.na.fill(0, left).where(F.col(target).isNotNull())
    while len(left) > keep:
        fitted = FittedModel(_regressor(left, target, trees, seed).fit(ready), left)
        weight = fitted.importances()
        weakest = sorted(left, key=lambda f: (weight[f], f))[: min(step, len(left) - keep)]
        left = [f for f in left if f not in weakest]
    return left


@dataclass
class UpsetModel:
    imputer: ImputerModel
    forest: Forest
    features: list[str]

    def importances(self) -> dict[str, float]:
        return dict(zip(self.features, [float(v) for v in self.forest.importances()]))


def train_upset_model(train: DataFrame, features: Sequence[str], label: str, trees: int = 200, depth: int = 8, seed: int = 42) -> UpsetModel:
    """Balanced classification forest on mean-imputed features."""
    rows = train.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features])
    counts = {r["_y"]: r["_n"] for r in rows.groupBy("_y").agg(F.count("*").alias("_n")).limit(CLASSES + 1).collect()}
    if not counts:
        raise ValueError(f"no row has {label}")
    if len(counts) > CLASSES or any(y != int(y) or not 0 <= y < CLASSES for y in counts):
        raise ValueError(f"{label} must count classes from 0, {CLASSES} at most")
    # n / (classes * n of the class), from the label counts
    weights = [sum(counts.values()) / (len(counts) * counts[y]) if y in counts else 0.0 for y in range(max(2, 1 + int(max(counts))))]
    rows = cut_lineage(_dealt(rows, features, trees))
    imputer = Imputer(strategy="mean", inputCols=list(features), outputCols=_filled(features)).fit(rows)
    return UpsetModel(imputer, grown(imputer.transform(rows), "_y", _filled(features), weights, trees, depth, seed), list(features))


def _filled(features: Sequence[str]) -> list[str]:
    return [f"_{f}" for f in features]


def _dealt(df: DataFrame, features: Sequence[str], trees: int) -> DataFrame:
    """Rows over as many tasks as the trees ask for: a scan of few bytes has few."""
    return spread(df, *features, work=max(1, trees // TREES_A_ROW))


def predict_upsets(fitted: UpsetModel, df: DataFrame) -> DataFrame:
    df = _dealt(df, fitted.features, len(fitted.forest.trees))
    doubles = df.withColumns({f: F.col(f).cast("double") for f in fitted.features})
    filled = fitted.imputer.transform(doubles)
    return filled.withColumn("upset_probability", fitted.forest.probability(_filled(fitted.features))).select(*df.columns, "upset_probability")
