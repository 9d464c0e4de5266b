"""Grid search with cross-validation over MLlib estimators."""

from __future__ import annotations

from itertools import product

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NegativePositionError(Evaluator):
    """Minus the mean distance between true (x, y) and predicted (x_pred, y_pred); larger is better."""

    def _evaluate(self, dataset: DataFrame) -> float:
        dx, dy = F.col("x") - F.col("x_pred"), F.col("y") - F.col("y_pred")
        return -float(dataset.agg(F.avg(F.sqrt(dx * dx + dy * dy))).first()[0])

    def isLargerBetter(self) -> bool:
        return True


def tree_grid(trees: list[int], depths: list[int], rates: list[float], seed: int = 42) -> tuple[Pipeline, list[dict], list[dict]]:
    """M9: boosted trees for x and for y, both with the same settings: (estimator, parameter maps, settings)."""
    own = {t: GBTRegressor(labelCol=t, predictionCol=f"{t}_pred", seed=seed) for t in ("x", "y")}
    settings = [{"trees": n, "depth": d, "rate": r} for n, d, r in product(trees, depths, rates)]
    maps = [
        {p: v for g in own.values() for p, v in ((g.maxIter, s["trees"]), (g.maxDepth, s["depth"]), (g.stepSize, s["rate"]))}
        for s in settings
    ]
    return Pipeline(stages=list(own.values())), maps, settings


def mlp_grid(hidden: list[tuple[int, ...]], n_features: int, n_classes: int, iterations: int, seed: int = 42) -> tuple[Estimator, list[dict], list[dict]]:
    """Hidden layers of a perceptron; Spark's has no penalty parameter."""
    mlp = MultilayerPerceptronClassifier(labelCol="label", maxIter=iterations, seed=seed, layers=[n_features, n_classes])
    return mlp, [{mlp.layers: [n_features, *h, n_classes]} for h in hidden], [{"hidden": "-".join(map(str, h))} for h in hidden]


def cross_validated(
    data: DataFrame, estimator: Estimator, maps: list[dict], settings: list[dict], evaluator: Evaluator, n_folds: int, fold_col: str = "fold",
    parallelism: int = 2,
) -> list[dict]:
    """Every setting with mean and standard deviation of its score over the folds of ``fold_col`` and whether it is the best.

    ``parallelism`` settings are fitted at once; each of these fits holds its own copy of a fold's rows.
    """
    cv = CrossValidator(
        estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=n_folds, foldCol=fold_col, parallelism=parallelism
    )
    model = cv.fit(data)
    best = (max if evaluator.isLargerBetter() else min)(range(len(settings)), key=model.avgMetrics.__getitem__)
    return [
        dict(s, score_mean=float(model.avgMetrics[i]), score_std=float(model.stdMetrics[i]), best=i == best)
        for i, s in enumerate(settings)
    ]
