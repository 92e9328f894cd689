"""Regressors, ensembles, cross-validation and searches (M1-M13) on
``pyspark.ml``.  Training data is a DataFrame with a vector column; every
fit is a distributed ``pyspark.ml`` job, metrics are one aggregation each.
"""

from __future__ import annotations

import itertools
import random
import time
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import stored
from . import evaluation as EV
from . import tuning
from .boosting import HistGBTRegressor
from .neighbors import KNNRegressor

LABEL = C.TARGET


def gbt(max_iter: int = C.GBT_PARAMS["n_estimators"], max_depth: int = C.GBT_PARAMS["max_depth"],
        step: float = C.GBT_PARAMS["learning_rate"], subsample: float = C.GBT_PARAMS["subsample"],
        colsample: float = C.GBT_PARAMS["colsample_bytree"], seed: int = C.GBT_PARAMS["random_state"],
        features: str = "features", **kw) -> HistGBTRegressor:
    """M1: boosted trees with the shipped model's settings by default (columns
    sampled per tree, L2 term 1)."""
    return HistGBTRegressor(featuresCol=features, labelCol=LABEL, maxIter=max_iter, maxDepth=max_depth,
                            stepSize=step, subsample=subsample, colsample=colsample, seed=seed, **kw)


def knn(k: int = C.PLAIN_MODELS["knn"]["k"], features: str = "features") -> KNNRegressor:
    """M4 on a feature vector."""
    return KNNRegressor(featuresCol=features, labelCol=LABEL, k=k)


def members(settings: dict[str, dict]) -> dict[str, Callable[[], object]]:
    """Makers of the compared models by name, from ``C.PLAIN_MODELS`` or
    ``C.TUNED_MODELS``."""
    makers = {"knn": knn, "gbt": gbt, "rf": random_forest}
    return {name: (lambda name=name, kw=kw: makers[name](**kw)) for name, kw in settings.items()}


def random_forest(num_trees: int = 20, max_depth: int = 5, seed: int = 42,
                  features: str = "features") -> RandomForestRegressor:
    """M3."""
    return RandomForestRegressor(featuresCol=features, labelCol=LABEL, numTrees=num_trees,
                                 maxDepth=max_depth, seed=seed)


def linear(reg: float = 0.0, elastic: float = 0.0, features: str = "features") -> LinearRegression:
    """M5: linear (reg 0), ridge (elastic 0), lasso (elastic 1), elastic net."""
    return LinearRegression(featuresCol=features, labelCol=LABEL, regParam=reg, elasticNetParam=elastic)


def metrics_row(pred: DataFrame, prediction: str = "prediction") -> dict:
    """A19 collected (one aggregated row)."""
    r = EV.regression_metrics(pred, LABEL, prediction).first()
    return r.asDict()


# ---- M2 early stopping -----------------------------------------------------------

def gbt_early_stop(train: DataFrame, validation_col: str = "is_validation", patience: int = C.GBT_PATIENCE, **kw):
    """M2: boosted trees that stop after ``patience`` rounds without a better
    error on the flagged rows of ``train`` and end at the best round."""
    return gbt(validationCol=validation_col, patience=patience, **kw).fit(train)


def _folded(train: DataFrame, k: int, features: str = "features", *more: str, source=None) -> DataFrame:
    """What the fits over ``k`` folds read, stored once: vector, label, ``fold``.
    With a ``source`` (a column and the transformer that makes the vector of it) the
    column is stored and each pass makes the vector anew."""
    column, transformer = source or (features, None)
    rows = stored(EV.with_folds(train, k).select(column, LABEL, *more, "fold"), "folds")
    return transformer.transform(rows).select(features, LABEL, *more, "fold") if transformer else rows


# ---- M6/M7 ensembles ------------------------------------------------------------

def voting(models: dict[str, object], df: DataFrame, features: str = "features") -> DataFrame:
    """M6: mean of member predictions in one chain of transforms."""
    out = df
    names = []
    for name, m in models.items():
        col = f"pred_{name}"
        m = m.copy({m.predictionCol: col}) if hasattr(m, "predictionCol") else m
        out = m.transform(out)
        names.append(col)
    return out.withColumn("prediction", sum(F.col(c) for c in names) / len(names))


def stacking(members: dict[str, Callable[[], object]], train: DataFrame, k: int = 5,
             meta: Callable[[], object] | None = None, features: str = "features"):
    """M7: out-of-fold member predictions -> linear meta model.

    For each fold, members are fit on the other folds and predict the held
    fold; the held-out predictions are unioned into the meta training set.
    Returns (members refit on all rows, meta model, meta feature names)."""
    folded = _folded(train, k, features)
    oof = None
    names = [f"pred_{n}" for n in members]
    for f in range(k):
        fit_part = folded.where(F.col("fold") != f)
        held = folded.where(F.col("fold") == f)
        for name, make in members.items():
            m = make().fit(fit_part)
            held = m.copy({m.predictionCol: f"pred_{name}"}).transform(held)
        part = held.select(LABEL, *names)
        oof = part if oof is None else oof.unionByName(part)
    from pyspark.ml.feature import VectorAssembler
    meta_in = VectorAssembler(inputCols=names, outputCol="meta_features").transform(oof)
    meta_est = (meta or (lambda: LinearRegression(labelCol=LABEL)))()
    meta_model = meta_est.copy({meta_est.featuresCol: "meta_features"}).fit(meta_in)
    full = {name: make().fit(train) for name, make in members.items()}
    return full, meta_model, names


def stacking_predict(full: dict, meta_model, names: Sequence[str], df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    out = df
    for name, m in full.items():
        out = m.copy({m.predictionCol: f"pred_{name}"}).transform(out)
    out = VectorAssembler(inputCols=list(names), outputCol="meta_features").transform(out)
    return meta_model.transform(out)


# ---- M8 k-fold report -----------------------------------------------------------

def cv_report(make: Callable[[], object], train: DataFrame, k: int = C.CV_REPORT_FOLDS, name: str = "model",
              parallelism: int = 1):
    """M8: per fold train and test R2/MAE/MSE and fit/score seconds; returns
    a list of dict rows (k rows, bounded).  With ``parallelism`` folds run side
    by side and their seconds include waiting for each other."""
    folded = _folded(train, k)

    def fold(f: int) -> dict:
        tr = folded.where(F.col("fold") != f)
        te = folded.where(F.col("fold") == f)
        t0 = time.time()
        m = make().fit(tr)
        fit_s = time.time() - t0
        t1 = time.time()
        m_te = metrics_row(m.transform(te))
        score_s = time.time() - t1
        m_tr = metrics_row(m.transform(tr))
        return {"model": name, "fold": f, "train_r2": m_tr["r2"], "test_r2": m_te["r2"],
                "train_mae": m_tr["mae"], "test_mae": m_te["mae"], "train_mse": m_tr["mse"],
                "test_mse": m_te["mse"], "fit_seconds": fit_s, "score_seconds": score_s}
    return _each(fold, range(k), parallelism)


def _each(job: Callable, items: Sequence, parallelism: int) -> list:
    """Jobs of the driver side by side, in order."""
    if parallelism <= 1:
        return [job(i) for i in items]
    with ThreadPool(parallelism) as pool:
        return pool.map(job, items, chunksize=1)


def cv_summary(rows: list[dict]) -> list[dict]:
    """Means over the folds of each model, by test MAE (ties by name)."""
    out = []
    for name in sorted({r["model"] for r in rows}):
        mine = [r for r in rows if r["model"] == name]
        means = {c: sum(r[c] for r in mine) / len(mine) for c in mine[0] if c not in ("model", "fold")}
        out.append({"model": name, "folds": len(mine), **means})
    out.sort(key=lambda r: (r["test_mae"], r["model"]))
    return [{"rank": i + 1, **r} for i, r in enumerate(out)]


def cv_mean_r2(make: Callable[[], object], folded: DataFrame, k: int, parallelism: int = 1) -> float:
    """Mean test R2 over the ``fold`` column."""
    def fold(f: int) -> float:
        m = make().fit(folded.where(F.col("fold") != f))
        return metrics_row(m.transform(folded.where(F.col("fold") == f)))["r2"]
    return sum(_each(fold, range(k), parallelism)) / k


# ---- M9-M11 searches ---------------------------------------------------------------

def _search(est, maps: list[dict], folded: DataFrame, k: int, parallelism: int) -> CrossValidatorModel:
    """Mean R2 of each parameter map over the ``fold`` column and the best map
    fitted on all rows.  Every fit reads the stored folds; ``CrossValidator``
    would cache each fold's two sides in the executors."""
    evaluator = RegressionEvaluator(labelCol=LABEL, metricName="r2")

    def score(job: tuple[int, dict]) -> float:
        f, params = job
        model = est.fit(folded.where(F.col("fold") != f), params)
        return evaluator.evaluate(model.transform(folded.where(F.col("fold") == f), params))
    scores = _each(score, [(f, m) for f in range(k) for m in maps], parallelism)
    means = np.array(scores).reshape(k, len(maps)).mean(axis=0)
    return CrossValidatorModel(est.fit(folded, maps[int(np.argmax(means))]), avgMetrics=means.tolist())


def grid_search(est, grid: dict, train: DataFrame, k: int = 5, parallelism: int = 2, source=None):
    """``ParamGridBuilder``, cross-validated on a hash fold column
    (``source`` as in :func:`_folded`)."""
    builder = ParamGridBuilder()
    for p, values in grid.items():
        builder = builder.addGrid(est.getParam(p), list(values))
    return _search(est, builder.build(), _folded(train, k, est.getFeaturesCol(), source=source), k, parallelism)


def random_search(est, space: dict, train: DataFrame, n_candidates: int = C.SEARCH_CANDIDATES,
                  k: int = C.SEARCH_FOLDS, seed: int = 42, parallelism: int = 2):
    """M9: ``n_candidates`` parameter maps sampled from the space, refit by R2."""
    rng = random.Random(seed)
    keys = list(space)
    combos = list(itertools.product(*[space[p] for p in keys]))
    picks = rng.sample(combos, min(n_candidates, len(combos)))
    maps = [{est.getParam(p): v for p, v in zip(keys, combo)} for combo in picks]
    return _search(est, maps, _folded(train, k, est.getFeaturesCol()), k, parallelism), maps


def tuned_gbt(params: dict, **kw) -> HistGBTRegressor:
    """A boosted model from a point of ``C.TUNING_SPACE``."""
    return gbt(max_iter=params["n_estimators"], max_depth=params["max_depth"], step=params["learning_rate"],
               subsample=params["subsample"], colsample=params["colsample_bytree"], seed=params["random_state"], **kw)


def tune_gbt(train: DataFrame, space: dict = C.TUNING_SPACE, max_trials: int = C.TUNING["n_trials"],
             budget_seconds: float = C.TUNING["timeout"], k: int = C.TUNING["cv_folds"], seed: int = 42,
             parallelism: int = 4, table: str | None = None):
    """A study over ``space`` (objective: mean k-fold R2), then a refit of
    the best point with early stopping on a fifth of the rows.  Returns (model,
    best parameters, trials, whether the deadline cut the study)."""
    folded = _folded(EV.with_validation_flag(train), k, "features", "is_validation")
    best, trials, cut = tuning.study(lambda p: cv_mean_r2(lambda: tuned_gbt(p), folded, k, parallelism), space,
                                     max_trials, budget_seconds, seed, train.sparkSession, table)
    model = tuned_gbt(best, validationCol="is_validation", patience=C.GBT_PATIENCE).fit(folded)
    return model, best, trials, cut


def ranked(rows: list[dict]) -> list[dict]:
    """Models by test MAE, with the best by R2 marked."""
    best = max(rows, key=lambda r: r["r2"])["model"]
    rows = sorted(rows, key=lambda r: (r["mae"], r["model"]))
    return [{"mae_rank": i + 1, **r, "best_by_r2": r["model"] == best} for i, r in enumerate(rows)]


def fit_full(features: Pipeline, est, train: DataFrame) -> PipelineModel:
    """Preprocessing + regressor as one ``PipelineModel`` (S9 round trip)."""
    return Pipeline(stages=[*features.getStages(), est]).fit(train)
