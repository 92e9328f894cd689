"""The sampler, the trial log and the reports of the model comparison."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from marktwert import config as C
from marktwert.operators import models as M
from marktwert.operators import tuning as T

SPACE = {"a": list(range(10)), "b": list(range(10)), "c": ["x", "y", "z"]}


def score(p):
    return -abs(p["a"] - 7) - abs(p["b"] - 2) - (p["c"] != "y")


def test_sampler_beats_random_choice():
    """Mean best of 40 trials over 20 seeds."""
    learned, drawn = [], []
    for seed in range(20):
        _, trials, cut = T.study(score, SPACE, 40, 1e9, seed)
        assert not cut and len(trials) == 40
        learned.append(max(t["score"] for t in trials))
        rng = random.Random(seed)
        drawn.append(max(score({p: rng.choice(v) for p, v in SPACE.items()}) for _ in range(40)))
    assert np.mean(learned) > np.mean(drawn) + 0.3


def test_deadline_is_told_and_the_first_trial_runs():
    now = iter(range(0, 10_000, 10))
    best, trials, cut = T.study(score, SPACE, 30, 35, clock=lambda: next(now))
    assert cut and 1 <= len(trials) < 30 and best == max(trials, key=lambda t: t["score"])["params"]


def test_study_goes_on_from_its_table(spark, tmp_path):
    table = str(tmp_path / "trials")
    _, first, cut = T.study(score, SPACE, 4, 1e9, 1, spark, table)
    assert not cut and T.read_trials(spark, table)[3]["params"] == first[3]["params"]
    _, more, _ = T.study(score, SPACE, 7, 1e9, 1, spark, table)
    assert [t["params"] for t in more[:4]] == [t["params"] for t in first]
    _, whole, _ = T.study(score, SPACE, 7, 1e9, 1)
    assert [t["params"] for t in whole] == [t["params"] for t in more]


@pytest.fixture(scope="module")
def listings(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(240, 3)), 2)
    rows = [(Vectors.dense(v), float(np.round(1000 + 200 * v[0] - 90 * v[1] + rng.normal() * 20, 2)), float(v[2]))
            for v in x]
    path = str(tmp_path_factory.mktemp("listings") / "rows")
    spark.createDataFrame(rows, ["features", "price", "age"]).write.parquet(path)
    return spark.read.parquet(path)


def test_tuning_refits_with_patience(listings):
    space = {**C.TUNING_SPACE, "n_estimators": [6, 12], "max_depth": [2, 3], "learning_rate": [0.3, 0.6]}
    model, best, trials, cut = M.tune_gbt(listings, space, max_trials=2, budget_seconds=1e9, k=2, parallelism=2)
    assert len(trials) == 2 and not cut and set(best) == set(C.TUNING_SPACE)
    assert 1 <= model.getNumTrees <= best["n_estimators"] and M.metrics_row(model.transform(listings))["r2"] > 0.5


def test_all_members_take_part_in_report_vote_stack_and_search(listings):
    settings = {"knn": {"k": 3}, "gbt": {"max_iter": 5, "max_depth": 2, "step": 0.4}, "rf": {"num_trees": 3, "max_depth": 3}}
    rows = []
    for name, make in M.members(settings).items():
        rows += M.cv_report(make, listings, k=2, name=name, parallelism=2)
    table = M.cv_summary(rows)
    assert [r["rank"] for r in table] == [1, 2, 3] and {r["model"] for r in table} == set(settings)
    assert [r["test_mae"] for r in table] == sorted(r["test_mae"] for r in table)
    fitted = {n: make().fit(listings) for n, make in M.members(settings).items()}
    votes = M.voting(fitted, listings).select("pred_knn", "pred_gbt", "pred_rf", "prediction").collect()
    assert all(abs(sum(r[:3]) / 3 - r[3]) < 1e-9 for r in votes)
    full, meta, names = M.stacking(M.members(settings), listings, k=2)
    assert M.metrics_row(M.stacking_predict(full, meta, names, listings))["r2"] > 0.5
    cv, maps = M.random_search(M.knn(), {"k": [1, 3, 5]}, listings, n_candidates=2, k=2)
    assert len(maps) == 2 and cv.bestModel.getOrDefault("k") in (1, 3, 5)
    ranked = M.ranked([{"model": "a", "mae": 2.0, "r2": 0.9}, {"model": "b", "mae": 1.0, "r2": 0.8}])
    assert [(r["model"], r["mae_rank"], r["best_by_r2"]) for r in ranked] == [("b", 1, False), ("a", 2, True)]


@pytest.mark.parametrize("query", ["cv_report", "random_search", "tune_gbt"])
def test_searches_and_reports_run_at_their_full_sizes(query, monkeypatch):
    """folds, members, spaces, trials and deadline as in ``config``."""
    from marktwert.plans import model_queries as Q
    asked = []

    class Asked(Exception):
        pass

    def report(make, train, k=None, name=None, **kw):
        asked.append((name, k))
        return []

    def search(est, space, train, n_candidates=C.SEARCH_CANDIDATES, k=C.SEARCH_FOLDS, **kw):
        asked.append((space, n_candidates, k))
        raise Asked

    def tune(train, space=C.TUNING_SPACE, max_trials=C.TUNING["n_trials"], budget_seconds=C.TUNING["timeout"],
             k=C.TUNING["cv_folds"], **kw):
        asked.append((space, max_trials, budget_seconds, k))
        raise Asked

    def all_members(settings):
        asked.append(settings)
        return dict.fromkeys(settings)
    monkeypatch.setattr(Q, "prepared", lambda spark, sf: (None, None, None))
    for name, double in (("members", all_members), ("cv_report", report), ("random_search", search), ("tune_gbt", tune),
                         ("knn", lambda: None), ("gbt", lambda: None), ("random_forest", lambda: None)):
        monkeypatch.setattr(M, name, double)
    monkeypatch.setattr(M, "cv_summary", lambda rows: (_ for _ in ()).throw(Asked()))
    with pytest.raises(Asked):
        getattr(Q, f"q_{query}")(None, "")
    assert asked == {"cv_report": [C.PLAIN_MODELS, *((name, 10) for name in C.PLAIN_MODELS)],
                     "random_search": [(C.SEARCH_SPACES["knn"], 5, 5)],
                     "tune_gbt": [(C.TUNING_SPACE, 30, 1200, 5)]}[query]


def test_grid_search_stores_the_column_that_the_vector_is_made_of(spark, monkeypatch, tmp_path):
    """the dense components were stored with every fold."""
    from pyspark.ml.feature import VectorSlicer
    rng = np.random.default_rng(4)
    rows = [(Vectors.sparse(40, sorted(set(i[:3].tolist())), [1.0] * len(set(i[:3].tolist()))), float(i[0]), float(i[1]))
            for i in rng.integers(0, 40, (200, 4))]
    spark.createDataFrame(rows, ["assembled", "price", "age"]).write.parquet(str(tmp_path / "rows"))
    made = VectorSlicer(inputCol="assembled", outputCol="features", indices=list(range(0, 40, 2)))
    train = made.transform(spark.read.parquet(str(tmp_path / "rows")))
    kept, real = [], M.stored
    monkeypatch.setattr(M, "stored", lambda df, name: kept.append(df.columns) or real(df, name))
    grid = {"regParam": [0.1, 1.0]}
    plain, made_anew = (M.grid_search(M.linear(), grid, train, k=2, source=s) for s in (None, ("assembled", made)))
    assert kept == [["features", "price", "fold"], ["assembled", "price", "fold"]]
    assert plain.avgMetrics == pytest.approx(made_anew.avgMetrics)
    assert plain.bestModel.coefficients.toArray() == pytest.approx(made_anew.bestModel.coefficients.toArray())
