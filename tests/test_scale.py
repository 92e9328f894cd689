"""What model, cache and comparison queries store, and how they look things up."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marktwert.operators import boosting as B
from marktwert.operators import comparables
from marktwert.operators import models as M
from marktwert.operators import scoring


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with the three tables that make listings."""
    rng = random.Random(3)
    folder = tmp_path_factory.mktemp("tables")
    day = dt.datetime(1998, 1, 1)
    parts = [(i, f"model{i % 4}", f"brand{i % 3}", f"TYPE{i % 2}", i % 40 + 1) for i in range(60)]
    orders = [(i, ["1-URGENT", "2-HIGH", "3-MEDIUM"][i % 3]) for i in range(150)]
    lines = [(i % 150, rng.randrange(60), i % 7 + 1, float(rng.randrange(4, 40)), round(rng.uniform(2000, 90000), 2),
              "AN"[i % 2], "FO"[i % 3 == 0], day + dt.timedelta(days=rng.randrange(900))) for i in range(900)]
    for name, rows, schema in (
            ("part", parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
            ("orders", orders, "o_orderkey long, o_orderpriority string"),
            ("lineitem", lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, "
             "l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_prepared_rows_are_stored_without_dense_vectors(spark, tables):
    from marktwert.operators import evaluation as EV
    from marktwert.plans import model_queries as Q
    from marktwert.plans.common import training
    train, test, pipe = Q.prepared(spark, tables)
    for frame, side in zip((train, test), EV.train_test_split(training(spark, tables))):
        stored = spark.read.parquet(frame.inputFiles()[0].rsplit("/", 1)[0])
        assert set(stored.columns) == {*side.columns, "assembled"}
        want = sorted(tuple(r[0]) for r in pipe.transform(side).select("features").collect())
        assert want and sorted(tuple(r[0]) for r in frame.select("features").collect()) == want


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(240, 3)), 2)
    y = x @ [30.0, -20.0, 5.0] + rng.normal(size=240) + 900
    return spark.createDataFrame([(i, Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x, y))],
                                 ["age", "features", "price"])


def test_grid_search_caches_no_folds_and_scores_like_a_loop(vectors, monkeypatch):
    def refuse(self, *_):
        raise AssertionError("a fold was cached")
    monkeypatch.setattr(DataFrame, "cache", refuse)
    grid = {"regParam": [0.01, 50.0], "elasticNetParam": [0.0, 0.5]}
    cv = M.grid_search(M.linear(), grid, vectors, k=3)
    folded = M.EV.with_folds(vectors, 3)
    want = []
    for reg in grid["regParam"]:
        for elastic in grid["elasticNetParam"]:
            scores = []
            for f in range(3):
                held = M.linear(reg, elastic).fit(folded.where(F.col("fold") != f)).transform(folded.where(F.col("fold") == f))
                scores.append(M.RegressionEvaluator(labelCol="price", metricName="r2").evaluate(held))
            want.append(sum(scores) / 3)
    assert sorted(cv.avgMetrics) == pytest.approx(sorted(want))
    assert max(cv.avgMetrics) == pytest.approx(max(want)) and cv.bestModel.getRegParam() == 0.01


def test_folds_are_stored_without_other_columns(vectors):
    wide = vectors.withColumn("assembled", F.col("features"))
    assert M._folded(wide, 3).columns == ["features", "price", "fold"]


def test_generations_of_many_purges_by_lookup(spark):
    start = dt.datetime(2024, 1, 1)
    rng = random.Random(5)
    purged = [start + dt.timedelta(seconds=rng.randrange(5000)) for _ in range(700)] + [None]
    asked = [start + dt.timedelta(seconds=rng.randrange(-50, 5100)) for _ in range(300)] + [None]
    purges = spark.createDataFrame([(p,) for p in purged], "purged_at timestamp")
    reqs = spark.createDataFrame([(i, "k", t) for i, t in enumerate(asked)], "id long, k string, t timestamp")
    out = scoring.with_generation(reqs, "k", "t", purges)
    got = {r["id"]: r["k"] for r in out.collect()}
    for i, t in enumerate(asked):
        assert got[i] == f"k#{sum(t is not None and p is not None and p <= t for p in purged)}"
    # no list of purges travels with the rows
    assert "NestedLoopJoin" not in out._jdf.queryExecution().toString()
    none = scoring.with_generation(reqs, "k", "t", purges.limit(0))
    assert {r["k"] for r in none.collect()} == {"k#0"}


def test_verdicts_sum_strips_of_the_band(spark, monkeypatch, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice(["m", None]), rng.choice([0.0, 10.0, 40.0, 45.0, 100.0, 130.0, None]),
             rng.choice([-5.0, 0.0, 3000.0, 9000.0, 12000.0, 39000.0]), float(rng.randrange(100, 999))) for _ in range(200)]
    cars = spark.createDataFrame(rows, "brand string, model string, powerPS double, kilometer double, price double")
    for c in comparables.TIE_ORDER:
        if c not in cars.columns:
            cars = cars.withColumn(c, F.lit("x"))
    cars.write.parquet(str(tmp_path / "cars"))
    cars = spark.read.parquet(str(tmp_path / "cars"))
    pairs = []
    real = comparables._in_band if hasattr(comparables, "_in_band") else None
    monkeypatch.setattr(comparables, "_in_band", lambda *a: pairs.append(real(*a)) or pairs[-1], raising=False)
    got = {(r.brand, r.model, r.powerPS, r.kilometer): (r.n_similar, r.avg_similar_price)
           for r in comparables.price_verdict(cars, cars).collect()}
    for (b, m, p, k), (n, mean) in got.items():
        like = [r[4] for r in rows if m and p is not None and r[:2] == (b, m) and r[2] is not None
                and (p * 0.3 <= r[2] <= p * 1.3 if p > 0 else p == r[2]) and p >= 0
                and (k * 0.3 <= r[3] <= k * 1.3 if k > 0 else k == 0 and r[3] == 0)]
        assert n == len(like) and (mean == pytest.approx(sum(like) / n) if n else mean is None)
    strips, met = (x.count() for x in pairs)
    requests = comparables.distinct_requests(cars)
    direct = comparables.matched_cells(requests, comparables.listing_cells(cars)[0]).count()
    assert met < direct and strips < direct


def test_a_pass_walks_no_earlier_tree_again(vectors):
    est = B.HistGBTRegressor(maxIter=3, maxDepth=3, stepSize=0.3, localRows=50)
    fit = B._Fit(est, vectors)
    want = {r["_row"]: r["_margin"] for r in fit.state.collect()}
    for t in range(2):
        fit._add_trees([fit._tree(t)])
        fit._advance(fit.trees[-1])
        for r in fit.state.collect():
            bins = np.frombuffer(bytes(r["_bins"]), np.uint8)[None, :]
            want[r["_row"]] += fit.trees[t].value[fit.trees[t].leaves(bins, fit.trees[t].bin)][0]
        assert {r["_row"]: r["_margin"] for r in fit._current().collect()} == want
    assert fit.live.storageLevel.useMemory and "pending" not in vars(fit._rows(2, [B._leaf()]))
    fit._release()
    assert fit._current() is fit.state
