"""Histogram boosting and the neighbour index against plain NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from marktwert.operators import boosting as B
from marktwert.operators import neighbors as N


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """600 rows with signal, ties, a constant column and repeated rows."""
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(600, 5)), 1)
    x[:, 4] = 1.0
    x[500:] = x[:100]
    y = np.round(x[:, 0] * 100 + 50 * np.sin(x[:, 1]) + (x[:, 2] > 0) * 70 + rng.normal(size=600) * 5 + 1000, 2)
    held = np.arange(600) % 5 == 0
    path = str(tmp_path_factory.mktemp("small") / "rows")
    spark.createDataFrame([(i, Vectors.dense(a), float(b), bool(h)) for i, (a, b, h) in enumerate(zip(x, y, held))],
                          ["id", "features", "price", "held"]).repartition(3).write.parquet(path)
    return spark.read.parquet(path), x, y, held


def trees_of(model):
    """The trees without the numbering of their nodes."""
    def form(rows, k):
        r = rows[k]
        if r["left"] < 0:
            return (r["value"], r["cover"])
        return (r["feature"], r["bin"], r["cover"], form(rows, r["left"]), form(rows, r["right"]))
    return [form(t.rows, 0) for t in model.trees]


def brute_boost(x, y, held, est):
    """Plain boosting: every threshold of every column of every node."""
    g = est.getOrDefault
    cuts = [np.unique(np.quantile(x[~held, k], np.arange(1, 256) / 256, method="inverted_cdf")) for k in range(x.shape[1])]
    base = round(float(y[~held].mean()), 6)
    spread = (y[~held].max() - y[~held].min()) * 4
    unit = 2.0 ** min(20, 61 - int(np.ceil(np.log2((~held).sum() + 1))) - int(np.ceil(np.log2(spread + 1))))
    margin, curve = np.full(len(y), base), []
    for t in range(g("maxIter")):
        rng = np.random.default_rng([g("seed"), t])
        columns = np.sort(rng.permutation(x.shape[1])[:max(1, int(np.ceil(g("colsample") * x.shape[1])))])
        grad = np.rint((margin - y) * unit)

        def grow(rows, depth):
            total, n = grad[rows].sum() / unit, len(rows)
            leaf = -g("stepSize") * total / (n + g("l2"))
            best = (max(g("minGain"), 1e-6), None)
            if depth < g("maxDepth"):
                for c in columns:
                    for cut in cuts[c]:
                        low = x[rows, c] <= cut
                        nl = low.sum()
                        if nl < 1 or n - nl < 1:
                            continue
                        gl = grad[rows][low].sum() / unit
                        gain = 0.5 * (gl * gl / (nl + g("l2")) + (total - gl) ** 2 / (n - nl + g("l2"))
                                      - total * total / (n + g("l2")))
                        if gain > best[0] * (1 + 1e-12):
                            best = (gain, (c, cut))
            if best[1] is None:
                return lambda z: np.full(len(z), leaf)
            c, cut = best[1]
            a, b = grow(rows[x[rows, c] <= cut], depth + 1), grow(rows[x[rows, c] > cut], depth + 1)
            return lambda z: np.where(z[:, c] <= cut, a(z), b(z))
        margin = margin + grow(np.flatnonzero(~held), 0)(x)
        curve.append(tuple(float(np.sqrt(((margin - y)[h] ** 2).mean())) for h in (~held, held)))
    return margin, curve


def test_boosting_equals_a_plain_loop(small):
    df, x, y, held = small
    est = B.HistGBTRegressor(maxIter=4, maxDepth=3, stepSize=0.3, subsample=1.0, colsample=0.8, validationCol="held")
    model = est.fit(df)
    margin, curve = brute_boost(x, y, held, est)
    got = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    assert np.allclose([got[i] for i in range(len(y))], margin, atol=1e-6)
    assert np.allclose(model.curve, curve, atol=1e-6)
    staged = [r["rmse"] for r in model.staged_errors(df.where("held")).orderBy("iteration").collect()]
    assert np.allclose(staged, [c[1] for c in curve], atol=1e-6)


def test_local_and_distributed_growth_give_the_same_trees(small):
    df = small[0]
    models = [B.HistGBTRegressor(maxIter=3, maxDepth=4, stepSize=0.3, localRows=n).fit(df) for n in (10_000, 120, 40)]
    assert trees_of(models[0]) == trees_of(models[1]) == trees_of(models[2])


def test_small_histograms_are_added_up_without_a_shuffle(small, monkeypatch):
    df = small[0].where("id % 50 > 0")
    est = B.HistGBTRegressor(maxIter=3, maxDepth=4, stepSize=0.3, minRows=3.0, localRows=40)
    monkeypatch.setattr(B, "SUMS", 0, raising=False)
    shuffled = trees_of(est.fit(df))
    monkeypatch.undo()
    monkeypatch.setattr(B, "_split_rows", None)
    assert trees_of(est.fit(df)) == shuffled


def test_patience_stops_like_a_loop(small):
    df = small[0]
    full = B.HistGBTRegressor(maxIter=25, maxDepth=5, stepSize=0.9, l2=0.0, validationCol="held").fit(df)
    errors, best, stop = [c[1] for c in full.curve], 0, len(full.curve) - 1
    for k, e in enumerate(errors):
        best = k if e < errors[best] else best
        if k - best >= 3:
            stop = k
            break
    some = B.HistGBTRegressor(maxIter=25, maxDepth=5, stepSize=0.9, l2=0.0, validationCol="held", patience=3).fit(df)
    assert stop < len(errors) - 1 and some.getNumTrees == best + 1 and len(some.curve) == stop + 1
    assert trees_of(some) == trees_of(full)[:best + 1]


def test_boosting_persists_and_tells_importances(small, tmp_path):
    df = small[0]
    model = B.HistGBTRegressor(maxIter=2, maxDepth=2, stepSize=0.5).fit(df)
    share = model.importances()
    assert abs(share.sum() - 1) < 1e-9 and share[0] == share.max() and share[4] == 0
    model.write().overwrite().save(str(tmp_path / "m"))
    again = B.HistGBTRegressionModel.load(str(tmp_path / "m"))
    assert trees_of(again) == trees_of(model) and again.curve == model.curve
    both = again.transform(model.transform(df).withColumnRenamed("prediction", "first"))
    assert both.where("first <> prediction").count() == 0
    loadings = np.array([[0.6, 0.8], [0.8, -0.6]])
    assert B.source_importances(np.array([1.0, 0.0]), loadings, ["a", "b"]) == pytest.approx({"a": 0.36, "b": 0.64})


def test_boosting_edges(spark):
    rows = [(Vectors.dense([1.0, float("nan")]), 5.0), (Vectors.dense([2.0, 1.0]), 5.0), (Vectors.dense([3.0, 2.0]), None)]
    df = spark.createDataFrame(rows, ["features", "price"])
    model = B.HistGBTRegressor(maxIter=2, maxDepth=2).fit(df)
    assert [r["prediction"] for r in model.transform(df).collect()] == [5.0, 5.0, 5.0]
    with pytest.raises(ValueError):
        B.HistGBTRegressor().fit(df.limit(0))


def brute_knn(x, y, q, k):
    out = []
    for v in q:
        d = N.distances(x, v[None, :])
        dk = np.sort(d)[min(k, len(d)) - 1]
        inside, tied = y[d < dk], y[d == dk]
        take = min(k, len(d)) - len(inside)
        out.append((inside.sum() + tied.sum() * take / len(tied)) / min(k, len(d)))
    return np.array(out)


@pytest.mark.parametrize("k,block", [(5, 2048), (5, 16), (1, 7), (700, 64)])
def test_neighbours_equal_a_plain_scan(small, k, block):
    df, x, y, held = small
    model = N.KNNRegressor(k=k, blockRows=block).fit(df.where("not held"))
    got = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    want = brute_knn(x[~held], y[~held], x, k)
    assert np.allclose([got[i] for i in range(len(y))], want, rtol=0, atol=1e-6)


def test_a_query_vector_is_joined_to_one_block_and_else_to_parts(spark, monkeypatch):
    """in many dimensions nearly every block is in reach."""
    rng = np.random.default_rng(5)
    x, y = np.round(rng.normal(size=(900, 30)), 3), np.round(rng.random(900) * 100, 2)
    x[600:640] = x[:40]  # queries that are training points
    x[300:310] = x[0]
    df = spark.createDataFrame([(i, Vectors.dense(v), float(p)) for i, (v, p) in enumerate(zip(x, y))], ["id", "features", "price"])
    monkeypatch.setattr(N, "PART_ROWS", 64)
    most, probe = [], N._probe

    def counted(pairs, *more):
        most.append(pairs.groupBy(*N.KEY).count().agg({"count": "max"}).first()[0])
        return probe(pairs, *more)
    monkeypatch.setattr(N, "_probe", counted)
    model = N.KNNRegressor(k=6, blockRows=8).fit(df.where("id < 600"))
    got = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    assert most == [1]
    assert np.allclose([got[i] for i in range(900)], brute_knn(x[:600], y[:600], x, 6), rtol=0, atol=1e-6)


def test_neighbours_on_the_feature_vectors(spark):
    """All held-out listings of the small table, in the space of the components."""
    from conftest import SMALL_SF
    from marktwert.plans import model_queries as Q
    train, test, _ = Q.prepared(spark, SMALL_SF)
    pull = [np.array([r["features"].toArray() for r in d.select("features", "price").collect()]) for d in (train, test)]
    price = np.array([r["price"] for r in train.select("features", "price").collect()], float)
    model = N.KNNRegressor(k=5, blockRows=256).fit(train)
    got = sorted(r["prediction"] for r in model.transform(test).collect())
    assert np.allclose(got, sorted(brute_knn(pull[0], price, pull[1], 5)), rtol=0, atol=1e-5)


def test_neighbours_persist_and_edges(spark, tmp_path):
    rows = [(i, Vectors.dense([float(i), 0.0]), float(i)) for i in range(9)]
    nan = [(20, Vectors.dense([float("nan"), 0.0]), 1.0), (21, Vectors.dense([1.0, 0.0]), None)]
    df = spark.createDataFrame(rows + nan, ["id", "features", "price"])
    model = Pipeline(stages=[N.KNNRegressor(k=3)]).fit(df)
    model.write().overwrite().save(str(tmp_path / "p"))
    from pyspark.ml import PipelineModel
    out = {r["id"]: r["prediction"] for r in PipelineModel.load(str(tmp_path / "p")).transform(df).collect()}
    assert out[4] == 4.0 and out[0] == 1.0 and out[20] is None and out[21] == 1.0
    with pytest.raises(ValueError):
        N.KNNRegressor().fit(df.limit(0))


def test_of_two_siblings_the_smaller_one_is_summed_from_blocks(small, monkeypatch):
    """A level above ``localRows`` is one pass
    over blocks, and half of its nodes follow from their parents."""
    asked, real = [], B._Histogram
    monkeypatch.setattr(B, "_Histogram", lambda rows, nodes, *a, **kw: asked.append(nodes) or real(rows, nodes, *a, **kw))
    est = B.HistGBTRegressor(maxIter=1, maxDepth=4, stepSize=0.3, subsample=1.0, colsample=1.0, localRows=40)
    tree = est.fit(small[0]).trees[0].rows
    parents = {r[side]: r for r in tree if r["left"] >= 0 for side in ("left", "right")}
    assert asked[0] == [0] and len(asked) > 2
    for node in (n for nodes in asked[1:] for n in nodes):
        both = [tree[parents[node][side]]["cover"] for side in ("left", "right")]
        assert tree[node]["cover"] == min(both) and max(both) > 40
    fit = B._Fit(est, small[0])
    assert fit._blocks().count() <= fit.tasks and sum(len(b["_y"]) for b in fit._blocks().collect()) == 600
