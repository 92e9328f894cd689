"""Brute-force NumPy references for the custom statistical plans and
invariants of the fitted transforms."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marktwert.operators import evaluation as EV
from marktwert.operators import features as FE
from marktwert.operators import stats

RNG = np.random.default_rng(7)


def _frame(spark, n=400):
    x = RNG.integers(1, 13, n)
    y = np.maximum(np.round(RNG.normal(5000, 2000, n) + x * 50, 0), 1.0)
    y[:20] = y[20:40]                          # ties in y
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(x, y)], "x int, y double"), x, y


def _kendall_brute(x, y):
    n = len(x)
    nc = nd = 0
    for i in range(n):
        dx = np.sign(x[i + 1:] - x[i])
        dy = np.sign(y[i + 1:] - y[i])
        s = dx * dy
        nc += int((s > 0).sum())
        nd += int((s < 0).sum())
    n0 = n * (n - 1) / 2
    _, tx = np.unique(x, return_counts=True)
    _, ty = np.unique(y, return_counts=True)
    n1 = (tx * (tx - 1) / 2).sum()
    n2 = (ty * (ty - 1) / 2).sum()
    return nc, nd, (nc - nd) / math.sqrt((n0 - n1) * (n0 - n2))


def test_kendall_equals_brute_force(spark):
    df, x, y = _frame(spark)
    r = stats.corr_kendall(df, "x", "y").first()
    nc, nd, tau = _kendall_brute(x, y)
    assert (r.concordant, r.discordant) == (nc, nd)
    assert r.tau_b == pytest.approx(tau, abs=1e-6)


def test_kendall_high_cardinality_equals_brute_force(spark):
    # x with ~700 levels (three digit levels in base 16), ties on both sides,
    # and a hot x value holding a third of the rows
    n = 1500
    x = RNG.integers(0, 700, n)
    x[: n // 3] = 350
    y = np.round(RNG.normal(0, 40, n) + x * 0.2, 0)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(x, y)], "x long, y double")
    r = stats.corr_kendall(df, "x", "y").first()
    nc, nd, tau = _kendall_brute(x, y)
    assert (r.concordant, r.discordant) == (nc, nd)
    assert r.tau_b == pytest.approx(tau, abs=1e-6)


def test_kendall_high_cardinality_string_key(spark):
    n = 600
    xi = RNG.integers(0, 400, n)
    y = RNG.integers(0, 50, n).astype(float)
    df = spark.createDataFrame([(f"k{int(a):04d}", float(b)) for a, b in zip(xi, y)], "x string, y double")
    r = stats.corr_kendall(df, "x", "y").first()
    nc, nd, tau = _kendall_brute(xi, y)
    assert (r.concordant, r.discordant) == (nc, nd)
    assert r.tau_b == pytest.approx(tau, abs=1e-6)


def _avg_rank(v):
    order = np.argsort(v, kind="mergesort")
    ranks = np.empty(len(v))
    ranks[order] = np.arange(1, len(v) + 1)
    out = np.empty(len(v))
    for u in np.unique(v):
        m = v == u
        out[m] = ranks[m].mean()
    return out


def test_spearman_and_prefix_ranks(spark):
    df, x, y = _frame(spark)
    got = {(r.col_a, r.col_b): r.corr for r in stats.corr_spearman(df, ["x", "y"]).collect()}
    want = np.corrcoef(_avg_rank(x.astype(float)), _avg_rank(y))[0, 1]
    assert got[("y", "x")] == pytest.approx(want, abs=1e-6)
    ranks = {r.y: r.rank_y for r in stats.average_rank(df, "y").collect()}
    ref = dict(zip(y.tolist(), _avg_rank(y).tolist()))
    assert all(ranks[k] == pytest.approx(v) for k, v in ref.items())


def test_kde_integrates_to_one(spark):
    df, _, y = _frame(spark)
    pts = sorted((r.x, r.density) for r in stats.kde(df, "y", grid=400).collect())
    xs = np.array([p[0] for p in pts])
    ds = np.array([p[1] for p in pts])
    h = np.std(y, ddof=1) * len(y) ** -0.2
    mid = xs[len(xs) // 2]
    brute = np.exp(-0.5 * ((mid - y) / h) ** 2).sum() / (len(y) * h * math.sqrt(2 * math.pi))
    assert ds[len(ds) // 2] == pytest.approx(brute, rel=1e-5)
    assert np.trapezoid(ds, xs) == pytest.approx(1.0, abs=0.05)


def test_boxcox_lambda_near_brute_force(spark):
    df, _, y = _frame(spark)
    lam = FE.boxcox_lambda(df, "y")
    grid = np.linspace(-2, 2, 4001)
    n, sl = len(y), np.log(y).sum()

    def llf(l):
        t = np.log(y) if abs(l) < 1e-12 else (y ** l - 1) / l
        return (l - 1) * sl - n / 2 * math.log(t.var())
    best = grid[np.argmax([llf(v) for v in grid])]
    assert abs(lam - best) < 2e-3
    assert llf(lam) >= llf(best) - 1e-6


def test_quantile_normal_properties(spark):
    df, _, y = _frame(spark, 2000)
    m = FE.QuantileNormalizer(inputCols=["y"], nQuantiles=100).fit(df)
    out = np.array([r.y_quantile for r in m.transform(df).collect()])
    assert abs(out.mean()) < 0.05 and abs(out.std() - 1) < 0.05
    assert out.max() <= 5.2 and out.min() >= -5.2
    # monotone in the input
    pairs = sorted((r.y, r.y_quantile) for r in m.transform(df).collect())
    assert all(b[1] >= a[1] - 1e-12 for a, b in zip(pairs, pairs[1:]))


def test_outlier_clipper_keeps_nulls_and_bounds(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]] + [(None,)], "p double")
    m = FE.OutlierClipper(inputCols=["p", "absent"]).fit(df)
    lo, hi = m.bounds["p"]
    vals = [r.p for r in m.transform(df).collect()]
    assert vals[-1] is None
    assert all(lo <= v <= hi for v in vals[:-1])
    assert "absent" not in m.bounds


def test_split_is_disjoint_complete_and_stable(spark):
    rows = [(float(p), float(k), float(w), int(a)) for p, k, w, a in
            zip(RNG.integers(200, 20000, 3000), RNG.integers(1, 50, 3000) * 3000,
                RNG.integers(1, 40, 3000) * 25, RNG.integers(1, 30, 3000))]
    df = spark.createDataFrame(rows, "price double, kilometer double, powerPS double, age int")
    train, test = EV.train_test_split(df)
    a, b = train.count(), test.count()
    assert a + b == 3000 and 0.15 < b / 3000 < 0.25
    assert train.intersect(test).count() == 0
    again = EV.train_test_split(df.repartition(7))[1]
    assert again.exceptAll(test).count() == 0


def test_one_hot_drop_first_and_unknown_zero(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "cat string")
    model = FE.Pipeline(stages=FE.one_hot_stages(["cat"])).fit(train)
    test = spark.createDataFrame([("a",), ("b",), ("c",), ("zzz",)], "cat string")
    got = {r.cat: r.cat_ohe.toArray().tolist() for r in model.transform(test).collect()}
    assert got["a"] == [0.0, 0.0] and got["zzz"] == [0.0, 0.0]
    assert sorted([got["b"], got["c"]]) == [[0.0, 1.0], [1.0, 0.0]]


def test_model_beats_mean_and_roundtrips(spark, tmp_path):
    from marktwert.operators import models as M
    from pyspark.ml.feature import VectorAssembler
    n = 600
    x1 = RNG.uniform(0, 10, n)
    x2 = RNG.uniform(0, 5, n)
    y = 300 * x1 - 100 * x2 + RNG.normal(0, 50, n) + 2000
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x1, x2, y)],
                               "a double, b double, price double")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    m = M.gbt(max_iter=10, max_depth=3, step=0.3).fit(df)
    r = EV.regression_metrics(m.transform(df)).first()
    assert r.r2 > 0.8
    path = str(tmp_path / "gbt")
    m.write().overwrite().save(path)
    from marktwert.operators.boosting import HistGBTRegressionModel
    again = HistGBTRegressionModel.load(path)
    d = m.transform(df).select("prediction").collect()
    e = again.transform(df).select("prediction").collect()
    assert d == e


def test_feature_estimators_persist(spark, tmp_path):
    df = spark.createDataFrame([(float(v), float(v % 7 + 1)) for v in range(1, 200)], "p double, q double")
    m = FE.BoxCoxStandardizer(inputCols=["p"]).fit(df)
    path = str(tmp_path / "bc")
    m.write().overwrite().save(path)
    again = FE.BoxCoxModel.load(path)
    assert again._state() == m._state()
    a = [r.p_boxcox for r in m.transform(df).collect()]
    b = [r.p_boxcox for r in again.transform(df).collect()]
    assert a == b
    assert abs(np.mean(a)) < 1e-9 and abs(np.std(a) - 1) < 1e-9


def _lowess_ref(x, y, x0, frac):
    n = len(x)
    k = math.ceil(frac * n)
    d = np.abs(x - x0)
    h = np.sort(d)[k - 1]
    u = d / h if h > 0 else np.where(d == 0, 0.0, 1.0)
    w = np.where(u < 1, (1 - u ** 3) ** 3, 0.0)
    dx = x - x0
    s0, s1, s2 = w.sum(), (w * dx).sum(), (w * dx * dx).sum()
    t0, t1 = (w * y).sum(), (w * dx * y).sum()
    den = s0 * s2 - s1 * s1
    b = (s0 * t1 - s1 * t0) / den if abs(den) > 1e-12 else 0.0
    return (t0 - b * s1) / s0


def test_lowess_matches_numpy(spark):
    x = RNG.integers(1, 30, 300).astype(float)
    y = 100 - 2 * x + RNG.normal(0, 5, 300)
    g = np.where(np.arange(300) % 2 == 0, "a", "b")
    df = spark.createDataFrame([(str(a), float(b), float(c)) for a, b, c in zip(g, x, y)],
                               "g string, x double, y double")
    got = {(r.g, r.point): (r.x, r.fitted) for r in stats.lowess_trend(df, "x", "y", "g", grid=7).collect()}
    for grp in ["a", "b"]:
        m = g == grp
        for p in range(7):
            x0, fit = got[(grp, p)]
            assert fit == pytest.approx(_lowess_ref(x[m], y[m], x0, 2 / 3), abs=1e-5)


def test_knn_regress_equals_brute_force(spark):
    from marktwert.operators import knn
    rng = np.random.default_rng(11)
    train, test = [], []
    for blk, n in (("a", 300), ("b", 40), ("c", 3)):
        for _ in range(n):
            train.append((blk, float(rng.uniform(0, 10)), float(rng.uniform(0, 50)), float(rng.uniform(0, 3)),
                          float(round(rng.uniform(1000, 9000), 2))))
    train += [train[0]] * 4                                   # duplicated listing
    train.append(("a", 1e6, 25.0, 1.5, 5000.0))              # a mistyped value on the training side
    for blk, n in (("a", 60), ("b", 10), ("c", 2), ("d", 2)):
        for _ in range(n):
            test.append((blk, float(rng.uniform(0, 10)), float(rng.uniform(0, 50)), float(rng.uniform(0, 3)), 0.0))
    test.append(train[0][:4] + (0.0,))                        # a query on top of the duplicates
    test.append(("a", 200.0, 400.0, 30.0, 0.0))              # far outside: several widenings
    schema = "brand string, x double, y double, z double, price double"
    tr = spark.createDataFrame(train, schema).withColumn("model", F.lit("m"))
    te = spark.createDataFrame(test, schema).withColumn("model", F.lit("m"))
    got = {(r.brand, r.x, r.y, r.z): r.prediction
           for r in knn.knn_regress(tr, te, ["x", "y", "z"], k=5, cell=0.5).collect()}
    arr = np.array([t[1:4] for t in train])
    mean, std = arr.mean(axis=0), arr.std(axis=0)
    ztr = [(t[0], tuple((np.array(t[1:4]) - mean) / std), t[4]) for t in train]
    zte = [(t[0], tuple((np.array(t[1:4]) - mean) / std), 0.0) for t in test]
    want = knn.knn_brute(ztr, zte, 5)
    for t, w in zip(test, want):
        g = got[(t[0], t[1], t[2], t[3])]
        if w is None:
            assert g is None
        else:
            assert g == pytest.approx(w, abs=1e-6)


def test_knn_symmetric_tie_is_shared(spark):
    # two listings 150 PS below and above the query are tied in exact
    # arithmetic; with k = 2 they share the second slot equally
    from marktwert.operators import knn
    schema = "brand string, model string, powerPS double, kilometer double, age int, price double"
    train = spark.createDataFrame([
        ("b", "m", 500.0, 100000.0, 7, 1000.0), ("b", "m", 350.0, 100000.0, 7, 3000.0),
        ("b", "m", 650.0, 100000.0, 7, 7000.0), ("b", "m", 990.0, 40000.0, 19, 9000.0),
        ("b", "m", 120.0, 150000.0, 2, 500.0)], schema)
    test = spark.createDataFrame([("b", "m", 500.0, 100000.0, 7, 0.0)], schema)
    r = knn.knn_regress(train, test, ["powerPS", "kilometer", "age"], k=2).first()
    assert r.prediction == pytest.approx((1000.0 + (3000.0 + 7000.0) / 2) / 2, abs=1e-9)


def test_knn_regress_reads_each_side_once_before_the_last_join(spark, tmp_path):
    """Every read of a side leaves a file per partition."""
    import uuid

    from marktwert.operators import knn
    rng = np.random.default_rng(12)

    def side(name, n):
        folder = tmp_path / name
        folder.mkdir()
        rows = [("b", f"m{i % 3}", float(a), float(b), float(p))
                for i, (a, b, p) in enumerate(zip(rng.integers(0, 30, n), rng.normal(0, 9, n), rng.integers(1, 99, n)))]

        def noted(batches, at=str(folder)):
            open(f"{at}/{uuid.uuid4().hex}", "w").close()
            yield from batches
        schema = "brand string, model string, x double, y double, price double"
        df = spark.createDataFrame(rows, schema).coalesce(1).mapInArrow(noted, schema)
        return rows, df, lambda: len(list(folder.iterdir()))
    train_rows, train, train_reads = side("train", 400)
    test_rows, test, test_reads = side("test", 60)
    got = {(r["model"], r["x"], r["y"]): r["prediction"] for r in knn.knn_regress(train, test, ["x", "y"], k=4).collect()}
    s = [np.std([r[i] for r in train_rows]) for i in (2, 3)]
    scaled = [[(r[1], (r[2] / s[0], r[3] / s[1]), r[4]) for r in rows] for rows in (train_rows, test_rows)]
    for row, want in zip(test_rows, knn.knn_brute(*scaled, 4)):
        assert got[row[1], row[2], row[3]] == pytest.approx(want, abs=1e-6)
    assert train_reads() == 1 and test_reads() == 2
