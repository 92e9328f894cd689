"""Leading components without a square matrix, against a full decomposition."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors

from marktwert.operators import features as FE


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    scale = np.concatenate([np.linspace(9, 3, 25), np.full(65, 0.4)])
    x = (rng.normal(size=(800, 90)) * scale) @ np.linalg.qr(rng.normal(size=(90, 90)))[0] + rng.normal(size=90) * 50
    path = str(tmp_path_factory.mktemp("wide") / "rows")
    spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x)], ["id", "assembled"]).repartition(4).write.parquet(path)
    return spark.read.parquet(path), x


@pytest.mark.parametrize("start,share", [(32, 0.95), (8, 0.9), (90, 0.95), (4, 0.999)])
def test_variances_equal_the_full_fit(wide, start, share):
    df, x = wide
    full = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    k = int(np.searchsorted(np.cumsum(full) / full.sum(), share - 1e-12)) + 1
    mean, variances, loadings, total = FE.leading_components(df, "assembled", share, start=start, tolerance=1e-10)
    assert len(variances) == k and total == pytest.approx(full.sum(), rel=1e-9)
    assert np.allclose(variances, full[:k], rtol=1e-6)
    assert np.allclose(loadings.T @ loadings, np.eye(k), atol=1e-9) and np.allclose(mean, x.mean(axis=0))


def test_wide_estimator_projects_and_persists(wide, tmp_path):
    df, x = wide
    model = FE.SharePCA(share=0.9, wide=50).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    got = {r["id"]: r["features"].toArray() for r in PipelineModel.load(str(tmp_path / "m")).transform(df).collect()}
    scores = np.stack([got[i] for i in range(len(x))])
    full = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(scores.var(axis=0, ddof=1), full[:scores.shape[1]], rtol=1e-6)
    assert np.allclose(scores.mean(axis=0), 0, atol=1e-8)
