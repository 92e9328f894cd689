"""Fit/transform feature operators as ``pyspark.ml`` Estimators.

Fitting runs aggregations on the cluster; the driver holds only per-feature
state (bounds, lambda, mean/std, knots, category lists), never rows.
Transforms are Column expressions except the inverse normal CDF of the
quantile transform, which is an Arrow ``pandas_udf``.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import (PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler,
                                VectorSlicer)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions import encode as E
from ..session import stored
from .boosting import source_importances
from .stats import exact_quantiles


class _StateParams(HasInputCols):
    """Input columns plus a JSON ``state`` param that carries fitted values
    (so ``DefaultParamsWritable`` persists models without extra files)."""

    state = Param(Params._dummy(), "state", "fitted state as JSON", typeConverter=TypeConverters.toString)

    def _state(self) -> dict:
        return json.loads(self.getOrDefault(self.state)) if self.isDefined(self.state) else {}


# ---- F1 outlier clipping ------------------------------------------------------

class OutlierClipper(Estimator, _StateParams, DefaultParamsReadable, DefaultParamsWritable):
    """Bounds ``Q1 - f*IQR``, ``Q3 + f*IQR`` per column at fit (one
    aggregation for all columns); clip at transform; missing columns are
    ignored; nulls stay null."""

    factor = Param(Params._dummy(), "factor", "IQR multiplier", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCols: list[str] | None = None, factor: float = C.OUTLIER_FACTOR):
        super().__init__()
        self._setDefault(factor=C.OUTLIER_FACTOR)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "OutlierClipperModel":
        cols = [c for c in self.getInputCols() if c in df.columns]
        f = self.getOrDefault(self.factor)
        bounds = {}
        for c, q in exact_quantiles(df, {c: (0.25, 0.75) for c in cols}).items():
            if q is not None:
                bounds[c] = [q[0] - f * (q[1] - q[0]), q[1] + f * (q[1] - q[0])]
        m = OutlierClipperModel()
        m._set(inputCols=self.getInputCols(), state=json.dumps(bounds))
        return self._copyValues(m)


class OutlierClipperModel(Model, _StateParams, DefaultParamsReadable, DefaultParamsWritable):
    factor = OutlierClipper.factor

    @property
    def bounds(self) -> dict:
        return self._state()

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c, (lo, hi) in self.bounds.items():
            if c in df.columns:
                out = out.withColumn(c, E.null_safe_clip(c, lo, hi))
        return out

    def transform_counted(self, df: DataFrame) -> tuple[DataFrame, Observation]:
        """A23 while transforming: the clipped frame and an observation of the
        values outside the bounds per column, filled by the first action on the
        frame (no second scan)."""
        seen = Observation()
        outside = [F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in self.bounds.items()
                   if c in df.columns]
        return self._transform(df.observe(seen, *outside) if outside else df), seen

    def outlier_counts(self, df: DataFrame) -> DataFrame:
        """A23 for the fitted bounds: rows outside per column, one pass."""
        b = self.bounds
        return df.agg(*[F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in b.items()])


# ---- F2 sequential IQR filtering ---------------------------------------------

def iqr_filter(df: DataFrame, features: Sequence[str], factor: float = C.OUTLIER_FACTOR):
    """Remove outliers feature by feature: the bounds of feature k use the
    rows left by feature k-1.  Returns (filtered frame, [(feature, lo, hi,
    removed)]).  One small aggregation per feature; the frame stays lazy."""
    report = []
    cur = df
    for c in features:
        found = exact_quantiles(cur, {c: (0.25, 0.75)})[c]
        if found is None:  # no values left: nothing to bound
            continue
        q1, q3 = found
        lo, hi = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
        keep = (F.col(c) >= lo) & (F.col(c) <= hi)
        # the pandas mask keeps nulls (comparisons with NaN are False)
        cur = cur.where(keep | F.col(c).isNull())
        report.append((c, lo, hi))
    return cur, report


# ---- F3 Box-Cox ---------------------------------------------------------------

def _boxcox_expr(c: Column, lam: float) -> Column:
    if abs(lam) < 1e-12:
        return F.log(c)
    return (F.pow(c, F.lit(lam)) - 1) / lam


def boxcox_lambda(df: DataFrame, c: str, shift: float = 0.0, lo: float = -2.0, hi: float = 2.0,
                  points: int = 41, rounds: int = 4) -> float:
    """Maximum-likelihood lambda.

    Values are pre-aggregated to (value, count); each round evaluates the
    profile log-likelihood on a grid of lambdas (grid exploded per distinct
    value, one grouped sum), then zooms around the best point.
    """
    x = (F.col(c) + F.lit(shift)).cast("double")
    vals = df.where(F.col(c).isNotNull()).select(x.alias("x"))
    bad = vals.where(F.col("x") <= 0).limit(1).count()
    if bad:
        raise ValueError(f"Box-Cox needs strictly positive {c} (add a shift)")
    counts = vals.groupBy("x").agg(F.count(F.lit(1)).alias("k")).cache()
    try:
        tot = counts.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log("x")).alias("sl")).first()
        n, sum_log = float(tot["n"]), float(tot["sl"])
        best = None
        for _ in range(rounds):
            grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
            g = F.explode(F.array(*[F.lit(v) for v in grid])).alias("lam")
            ex = counts.select("x", "k", g)
            y = F.when(F.abs(F.col("lam")) < 1e-12, F.log("x")).otherwise(
                (F.pow(F.col("x"), F.col("lam")) - 1) / F.col("lam"))
            ex = ex.withColumn("y", y)
            agg = ex.groupBy("lam").agg(F.sum(F.col("k") * F.col("y")).alias("s1"),
                                         F.sum(F.col("k") * F.col("y") * F.col("y")).alias("s2")).collect()
            scored = []
            for r in agg:
                var = r["s2"] / n - (r["s1"] / n) ** 2
                if var <= 0:
                    continue
                llf = (r["lam"] - 1) * sum_log - n / 2 * math.log(var)
                scored.append((llf, r["lam"]))
            best = max(scored)[1]
            step = (hi - lo) / (points - 1)
            lo, hi = best - step, best + step
        return float(best)
    finally:
        counts.unpersist()


class BoxCoxStandardizer(Estimator, _StateParams, DefaultParamsReadable, DefaultParamsWritable):
    """Box-Cox with MLE lambda per column, then z-score with population std
    (``standardize=False`` skips it; ``shift`` adds a constant first, as the
    notebook's ``x + 1`` variant)."""

    standardize = Param(Params._dummy(), "standardize", "z-score after transform",
                        typeConverter=TypeConverters.toBoolean)
    shift = Param(Params._dummy(), "shift", "constant added first", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCols: list[str] | None = None, standardize: bool = True, shift: float = 0.0):
        super().__init__()
        self._setDefault(standardize=True, shift=0.0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "BoxCoxModel":
        shift = self.getOrDefault(self.shift)
        state = {}
        for c in self.getInputCols():
            lam = boxcox_lambda(df, c, shift)
            y = _boxcox_expr(F.col(c) + F.lit(shift), lam)
            r = df.agg(F.avg(y).alias("m"), F.stddev_pop(y).alias("s")).first()
            state[c] = {"lambda": lam, "mean": r["m"], "std": r["s"]}
        m = BoxCoxModel()
        m._set(inputCols=self.getInputCols(), state=json.dumps(state))
        return self._copyValues(m)


class BoxCoxModel(Model, _StateParams, DefaultParamsReadable, DefaultParamsWritable):
    standardize = BoxCoxStandardizer.standardize
    shift = BoxCoxStandardizer.shift

    def output_cols(self) -> list[str]:
        return [f"{c}_boxcox" for c in self.getInputCols()]

    def _transform(self, df: DataFrame) -> DataFrame:
        st = self._state()
        shift = self.getOrDefault(self.shift)
        out = df
        for c in self.getInputCols():
            s = st[c]
            y = _boxcox_expr(F.col(c) + F.lit(shift), s["lambda"])
            if self.getOrDefault(self.standardize):
                y = (y - s["mean"]) / (s["std"] if s["std"] else 1.0)
            out = out.withColumn(f"{c}_boxcox", y)
        return out


# ---- F4 quantile -> normal -----------------------------------------------------

BOUNDS_THRESHOLD = 1e-7


# ---- fixed values: rational approximation of the standard normal quantile -----
_CENTRE_NUM = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
               1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_CENTRE_DEN = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
               6.680131188771972e+01, -1.328068155288572e+01, 1.0]
_TAIL_NUM = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
             -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_TAIL_DEN = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
             3.754408661907416e+00, 1.0]


def _inv_normal(p: np.ndarray) -> np.ndarray:
    """Standard normal quantile for 0 < p < 1, vectorised (relative error
    about 1e-9)."""
    tail = np.minimum(p, 1 - p)
    q = tail - 0.5
    centre = q * np.polyval(_CENTRE_NUM, q * q) / np.polyval(_CENTRE_DEN, q * q)
    t = np.sqrt(-2 * np.log(tail))
    low = np.polyval(_TAIL_NUM, t) / np.polyval(_TAIL_DEN, t)
    lower = np.where(tail < 0.02425, low, centre)  # the quantile of the smaller tail
    return np.where(p <= 0.5, lower, -lower)


def quantile_to_normal(x: np.ndarray, quantiles: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Interpolate ``x`` into the fitted quantiles (averaging the forward and
    reversed interpolation so repeated knots map to their mid rank), clip
    the tails and map through the inverse normal CDF."""
    out = np.full(x.shape, np.nan)
    ok = ~np.isnan(x)
    xv = x[ok]
    p = 0.5 * (np.interp(xv, quantiles, refs) - np.interp(-xv, -quantiles[::-1], -refs[::-1]))
    p = np.where(xv <= quantiles[0], 0.0, p)
    p = np.where(xv >= quantiles[-1], 1.0, p)
    p = np.clip(p, BOUNDS_THRESHOLD, 1 - BOUNDS_THRESHOLD)
    out[ok] = _inv_normal(p)
    return out


def _normal_udf(q: np.ndarray, r: np.ndarray):
    @F.pandas_udf(T.DoubleType())
    def to_normal(s: pd.Series) -> pd.Series:
        return pd.Series(quantile_to_normal(s.to_numpy(dtype=float, na_value=np.nan), q, r))
    return to_normal


class QuantileNormalizer(Estimator, _StateParams, DefaultParamsReadable, DefaultParamsWritable):
    """Exact quantiles at ``nQuantiles`` evenly spaced levels (value counts
    and prefix sums); transform maps values to a standard normal."""

    nQuantiles = Param(Params._dummy(), "nQuantiles", "number of knots", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCols: list[str] | None = None, nQuantiles: int = 1000):
        super().__init__()
        self._setDefault(nQuantiles=1000)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "QuantileNormalizerModel":
        nq = self.getOrDefault(self.nQuantiles)
        levels = [i / (nq - 1) for i in range(nq)]
        found = exact_quantiles(df, {c: levels for c in self.getInputCols()})
        state = {c: {"quantiles": found[c], "refs": levels} for c in self.getInputCols()}
        m = QuantileNormalizerModel()
        m._set(inputCols=self.getInputCols(), state=json.dumps(state))
        return self._copyValues(m)


class QuantileNormalizerModel(Model, _StateParams, DefaultParamsReadable, DefaultParamsWritable):
    nQuantiles = QuantileNormalizer.nQuantiles

    def output_cols(self) -> list[str]:
        return [f"{c}_quantile" for c in self.getInputCols()]

    def _transform(self, df: DataFrame) -> DataFrame:
        st = self._state()
        out = df
        for c in self.getInputCols():
            q = np.asarray(st[c]["quantiles"], dtype=float)
            r = np.asarray(st[c]["refs"], dtype=float)

            out = out.withColumn(f"{c}_quantile", _normal_udf(q, r)(F.col(c).cast("double")))
        return out


# ---- F5 z-score ------------------------------------------------------------------

class PopulationScaler(Estimator, _StateParams, DefaultParamsReadable, DefaultParamsWritable):
    """Mean / population std per column in one aggregation."""

    @keyword_only
    def __init__(self, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "PopulationScalerModel":
        cols = self.getInputCols()
        aggs = []
        for c in cols:
            aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{c}"),
                     F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}")]
        r = df.agg(*aggs).first()
        state = {c: {"mean": r[f"m_{c}"], "std": r[f"s_{c}"]} for c in cols}
        m = PopulationScalerModel()
        m._set(inputCols=cols, state=json.dumps(state))
        return self._copyValues(m)


class PopulationScalerModel(Model, _StateParams, DefaultParamsReadable, DefaultParamsWritable):
    def output_cols(self) -> list[str]:
        return [f"{c}_scaled" for c in self.getInputCols()]

    def _transform(self, df: DataFrame) -> DataFrame:
        st = self._state()
        out = df
        for c in self.getInputCols():
            s = st[c]
            out = out.withColumn(f"{c}_scaled", (F.col(c) - s["mean"]) / (s["std"] if s["std"] else 1.0))
        return out


def zscore_expr(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F5 as a single lazy plan: the one-row mean/std frame is broadcast."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"_m_{c}"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"_s_{c}")]
    st = df.agg(*aggs)
    j = df.crossJoin(F.broadcast(st))  # one-row frame
    return j.select(*df.columns, *[((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(f"{c}_scaled")
                                   for c in cols])


# ---- F6 one-hot (drop first, unknown -> zeros) --------------------------------

def one_hot_stages(cols: Sequence[str]) -> list:
    """StringIndexer (alphabet descending, unknown kept at index n) ->
    clamp unknown onto the last index -> OneHotEncoder(dropLast): the
    alphabetically first category and unknown values both encode as zeros."""
    stages = []
    for c in cols:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_idx", stringOrderType="alphabetDesc",
                                    handleInvalid="keep"))
        stages.append(ClampIndex(inputCol=f"{c}_idx", labelsFrom=f"{c}_idx"))
        stages.append(OneHotEncoder(inputCol=f"{c}_idx", outputCol=f"{c}_ohe", dropLast=True,
                                    handleInvalid="error"))
    return stages


class ClampIndex(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Map the StringIndexer's 'unknown' index n onto n-1 (read from the
    column metadata), so unknown rows get the dropped slot."""

    inputCol = Param(Params._dummy(), "inputCol", "index column", typeConverter=TypeConverters.toString)
    labelsFrom = Param(Params._dummy(), "labelsFrom", "column with label metadata",
                       typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCol: str | None = None, labelsFrom: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        c = self.getOrDefault(self.inputCol)
        meta = json.loads(json.dumps(df.schema[c].metadata))
        attr = meta.get("ml_attr", {})
        vals = list(attr.get("vals", []))
        if vals and vals[-1] == "__unknown":
            vals = vals[:-1]
            attr["vals"] = vals
        n = len(vals)
        return df.withColumn(c, F.least(F.col(c), F.lit(float(max(n - 1, 0)))).alias(c, metadata=meta))


def one_hot_slots(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F6 long form: for each category its slot in the encoded vector
    (null for the dropped first category).  Categories are bounded by the
    column's cardinality."""
    parts = []
    for c in cols:
        d = df.where(F.col(c).isNotNull()).select(F.lit(c).alias("feature"), F.col(c).alias("category")).distinct()
        parts.append(d)
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    from pyspark.sql import Window
    w = Window.partitionBy("feature").orderBy("category")
    r = F.row_number().over(w) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy("feature"))
    return u.select("feature", "category", F.when(r == 0, F.lit(None)).otherwise(n - 1 - r)
                    .cast("int").alias("slot"))


# ---- F7 dummies ------------------------------------------------------------------

def dummies(df: DataFrame, cols: Sequence[str], max_categories: int = 1000) -> DataFrame:
    """``get_dummies(drop_first=True)``: one 0/1 column per sorted category
    after the first.  The result has a column per category, so a column with
    more than ``max_categories`` raises (categories are then better one-hot
    encoded into a vector)."""
    out_cols = [c for c in df.columns if c not in cols]
    extra = []
    found = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])).alias("x")).select("x.*")
    # one pass for all columns; at most one row beyond the bound per column
    seen = found.where("v is not null").distinct().limit(len(cols) * (max_categories + 1)).collect()
    for c in cols:
        cats = sorted(r["v"] for r in seen if r["c"] == c)
        if len(cats) > max_categories:
            raise ValueError(f"{c} has more than {max_categories} categories")
        for v in cats[1:]:
            extra.append((F.col(c) == F.lit(v)).cast("int").alias(f"{c}_{v}"))
    return df.select(*out_cols, *extra)


# ---- F10 transformation comparison ------------------------------------------------

def transform_skew(df: DataFrame, cols: Sequence[str], fitted: bool = False) -> DataFrame:
    """Skewness (population) of each column as is, after sqrt and after
    log1p; with ``fitted`` also after Box-Cox(x + 1) and quantile-normal
    (100 knots).  Long form (feature, transform, skewness)."""
    aggs, names = [], []
    for c in cols:
        x = F.col(c).cast("double")
        for t, e in (("original", x), ("sqrt", F.sqrt(x)), ("log", F.log1p(x))):
            aggs.append(F.skewness(e).alias(f"{c}__{t}"))
            names.append((c, t))
    wide = df.agg(*aggs)
    if fitted:
        bc = BoxCoxStandardizer(inputCols=list(cols), standardize=False, shift=1.0).fit(df)
        qn = QuantileNormalizer(inputCols=list(cols), nQuantiles=100).fit(df)
        t = qn.transform(bc.transform(df))
        extra = t.agg(*[F.skewness(f"{c}_boxcox").alias(f"{c}__boxcox") for c in cols],
                      *[F.skewness(f"{c}_quantile").alias(f"{c}__quantile") for c in cols])
        wide = wide.crossJoin(extra)
        names += [(c, "boxcox") for c in cols] + [(c, "quantile") for c in cols]
    parts = ", ".join(f"'{c}', '{t}', `{c}__{t}`" for c, t in names)
    return wide.selectExpr(f"stack({len(names)}, {parts}) as (feature, transform, skewness)") \
               .select("feature", "transform", F.round("skewness", 6).alias("skewness"))


# ---- F8 the feature pipeline ---------------------------------------------------

def feature_pipeline(numeric: Sequence[str] = tuple(C.NUMERICAL_FEATURES),
                     quantile: Sequence[str] = tuple(C.QUANTILE_FEATURES),
                     boxcox: Sequence[str] = tuple(C.BOXCOX_FEATURES),
                     categorical: Sequence[str] = tuple(C.CATEGORICAL_FEATURES),
                     passthrough: Sequence[str] = tuple(C.BINARY_FEATURES),
                     outliers: Sequence[str] = tuple(C.OUTLIER_FEATURES),
                     n_quantiles: int = 1000, output: str = "features",
                     pca_share: float = C.PCA_VARIANCE) -> Pipeline:
    """Clip -> quantile(km) || boxcox(power, age) || zscore(power, km, age)
    || one-hot(4) || passthrough -> one vector ``assembled`` in the
    reference's order (numeric columns appear more than once on purpose) ->
    the principal components that hold ``pca_share`` of its variance."""
    q = QuantileNormalizer(inputCols=list(quantile), nQuantiles=n_quantiles)
    b = BoxCoxStandardizer(inputCols=list(boxcox))
    z = PopulationScaler(inputCols=list(numeric))
    parts = ([f"{c}_quantile" for c in quantile] + [f"{c}_boxcox" for c in boxcox]
             + [f"{c}_scaled" for c in numeric] + [f"{c}_ohe" for c in categorical] + list(passthrough))
    stages = [OutlierClipper(inputCols=list(outliers)), q, b, z, *one_hot_stages(categorical),
              VectorAssembler(inputCols=parts, outputCol="assembled", handleInvalid="keep"),
              SharePCA(inputCol="assembled", outputCol=output, share=pca_share)]
    return Pipeline(stages=stages)


# ---- F9 PCA keeping a share of variance -----------------------------------------

WIDE = 1000


def _products(basis: np.ndarray | None, d: int):
    """Per task: sums of the rows and of their squares, or (given a basis) the
    product of the rows with their projections on it."""
    def run(batches):
        first, second = np.zeros(d), np.zeros((d, 1 if basis is None else basis.shape[1]))
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            first += x.sum(axis=0)
            second += (x * x).sum(axis=0)[:, None] if basis is None else x.T @ (x @ basis)
            n += len(x)
        rows = pa.array(np.arange(d, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [rows, pa.array(np.full(d, n)), pa.array(first), pa.array(second.tolist(), pa.list_(pa.float64()))],
            ["slot", "n", "first", "second"])
    return run


def _summed(x: DataFrame, basis: np.ndarray | None, d: int, width: int):
    """Products summed over all tasks, a row per slot."""
    parts = x.mapInArrow(_products(basis, d), "slot int, n long, first double, second array<double>")
    rows = parts.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("first").alias("first"), *[
        F.sum(F.col("second")[i]).alias(f"s{i}") for i in range(width)]).orderBy("slot").collect()  # d rows
    return rows[0]["n"], np.array([r["first"] for r in rows]), np.array([[r[f"s{i}"] for i in range(width)] for r in rows])


def leading_components(df: DataFrame, input_col: str, share: float, seed: int = 42, start: int = 32,
                       tolerance: float = 1e-9, most_rounds: int = 60):
    """Mean, variances, loadings (slots x k) and total variance of the first k
    principal components that hold ``share`` of the total, by a randomised range
    finder: a seeded test matrix of ``start`` columns goes through the
    covariance as task-wise products (two narrow matrices, never slots x slots),
    is orthogonalised, and so on until the variances on its span stand still;
    while they hold less than the share the span is doubled.

    Raises if they do not settle in ``most_rounds`` rounds at one width."""
    x = stored(df.select(vector_to_array(input_col).alias("x")).where("x is not null"), "wide-rows")
    d = len(x.first()["x"])
    n, first, squares = _summed(x, None, d, 1)
    if n < 2:
        raise ValueError("fewer than two rows")
    mean = first / n
    total = float((squares[:, 0] - n * mean * mean).sum() / (n - 1))
    width = min(start, d)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    while True:
        before = np.zeros(width)
        for _ in range(most_rounds):
            _, _, product = _summed(x, basis, d, width)
            product = (product - n * np.outer(mean, mean @ basis)) / (n - 1)
            small = basis.T @ product
            values, turns = np.linalg.eigh((small + small.T) / 2)
            values, turns = np.maximum(values[::-1], 0), turns[:, ::-1]
            held = np.cumsum(values) >= share * total * (1 - 1e-12)
            k = int(np.argmax(held)) + 1 if held.any() else width
            # a span that is too narrow need not settle
            done = width == d or np.abs(values[:k] - before[:k]).max() <= tolerance * max(values[0], 1e-300)
            if done and held.any():
                return mean, values[:k], basis @ turns[:, :k], total
            if not held.any() and (done or np.abs(values - before).max() <= 1e-3 * max(values[0], 1e-300)):
                break
            before, basis = values, np.linalg.qr(product)[0]
        else:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        if width == d:
            return mean, values, basis @ turns, total  # rounding alone keeps them below the share
        wider = min(2 * width, d)
        more = np.random.default_rng([seed, wider]).normal(size=(d, wider - width))
        basis, width = np.linalg.qr(np.hstack([product, more]))[0], wider


class ProjectionModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Centred vectors projected on fitted loadings."""

    inputCol = Param(Params._dummy(), "inputCol", "vector column", typeConverter=TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "kept components", typeConverter=TypeConverters.toString)
    state = _StateParams.state

    @keyword_only
    def __init__(self, inputCol: str = "assembled", outputCol: str = "features"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        fitted = json.loads(self.getOrDefault(self.state))
        shared = df.sparkSession.sparkContext.broadcast((np.array(fitted["mean"]), np.array(fitted["loadings"])))

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def project(x: pd.Series) -> pd.Series:
            mean, loadings = shared.value
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list((np.stack(x.to_numpy()) - mean) @ loadings))
        out = project(vector_to_array(self.getOrDefault(self.inputCol)))
        return df.withColumn(self.getOrDefault(self.outputCol), array_to_vector(out))


class SharePCA(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Centre, fit all components once, keep the first k whose cumulative
    explained variance reaches ``share`` (a slice of the one fit).  The fitted
    model is a persistable ``PipelineModel``.

    Over ``wide`` slots the components come from ``leading_components``, which
    holds nothing of size slots x slots on the driver, and the model ends in a
    ``ProjectionModel``."""

    inputCol = Param(Params._dummy(), "inputCol", "vector column", typeConverter=TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "kept components", typeConverter=TypeConverters.toString)
    share = Param(Params._dummy(), "share", "variance share to keep", typeConverter=TypeConverters.toFloat)
    wide = Param(Params._dummy(), "wide", "slots beyond which only leading components are fitted",
                 typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol: str = "assembled", outputCol: str = "features", share: float = C.PCA_VARIANCE,
                 wide: int = WIDE):
        super().__init__()
        self._setDefault(inputCol="assembled", outputCol="features", share=C.PCA_VARIANCE, wide=WIDE)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PipelineModel:
        src, dst = self.getOrDefault(self.inputCol), self.getOrDefault(self.outputCol)
        d = len(df.select(src).first()[0])
        if d > self.getOrDefault(self.wide):
            mean, variances, loadings, _ = leading_components(df, src, self.getOrDefault(self.share))
            model = ProjectionModel(inputCol=src, outputCol=dst)
            model._set(state=json.dumps({"mean": mean.tolist(), "variances": variances.tolist(),
                                         "loadings": loadings.tolist()}))
            return PipelineModel(stages=[model])
        centre = StandardScaler(inputCol=src, outputCol=f"{dst}_centred", withMean=True, withStd=False).fit(df)
        full = PCA(k=d, inputCol=f"{dst}_centred", outputCol=f"{dst}_all").fit(centre.transform(df))
        cumulative = np.cumsum(full.explainedVariance.toArray())
        k = min(int(np.searchsorted(cumulative, self.getOrDefault(self.share) - 1e-12)) + 1, d)
        kept = VectorSlicer(inputCol=f"{dst}_all", outputCol=dst, indices=list(range(k)))
        return PipelineModel(stages=[centre, full, kept])


def pca_select(df: DataFrame, input_col: str = "assembled", share: float = C.PCA_VARIANCE):
    """(k, fitted PipelineModel producing ``pca`` with k components, variance
    frame) of one fit over all components."""
    model = SharePCA(inputCol=input_col, outputCol="pca", share=share).fit(df)
    return len(model.stages[2].getIndices()), model, variance_frame(df.sparkSession, model)


def variance_frame(spark, model: PipelineModel) -> DataFrame:
    """Explained and cumulative variance share per component."""
    ratios = model.stages[1].explainedVariance.toArray()
    return spark.createDataFrame([(i + 1, float(v), float(c)) for i, (v, c) in enumerate(zip(ratios, np.cumsum(ratios)))],
                                 "component int, ratio double, cumulative double")


def importances_by_column(df: DataFrame, vector_col: str, loadings: np.ndarray, importances: np.ndarray) -> dict[str, float]:
    """Importances of components as shares of the source columns: the slots'
    names come from the vector column's metadata, their suffix names the
    transformation."""
    attrs = json.loads(json.dumps(df.schema[vector_col].metadata))["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a["name"]) for kind in attrs.values() for a in kind)
    source = [re.split(r"_(?:ohe|idx|scaled|boxcox|quantile)(?:_|$)", name)[0] for _, name in slots]
    return source_importances(importances, loadings, source)
