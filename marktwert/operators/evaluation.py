"""Splits, the group-mean baseline regressor, residuals, metrics, price
bands and the largest errors (F11, F12, M13, A19, SC3, T1).

The split key is ``md5`` over a salt, the seed and the canonical text of all
training columns: deterministic, independent of partitioning (so a lost
executor recomputes the same side), expressible in plain SQL, and spread over
every value combination.  Different salts give independent splits.  Rows with
nulls take part (a null has its own text); rows equal in every column share a
side, so no copy of a training row is held out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import encode as E
from .market import canonical, cents

#: Columns of the split key, as far as the frame has them.
SPLIT_COLUMNS = ["brand", "model", "vehicleType", "fuelType", "gearbox", "notRepairedDamage",
                 "powerPS", "kilometer", "age", C.TARGET]


def split_key(df: DataFrame, seed: int = C.SPLIT_SEED, salt: str = "split",
              columns: Sequence[str] | None = None) -> Column:
    """First eight hex digits of the row's keyed ``md5``."""
    names = [c for c in (columns or SPLIT_COLUMNS) if c in df.columns]
    if not names:
        raise ValueError(f"none of the split columns {list(columns or SPLIT_COLUMNS)} is in the frame")
    parts = [F.coalesce(canonical(df, c), F.lit("\\N")) for c in names]
    return F.substring(F.md5(F.concat_ws("|", F.lit(salt), F.lit(str(seed)), *parts)), 1, 8)


def share_text(share: float) -> str:
    """Hex bound below which a ``share`` of all split keys lies."""
    return f"{int(share * 2 ** 32):08x}"


def train_test_split(df: DataFrame, test_size: float = C.TEST_SIZE,
                     seed: int = C.SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    """test = the ``test_size`` share of the keys."""
    held = split_key(df, seed) < share_text(test_size)
    return df.where(~held), df.where(held)


def split3(df: DataFrame, seed: int = C.SPLIT_SEED, test: float = 0.15, validation: float = 0.15) -> DataFrame:
    """70/15/15 as a ``part`` column (train / validation / test)."""
    key = split_key(df, seed)
    return df.withColumn("part", F.when(key < share_text(test), "test")
                         .when(key < share_text(test + validation), "validation").otherwise("train"))


def with_validation_flag(df: DataFrame, share: float = 0.2, seed: int = C.SPLIT_SEED) -> DataFrame:
    """``is_validation`` for early stopping, independent of the test split."""
    return df.withColumn("is_validation", split_key(df, seed, "validation") < share_text(share))


def with_folds(df: DataFrame, k: int, seed: int = C.SPLIT_SEED) -> DataFrame:
    """Fold column 0..k-1, independent of the test split."""
    number = F.conv(split_key(df, seed, "fold"), 16, 10).cast("bigint")
    return df.withColumn("fold", F.pmod(number, F.lit(k)).cast("int"))


# ---- baseline regressor: mean price of the (brand, model) group ---------------

def fit_group_mean(train: DataFrame, keys: Sequence[str] = ("brand", "model"),
                   target: str = C.TARGET) -> tuple[DataFrame, DataFrame]:
    """Per-group and overall mean prices (exact integer-cent means)."""
    keys = list(keys)
    groups = train.groupBy(*keys).agg(
        (F.sum(cents(target)) / (F.count(F.lit(1)) * F.lit(100.0))).alias("_gm"))
    overall = train.agg((F.sum(cents(target)) / (F.count(F.lit(1)) * F.lit(100.0))).alias("_om"))
    return groups, overall


def predict_group_mean(df: DataFrame, model: tuple[DataFrame, DataFrame],
                       keys: Sequence[str] = ("brand", "model")) -> DataFrame:
    groups, overall = model
    out = df.join(groups, list(keys), "left").crossJoin(F.broadcast(overall))  # one-row frame
    return out.withColumn("prediction", F.coalesce("_gm", "_om")).drop("_gm", "_om")


def residuals(pred: DataFrame, target: str = C.TARGET, prediction: str = "prediction") -> DataFrame:
    """Features + price_true, price_pred, error, error_abs."""
    feats = [c for c in pred.columns if c not in (target, prediction)]
    return pred.select(*feats, F.col(target).alias("price_true"), F.col(prediction).alias("price_pred"),
                       (F.col(target) - F.col(prediction)).alias("error"),
                       F.abs(F.col(target) - F.col(prediction)).alias("error_abs"))


def regression_metrics(pred: DataFrame, label: str = C.TARGET, prediction: str = "prediction") -> DataFrame:
    """One aggregation pass for R2, MAE, MSE, RMSE (+ n)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    stats = pred.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(y - p)).alias("_mae"),
                     F.avg((y - p) * (y - p)).alias("_mse"), F.var_pop(y).alias("_var"))
    return stats.select("n", F.round("_mae", 4).alias("mae"), F.round("_mse", 4).alias("mse"),
                        F.round(F.sqrt("_mse"), 4).alias("rmse"),
                        F.round(1 - F.col("_mse") / F.col("_var"), 6).alias("r2"))


def price_band(pred: DataFrame, margin: Column | float, prediction: str = "prediction") -> DataFrame:
    """SC3: predicted price, margin, range bounds and the ``"lo - hi"`` text."""
    lo, hi, text = E.price_band(prediction, margin)
    m = margin if isinstance(margin, Column) else F.lit(float(margin))
    return pred.select("*", E.round_half_away(prediction, 2).alias("predicted_price"),
                       E.round_half_away(m, 2).alias("error_margin"), lo.alias("range_low"),
                       hi.alias("range_high"), text.alias("acceptable_range"))


def margin_from_metrics(metrics: DataFrame | None, column: str = "mae",
                        default: float = C.DEFAULT_ERROR_MARGIN) -> Column:
    """The held-out MAE from the first metrics row; the default when the
    table or column is missing.  Returns a scalar subquery-free column by
    joining the one-row table."""
    if metrics is None or column not in metrics.columns:
        return F.lit(default)
    return F.coalesce(F.col(f"_m_{column}"), F.lit(default))


def with_margin(pred: DataFrame, metrics: DataFrame | None, column: str = "mae") -> DataFrame:
    if metrics is None or column not in metrics.columns:
        return pred
    one = metrics.limit(1).select(F.col(column).cast("double").alias(f"_m_{column}"))
    return pred.crossJoin(F.broadcast(one))  # one-row frame


def top_errors(res: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` rows with the largest absolute error (ties by all columns)."""
    order = [F.col("error_abs").desc()] + [F.col(c).asc() for c in res.columns if c != "error_abs"]
    return res.orderBy(*order).limit(k)
