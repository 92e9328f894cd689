"""Registered source/sink queries (S1-S4, S6-S8), the split (F11, F12) and
the evaluation path of the group-mean baseline (M13, A19, SC3, T1)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import evaluation as EV
from ..operators import market
from ..session import shared_path
from ..sources import files, tables
from .common import listings, market as market_df, training
from .oracle import MARKET_SQL, with_listings, with_market, with_training
from .registry import register

LISTING_SCHEMA = T.StructType([
    T.StructField("brand", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("vehicleType", T.StringType()), T.StructField("fuelType", T.StringType()),
    T.StructField("gearbox", T.StringType()), T.StructField("notRepairedDamage", T.StringType()),
    T.StructField("powerPS", T.DoubleType()), T.StructField("kilometer", T.DoubleType()),
    T.StructField("yearOfRegistration", T.IntegerType()),
    T.StructField("monthOfRegistration", T.IntegerType()), T.StructField("price", T.DoubleType()),
])


def _out(spark, sf: str, name: str) -> str:
    import zlib
    return shared_path(spark, "out", f"{name}_{zlib.crc32(sf.encode()):08x}")


@register("scan_listings", with_listings("SELECT * FROM listings"))
def q_scan_listings(spark, sf):
    """The listing view written as CSV (nulls as empty fields), scanned
    back with the explicit schema and the pandas null-token set."""
    path = _out(spark, sf, "listings_csv")
    files.write_csv(listings(spark, sf), path)
    return files.scan_listings_csv(spark, path, LISTING_SCHEMA)


_STORED_SQL = """
SELECT brand, model, vehicleType AS vehicle_type, fuelType AS fuel_type, CAST(powerPS AS DOUBLE) AS power_ps,
       CAST(kilometer AS DOUBLE) AS kilometer, CAST(yearOfRegistration AS INT) AS year_of_registration,
       gearbox, notRepairedDamage AS not_repaired_damage, CAST(price AS DECIMAL(12,2)) AS price
FROM market"""


def _stored(spark, sf):
    """The stored table: imported once per session, then found non-empty."""
    path = _out(spark, sf, "cars")
    files.import_listings(spark, market_df(spark, sf), path)
    return spark.read.parquet(path)


@register("import_listings", with_market(_STORED_SQL))
def q_import_listings(spark, sf):
    """S4 (+P12-P14): cleaned listings imported into the stored table."""
    return _stored(spark, sf)


@register("db_slice", with_market(f"""
SELECT brand, model, vehicle_type AS vehicleType, fuel_type AS fuelType, power_ps AS powerPS, kilometer,
       year_of_registration AS yearOfRegistration, gearbox, not_repaired_damage AS notRepairedDamage, price
FROM ({_STORED_SQL}) s WHERE year_of_registration >= 1995
ORDER BY brand NULLS FIRST, model NULLS FIRST, vehicleType NULLS FIRST, fuelType NULLS FIRST,
         powerPS NULLS FIRST, kilometer NULLS FIRST, yearOfRegistration NULLS FIRST, gearbox NULLS FIRST,
         notRepairedDamage NULLS FIRST, price NULLS FIRST
LIMIT 1000"""))
def q_db_slice(spark, sf):
    """The dashboard's projection + year filter + LIMIT 1000 (the
    fixture's years end in 2001, so the filter year is 1995)."""
    return market.db_slice(_stored(spark, sf), min_year=1995, n=1000)


@register("save_clean", with_market("SELECT * FROM market"))
def q_save_clean(spark, sf):
    """Cleaned data written once, read back."""
    path = _out(spark, sf, "clean")
    files.save_table(market_df(spark, sf), path)
    return spark.read.parquet(path)


@register("split", with_training("""
SELECT *, 'train' AS part FROM train UNION ALL SELECT *, 'test' AS part FROM test"""))
def q_split(spark, sf):
    train, test = EV.train_test_split(training(spark, sf))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@register("split3", with_training(f"""
SELECT * EXCLUDE (_key),
       CASE WHEN _key < '26666666' THEN 'test' WHEN _key < '4ccccccc' THEN 'validation' ELSE 'train' END AS part
FROM keyed"""))
def q_split3(spark, sf):
    return EV.split3(training(spark, sf))


def _written_split(spark, sf):
    """Both sides, written once per session (a lazy reader of an earlier
    result never sees its files replaced)."""
    base = _out(spark, sf, "split")
    if files.table_is_empty(spark, f"{base}/test"):
        train, test = EV.train_test_split(training(spark, sf))
        files.save_split(train, test, base)
    return base


@register("save_split", with_training("SELECT * FROM train"))
def q_save_split(spark, sf):
    """Both sides written with the target last; returns the train side."""
    base = _written_split(spark, sf)
    return spark.read.parquet(f"{base}/train")


@register("load_split", with_training("""
SELECT 'X_train' AS frame, * EXCLUDE (price), CAST(NULL AS DOUBLE) AS price FROM train
UNION ALL SELECT 'X_test', * EXCLUDE (price), NULL FROM test
UNION ALL SELECT 'y_train', * EXCLUDE (price) REPLACE (NULL AS brand, NULL AS model, NULL AS vehicleType,
  NULL AS fuelType, NULL AS gearbox, NULL AS notRepairedDamage, NULL AS powerPS, NULL AS kilometer, NULL AS age), price FROM train
UNION ALL SELECT 'y_test', * EXCLUDE (price) REPLACE (NULL AS brand, NULL AS model, NULL AS vehicleType,
  NULL AS fuelType, NULL AS gearbox, NULL AS notRepairedDamage, NULL AS powerPS, NULL AS kilometer, NULL AS age), price FROM test"""))
def q_load_split(spark, sf):
    """The four frames of the written split, marked by name."""
    base = _written_split(spark, sf)
    x_train, y_train, x_test, y_test = files.load_split(spark, base)
    out = None
    for name, df in (("X_train", x_train), ("X_test", x_test), ("y_train", y_train), ("y_test", y_test)):
        part = df.withColumn("frame", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


_BASELINE = """
g AS (SELECT brand, model, CAST(sum(CAST(round(price * 100) AS BIGINT)) AS DOUBLE) / (count(*) * CAST(100 AS DOUBLE)) AS gm
      FROM train GROUP BY brand, model),
o AS (SELECT CAST(sum(CAST(round(price * 100) AS BIGINT)) AS DOUBLE) / (count(*) * CAST(100 AS DOUBLE)) AS om FROM train),
pred AS (SELECT t.*, coalesce(g.gm, o.om) AS prediction FROM test t LEFT JOIN g ON t.brand = g.brand AND t.model = g.model
         CROSS JOIN o),
res AS (SELECT brand, model, vehicleType, fuelType, gearbox, notRepairedDamage, powerPS, kilometer, age,
               price AS price_true, prediction AS price_pred, price - prediction AS error,
               abs(price - prediction) AS error_abs FROM pred)"""


def _baseline_predictions(spark, sf):
    train, test = EV.train_test_split(training(spark, sf))
    return EV.predict_group_mean(test, EV.fit_group_mean(train))


@register("residuals", with_training(f"WITH {_BASELINE}\nSELECT * FROM res"))
def q_residuals(spark, sf):
    return EV.residuals(_baseline_predictions(spark, sf))


_METRICS_SQL = """SELECT count(*) AS n, round(avg(abs(price - prediction)), 4) AS mae,
       round(avg((price - prediction) * (price - prediction)), 4) AS mse,
       round(sqrt(avg((price - prediction) * (price - prediction))), 4) AS rmse,
       round(1 - avg((price - prediction) * (price - prediction)) / var_pop(price), 6) AS r2 FROM pred"""


@register("regression_metrics", with_training(f"WITH {_BASELINE}\n{_METRICS_SQL}"))
def q_regression_metrics(spark, sf):
    return EV.regression_metrics(_baseline_predictions(spark, sf))


@register("price_band", with_training(f"""WITH {_BASELINE},
m AS (SELECT avg(abs(price - prediction)) AS mae FROM pred),
b AS (SELECT pred.*, m.mae FROM pred CROSS JOIN m)
SELECT brand, model, vehicleType, fuelType, gearbox, notRepairedDamage, powerPS, kilometer, price, age,
       prediction, round(prediction, 2) AS predicted_price, round(mae, 2) AS error_margin,
       round(greatest(0.0, prediction - mae), 2) AS range_low, round(prediction + mae, 2) AS range_high,
       concat_ws(' - ', CASE WHEN prediction - mae <= 0 THEN '0' ELSE CAST(round(greatest(0.0, prediction - mae), 2) AS VARCHAR) END,
                 CAST(round(prediction + mae, 2) AS VARCHAR)) AS acceptable_range
FROM b"""))
def q_price_band(spark, sf):
    """SC3: band of each held-out prediction, margin = held-out MAE read
    from the metrics table (first row)."""
    pred = _baseline_predictions(spark, sf)
    metrics_path = _out(spark, sf, "metrics")
    m = pred.agg(F.avg(F.abs(F.col("price") - F.col("prediction"))).alias("mae")).first()
    files.save_metrics(spark, m.asDict(), metrics_path)
    metrics = spark.read.parquet(metrics_path)
    joined = EV.with_margin(pred, metrics)
    out = EV.price_band(joined, EV.margin_from_metrics(metrics), "prediction")
    return out.drop("_m_mae")


@register("top_errors", with_training(f"""WITH {_BASELINE}
SELECT * FROM res ORDER BY error_abs DESC, age, brand, error, fuelType, gearbox, kilometer, model,
         notRepairedDamage, powerPS, price_pred, price_true, vehicleType LIMIT 5"""))
def q_top_errors(spark, sf):
    return EV.top_errors(EV.residuals(_baseline_predictions(spark, sf)))
